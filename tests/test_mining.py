"""Mining over bits against counting every literal set case by case."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from ruleweave.operators import mining


def by_definition(rows, names, most, support, precision, lift):
    literals = [(o, negated) for o in sorted(names) for negated in (False, True)]
    usable = {o for o in names if 0 < sum(r[o] == 2 for r in rows) < len(rows)}
    base = sum(bool(r["label"]) for r in rows) / len(rows)
    found = {}
    for k in range(1, most + 1):
        for body in combinations(literals, k):
            if len({o for o, _ in body}) < k or any(o not in usable for o, _ in body):
                continue
            held = [r for r in rows if all(r[o] == (0 if negated else 2) for o, negated in body)]
            hits = sum(bool(r["label"]) for r in held)
            if len(held) >= support and hits / len(held) >= precision and hits / len(held) - base >= lift:
                found[body] = (len(held), hits)
    return found


@pytest.mark.parametrize(("n", "parts"), [(1, 1), (63, 1), (64, 3), (500, 7)])
def test_counts(spark, n, parts):
    rnd = random.Random(n)
    names = ["d", "b", "a", "c"]
    rows = [{**{o: rnd.choice([0, 1, 2, 2, None]) for o in names}, "label": rnd.choice([True, False, None])} for _ in range(n)]
    rows += rows[: n // 3]  # repeated rows count as often as they occur
    cases = spark.createDataFrame([(i, *(r[o] for o in names), r["label"]) for i, r in enumerate(rows)], "id int, " + ", ".join(f"{o} int" for o in names) + ", label boolean").repartition(parts)
    ranked = mining.candidates(cases, names, "label", most_body=3, support=2, precision=0.4, lift=0.05)
    assert {c.body: (c.support, c.hits) for c in ranked} == by_definition(rows, names, 3, 2, 0.4, 0.05)
    assert [(-c.precision, -c.support, len(c.body)) for c in ranked] == sorted((-c.precision, -c.support, len(c.body)) for c in ranked)


def test_words_hold_each_case_once(spark):
    cases = spark.range(1000).repartition(5)
    words = mining.bit_words(cases, {"even": F.col("id") % 2 == 0, "none": F.lit(None).cast("boolean"), "case": F.lit(True)})
    row = words.agg(*(F.sum(F.bit_count(c)) for c in ("even", "none", "case"))).first()
    assert tuple(row) == (500, 0, 1000) and words.count() <= 1000 // 64 + 6
