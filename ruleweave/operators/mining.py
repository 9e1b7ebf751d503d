"""Level-wise mining of rules from labelled cases held as bits, and what becomes of the candidates."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweave.plans.rules import Atom, Literal, Rule, Var, canonical_key
from ruleweave.sources.tables import saved

#: The longest body, the least support, precision and gain over the base rate, and the most proposals.
MOST_BODY, SUPPORT, PRECISION, LIFT, MOST_PROPOSALS = 3, 20, 0.70, 0.10, 8


@dataclass(frozen=True)
class Candidate:
    """Literals (observable, negated) that hold together on `support` cases, `hits` of them with the label."""

    body: tuple[tuple[str, bool], ...]
    support: int
    hits: int

    @property
    def precision(self) -> float:
        return self.hits / self.support

    def __str__(self) -> str:
        return ", ".join(f"not {o}" if negated else o for o, negated in self.body)

    def holds(self) -> Column:
        return reduce(and_, (F.col(o) == (0 if negated else 2) for o, negated in self.body))

    def rule(self, head: str, rule_id: str = "") -> Rule:
        x = Var("X")
        return Rule(Atom(head, (x,)), tuple(Literal(Atom(o, (x,)), negated) for o, negated in self.body), round(self.precision, 3), rule_id)


def bit_words(cases: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """A row for every 64 cases with a long for each condition, in which a case's bit is set where the condition holds.

    Cases are numbered in the order in which a written table is read, so a task that is run again gives the same words. A word
    lies inside one partition and is combined before the shuffle.
    """
    kept = saved(cases.select(*(F.coalesce(c, F.lit(False)).alias(name) for name, c in conditions.items())))
    bits = kept.withColumn("__n", F.monotonically_increasing_id()).select(F.shiftright("__n", 6).alias("__word"), F.expr("shiftleft(1L, cast(__n & 63 as int))").alias("__bit"), *conditions)
    return bits.groupBy("__word").agg(*(F.bit_or(F.when(F.col(c), F.col("__bit")).otherwise(F.lit(0).cast("long"))).alias(c) for c in conditions)).drop("__word")


def _counted(words: DataFrame, sets: np.ndarray, label: int) -> dict[int, tuple[int, int]]:
    """Cases in which all columns of a set hold, and those of them with the label, for each row of `sets` by its number.

    The sets are as many as the schema allows and travel with the task; a task ANDs the words of 4096 rows at a time, for as many
    sets as fill some 8 MB, and sends on two sums for each set.
    """

    def part(batches):
        sums = np.zeros((len(sets), 2), np.int64)
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns]
            for start in range(0, batch.num_rows, 4096):
                table = np.stack([c[start : start + 4096] for c in columns])
                for first in range(0, len(sets), 256):
                    chosen = sets[first : first + 256]
                    both = table[chosen[:, 0]]
                    for k in range(1, sets.shape[1]):
                        both &= table[chosen[:, k]]
                    sums[first : first + 256, 0] += np.bitwise_count(both).sum(axis=1, dtype=np.int64)
                    sums[first : first + 256, 1] += np.bitwise_count(both & table[label]).sum(axis=1, dtype=np.int64)
        found = np.flatnonzero(sums[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sums[found, 0]), pa.array(sums[found, 1])], ["id", "support", "hits"])

    counts = words.mapInArrow(part, "id long, support long, hits long").groupBy("id").agg(F.sum("support").alias("support"), F.sum("hits").alias("hits"))
    return {r.id: (r.support, r.hits) for r in counts.collect()}  # a row for each set


def candidates(cases: DataFrame, observables: list[str], label: str, most_body: int = MOST_BODY, support: int = SUPPORT, precision: float = PRECISION, lift: float = LIFT) -> list[Candidate]:
    """Literal sets that hold often and predict the label; by precision, then support, then length.

    An observable counts if it is true in some cases but not in all. Unknown observables make neither literal hold, and a null
    label is none. The cases are read once and kept as bits, 64 cases a word; each level is one job over the words that only counts
    extensions of the last level's frequent sets.
    """
    literals = [(o, negated) for o in sorted(observables) for negated in (False, True)]
    conditions = {f"c{i}": F.col(o) == (0 if negated else 2) for i, (o, negated) in enumerate(literals)}
    words = saved(bit_words(cases, conditions | {"label": F.col(label), "case": F.lit(True)}))
    last = len(literals)
    bits = words.agg(*(F.sum(F.bit_count(c)) for c in ("case", "label", *(f"c{i}" for i in range(0, last, 2))))).first()
    total, hit, *true = (n or 0 for n in bits)
    usable = [i for i in range(last) if 0 < true[i // 2] < total]
    level = [(i,) for i in usable]
    found: list[Candidate] = []
    while level and len(level[0]) <= most_body:
        counts = _counted(words, np.array(level), last)
        frequent = [(b, *counts[i]) for i, b in enumerate(level) if i in counts and counts[i][0] >= support]
        made = [Candidate(tuple(literals[i] for i in b), n, hits) for b, n, hits in frequent]
        found += [c for c in made if c.precision >= precision and c.precision - hit / total >= lift]
        level = [(*b, i) for b, *_ in frequent for i in usable if i > b[-1] and i // 2 != b[-1] // 2]
    return sorted(found, key=lambda c: (-c.precision, -c.support, len(c.body)))


def unsubsumed(ranked: list[Candidate]) -> list[Candidate]:
    """Candidates none of whose literal subsets ranks before them."""
    kept: list[Candidate] = []
    for c in ranked:
        if not any(set(k.body) <= set(c.body) for k in kept):
            kept.append(c)
    return kept


def proposals(ranked: list[Candidate], head: str, known: set[str] = frozenset(), most: int = MOST_PROPOSALS) -> list[tuple[Candidate, Rule]]:
    """Rules to propose: unsubsumed, with a premise that must hold, and not known by canonical key."""
    out = []
    for c in unsubsumed(ranked):
        if len(out) < most and not all(negated for _, negated in c.body):
            rule = c.rule(head)
            if canonical_key(rule) not in known:
                out.append((c, rule))
    return out


def examples(cases: DataFrame, key: str, label: str, chosen: list[Candidate], most: int = 5) -> DataFrame:
    """body, key, example: the first `most` cases by key with the label, and without it, on which each body holds."""
    parts = [
        cases.where(c.holds() & (F.col(label) if good else ~F.coalesce(F.col(label), F.lit(False)))).select(F.lit(str(c)).alias("body"), key, F.lit(good).alias("example")).orderBy(key).limit(most)
        for c in chosen
        for good in (True, False)
    ]
    empty = cases.select(F.lit("").alias("body"), key, F.lit(True).alias("example")).limit(0)
    return reduce(DataFrame.unionByName, parts, empty)


def mine(cases: DataFrame, observables: list[str], label: str, pruned: bool = False, **limits) -> DataFrame:
    """body, support, hits, precision, place of the candidates, all or only the unsubsumed ones."""
    ranked = candidates(cases, observables, label, **limits)
    rows = [(str(c), c.support, c.hits, c.precision, i + 1) for i, c in enumerate(unsubsumed(ranked) if pruned else ranked)]
    return cases.sparkSession.createDataFrame(rows, "body string, support long, hits long, precision double, place int")
