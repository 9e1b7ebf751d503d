"""Waiting cases over several runs of a stream against a plain walk through the messages."""

import random

from pyspark.sql import functions as F

from ruleweave.sources.tables import scratch
from ruleweave.streaming.waiting import MESSAGES, audit_queue, audited, next_status, places, start_waiting, waiting


def by_definition(runs):
    """(case, seq, kind, status) of every message, and each case's place."""
    place, early, out = {}, {}, []
    order = lambda m: tuple((x is not None, x) for x in (m[1], m[2], m[5], m[3]))
    for messages in runs:
        for case in {m[0] for m in messages if m[0] is not None}:
            todo = sorted((m for m in messages if m[0] == case), key=order)
            if case not in place:
                asked = next((m for m in todo if m[2] == "asked"), None)
                if asked is None:
                    early.setdefault(case, []).extend(todo)
                    continue
                todo.remove(asked)
                todo = [asked, *sorted(early.pop(case, []), key=order), *todo]
                place[case] = (None, False)
            for _, seq, kind, flag, sampled, _ in todo:
                status, drawn = place[case]
                now = next_status(status, drawn, kind, bool(flag))
                out.append((case, seq, kind, now))
                if now != "refused":
                    place[case] = (now, bool(sampled) and now == "settled" if kind == "asked" else drawn)
    return out, place


def test_waiting_over_restarts(spark):
    rnd = random.Random(5)
    runs = [[(f"c{rnd.randrange(12)}", rnd.randrange(9), rnd.choice(["asked", "settle", "audit"]), rnd.choice([True, False, None]), rnd.random() < 0.7, rnd.choice(["ann", "bob", None])) for _ in range(25)] for _ in range(3)]
    runs[0] += [("c1", None, "asked", None, None, None), (None, 1, "asked", True, True, "ann"), ("c2", 3, "what", True, False, "ann"), ("long", 0, "asked", True, False, "x" * 100_000)]
    source, log, checkpoint = (scratch(spark, k) for k in ("messages", "log", "checkpoint"))
    spark.createDataFrame([], MESSAGES).write.parquet(source)
    for messages in runs:
        spark.createDataFrame(messages, MESSAGES).repartition(3).write.mode("append").parquet(source)
        for _ in range(2):  # a run without news changes nothing
            start_waiting(spark.readStream.schema(MESSAGES).parquet(source), log, checkpoint).awaitTermination()
    want, place = by_definition(runs)
    found = spark.read.parquet(log)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in found.select("case_id", "seq", "kind", "status").collect()), key=key) == sorted(want, key=key)
    assert {r.case_id: (r.status, r.sampled) for r in places(found).collect()} == place
    assert {r.case_id for r in waiting(found).collect()} == {c for c, (s, _) in place.items() if s == "waiting"}
    assert {r.case_id for r in audit_queue(found).collect()} == {c for c, (s, d) in place.items() if s == "settled" and d}
    assert {tuple(r) for r in audited(found).collect()} == {(c, s == "audited_ok") for c, (s, _) in place.items() if s.startswith("audited")}
    ruled = found.where(F.col("status").isin("approved", "rejected", "audited_ok", "audited_wrong"))
    assert ruled.count() == ruled.select("case_id").distinct().count()  # settled once
