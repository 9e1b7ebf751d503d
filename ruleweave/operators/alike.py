"""Cases that are alike but for the names of their constants, so that one of them is evaluated for all.

Rules can't tell constants apart that they don't name. So if a renaming of such constants turns the facts of one case into those
of another, it also turns the results of the one into those of the other. A case's key is its facts with the constants
numbered in an order that the facts alone decide as far as a few rounds of telling them apart go; constants that stay alike are
numbered in any order. Equal keys so always mean alike cases; alike cases may have several keys, which costs work only.

The keys are exact facts under SHA-256. A case with many facts, and all cases if terms of different types meet, stay by themselves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweave.plans.rules import Rule, Var
from ruleweave.sources.tables import by_case, case_parts, saved

#: Facts beyond which a case stays by itself.
MOST_FACTS = 128
#: Kinds up to which they are sent to every task.
MOST_SENT = 100_000
#: Rounds in which constants are told apart by the facts that they stand in.
ROUNDS = 3
_NULL = "\0"
_FAMILY = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "string": "string"}


class Alike:
    """each: member, key, names of every case; kinds: key, case_id, cases: the case that stands for a key, and how many have it.

    names are a case's constants, each after the number of its sort, and those of alike cases correspond by place. goals by signature are
    facts of a case like any other. A case with more than most_open unknown facts stays by itself. cases, if given, are told from those
    that only have facts.
    """

    def __init__(self, rules: Iterable[Rule], relations: dict[str, DataFrame], goals: dict[str, DataFrame] | None = None, cases: DataFrame | None = None, most_open: int | None = None):
        rules = list(rules)
        facts = [(s, r) for s, r in relations.items()]
        facts += [(s, g.withColumn("t", F.lit(2))) for s, g in (goals or {}).items()]
        if cases is not None:
            facts.append(("/0", cases.select("case_id", F.lit(2).alias("t")).distinct()))
        facts = [(s, r.where("case_id is not null")) for s, r in facts]
        self.sorts = _sorts(rules, facts)
        rows = _rows(facts)
        if self.sorts is None:
            numbered = rows.select("case_id", F.lit(True).alias("alone"), F.lit(b"").alias("facts"), F.expr("array()").cast("array<string>").alias("names")).distinct()
        else:
            kept = sorted({str(t) for r in rules for a in (r.head, *(x.atom for x in r.body)) for t in a.terms if not isinstance(t, Var)})
            sorts = [[self.sorts[s, i] for i in range(_arity(s))] for s, _ in facts]
            placed = rows.repartition(case_parts(rows.sparkSession), "case_id").sortWithinPartitions("case_id")
            schema = f"case_id {rows.schema['case_id'].dataType.simpleString()}, alone boolean, facts binary, names array<string>"
            numbered = placed.mapInArrow(_numbered(sorts, kept, len(relations), most_open, MOST_FACTS), schema)
        own = F.concat(F.lit(b"\1"), F.col("case_id").cast("string").cast("binary"))
        key = F.when(F.col("alone"), own).otherwise(F.concat(F.lit(b"\0"), F.unhex(F.sha2("facts", 256))))
        self.each = saved(numbered.select(F.col("case_id").alias("member"), key.alias("key"), "names"))
        kinds = saved(self.each.groupBy("key").agg(F.min("member").alias("member"), F.count("*").alias("cases")))
        n = kinds.count()
        self._sent = F.broadcast if n <= MOST_SENT else lambda df: df
        self.kinds = by_case(kinds.select("key", F.col("member").alias("case_id"), "cases"), 8 * n)

    def one(self, relation: DataFrame) -> DataFrame:
        """The rows of the cases that stand for a kind."""
        return relation.join(self._sent(self.kinds.select("case_id")), "case_id", "left_semi")

    def names(self) -> DataFrame:
        """case_id, names of the cases that stand for a kind."""
        return self.each.join(self._sent(self.kinds.select(F.col("case_id").alias("member"))), "member", "left_semi").select(F.col("member").alias("case_id"), "names")

    def all_of(self, found: DataFrame) -> DataFrame:
        """Rows of the cases that stand for a kind, for each of its cases: case_id, names of the case, and the other columns."""
        of_kind = found.join(self.kinds.select("key", "case_id"), "case_id").drop("case_id")
        return self.each.join(self._sent(of_kind), "key").select(F.col("member").alias("case_id"), "names", *(c for c in found.columns if c != "case_id"))


def _arity(signature: str) -> int:
    return int(signature.rsplit("/", 1)[1])


def _family(value: object) -> str:
    return "string" if isinstance(value, str) else "int" if isinstance(value, int) and not isinstance(value, bool) else type(value).__name__


def _sorts(rules: list[Rule], facts: list[tuple[str, DataFrame]]) -> dict[tuple[str, int], int] | None:
    """A number for each place of a predicate, the same where a variable links them; None if terms meet that aren't all whole numbers or all strings."""
    sort: dict[tuple[str, int], int] = {}
    of = lambda at: sort.setdefault(at, len(sort))
    family: list[tuple[tuple[str, int], str]] = []
    for s, r in facts:
        types = dict(r.dtypes)
        family += [((s, i), _FAMILY.get(types[f"a{i}"], types[f"a{i}"])) for i in range(_arity(s))]
    for at, _ in family:
        of(at)
    for r in rules:
        first: dict[str, tuple[str, int]] = {}
        for a in (r.head, *(x.atom for x in r.body)):
            for i, t in enumerate(a.terms):
                at = (a.signature, i)
                if not isinstance(t, Var):
                    of(at)
                    family.append((at, _family(t)))
                    continue
                old, new = of(at), of(first.setdefault(t.name, at))
                for k in [k for k, v in sort.items() if v == old]:
                    sort[k] = new
    met: dict[int, set[str]] = {}
    for at, name in family:
        met.setdefault(sort[at], set()).add(name)
    return sort if all(len(names) == 1 and names <= {"int", "string"} for names in met.values()) else None


def _rows(facts: list[tuple[str, DataFrame]]) -> DataFrame:
    """case_id, kind, t, p if any relation has it, a0, a1, ...: all facts, terms as text."""
    most, doubted = max(_arity(s) for s, _ in facts), any("p" in r.columns for _, r in facts)
    parts = []
    for i, (s, r) in enumerate(facts):
        p = [F.coalesce(F.col("p").cast("double"), F.lit(1.0)).alias("p")] if "p" in r.columns else [F.lit(1.0).alias("p")] if doubted else []
        terms = [(F.coalesce(F.col(f"a{j}").cast("string"), F.lit(_NULL)) if j < _arity(s) else F.lit(None).cast("string")).alias(f"a{j}") for j in range(most)]
        parts.append(r.select("case_id", F.lit(i).cast("smallint").alias("kind"), F.coalesce(F.col("t").cast("int"), F.lit(3)).cast("tinyint").alias("t"), *p, *terms))
    return reduce(DataFrame.unionByName, parts)


def _numbered(sorts: list[list[int]], kept: list[str], n_relations: int, most_open: int | None, most_facts: int):
    """mapInArrow function over rows in the order of their cases: case_id, alone, the facts with numbered constants, the constants by number."""
    kept = [*kept, _NULL]
    most = max(map(len, sorts))
    sort_of = np.array([[*x, *[0] * (most - len(x))] for x in sorts], np.int64).reshape(len(sorts), most)

    def mixed(x: np.ndarray) -> np.ndarray:
        """64 bits in which each bit hangs on all of those given."""
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def starts_of(ids: pa.Array) -> np.ndarray:
        return np.flatnonzero(np.concatenate([[True], np.asarray(pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)))]))

    def of_cases(batch: pa.RecordBatch) -> pa.RecordBatch:
        first = starts_of(batch.column("case_id"))
        n, count = len(first), batch.num_rows
        case = np.repeat(np.arange(n), np.diff(first, append=count))
        kind, t = (np.asarray(batch.column(c)).astype(np.int64) for c in ("kind", "t"))
        alone = np.bincount(case, minlength=n) > most_facts
        if most_open is not None:
            alone |= np.bincount(case[(t == 1) & (kind < n_relations)], minlength=n) > most_open
        p = np.asarray(batch.column("p")).astype(np.float64) if "p" in batch.schema.names else np.ones(count)
        whole = p.view(np.uint64)
        terms = [batch.column(f"a{j}") for j in range(most)]
        rows_of = [np.flatnonzero(np.asarray(a.is_valid()) & ~alone[case]) for a in terms]
        text = pa.concat_arrays([pa.array([], "string"), *(a.take(pa.array(f)).cast("string") for a, f in zip(terms, rows_of, strict=True))]).dictionary_encode()
        fact = np.concatenate([np.zeros(0, np.int64), *rows_of])
        place = np.repeat(np.arange(most), [len(f) for f in rows_of])
        code, size = np.asarray(text.indices).astype(np.int64), max(1, len(text.dictionary))
        node, of = np.unique((case[fact] * (sort_of.max(initial=0) + 1) + sort_of[kind[fact], place]) * size + code, return_inverse=True)  # a constant of a case
        node_code, node_sort, node_case = node % size, node // size % (sort_of.max(initial=0) + 1), node // size // (sort_of.max(initial=0) + 1)
        rank = np.asarray(pc.index_in(text.dictionary, pa.array(kept, "string")).fill_null(-1)).astype(np.int64)[node_code]
        color = mixed((rank + 1 + (node_sort << 32)).astype(np.uint64))
        base = mixed(mixed((kind * 4 + t + 1).astype(np.uint64)) + whole)
        shift = mixed(place.astype(np.uint64) + np.uint64(1))
        for _ in range(ROUNDS):
            seen, grown = base.copy(), color.copy()
            np.add.at(seen, fact, mixed(color[of] + shift))
            np.add.at(grown, of, mixed(mixed(seen)[fact] ^ shift))
            color = mixed(grown)
        free = np.flatnonzero(rank < 0)
        free = free[np.lexsort((color[free], node[free] // size))]
        starts = np.searchsorted(node_case[free], np.arange(n + 1))
        number = rank.copy()
        number[free] = len(kept) + np.arange(len(free)) - starts[node_case[free]]
        rows = np.zeros((count, 4 + most), np.uint32)  # 0 where a relation has fewer terms
        rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3] = kind, t, whole >> np.uint64(32), whole & np.uint64(0xFFFFFFFF)
        rows[fact, 4 + place] = number[of] + 1
        mark = np.zeros(count, np.uint64)  # an order of a case's rows, whichever, in which equal facts come out alike
        for column in rows.T:
            mark = mixed(mark + column + np.uint64(1))
        rows = rows[np.lexsort((mark, case))].astype("<u4")
        ends = np.append(first, count) * rows.itemsize * rows.shape[1]
        facts = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(rows.tobytes())]).cast(pa.binary())
        names = pc.binary_join_element_wise(pa.array(node_sort[free]).cast("string"), text.dictionary.take(pa.array(node_code[free])), ":")
        made = [batch.column("case_id").take(pa.array(first)), pa.array(alone), facts, pa.ListArray.from_arrays(pa.array(starts, pa.int32()), names)]
        return pa.RecordBatch.from_arrays(made, ["case_id", "alone", "facts", "names"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # a case that may go on in the next batch; of a large one as much as tells that it is
        for batch in batches:
            if batch.num_rows:
                batch = batch if held is None else pa.concat_batches([held, batch])
                last = int(starts_of(batch.column("case_id"))[-1])
                if last:
                    yield of_cases(batch.slice(0, last))
                held = batch.slice(last, most_facts + 1)
        if held is not None:
            yield of_cases(held)

    return run


# -- atoms under the names of a case -----------------------------------------------------------------------


def spelling(signature: str, columns: list[str], sorts: dict[tuple[str, int], int] | None) -> Column:
    """A relation's rows, with the names of their cases, as atoms whose constants are told by their place among the names, if they have one."""
    place = lambda i, c: F.array_position("names", F.concat(F.lit(f"{(sorts or {}).get((signature, i), '')}:"), F.col(c).cast("string")))
    terms = [F.struct(F.col(c).cast("string").alias("text"), place(i, c).alias("at")) for i, c in enumerate(columns)]
    none = F.lit(None).cast("array<struct<text:string,at:bigint>>")
    return F.struct(F.lit(signature.rsplit("/", 1)[0]).alias("predicate"), (F.array(*terms) if terms else none).alias("terms"))


def spelled(atom: Column) -> Column:
    """The atom's text under the names of a case."""
    name = lambda x: F.coalesce(F.regexp_replace(F.get("names", (x["at"] - 1).cast("int")), "^[0-9]*:", ""), x["text"])
    return F.when(atom["terms"].isNull(), atom["predicate"]).otherwise(F.concat(atom["predicate"], F.lit("("), F.array_join(F.transform(atom["terms"], name), ", "), F.lit(")")))
