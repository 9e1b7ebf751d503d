"""How far apart the sources of a language are in their use of terms, by a heavy-light split.

Terms are lower-cased runs of letters (A-Z and everything beyond ASCII). Each language keeps the V terms that stand in at
least `LEAST_DOCS` of its documents. A group (language, source) and the language as a whole give each kept term

    p = 1 + floor(1000000000 * (count + 5) / (N + 5 * V)),     N = their count of all kept terms,

so terms that a group lacks all have one p, its floor. The divergence of two groups is the sum of |p - p'| over the kept
terms. It is added up from two exact sums of integers:

* Heavy terms, in at least a third of a language's groups, are laid out as dense numpy tiles: a block of terms by two
  blocks of groups. Every group of the blocks has a row in each of their tiles, with or without terms.
* Light terms are never laid out. If a and b were never to share one, the sum would be that of |p_a - floor_b| over the
  terms of a, that of |floor_a - p_b| over those of b, and |floor_a - floor_b| for each of the rest; the first two come
  from the histogram of a group's p by binary search in its prefix sums. For the pairs in the posting list of a light term,
  |p_a - p_b| - |p_a - floor_b| - |floor_a - p_b| + |floor_a - floor_b| is added.

Counts are added up in each task before they are shuffled, by term, so a source with a third of all documents costs no
more there than any other. A tile holds at most `BLOCK` groups twice over and about `TILE_TERMS` terms; posting lists are
shorter than a third of a language's groups. The rows of the pairs are the square of a language's sources, as is the
result.

Cases: null text, lang and source are read as empty; empty texts and a language without kept terms leave their groups in
the result (each pair with the value 0 where V is 0); equal values are ranked by item, by its UTF-8 bytes; repeated
documents count each time; very long texts are counted whole, in slices; empty tables give empty results; other columns
are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, slices, table

LEAST_DOCS = 30
SMOOTH = 5
SCALE = 1_000_000_000
TOP = 50
#: Groups in a block of a tile.
BLOCK = 64
#: Terms in a tile, about.
TILE_TERMS = 256
#: Terms that a task holds before it hands on their counts.
MOST_TERMS = 300_000
#: Pairs of postings whose corrections a task makes at a time.
MOST_PAIRS = 1 << 20

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_COUNTS = "lang string, source string, term string, n long, docs long"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def count_terms(documents: DataFrame) -> DataFrame:
    """lang, source, term, n, docs, several rows a term; the term '' stands for the group itself."""
    read = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    names = [x.split()[0] for x in _COUNTS.split(", ")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict = defaultdict(Counter)
        docs: dict = defaultdict(Counter)

        def rows():
            for (lang, source), found in n.items():
                terms = list(found)
                columns = [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(found.values(), pa.int64()), pa.array([docs[lang, source][t] for t in terms], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        for part in slices(batches):
            for lang, source, text in zip(*(part.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                words, key = terms_of(text), (lang, source)
                n[key].update(words)
                n[key][b""] += 0
                docs[key].update(set(words))
                docs[key][b""] += 1
            if sum(map(len, n.values())) > MOST_TERMS:
                yield from rows()
                n.clear()
                docs.clear()
        yield from rows()

    return read.mapInArrow(count, _COUNTS)


def _share(count: str, total: str) -> F.Column:
    """p of a count, exact for any count below 10^18."""
    return F.expr(f"1 + (cast({count} + {SMOOTH} as decimal(20, 0)) * cast({SCALE} as decimal(10, 0))) div cast({total} + {SMOOTH} * v as decimal(20, 0))")


class Shares:
    """What the terms of each group weigh.

    groups: lang, source, n, v, floor, light (its light terms), light_v (the language's), block, blocks, chunks.
    cells: lang, source, term, p, floor, q, heavy, block, blocks, chunks; a row for each kept term that a group has.
    """

    def __init__(self, documents: DataFrame, least_docs: int = LEAST_DOCS, block: int = BLOCK, tile_terms: int = TILE_TERMS):
        dealt = count_terms(documents).repartition("lang", "term")  # both groupings below find their rows together
        postings = saved(
            dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
            .groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("sources"))
            .where((F.col("docs") >= least_docs) | (F.col("term") == ""))
        )
        every = postings.where("term = ''")
        langs = saved(every.select("lang", F.size("sources").alias("groups")))  # a row for each language
        kept = postings.where("term <> ''").join(langs, "lang").withColumn("heavy", 3 * F.size("sources") >= F.col("groups"))
        totals = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"), F.count_if(~F.col("heavy")).alias("light_v"))
        held = kept.select("lang", "heavy", F.explode("sources").alias("x")).groupBy("lang", F.col("x.source").alias("source"))
        per_group = held.agg(F.sum("x.n").alias("n"), F.count_if(~F.col("heavy")).alias("light"))
        known = every.select("lang", F.explode("sources.source").alias("source")).join(langs, "lang").join(totals, "lang", "left").join(per_group, ["lang", "source"], "left")
        known = known.na.fill(0, ["v", "lang_n", "light_v", "n", "light"])
        blocks, chunks = F.ceil(F.col("groups") / block).cast("int"), F.greatest(F.lit(1), F.ceil((F.col("v") - F.col("light_v")) / tile_terms).cast("int"))
        known = known.withColumn("floor", F.when(F.col("v") == 0, F.lit(0).cast("long")).otherwise(_share("0", "n"))).withColumns({"blocks": blocks, "chunks": chunks})
        self.groups = saved(known.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")))
        of = self.groups.withColumnRenamed("n", "group_n")
        cells = kept.select("lang", "term", "total", "heavy", F.explode("sources").alias("x")).select("lang", "term", "total", "heavy", "x.source", "x.n")
        weighed = cells.join(of, ["lang", "source"]).withColumns({"p": _share("n", "group_n"), "q": _share("total", "lang_n")})
        self.cells = saved(weighed.select("lang", "source", "term", "p", "floor", "q", "heavy", "block", "blocks", "chunks"))


# -- pairs of sources ----------------------------------------------------------------------------------

_TILE = "lang string, x int, y int, chunk int, kind int, block int, source string, term string, p long, n long, v long"
_SUMS = "lang string, a string, b string, value long"


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sum of |left[i] - right[j]| over the columns, for each i and j."""
    out = np.empty((len(left), len(right)), np.int64)
    for i, row in enumerate(left):
        out[i] = np.abs(right - row).sum(axis=1)
    return out


def spread(p: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of n * |p - x| for each x of at."""
    order = np.argsort(p)
    p, n = p[order], n[order]
    number, weight = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(n * p)]
    k = np.searchsorted(p, at, "right")
    return at * (2 * number[k] - number[-1]) + weight[-1] - 2 * weight[k]


def _tile(key: tuple, rows: pa.Table) -> pa.Table:
    """The partial sums of all pairs of groups of a tile.

    Chunk 0 counts each term, other than the light ones of either group, with the distance of the floors; tiles replace
    that by the true distance for the terms they hold. So heavy terms that neither block has need no tile.
    """
    lang, x, y, chunk = (k.as_py() for k in key)
    kind, block, p, n = (rows.column(c).to_numpy() for c in ("kind", "block", "p", "n"))
    source = rows.column("source")
    names = sorted(source.filter(pa.array(kind == 0)).to_pylist())
    place = {s: i for i, s in enumerate(names)}
    codes = source.combine_chunks().dictionary_encode()
    group = np.array([place[s] for s in codes.dictionary.to_pylist()], np.int64)[codes.indices.to_numpy()]
    heads = kind == 0
    floor, light, side = (np.empty(len(names), np.int64) for _ in range(3))
    floor[group[heads]], light[group[heads]], side[group[heads]] = p[heads], n[heads], block[heads]
    one, two = np.flatnonzero(side == x), np.flatnonzero(side == y)
    total, apart = np.zeros((len(one), len(two)), np.int64), np.abs(floor[one][:, None] - floor[two])
    heavy = kind == 1
    if heavy.any():
        terms = rows.column("term").filter(pa.array(heavy)).combine_chunks().dictionary_encode()
        dense = np.repeat(floor[:, None], len(terms.dictionary), axis=1)
        dense[group[heavy], terms.indices.to_numpy()] = p[heavy]
        total += distances(dense[one], dense[two]) - dense.shape[1] * apart
    bars = kind == 2
    for i, own in enumerate(one):
        mine = bars & (group == own)
        if mine.any():
            total[i] += spread(p[mine], n[mine], floor[two])
    for j, own in enumerate(two):
        mine = bars & (group == own)
        if mine.any():
            total[:, j] += spread(p[mine], n[mine], floor[one])
    if chunk == 0:
        total += (rows.column("v").to_numpy()[heads][0] - light[one][:, None] - light[two]) * apart
    i, j = np.nonzero(one[:, None] < two) if x == y else np.indices(total.shape).reshape(2, -1)
    a, b, value = np.minimum(one[i], two[j]), np.maximum(one[i], two[j]), total[i, j]  # names are sorted
    of = pa.array(names, pa.string())
    return pa.table([pa.array([lang] * len(a), pa.string()), of.take(pa.array(a)), of.take(pa.array(b)), pa.array(value)], names=["lang", "a", "b", "value"])


def tile_sums(shares: Shares) -> DataFrame:
    """lang, a, b, value: the sums over heavy terms and those over light terms as if no two groups shared one."""
    x, y = F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y")
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    none = F.lit(None).cast("string")

    def placed(df: DataFrame, chunk: F.Column, kind: int, term: F.Column, n: F.Column, v: F.Column) -> DataFrame:
        found = df.select("*", chunk.alias("chunk")).select("*", others)
        return found.select("lang", x, y, "chunk", F.lit(kind).alias("kind"), "block", "source", term.alias("term"), "p", n.cast("long").alias("n"), v.cast("long").alias("v"))

    heads = placed(shares.groups.withColumnRenamed("floor", "p"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)), 0, none, F.col("light"), F.col("v"))
    heavy = placed(shares.cells.where("heavy"), F.pmod(F.xxhash64("term"), "chunks").cast("int"), 1, F.col("term"), F.lit(1), F.lit(0))
    bars = shares.cells.where("not heavy").groupBy("lang", "source", "block", "blocks", "chunks", "p").agg(F.count("*").alias("n"))
    light = placed(bars, F.pmod(F.xxhash64("p"), "chunks").cast("int"), 2, none, F.col("n"), F.lit(0))
    return heads.unionByName(heavy).unionByName(light).groupBy("lang", "x", "y", "chunk").applyInArrow(_tile, _SUMS)


def corrections(group: np.ndarray, p: np.ndarray, floor: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """low group, high group, sum of corrections for the pairs that share a posting list; list k lies from starts[k] to starts[k + 1].

    Lists of one length are taken together, and of these the pairs at one distance within the list.
    """
    sizes = np.diff(starts)
    keys, sums = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    held, most = 0, int(group.max(initial=0)) + 1

    def summed() -> None:
        key, value = np.concatenate(keys), np.concatenate(sums)
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        keys[:], sums[:] = [key[first]], [np.add.reduceat(value, first) if len(first) else value]

    for size in np.unique(sizes[sizes > 1]):
        at = starts[:-1][sizes == size][:, None] + np.arange(size)
        g, own, low = group[at], p[at], floor[at]
        for apart in range(1, size):
            a, b, pa_, pb, fa, fb = g[:, :-apart], g[:, apart:], own[:, :-apart], own[:, apart:], low[:, :-apart], low[:, apart:]
            value = np.abs(pa_ - pb) - np.abs(pa_ - fb) - np.abs(fa - pb) + np.abs(fa - fb)
            keys.append((np.minimum(a, b) * most + np.maximum(a, b)).ravel())
            sums.append(value.ravel())
            held += value.size
            if held > MOST_PAIRS:
                summed()
                held = 0
    summed()
    return keys[0] // most, keys[0] % most, sums[0]


def posting_sums(shares: Shares) -> DataFrame:
    """lang, a, b, value: what has to be added for the light terms that two groups share."""
    lists = shares.cells.where("not heavy").groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "floor")).alias("x")).where("size(x) > 1").select("lang", "x")

    def correct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("x")
            starts = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.flatten()
            langs = np.array(batch.column("lang").to_pylist(), object)[np.repeat(np.arange(len(lists)), np.diff(starts))]
            pairs = list(zip(langs, flat.field("source").to_pylist(), strict=True))
            names = sorted(set(pairs))
            place = {s: i for i, s in enumerate(names)}
            a, b, value = corrections(np.fromiter(map(place.__getitem__, pairs), np.int64, len(pairs)), flat.field("p").to_numpy(), flat.field("floor").to_numpy(), starts - starts[0])
            columns = [pa.array([names[i][0] for i in a], pa.string()), pa.array([names[i][1] for i in a], pa.string()), pa.array([names[i][1] for i in b], pa.string()), pa.array(value, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "a", "b", "value"])

    return lists.mapInArrow(correct, _SUMS)


def source_pairs(shares: Shares) -> DataFrame:
    """lang, source, item, value for each ordered pair of a language's sources."""
    sums = tile_sums(shares).unionByName(posting_sums(shares)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x")
    return sums.select("lang", both, "value").select("lang", "x.source", "x.item", "value")


def marked_terms(shares: Shares) -> DataFrame:
    """lang, source, item, value for each kept term that a group uses more than its language does."""
    return shares.cells.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))


def audit(documents: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK, tile_terms: int = TILE_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: every pair of sources, and the `top` terms of each group."""
    shares = Shares(documents, least_docs, block, tile_terms)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    pairs = source_pairs(shares).select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank)
    terms = marked_terms(shares).select("lang", "source", F.lit("term").alias("part"), "item", "value", rank).where(F.col("rank") <= top)  # cut before it is shuffled
    return pairs.unionByName(terms)


OP11_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
g AS (SELECT d.lang, d.source, coalesce(any_value(x.n), 0) AS n FROM d LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) x USING (lang, source) GROUP BY ALL),
p AS (
    SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS own,
           1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)::HUGEINT) // (g.n + 5 * v.v)::HUGEINT AS p,
           1 + (1000000000::HUGEINT * (kept.n + 5)::HUGEINT) // (v.n + 5 * v.v)::HUGEINT AS q
    FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sums.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE own > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))
