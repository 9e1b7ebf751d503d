"""Phrases that occur together more often than their parts would, by level-wise passes over the documents.

Texts are lower-cased (A-Z), cut into pieces at . , ; : ! ? and line ends, and the pieces into words at blanks and tabs.
All counts are per language. Pass k counts phrases of k words: first the words, then, by what the pass before found
frequent, only those phrases whose first and last k - 1 words are both frequent. A phrase that is frequent has
only frequent parts, so nothing is lost.

The frequent phrases of a level are broadcast as a bitmap of their hashes, of `MOST_BITS` bits at most (32 MB), built in
Spark by buckets of 32768 bits. It may take a rare phrase for a frequent one, never the reverse; what such a phrase lets
through doesn't reach the least count itself, so counts and result are exact at any size of the level.

A task adds up its phrases before they are shuffled, by language and phrase. Cuts are scored from the level tables by
joins, and ranks come from ranges of the order, so no task holds a language.

Cases: null texts are empty; null languages are `und`, together with those named so; empty texts and pieces have no words;
repeated documents count each time; ties are ranked by the phrase's UTF-8 bytes; a text of any length is counted whole,
in runs that end at piece ends or, in a longer piece, overlap by k - 1 words; empty tables give empty results; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, slices, table

LEAST = 10
LONGEST = 3
TOP = 2000
#: Percent of a phrase's occurrences that have to lie in one longer phrase for it to be dropped.
COVERED = 50
#: Bytes of text whose words are looked up at a time.
RUN_BYTES = 2 << 20
#: Distinct words, their bytes, and distinct phrases that a task holds before it hands on its counts.
MOST_WORDS = 1 << 19
MOST_WORD_BYTES = 64 << 20
MOST_PHRASES = 1 << 21
LEAST_BITS, MOST_BITS = 1 << 18, 1 << 28
_BUCKET = 1 << 15

#: Blanks and tabs part words; a point stands for all that parts pieces, so no word holds one.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b in b" \t" else 0x2E if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
_COUNTS = "lang string, phrase binary, n long"


def runs(text: bytes, k: int, most: int = RUN_BYTES) -> Iterator[bytes]:
    """A folded text in runs of about `most` bytes that hold each phrase of k words once."""
    start, kept = 0, b""
    while len(text) - start > most:
        end = text.rfind(b".", start, start + most)
        inside = end < 0
        if inside:  # within a piece: the next run begins with the last k - 1 words of this one
            end = text.rfind(b" ", start, start + most)
        if end < 0:  # within a word
            ends = [e for e in (text.find(b".", start + most), text.find(b" ", start + most)) if e >= 0]
            end = min(ends, default=len(text) - 1)
            inside = text[end : end + 1] == b" "
        run = kept + text[start : end + 1]
        kept = b" ".join(run.rpartition(b".")[2].split()[-(k - 1) :]) + b" " if inside and k > 1 else b""
        yield run
        start = end + 1
    yield kept + text[start:]


class Bitmap:
    """A set of hashes that may hold more than was put in."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def word_hash(word: bytes, lang: str) -> int:
    return xxhash.xxh64_intdigest(word, seed=xxhash.xxh64_intdigest(lang.encode()))


def joined_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The hash of a phrase, from that of all its words but the last and that of the last."""
    x = (first * np.uint64(0x9E3779B97F4A7C15)) ^ second
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class _Numbered(dict):
    """Numbers a word when it is first looked up."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


class Counts:
    """Occurrences of the phrases of k words of a language; `known` holds the frequent phrases of k - 1 words."""

    def __init__(self, lang: str, k: int, known: Bitmap | None):
        self.lang, self.k, self.known = lang, k, known
        self.clear()

    def clear(self) -> None:
        self.words = _Numbered({b".": 0})
        self.hashes = np.zeros(1, np.uint64)
        self.codes, self.numbers = [np.empty((0, self.k), np.int32)], [np.empty(0, np.int64)]
        self.held = self.bytes = self.total = 0

    def full(self) -> bool:
        return len(self.words) > MOST_WORDS or self.bytes > MOST_WORD_BYTES or self.held > MOST_PHRASES

    def add(self, run: bytes) -> None:
        """Count a folded run."""
        tokens = run.replace(b".", b" . ").split()
        if not tokens:
            return
        before = len(self.words)
        ids = np.fromiter(map(self.words.__getitem__, tokens), np.int64, len(tokens))
        fresh = list(self.words)[before:] if len(self.words) > before else []
        self.bytes += sum(map(len, fresh))
        if self.k == 1:
            found = np.bincount(ids)
            at = np.flatnonzero(found)
            at = at[at > 0]
            self.total += int(found[at].sum())
            self._keep(at[:, None].astype(np.int32), found[at])
            return
        self.hashes = np.r_[self.hashes, np.array([word_hash(w, self.lang) for w in fresh], np.uint64)]
        h = self.hashes[ids]
        phrase, good = h, ids > 0
        for width in range(2, self.k):
            n = len(ids) - width + 1
            if n < 1:
                return
            phrase, good = joined_hash(phrase[:n], h[width - 1 :]), good[:n] & (ids[width - 1 :] > 0)
        good = good & self.known.has(phrase)  # now of k - 1 words each
        at = np.flatnonzero(good[:-1] & good[1:])
        if len(at):
            self._keep(*_distinct([ids[at + i] for i in range(self.k)]))

    def _keep(self, codes: np.ndarray, numbers: np.ndarray) -> None:
        self.codes.append(codes)
        self.numbers.append(numbers)
        self.held += len(codes)
        if self.held > MOST_PHRASES:
            self._sum()

    def _sum(self) -> None:
        codes, numbers = np.concatenate(self.codes), np.concatenate(self.numbers)
        if len(codes):
            codes, numbers = _distinct(list(codes.T.astype(np.int64)), numbers)
        self.codes, self.numbers, self.held = [codes], [numbers], len(codes)

    def rows(self) -> Iterator[pa.RecordBatch]:
        self._sum()
        words, codes, numbers = pa.array(list(self.words), pa.binary()), self.codes[0], self.numbers[0]
        step = 1 << 16
        for i in range(0, len(codes), step):
            parts = [words.take(pa.array(c)) for c in codes[i : i + step].T]
            phrases = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())) if self.k > 1 else parts[0]
            yield pa.RecordBatch.from_arrays([pa.array([self.lang] * len(phrases)), phrases, pa.array(numbers[i : i + step])], names=["lang", "phrase", "n"])
        if self.total:  # the row of an empty phrase holds the number of words
            yield pa.RecordBatch.from_arrays([pa.array([self.lang]), pa.array([b""], pa.binary()), pa.array([self.total], pa.int64())], names=["lang", "phrase", "n"])


def _distinct(columns: list[np.ndarray], numbers: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of ids and their counts, or the sums of their numbers."""
    bits = [int(c.max()).bit_length() for c in columns]
    code = columns[0].astype(np.int64)
    if sum(bits) > 63:  # more words in a run than three fit a number: number pairs first
        for c in columns[1:]:
            code = np.unique(code, return_inverse=True)[1] << 31 | c
    else:
        for c, b in zip(columns[1:], bits[1:], strict=True):
            code = code << b | c
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    count = np.diff(np.r_[first, len(code)]) if numbers is None else np.add.reduceat(numbers[order], first)
    return np.stack([c[order[first]] for c in columns], axis=1).astype(np.int32), count


def count_phrases(documents: DataFrame, k: int, known: Bitmap | None) -> DataFrame:
    """lang, phrase, n over all documents, each pair once."""
    read = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))
    shared = read.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang: dict[str, Counts] = {}
        for part in slices(batches, most=RUN_BYTES):
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                if text:
                    texts.setdefault(lang, []).append(text.translate(_FOLD))
            for lang, found in texts.items():
                counts = by_lang.setdefault(lang, Counts(lang, k, shared.value))
                for run in runs(b".".join(found), k):
                    counts.add(run)
                    if counts.full():
                        yield from counts.rows()
                        counts.clear()
        for counts in by_lang.values():
            yield from counts.rows()

    dealt = read.mapInArrow(count, _COUNTS).select("lang", F.col("phrase").cast("string").alias("phrase"), "n").repartition("lang", "phrase")
    return dealt.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def bitmap_of(phrases: DataFrame, most_bits: int = MOST_BITS) -> Bitmap:
    """The bitmap of a table's phrases: 32 bits for each, but most_bits at most."""
    bits = min(most_bits, max(LEAST_BITS, 1 << (32 * phrases.count()).bit_length()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.empty(batch.num_rows, np.int64)
            for i, (lang, phrase) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True)):
                words = np.array([word_hash(w, lang) for w in phrase.split(b" ")], np.uint64)
                found = words[:1]
                for j in range(1, len(words)):
                    found = joined_hash(found, words[j : j + 1])
                at[i] = int(found[0]) & (bits - 1)
            yield pa.RecordBatch.from_arrays([pa.array(at)], names=["at"])

    placed = phrases.select("lang", F.col("phrase").cast("binary").alias("phrase")).mapInArrow(place, "at long")
    buckets = placed.groupBy(F.expr(f"at div {_BUCKET}").alias("bucket")).agg(F.bitmap_construct_agg(F.col("at") % _BUCKET).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for row in buckets.toLocalIterator():  # bits / 32768 rows of 4096 bytes
        out[row.bucket * _BUCKET // 8 : (row.bucket + 1) * _BUCKET // 8] = np.frombuffer(row.bits, np.uint8)
    return Bitmap(out)


def levels(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, most_bits: int = MOST_BITS) -> tuple[list[DataFrame], DataFrame]:
    """Tables lang, phrase, n of the frequent phrases of 1, 2, ... words; and lang, n of all words."""
    found = saved(count_phrases(documents, 1, None).where((F.col("n") >= least) | (F.col("phrase") == "")))
    totals = found.where("phrase = ''").select("lang", "n")
    out = [found.where("phrase <> ''")]
    for k in range(2, longest + 1):
        known = bitmap_of(out[-1], most_bits)
        out.append(saved(count_phrases(documents, k, known).where(F.col("n") >= least)))
    return out, totals


def scored(tables: list[DataFrame]) -> DataFrame:
    """lang, phrase, a, l, r, score of every frequent phrase of two words or more: its lowest cut, of equal ones the first."""
    counts = tables[0]
    for more in tables[1:]:
        counts = counts.unionByName(more)
    long = tables[1]
    for more in tables[2:]:
        long = long.unionByName(more)
    words = F.split("phrase", " ")
    cut = long.select("lang", "phrase", F.col("n").alias("a"), words.alias("w")).select("*", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    parts = cut.select("lang", "phrase", "a", "k", F.array_join(F.expr("slice(w, 1, k)"), " ").alias("first"), F.array_join(F.expr("slice(w, k + 1, size(w) - k)"), " ").alias("rest"))
    of = lambda part, name: counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(name))
    both = parts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    score = F.expr("(cast(a as decimal(15, 0)) * cast(a as decimal(15, 0)) * cast(1000000 as decimal(7, 0))) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))")
    return both.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r", "a")).alias("x")).select("lang", "phrase", "x.a", "x.l", "x.r", "x.score")


def uncovered(found: DataFrame, covered: int = COVERED) -> DataFrame:
    """The phrases that no longer one holds at `covered` percent of their occurrences or more."""
    words = F.split("phrase", " ")
    long = found.select("lang", words.alias("w"), F.col("a").alias("n")).where("size(w) > 2")
    spans = "flatten(transform(sequence(2, size(w) - 1), k -> transform(sequence(1, size(w) - k + 1), i -> array_join(slice(w, i, k), ' '))))"
    held = long.select("lang", F.explode(F.expr(spans)).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    return found.join(held, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < covered * F.col("a"), F.lit(True))).drop("longer")


def first_of_each(df: DataFrame, group: str, order: list, top: int) -> DataFrame:
    """The first rows of each group with their rank; rows are dealt by ranges of the order, whose sizes say where each range begins."""
    dealt = saved(df.repartitionByRange(group, *order).withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sizes = dealt.groupBy(group, "part").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).where(F.col("before") < top)
    inside = F.row_number().over(Window.partitionBy(group, "part").orderBy(*order))
    return dealt.join(sizes.drop("count"), [group, "part"]).withColumn("rank", F.col("before") + inside).where(F.col("rank") <= top).drop("part", "before")


def mine(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, covered: int = COVERED, top: int = TOP, most_bits: int = MOST_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    tables, totals = levels(documents, least, longest, most_bits)
    kept = uncovered(saved(scored(tables)), covered)
    ranked = first_of_each(kept, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
p AS (SELECT lang, row_number() OVER () AS pid, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
words AS (SELECT lang, pid, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM p),
t AS (SELECT lang, x, lead(x) OVER piece AS y, lead(x, 2) OVER piece AS z FROM words WINDOW piece AS (PARTITION BY pid ORDER BY i)),
f AS (
    SELECT lang, x AS phrase, 1 AS k, count(*) AS n FROM t GROUP BY ALL
    UNION ALL SELECT lang, x || ' ' || y, 2, count(*) FROM t WHERE y IS NOT NULL GROUP BY ALL
    UNION ALL SELECT lang, x || ' ' || y || ' ' || z, 3, count(*) FROM t WHERE z IS NOT NULL GROUP BY ALL),
total AS (SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, k, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 10),
cuts AS (
    SELECT lang, phrase, k, a, 1 AS cut, w[1] AS first, array_to_string(w[2:], ' ') AS rest FROM c
    UNION ALL SELECT lang, phrase, k, a, 2, w[1] || ' ' || w[2], w[3] FROM c WHERE k = 3),
s AS (
    SELECT cuts.*, l.n AS l, r.n AS r, (1000000::HUGEINT * a::HUGEINT * a::HUGEINT) // (l.n::HUGEINT * r.n::HUGEINT) AS score
    FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = first JOIN f r ON r.lang = cuts.lang AND r.phrase = rest),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN longer USING (lang, phrase) WHERE longer.a IS NULL OR 100 * longer.a < 50 * low.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, total.n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))
