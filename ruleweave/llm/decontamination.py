"""Benchmark decontamination by a prefix-filtered set join.

A window is 13 consecutive words of a benchmark item (all its words, if it has fewer). Exact containment means that
every word of a window has to match, so the necessary prefix of a window, with its words ordered by rarity in the
corpus, is its single rarest word. A document's word is joined with the windows of that prefix word; the word's place
in the window (positional bound) and the window's length (length bound) fix where the window would start and end; the
words between are then compared exactly.

Documents are never shuffled: the benchmark is the stated query set. It is read in blocks of at most
`block_bytes` of text; each block's index is broadcast and all documents pass it. A benchmark that fits one block, the
usual case, takes one counting pass and one matching pass over the documents. A document with a common word costs
at most one exact comparison per (place, length) of that word, 13 * 13 at most, whatever the number of windows.

Cases: null and empty texts have no words; items without words or without an id have no window; an item id that
stands in several rows counts once; repeated documents are judged each on its own; empty tables give empty results, and
without items nothing is hit; other columns are not read; a very long text is matched whole.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, slices, table

WINDOW = 13
#: The text of the items in one broadcast block.
BLOCK_BYTES = 16 << 20

_WORD = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD else 0x20) for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words (runs of 0-9, a-z and everything beyond ASCII) as UTF-8."""
    return text.encode().translate(_FOLD).split() if text else []


def windows_of(words: list[bytes], window: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


def build_index(items: list[tuple], counts: dict[bytes, int], window: int = WINDOW) -> tuple[dict, dict]:
    """windows: words -> item ids; prefix: rarest word -> (place, length) pairs of the windows it stands for."""
    windows: dict[tuple, set] = {}
    prefix: dict[bytes, set] = {}
    for item_id, text in items:
        for w in windows_of(words_of(text), window):
            windows.setdefault(w, set()).add(str(item_id))
    for w in windows:
        place = min(range(len(w)), key=lambda i: (counts.get(w[i], 0), w[i], i))
        prefix.setdefault(w[place], set()).add((place, len(w)))
    return windows, {w: sorted(x) for w, x in prefix.items()}


def match(words: list[bytes], windows: dict, prefix: dict) -> tuple[list[int], set[str]]:
    """Places of hit words, and the items found."""
    items: set[str] = set()
    if prefix.keys().isdisjoint(words):
        return [], items
    n, hit = len(words), set()
    for i, w in enumerate(words):
        for place, length in prefix.get(w, ()):
            start = i - place
            if start >= 0 and start + length <= n and (found := windows.get(tuple(words[start : start + length]))):
                items |= found
                hit.update(range(start, start + length))
    return sorted(hit), items


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    items = benchmark.where("item_id is not null and text is not null").select("item_id", F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) for b in range(n)] if n > 1 else [items]


def _counts(documents: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """How often each benchmark word occurs in all documents."""
    known = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for part in slices(batches):
            for text in part.column("text").to_pylist():
                found.update(filter(known.value.__contains__, words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    counted = documents.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in counted.collect()}  # at most the vocabulary of one block


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, key: str = "doc_id") -> DataFrame:
    """The key column, n_words, hits (places of hit words), items (ids of items found) for every document."""
    spark = documents.sparkSession
    docs = documents.select(key, F.col("text").cast("string").alias("text"))
    blocks = _blocks(benchmark, block_bytes)
    many = len(blocks) > 1
    if many:
        docs = docs.withColumn("row", F.monotonically_increasing_id())
    out = None
    for block in blocks:
        items = [(r.item_id, r.text) for r in block.collect()]  # bounded by block_bytes
        counts = _counts(docs, {w for _, t in items for w in words_of(t)}) if items else {}
        index = spark.sparkContext.broadcast(build_index(items, counts, window))

        def make(index=index):
            windows, prefix = index.value

            def judge(texts):
                words = list(map(words_of, texts))
                found = [match(w, windows, prefix) for w in words]
                return {"n_words": list(map(len, words)), "hits": [hit for hit, _ in found], "items": [sorted(items) for _, items in found]}

            return judge

        part = map_texts(docs, make, "n_words long, hits array<int>, items array<string>")
        out = part if out is None else out.unionByName(part)
    if many:
        merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)  # noqa: E731  as many lists as blocks
        out = out.groupBy("row", key).agg(F.max("n_words").alias("n_words"), merged("hits"), merged("items")).drop("row")
    return out


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return digest(found)


def digest(found: DataFrame) -> DataFrame:
    n_hit = F.size("hits").cast("long")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


#: Every window of every text as a row: for small tables.
OP2_SQL = r"""with low as (select doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
d as (select doc_id, coalesce(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w, row_number() over () as r from low),
i as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
v as (select distinct item_id, k, array_to_string(w[a:a + k - 1], ' ') as s from (select item_id, w, least(13, len(w)) as k, unnest(range(1, len(w) - least(13, len(w)) + 2)) as a from i where len(w) > 0)),
x as (select r, k, a, array_to_string(w[a:a + k - 1], ' ') as s from (select r, w, k, unnest(range(1, len(w) - k + 2)) as a from d, (select distinct k from v) where len(w) >= k)),
h as (select r, item_id, x.k, a from x join v on x.k = v.k and x.s = v.s),
c as (select r, count(distinct p) as n_hit from (select r, unnest(range(a, a + k)) as p from (select distinct r, a, k from h)) group by r),
e as (select r, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as items from (select distinct r, item_id from h) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
 coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated from d left join c using (r) left join e using (r)"""


def brute(texts: list[str | None], items: list[tuple]) -> list[tuple]:
    """By definition, for tests: n_words, n_hit, n_items, items_sha256, contaminated."""
    windows = [(w, str(i)) for i, t in items if i is not None for w in windows_of(words_of(t))]
    out = []
    for text in texts:
        words, hit, found = words_of(text), set(), set()
        for w, item in windows:
            for s in range(len(words) - len(w) + 1):
                if tuple(words[s : s + len(w)]) == w:
                    hit.update(range(s, s + len(w)))
                    found.add(item)
        out.append((len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(words)))
    return out
