"""SimHash near-duplicate classes by anchor-point covering.

A fingerprint's 64 bits are two halves of 32. If two fingerprints differ in at most two bits, one of the halves differs
in at most one. On 31 bits of each half the perfect Hamming code is a covering code of radius 1: every value has one
code word, its home anchor, within distance 1. Of two values that differ in at most one bit, the second lies within
1 + 1 = 2 of the first one's home. So each distinct fingerprint goes to all anchors within 2 of either half, 16 or 1
code words per half, and fingerprints are compared per anchor. No link can be missed, and no bucket is capped.

Copies share one fingerprint and are carried as one row with their least doc_id. Inside an anchor the comparison
returns a spanning forest of its links, never all pairs, so a dense group of n costs n - 1 edges. Classes are the
connected components of the forests, found by alternating large-star and small-star steps on Spark.

Cases: null, empty and blank texts have fingerprint zero and are linked like any other; repeated rows keep one row
each; a null doc_id keeps its row and is never the least id unless its class has no other; empty tables give empty
results; other columns pass through one_of_each and are not read otherwise; a very long text is hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, saved, table

THRESHOLD = 2
SHINGLE = 3
SEED = 42
_HALF = np.uint64(0x7FFFFFFF)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    import xxhash

    words = (text or "").encode().lower().split()  # both are ASCII-only on bytes
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(p, seed) for p in parts], dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">u8")[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def make():
        return lambda texts: {"fp": np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)}

    return map_texts(documents.select("doc_id", F.col("text").cast("string").alias("text")), make, "fp long")


# -- the covering code ---------------------------------------------------------------------------


def syndrome(x: np.ndarray) -> np.ndarray:
    """Of 31-bit values: the 1-based place of the bit to flip to reach the code word, 0 for code words."""
    s = np.zeros(len(x), dtype=np.uint64)
    for i in range(31):
        s ^= ((x >> np.uint64(i)) & np.uint64(1)) * np.uint64(i + 1)
    return s.astype(np.int64)


def _pairs() -> np.ndarray:
    """For each syndrome the masks of the 15 two-bit changes that lead to a code word."""
    masks = np.zeros((32, 15), dtype=np.uint64)
    for s in range(1, 32):
        found = [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < (i ^ s)]
        masks[s] = found
    return masks


_MASKS = _pairs()


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into fp, anchor) of all anchors within covering radius 1 plus threshold 1, over both halves."""
    at, keys = [], []
    for half in (0, 1):
        x = (fp >> np.uint64(32 * half)) & _HALF
        tag = np.uint64(half << 32)
        s = syndrome(x)
        home = np.where(s > 0, x ^ (np.uint64(1) << np.maximum(s - 1, 0).astype(np.uint64)), x)
        at.append(np.arange(len(fp)))
        keys.append(home | tag)
        off = np.flatnonzero(s)
        at.append(np.repeat(off, 15))
        keys.append((x[off, None] ^ _MASKS[s[off]]).ravel() | tag)
    return np.concatenate(at), np.concatenate(keys)


def _roots(label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if np.array_equal(up, label):
            return label
        label = up


def _hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the classes of a[i] and b[i]; labels are roots, the least index of a class."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        label = _roots(label)


def _forest(keys: np.ndarray, fp: np.ndarray, threshold: int, block: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links among rows of equal key; rows are sorted by key. Work is done a block of pairs at a time."""
    n = len(keys)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[starts, n])
    ends = np.repeat(starts + size, size)
    later = ends - np.arange(n) - 1  # row i is compared with the rows after it in its group
    label = np.arange(n)
    done = np.r_[0, np.cumsum(later)]
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(done, done[i] + block, "right")) - 1)
        a = np.repeat(np.arange(i, j), later[i:j])
        b = a + 1 + np.arange(len(a)) - np.repeat(done[i:j] - done[i], later[i:j])
        near = np.bitwise_count(fp[a] ^ fp[b]) <= threshold
        label = _hook(label, a[near], b[near])
        i = j
    child = np.flatnonzero(label != np.arange(n))
    return fp[child], fp[label[child]]


def links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Edges (u, v), u < v, that join the same classes as all links among distinct fingerprints (column fp)."""
    if not 0 <= threshold <= 2:
        raise ValueError("the code covers thresholds of 0 to 2 bits")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            at, key = anchors(fp)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp[at].view(np.int64))], names=["anchor", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in _with_end(batches):
            if batch is not None:
                keys = np.r_[keys, batch.column("anchor").to_numpy(zero_copy_only=False)]
                fps = np.r_[fps, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)]
                cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last anchor may go on in the next batch
            else:
                cut = len(keys)
            if cut:
                u, v = _forest(keys[:cut], fps[:cut], threshold)
                u, v = u.view(np.int64), v.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])
                keys, fps = keys[cut:], fps[cut:]

    spread_out = distinct.select("fp").mapInArrow(spread, "anchor long, fp long")
    sorted_by = spread_out.repartition("anchor").sortWithinPartitions("anchor")
    return sorted_by.mapInArrow(compare, "u long, v long").distinct()


def _with_end(batches):
    yield from batches
    yield None


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """node, root (its component's least node) for every node of edges (u, v), by large-star and small-star steps."""
    edges = saved(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct())
    mark = None
    for _ in range(most_rounds):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))  # large-star: later neighbours to the least
        edges = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        least = edges.groupBy("v").agg(F.min("u").alias("m"))  # small-star: earlier neighbours, and v, to the least
        small = edges.join(least, "v").select(F.col("m").alias("u"), F.col("u").alias("v")).where("u <> v")
        edges = saved(small.union(least.select(F.col("m").alias("u"), "v")).distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == mark:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
        mark = now
    raise RuntimeError("components did not settle")


def near_duplicates(documents: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, fp, root (a fingerprint that names the class), component_id (its least doc_id) for every document."""
    fps = saved(fingerprints(documents))
    least = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(least, threshold))
    rooted = least.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    linked = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")
    return fps.join(linked, "fp").select("doc_id", "fp", "root", "component_id")


def one_of_each(documents: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that have the least doc_id of their class: one row a class."""
    found = near_duplicates(documents, threshold)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("fp"))).alias("x"))
    winners = first.select(F.col("x.id").alias("winner"), F.col("x.fp").alias("winner_fp"))

    def make():
        return lambda texts: {"fp": np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)}

    packed = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("doc"), F.col("text").cast("string").alias("text"))
    marked = map_texts(packed, make, "fp long").withColumn("id", F.col("doc.doc_id"))
    kept = marked.join(winners, F.col("id").eqNullSafe(F.col("winner")) & (F.col("fp") == F.col("winner_fp")), "left_semi")
    return kept.dropDuplicates(["id", "fp"]).select("doc.*")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
