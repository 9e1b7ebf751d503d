"""Packing of documents into training sequences of equal length and balanced attention cost.

A document's ids, with the end id, are cut into pieces of `capacity` ids, which fill a sequence each, and a rest. The
rests of a shard are packed by estimated cost, `LINEAR` for each id and 1 for each pair of ids of a piece, as attention
stays within a piece: in descending order, each goes to the sequence of lowest cost that has room for it. A shard has
as many sequences as its ids fill. A rest for which no sequence has room is cut to what they have, lowest cost first, so all
sequences of a shard are full, and less than one sequence's ids are left open.

A shard is a bounded run of the documents of one task; what it leaves open goes into the task's next shard. What tasks
leave open is dealt to as few tasks as it fills and packed there in the same way; only what those leave open is padded: less
than one sequence a task of that second pass, which has one for about `SHARD_IDS` open ids.

Nothing is shuffled but those last open pieces, and a task's sequences hold only its own documents, so a task that runs
again rewrites them whole. Full pieces and packed rests are written with their ids to a table in the shared folder.

Cases: a null or empty text is the end id alone; null and repeated doc_ids are packed row by row; equal costs are taken in
the order read, equal sequences from the first; a very long text is encoded whole and cut; empty tables give no
sequences; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, slices, table
from .token_files import END_ID, _encoder

CAPACITY = 1024
#: Cost of an id beside that of a pair of ids: six times a model's width of 1024.
LINEAR = 6 * 1024
#: Rests, and ids of rests, in a shard.
SHARD_RESTS = 8192
SHARD_IDS = 1 << 22
_FIRST_OF_OPEN = 1 << 62

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_KINDS = [pa.int64()] * 7 + [pa.binary()]


def attention_cost(length, linear: float = LINEAR):
    return linear * length + length * length


def assign(lengths: list[int], capacity: int, linear: float = LINEAR) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """(rest, start, length, sequence, offset) of the pieces that fill sequences, and (rest, start, length) of those left open."""
    count = sum(lengths) // capacity
    cost, room = np.zeros(count), np.full(count, capacity, np.int64)
    placed, left = [], []

    def put(rest: int, start: int, length: int, to: int) -> None:
        placed.append((rest, start, length, to, capacity - int(room[to])))
        cost[to] += attention_cost(length, linear)
        room[to] -= length

    for rest in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        start, length = 0, lengths[rest]
        fits = room >= length
        if fits.any():
            put(rest, 0, length, int(np.where(fits, cost, np.inf).argmin()))
            continue
        while length and (room > 0).any():
            to = int(np.where(room > 0, cost, np.inf).argmin())
            part = min(length, int(room[to]))
            put(rest, start, part, to)
            start, length = start + part, length - part
        if length:
            left.append((rest, start, length))
    return placed, left


class _Shard:
    """Rests of documents: rows (doc_id, start, ids, doc_tokens)."""

    def __init__(self, capacity: int, linear: float, first: int):
        self.capacity, self.linear, self.next = capacity, linear, first
        self.rests: list[tuple] = []
        self.held = 0

    def add(self, row: tuple) -> None:
        self.rests.append(row)
        self.held += len(row[2])

    def full(self) -> bool:
        return len(self.rests) >= SHARD_RESTS or self.held >= SHARD_IDS

    def whole(self, doc_id, start: int, ids: np.ndarray, doc_tokens: int) -> tuple:
        """A piece that fills a sequence."""
        self.next += 1
        return doc_id, start, ids, doc_tokens, self.next - 1, 0

    def pack(self) -> Iterator[tuple]:
        """Pieces in full sequences; what is left open stays."""
        placed, left = assign([len(r[2]) for r in self.rests], self.capacity, self.linear)
        part = lambda rest, start, length: (self.rests[rest][0], self.rests[rest][1] + start, self.rests[rest][2][start : start + length], self.rests[rest][3])
        for rest, start, length, to, offset in placed:
            yield *part(rest, start, length), self.next + to, offset
        self.next += sum(len(r[2]) for r in self.rests) // self.capacity
        self.rests = [part(*x) for x in left]
        self.held = sum(len(r[2]) for r in self.rests)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """rows: doc_id, start, ids, doc_tokens, sequence_id, offset."""
    stored = [x[2].astype("<u4").tobytes() for x in rows]
    columns = [[x[0] for x in rows], [x[1] for x in rows], [len(x[2]) for x in rows], list(map(zlib.crc32, stored)), [x[3] for x in rows], [x[4] for x in rows], [x[5] for x in rows], stored]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=[x.split()[0] for x in _PIECES.split(", ")])


def pack(documents: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, linear: float = LINEAR) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit) of every piece."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = _encoder(tokenizer), _Shard(capacity, linear, TaskContext.get().partitionId() << 32)
        for batch in slices(batches):
            rows = []
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text").to_pylist()), strict=True):
                ids = np.r_[found, np.uint32(END_ID)]
                full = len(ids) // capacity * capacity
                rows += [shard.whole(doc_id, k, ids[k : k + capacity], len(ids)) for k in range(0, full, capacity)]
                if full < len(ids):
                    shard.add((doc_id, full, ids[full:], len(ids)))
                if shard.full():
                    rows += shard.pack()
            if rows:
                yield _batch(rows)
        rows = [*shard.pack(), *((*r, None, None) for r in shard.rests)]
        if rows:
            yield _batch(rows)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(capacity, linear, _FIRST_OF_OPEN + (TaskContext.get().partitionId() << 32))
        for batch in batches:
            rows = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True):
                shard.add((row[0], row[1], np.frombuffer(row[2], "<u4"), row[3]))
                if shard.full():
                    rows += shard.pack()
            if rows:
                yield _batch(rows)
        rows, at = list(shard.pack()), 0
        for rest in shard.rests:  # together less than a sequence
            rows.append((*rest, shard.next, at))
            at += len(rest[2])
        if rows:
            yield _batch(rows)

    packed = saved(docs.mapInArrow(first, _PIECES))
    left = packed.where("sequence_id is null")
    tasks = -(-(left.agg(F.sum("length")).first()[0] or 0) // SHARD_IDS)
    if not tasks:
        return packed
    return packed.where("sequence_id is not null").unionByName(saved(left.repartition(tasks).mapInArrow(second, _PIECES)))


def sequences(pieces: DataFrame, capacity: int = CAPACITY, pad_id: int = END_ID) -> DataFrame:
    """sequence_id, n_ids, ids (array, padded to capacity unless n_ids is a power of two), piece_lengths, doc_ids (in order)."""
    n = F.col("n_ids")
    lists = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "ids"))).alias("x"))  # at most capacity ids

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(y["ids"] for y in x), "<u4").astype(np.int32) for x in batch.column("x").to_pylist()]
            padded = [x if len(x) & (len(x) - 1) == 0 else np.r_[x, np.full(capacity - len(x), pad_id, np.int32)] for x in ids]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("sequence_id", "n_ids", "piece_lengths", "doc_ids")), pa.array(padded, pa.list_(pa.int32()))], names=["sequence_id", "n_ids", "piece_lengths", "doc_ids", "ids"])

    return lists.select("sequence_id", n, F.col("x.length").alias("piece_lengths"), F.col("x.doc_id").alias("doc_ids"), "x").mapInArrow(joined, "sequence_id long, n_ids long, piece_lengths array<long>, doc_ids array<long>, ids array<int>")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("ids")
