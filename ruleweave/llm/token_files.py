"""Token-id files with Re-Pair grammar compression.

Documents are range-partitioned and sorted by doc_id; each range is a shard. A shard is a run of blocks of about
`BLOCK_IDS` ids that end at document ends. Each block is compressed by Re-Pair in rounds: all adjacent id pairs are
counted, up to `PAIRS` of the most frequent become nonterminals, and their occurrences are replaced from the left,
without overlaps; the next round sees the shortened sequence, until no pair occurs `LEAST_COUNT` times. The block stores the rules, the expansion length of
every nonterminal, and the sequence, so any id range is decoded without expanding the rest.

File format: a Parquet table with the columns shard int, block int, offset long (ids of the shard before the block),
doc_ids array<long>, n_ids array<long>, base int (first nonterminal), rules binary (little-endian uint32 pairs),
lengths binary (uint32 for each rule), sequence binary (uint32).

Encoding cuts a text at single blanks between two non-blanks, where the byte-level pre-tokenizer always cuts too, and
encodes each distinct piece with the tokenizers library; a bounded table of pieces is kept by the Python worker. A text
that holds an added token, such as the end mark, is encoded whole.

Cases: a null or empty text is the end id alone; null doc_ids sort first; equal doc_ids stand side by side, by a hash
of the text; empty tables give empty files; a very long text is encoded whole and makes a block of its own; other columns
are not read.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, slices, table

END_ID = 0
BLOCK_IDS = 1 << 17
PAIRS = 2048
#: A rule takes three words (its pair and its length), so a pair pays from four occurrences on.
LEAST_COUNT = 4
#: Pieces that a Python worker keeps; beyond it the table starts anew.
MOST_PIECES = 2_000_000
FORMAT = "shard int, block int, offset long, doc_ids array<long>, n_ids array<long>, base int, rules binary, lengths binary, sequence binary"

_CUT = re.compile(r"(?<=\S) (?=\S)")


class _Numbered(dict):
    """Numbers a piece when it is first looked up, and lists it in fresh."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []
        self.next = 0

    def __missing__(self, piece: str) -> int:
        self.fresh.append(piece)
        self[piece] = found = self.next
        self.next += 1
        return found


class Encoder:
    """Whole texts to id arrays, by distinct pieces.

    The first piece of a text stands without a blank, every other one after a blank; both are numbered apart. The
    pieces after blanks are joined and encoded in runs: as none holds another blank, one begins at each id whose
    token begins with the blank.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # pieces hold no added token; texts with one go to self.whole
        self.whole = Tokenizer.from_file(path)
        self.added = [x.content for x in self.whole.get_added_tokens_decoder().values()]
        names = self.tokenizer.get_vocab()
        self.vocabulary = max(names.values()) + 1
        self.opens = np.zeros(self.vocabulary, bool)
        self.opens[[i for name, i in names.items() if name.startswith("\u0120")]] = True
        self.clear()

    def clear(self) -> None:
        self.known = _Numbered()
        self.ids = np.empty(0, np.uint32)
        self.starts = np.zeros(1, np.int64)

    def _single(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _run(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids and lengths of pieces that follow a blank each."""
        plain = [i for i, p in enumerate(pieces) if " " not in p and not p[-1:].isspace()]
        flat, lengths = np.empty(0, np.uint32), np.zeros(len(pieces), np.int64)
        if plain:
            step = 512  # longer runs cost more a piece
            runs = [" " + " ".join(pieces[i] for i in plain[k : k + step]) for k in range(0, len(plain), step)]
            flat = np.concatenate(self._single(runs))
            begin = np.flatnonzero(self.opens[flat])
            lengths[plain] = np.diff(np.r_[begin, len(flat)])
        if len(plain) < len(pieces):
            odd = sorted(set(range(len(pieces))) - set(plain))
            own = dict(zip(odd, self._single([" " + pieces[i] for i in odd]), strict=True))
            at, parts = 0, []
            for i, n in enumerate(lengths):
                parts.append(own.get(i, flat[at : at + n]))
                at += n
            flat, lengths = np.concatenate(parts), np.array(list(map(len, parts)), np.int64)
        return flat, lengths

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.known) > MOST_PIECES:
            self.clear()
        known = self.known
        whole = [i for i, t in enumerate(texts) if t and any(x in t for x in self.added)]
        if whole:
            texts = list(texts)
            marked = self.whole.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)
            for i in whole:
                texts[i] = None
        rows = [t.split(" ") if t else [] for t in texts]
        look = lambda: [np.fromiter(map(known.__getitem__, r[1:]), np.int64, max(len(r) - 1, 0)) for r in rows]
        at = look()
        awkward = {p for p in known.fresh if not p or p[0].isspace() or p[-1].isspace()}  # the blank beside it is no cut
        heads = [r[0] for r in rows if r]
        if awkward or any(not h or h[-1].isspace() for h in heads):
            for p in awkward:
                del known[p]
            known.fresh = ["-" if p in awkward else p for p in known.fresh]  # their numbers stay unused
            for i, r in enumerate(rows):
                if r and (not r[0] or r[0][-1].isspace() or not awkward.isdisjoint(r[1:])):
                    rows[i] = _CUT.split(texts[i])
            at = look()
            heads = [r[0] for r in rows if r]
        if known.fresh:
            fresh, known.fresh = known.fresh, []
            flat, lengths = self._run(fresh)
            self.ids = np.r_[self.ids, flat]
            self.starts = np.r_[self.starts, self.starts[-1] + np.cumsum(lengths)]
        first = iter(self._single(heads))
        out = []
        for r, x in zip(rows, at, strict=True):
            if not r:
                out.append(np.empty(0, np.uint32))
                continue
            start, length = self.starts[x], self.starts[x + 1] - self.starts[x]
            ends = np.cumsum(length)
            rest = self.ids[np.repeat(start - (ends - length), length) + np.arange(int(length.sum()))]
            out.append(np.r_[next(first), rest])
        if whole:
            for i, x in zip(whole, marked, strict=True):
                out[i] = np.array(x.ids, np.uint32)
        return out


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_encoders: dict[str, Encoder] = {}


def _encoder(path: str | None) -> Encoder:
    path = path or default_tokenizer()
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# -- Re-Pair ---------------------------------------------------------------------------------------


def repair(ids: np.ndarray, base: int, pairs: int = PAIRS, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rules (n x 2), expansion lengths, sequence. base: the first nonterminal, above all ids."""
    seq = ids.astype(np.uint32)
    rules, lengths = np.empty((0, 2), np.uint32), np.empty(0, np.uint32)
    slots = 1 << 16
    live = np.arange(max(len(seq) - 1, 0))  # where a pair may be frequent: one without a new symbol never grows more frequent
    while len(live):
        key = seq[live].astype(np.uint64) << np.uint64(32) | seq[live + 1]
        ordered = np.sort(key)
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        count = np.diff(np.r_[first, len(ordered)])
        often = np.flatnonzero(count >= least)
        if not len(often):
            break
        some = ordered[first[often]]
        chosen = some[np.lexsort((some, -count[often]))[:pairs]]
        slot = ((chosen * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)
        taken = np.full(slots, -1, np.int64)
        taken[slot[::-1]] = np.arange(len(chosen))[::-1]  # of two pairs in a slot the more frequent one
        keep = np.sort(taken[slot][taken[slot] == np.arange(len(chosen))])
        number = np.full(slots, -1, np.int64)
        number[slot[keep]] = np.arange(len(keep))
        held = np.zeros(slots, np.uint64)
        held[slot[keep]] = chosen[keep]
        at = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)
        hit = np.flatnonzero((number[at] >= 0) & (held[at] == key))
        where = live[hit]
        run = np.r_[True, np.diff(where) != 1]  # of overlapping occurrences every second one, from the left
        begin = np.maximum.accumulate(np.where(run, where, 0))
        odd = (where - begin) % 2 == 0
        hit, where = hit[odd], where[odd]
        new = np.uint32(base + len(rules))
        seq[where] = new + number[at[hit]].astype(np.uint32)
        rest = np.ones(len(seq), bool)
        rest[where + 1] = False
        marked = np.zeros(slots, bool)  # frequent pairs may wait for another round; others that share a slot with one do no harm
        marked[((some * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)] = True
        again = np.zeros(len(seq), bool)
        again[live[marked[at]]] = True
        seq, again = seq[rest], again[rest]
        fresh = seq >= new
        again |= fresh
        live = np.flatnonzero(again[:-1] | fresh[1:])
        added = np.c_[(chosen[keep] >> np.uint64(32)).astype(np.uint32), (chosen[keep] & np.uint64(0xFFFFFFFF)).astype(np.uint32)]
        size = np.r_[np.ones(base, np.uint32), lengths]
        lengths = np.r_[lengths, size[added[:, 0]] + size[added[:, 1]]]
        rules = np.r_[rules, added]
    return rules, lengths, seq


def expand(rules: np.ndarray, seq: np.ndarray, base: int) -> np.ndarray:
    """All ids of a sequence, a level of rules at a time."""
    while len(rules) and len(at := np.flatnonzero(seq >= base)):
        pair = rules[seq[at] - base]
        width = np.ones(len(seq), np.int64)
        width[at] = 2
        begin = np.cumsum(width) - width
        seq = np.repeat(seq, width)
        seq[begin[at]], seq[begin[at] + 1] = pair[:, 0], pair[:, 1]
    return seq


def decode_range(rules: np.ndarray, lengths: np.ndarray, seq: np.ndarray, base: int, start: int, stop: int) -> np.ndarray:
    """ids start to stop of a block: only the symbols that cover the range are expanded."""
    size = np.r_[np.ones(base, np.int64), lengths.astype(np.int64)][seq] if len(lengths) else np.ones(len(seq), np.int64)
    ends = np.cumsum(size)
    a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
    skipped = int(ends[a - 1]) if a else 0
    return expand(rules, seq[a:b], base)[start - skipped : stop - skipped]


# -- writing and reading ----------------------------------------------------------------------------


def write_tokens(documents: DataFrame, tokenizer: str | None = None, path: str | None = None, block_ids: int = BLOCK_IDS) -> str:
    """Write the ids of all documents under path (a new folder in the shared folder where it is None); return path."""
    path = path or scratch(documents.sparkSession, "tokens")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def write(batches):
        encoder, shard = _encoder(tokenizer), TaskContext.get().partitionId()
        block, offset, docs, parts, held = 0, 0, [], [], 0

        def closed():
            rules, lengths, seq = repair(np.concatenate(parts), encoder.vocabulary)
            row = [[shard], [block], [offset], [docs], [[len(p) for p in parts]], [encoder.vocabulary], *([x.astype("<u4").tobytes()] for x in (rules, lengths, seq))]
            return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(row, kinds, strict=True)], names=names)

        for part in slices(batches):
            for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text").to_pylist()), strict=True):
                docs.append(doc)
                parts.append(np.r_[ids, np.uint32(END_ID)])
                held += len(ids) + 1
                if held >= block_ids:
                    yield closed()
                    block, offset, docs, parts, held = block + 1, offset + held, [], [], 0
        if docs:
            yield closed()

    names = [x.split()[0] for x in FORMAT.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    dealt.mapInArrow(write, FORMAT).write.option("compression", "zstd").parquet(path)
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files."""
    stored = spark.read.schema(FORMAT).parquet(path)
    totals = stored.select("shard", F.aggregate("n_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    before, total = {}, 0
    for row in totals.orderBy("shard").collect():  # one row a shard
        before[row.shard] = total
        total += row.n
    base_of = spark.sparkContext.broadcast(before)

    def read(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i].as_py() for k in batch.schema.names}
                rules, seq = np.frombuffer(row["rules"], "<u4").reshape(-1, 2), np.frombuffer(row["sequence"], "<u4")
                ids = expand(rules, seq, row["base"]).astype("<u4")
                sizes = np.array(row["n_ids"], np.int64)
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(ids[b - n : b]) for n, b in zip(sizes, ends, strict=True)]
                start = base_of.value[row["shard"]] + row["offset"] + ends - sizes
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(start), pa.array(sizes), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return stored.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(spark, write_tokens(table(spark, sf_dir, "documents")))
