"""SentencePiece encoding and decoding by suffix-array matching.

The blanks of a text become U+2581 and one is put before it. No piece runs on from another character into U+2581, so a
text is a sequence of chunks (blanks and the word behind them) that are encoded alone. The distinct chunks of a slice of
texts that the worker has not met are concatenated and indexed: a suffix array over the characters, to the depth of
the longest piece; every piece of the model is found by binary search as a range of it; the occurrences, sorted by
position, are the edges. The model is a BPE model, for which the best path by scores would give other results than
SentencePiece does; so the edges are relaxed in the model's own order: in all chunks at once, the adjacent pair of
symbols joined by the edge of best score, the leftmost of equals, becomes one symbol, until no edge joins two
symbols. Characters without a piece become their UTF-8 bytes.

Chunks of more than `LONG` characters are relaxed with a heap each, so that a text without blanks takes no more than
its length times a logarithm.

Cases: a null or empty text has no ids; U+2581 in a text decodes to a blank, as in SentencePiece; empty tables give
empty results; repeated rows are encoded alike; other columns pass through, and a new column whose name is taken gets
underscores after it; a very long text is encoded whole.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table

BLANK = "▁"
LONG = 64
#: Chunks that a Python worker keeps; beyond it the table starts anew.
MOST_CHUNKS = 400_000

_CHUNK = re.compile(f"(?<=[^{BLANK}])(?={BLANK})")
_U = np.uint64


class _Numbered(dict):
    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []
        self.next = 0

    def __missing__(self, chunk: str) -> int:
        self.fresh.append(chunk)
        self[chunk] = found = self.next
        self.next += 1
        return found


class Model:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback is needed")
        self.names = [p.piece for p in model.pieces]
        normal = [i for i, p in enumerate(model.pieces) if p.type == 1]
        self.id_of = {self.names[i]: i for i in normal}
        if any(BLANK in n.lstrip(BLANK) for n in self.id_of):
            raise ValueError("a piece runs on into a blank")
        scores = np.array([p.score for p in model.pieces])
        self.order = np.empty(len(scores), np.int64)  # dense rank of the score: larger is merged earlier
        self.order[:] = np.unique(scores, return_inverse=True)[1]
        self.byte = np.full(256, -1, np.int64)
        raw = [b""] * len(self.names)
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.byte[int(p.piece[3:5], 16)] = i
                raw[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == 1:
                raw[i] = p.piece.replace(BLANK, " ").encode()
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(r) for r in raw], np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        self.pieces = sorted(self.id_of, key=lambda n: self.id_of[n])
        self.width = max(map(len, self.pieces))
        self.bits = self.width.bit_length()
        self.clear()

    def clear(self) -> None:
        self.known = _Numbered()
        self.ids = np.empty(0, np.int32)
        self.starts = np.zeros(1, np.int64)

    # -- suffix array and edges ---------------------------------------------------------------------

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start << bits | length, id) of all occurrences of pieces in an array of code points, by position."""
        length = np.array([len(p) for p in self.pieces])
        codes = np.frombuffer("".join(self.pieces).encode("utf-32-le"), "<u4")
        letters = np.unique(np.r_[codes, 0])  # the letters of pieces are numbered; all others are no part of any piece
        if len(letters) >= 1 << 15:
            raise ValueError("too many letters")
        place = np.minimum(np.searchsorted(letters, text), len(letters) - 1)
        small = np.where(letters[place] == text, place, 0).astype(_U)
        levels = -(-self.width // 4)
        padded = np.r_[small, np.zeros(4 * levels + 4, _U)]
        packed = padded[:-3] << _U(48) | padded[1:-2] << _U(32) | padded[2:-1] << _U(16) | padded[3:]
        n = len(text)
        sa, rank = np.argsort(packed[:n], kind="stable"), None
        for k in range(levels):  # refine by four characters more
            key = packed[sa + 4 * k]
            if k:
                order = np.lexsort((key, rank))
                sa, key, rank = sa[order], key[order], rank[order]
                rank = np.cumsum(np.r_[False, (key[1:] != key[:-1]) | (rank[1:] != rank[:-1])])
            else:
                rank = np.cumsum(np.r_[False, key[1:] != key[:-1]])
            if len(rank) and rank[-1] == n - 1:
                break
        # binary search of every piece, four characters a round; low and high bound its range
        letter = np.searchsorted(letters, codes).astype(_U)
        first = np.cumsum(length) - length
        low, high = np.zeros(len(length), np.int64), np.full(len(length), n, np.int64)
        for k in range(levels):
            live = np.flatnonzero((length > 4 * k) & (low < high))
            if not len(live):
                break
            least, most = np.zeros(len(live), _U), np.zeros(len(live), _U)
            for c in range(4):
                has = length[live] > 4 * k + c
                x = np.where(has, letter[np.minimum(first[live] + 4 * k + c, len(letter) - 1)], 0)
                shift = _U(48 - 16 * c)
                least |= x.astype(_U) << shift
                most |= np.where(has, x, 0xFFFF).astype(_U) << shift
            column = packed[sa + 4 * k]
            a, b = _bounds(column, low[live], high[live], least, False), _bounds(column, low[live], high[live], most, True)
            low[live], high[live] = a, b
        count = np.maximum(high - low, 0)
        at = sa[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
        key = at.astype(np.int64) << self.bits | np.repeat(length, count)
        order = np.argsort(key)
        ids = np.array([self.id_of[p] for p in self.pieces], np.int64)
        return key[order], np.repeat(ids, count)[order]

    # -- relaxation ---------------------------------------------------------------------------------

    def _encode_fresh(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of the chunks in a row, and how many each has."""
        flat = np.frombuffer("\0".join([*chunks, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        size = np.array([len(c) for c in chunks], np.int64)
        begin = np.cumsum(size + 1) - size - 1
        key, piece = self.edges(flat)

        def edge(start: np.ndarray, end: np.ndarray) -> np.ndarray:
            """id of the edge, -1 where there is none."""
            width = end - start
            want = start << self.bits | np.minimum(width, (1 << self.bits) - 1)
            at = np.minimum(np.searchsorted(key, want), max(len(key) - 1, 0))
            return np.where((width <= self.width) & (key[at] == want), piece[at], -1) if len(key) else np.full(len(start), -1)

        long = size > LONG
        short = np.flatnonzero(~long)
        start = np.repeat(begin[short] - (np.cumsum(size[short]) - size[short]), size[short]) + np.arange(int(size[short].sum()))
        end, owner = start + 1, np.repeat(short, size[short])
        done: list[tuple] = []
        while len(start):
            join = np.full(len(start), -1, np.int64)
            same = np.flatnonzero(owner[1:] == owner[:-1])
            found = edge(start[same], end[same + 1])
            join[same] = np.where(found >= 0, self.order[found] + 1, 0) - 1
            heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            width = np.diff(np.r_[heads, len(start)])
            best = np.maximum.reduceat(join, heads)
            settled = np.repeat(best < 0, width)
            if settled.any():
                done.append((start[settled], end[settled]))
            is_best = (join == np.repeat(best, width)) & ~settled
            left = np.minimum.reduceat(np.where(is_best, np.arange(len(start)), len(start)), heads)
            left = left[best >= 0]
            end[left] = end[left + 1]
            keep = ~settled
            keep[left + 1] = False
            start, end, owner = start[keep], end[keep], owner[keep]
        for c in np.flatnonzero(long):
            done.append(_heap(int(begin[c]), int(size[c]), key, piece, self.order, self.bits))
        start, end = (np.concatenate([d[i] for d in done]) if done else np.empty(0, np.int64) for i in (0, 1))
        order = np.argsort(start)
        start, end = start[order], end[order]
        ids = edge(start, end)
        unknown = np.flatnonzero(ids < 0)  # single characters without a piece
        count = np.ones(len(ids), np.int64)
        raw = [chr(flat[i]).encode("utf-8", "surrogatepass") for i in start[unknown]]
        count[unknown] = [len(r) for r in raw]
        out = np.repeat(ids, count)
        if raw:
            firsts = (np.cumsum(count) - count)[unknown]
            for at, r in zip(firsts, raw, strict=True):
                out[at : at + len(r)] = self.byte[list(r)]
        return out.astype(np.int32), np.bincount(np.searchsorted(begin, start, "right") - 1, weights=count, minlength=len(chunks)).astype(np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        if len(self.known) > MOST_CHUNKS:
            self.clear()
        known = self.known
        at, sizes = [], []
        for t in texts:
            chunks = _CHUNK.split(BLANK + t.replace(" ", BLANK)) if t else []
            at.append(np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks)))
            sizes.append(len(chunks))
        if known.fresh:
            fresh, known.fresh = known.fresh, []
            ids, count = self._encode_fresh(fresh)
            self.ids = np.r_[self.ids, ids]
            self.starts = np.r_[self.starts, self.starts[-1] + np.cumsum(count)]
        x = np.concatenate(at) if at else np.empty(0, np.int64)
        start, length = self.starts[x], self.starts[x + 1] - self.starts[x]
        ends = np.cumsum(length)
        out = self.ids[np.repeat(start - (ends - length), length) + np.arange(int(length.sum()))]
        return out, np.diff(np.r_[0, ends][np.cumsum([0, *sizes])])

    def decode(self, ids: np.ndarray, count: np.ndarray) -> list[str]:
        """Texts of ids in a row, count of them each; the first blank of a text goes."""
        size = self.raw_size[ids]
        ends = np.cumsum(size)
        data = self.raw[np.repeat(self.raw_start[ids] - (ends - size), size) + np.arange(int(size.sum()))].tobytes()
        bounds = np.r_[0, ends][np.cumsum([0, *count])]
        return [data[a + (data[a : a + 1] == b" ") : b].decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _bounds(column: np.ndarray, low: np.ndarray, high: np.ndarray, want: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of want[i] in column[low[i]:high[i]], all at once."""
    low, high = low.copy(), high.copy()
    while (live := low < high).any():
        mid = (low + high) >> 1
        x = column[np.minimum(mid, len(column) - 1)]
        right = live & ((x <= want) if after else (x < want))
        low = np.where(right, mid + 1, low)
        high = np.where(live & ~right, mid, high)
    return low


def _heap(begin: int, size: int, key: np.ndarray, piece: np.ndarray, order: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of one long chunk's symbols."""
    a, b = np.searchsorted(key, [begin << bits, (begin + size) << bits])
    edge = dict(zip((key[a:b] - (begin << bits)).tolist(), order[piece[a:b]].tolist(), strict=True))
    end = list(range(1, size + 1))  # end[i]: end of the symbol that starts at i; 0 for none
    before = list(range(-1, size - 1))
    heap: list[tuple] = []

    def offer(i: int) -> None:
        j = end[i]
        if j < size and end[j] - i < 1 << bits and (score := edge.get(i << bits | (end[j] - i))) is not None:
            heapq.heappush(heap, (-score, i, end[j], j))

    for i in range(size):
        offer(i)
    while heap:
        _, i, stop, j = heapq.heappop(heap)
        if end[i] != j or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        if stop < size:
            before[stop] = i
            offer(i)
        if before[i] >= 0:
            offer(before[i])
    starts = np.array([i for i in range(size) if end[i]], np.int64)
    return starts + begin, np.array([end[i] for i in starts], np.int64) + begin


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


_models: dict[str, Model] = {}


def load(path: str | None = None) -> Model:
    path = path or default_model()
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def encode(documents: DataFrame, model: str | None = None) -> DataFrame:
    """All columns but text, and ids, n_tokens and round_trip (whether decoding gives the text again)."""

    def make():
        def run(texts):
            m = load(model)
            ids, count = m.encode(texts)
            back = m.decode(ids, count)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *count]), pa.int32()), pa.array(ids, pa.int32()))
            return {"ids": lists, "n_tokens": count, "round_trip": [x == (t or "") for x, t in zip(back, texts, strict=True)]}

        return run

    return map_texts(documents, make, "ids array<int>, n_tokens long, round_trip boolean")


def decode(encoded: DataFrame, model: str | None = None, column: str = "ids") -> DataFrame:
    """Replace the column of ids by their text."""
    keys = [c for c in encoded.columns if c != column]

    def run(batches):
        for batch in batches:
            lists = batch.column(column)
            count = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
            texts = load(model).decode(lists.flatten().to_numpy(zero_copy_only=False), count)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(texts, pa.string())], names=[*keys, "text"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in encoded.select(*keys).schema) + "text string"
    return encoded.select(*keys, column).mapInArrow(run, schema)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return encode(documents.select("doc_id", F.col("text").cast("string").alias("text"))).select("doc_id", "n_tokens", "ids", "round_trip")
