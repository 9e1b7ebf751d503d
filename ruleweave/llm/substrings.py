"""Removal of byte strings that repeat across documents, by suffix arrays of shards and their merging.

A shard is a slice of whole documents, about 2 MB of text, saved once, compressed. Every 50-byte window of a document is
owned by an anchor: of its 16-byte strings the one with the least hash, the leftmost of equals. Equal windows have equal
anchors at equal places.

1. Each shard asks about the distinct hashes of its anchors, four bytes each, which is enough inside a part; the answer
   is two bits per hash: whether another shard has it, and whether at least `HOT_SHARDS` shards have it. Windows of an anchor that stands in a single
   document can't repeat.
2. A shard builds the suffix array of the passages that may repeat, by Larsson-Sadakane refinement: sort by the first
   eight bytes, then sort the groups still unsorted by the ranks of the suffixes h bytes further on, doubling h. Common
   prefixes come from Kasai's recurrence, run over chunks of windows side by side. Neighbours that share 50 bytes are
   one string; of each string only the windows of the shard's least doc_id go on, the others are removed.
3. Shards are merged: windows go on as runs with one anchor, to the part that the anchor's hash falls into, so a part
   sees each of its strings from all shards. A part sorts keys of the windows that fit an array, keeps each string once
   with its least doc_id, and merges the sorted tables of its arrays in pairs by binary search; equal keys are compared
   byte by byte. A window goes if its string's least doc_id is smaller than its own.
4. Spans go back to their shards, which cut them out.

Windows of a hot anchor travel in runs of up to seven, by the hash of the 44 bytes that these share, and merge in rounds
of `FAN` shards each, of which again only the least doc_id's windows go on: no part gets more than `FAN` shards' runs of
one string, however many documents hold it.

Cases: null texts are empty; a null doc_id counts as larger than all others; rows that repeat a doc_id are separate
documents with that id; texts under 50 bytes keep all bytes; empty tables give empty results; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, slices, table

WIDTH = 50
GRAM = 16
#: Text bytes of a shard, text bytes for each part of the merging, windows of one table before merging.
SLICE = 2 << 20
PART = 16 << 20
ARRAY = 1 << 20
#: An anchor found in so many shards is hot; shards merged in a round of hot anchors' windows; windows of their runs.
HOT_SHARDS = 64
FAN = 1024
HOT_RUN = 7
#: Windows of a chunk of Kasai's recurrence.
CHUNK = 64
LAST = (1 << 63) - 1

_U = np.uint64
_SLICE = "slice long, docs binary, sizes binary, body binary"
_ASKED = "slice long, part int, hashes binary"
_ANSWERED = "slice long, part int, bits binary"
_PACKED = "slice long, part int, bucket int, docs binary, counts array<int>, body binary, spans binary"
_OUT = "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long"


def _words(data: np.ndarray, kind: str) -> np.ndarray:
    """Unaligned integers at every byte."""
    width = np.dtype(kind).itemsize
    return np.ndarray((max(len(data) - width + 1, 0),), kind, data, strides=(1,))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(32))


def _hash(data: np.ndarray, at: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the strings of `width` bytes at `at`."""
    x = _words(data, "<u8")
    h = np.full(len(at), seed, _U)
    for i in [*range(0, width - 8, 8), width - 8]:
        h = _mix(h * _U(0x9E3779B97F4A7C15) + x[at + i])
    return h


def windows(parts: list[bytes]) -> tuple[np.ndarray, ...]:
    """bytes; and of every window: start in them, index of its text, offset in the text, start and hash of its anchor; and which begin a run of one anchor."""
    sizes = np.array([len(p) for p in parts], np.int64)
    data = np.frombuffer(b"".join(parts) + b"\0" * 8, np.uint8)
    starts = np.cumsum(sizes) - sizes
    n = np.maximum(sizes - WIDTH + 1, 0)
    total = int(n.sum())
    doc = np.repeat(np.arange(len(parts), dtype=np.int32), n)
    offset = np.arange(total, dtype=np.int32) - np.repeat((np.cumsum(n) - n).astype(np.int32), n)
    at = starts.astype(np.int32)[doc] + offset
    if not total:
        return data, at, doc, offset, at, np.empty(0, _U), np.empty(0, bool)
    x = _words(data, "<u8")
    h = _mix(x[:-8].astype(_U) * _U(0x9E3779B97F4A7C15) + x[8:].astype(_U))
    best = h & _U(0xFFFFFFFF00000000) | np.arange(len(h), dtype=_U)  # hash and place: the leftmost least one wins
    span, width = 1, WIDTH - GRAM + 1
    while span < width:
        step = min(span, width - span)
        best = np.minimum(best[:-step], best[step:])
        span += step
    anchor = (best & _U(0xFFFFFFFF)).astype(np.int32)[at]
    del best
    begins = np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]
    return data, at, doc, offset, anchor, h[anchor], begins


# -- suffix array of a shard -------------------------------------------------------------------------


def suffix_array(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Order of the windows that start at `at` (ascending) by their 50 bytes, by Larsson-Sadakane refinement.

    All suffixes that lie in a window take part, as their ranks refine those before them: after a step at distance h,
    rank[i] orders the suffixes by their first 2 h bytes. Only groups of equal rank are sorted again. The last step
    overlaps, so that exactly 50 bytes count.
    """
    cover = np.zeros(len(data) + WIDTH, np.int32)
    cover[at] += 1
    cover[at + WIDTH] -= 1
    sa = np.flatnonzero(np.cumsum(cover)[: len(data) - 7])
    key = _words(data, ">u8")[sa].astype(_U)
    order = np.argsort(key)
    sa, key = sa[order], key[order]
    new = np.r_[True, key[1:] != key[:-1]]
    del order, key, cover
    rank = np.zeros(len(data) + WIDTH, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(len(sa), dtype=np.int32), 0))
    for h in (8, 16, WIDTH - 32):
        if h == WIDTH - 32:  # from here on only the windows themselves
            own = np.zeros(len(data), bool)
            own[at] = True
            own = own[sa]
            sa, group = sa[own], rank[sa[own]]
            new = np.r_[True, group[1:] != group[:-1]]
        unsorted = np.flatnonzero(~(new & np.r_[new[1:], True]))
        if not len(unsorted):
            continue
        i = sa[unsorted]
        key = rank[i].astype(_U) << _U(32) | rank[i + h].astype(_U)
        order = np.argsort(key)
        key = key[order]
        sa[unsorted] = i[order]
        new[unsorted] = np.r_[True, key[1:] != key[:-1]]
        head = unsorted[np.maximum.accumulate(np.where(new[unsorted], np.arange(len(unsorted)), 0))]
        if h == WIDTH - 32:
            break
        rank[sa[unsorted]] = head
    where = np.zeros(len(data), np.int32)
    where[at] = np.arange(len(at))
    return where[sa]


def common_prefixes(data: np.ndarray, at: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Kasai: for each window, bytes (50 at most) shared with the window before it in sa.

    A window shares at least one byte less than the window one byte before it does, if the successor of that one's
    neighbour is in the array and sorted before it. Chunks of `CHUNK` windows advance together, a window at a time.
    """
    n = len(at)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    rank = np.empty(n, np.int32)
    rank[sa] = np.arange(n)
    follows = np.r_[False, at[1:] == at[:-1] + 1, False]  # whether window i starts one byte after window i - 1
    x = _words(data, "<u8")
    out = np.zeros(n, np.int8)
    shared = np.zeros(-(-n // CHUNK), np.int64)
    for step in range(min(CHUNK, n)):
        i = np.arange(step, n, CHUNK)
        j = before[i]
        h = np.maximum(shared[: len(i)] - 1, 0)
        near = before[i - 1] + 1 if step else np.zeros(len(i), np.int32)
        h[~(follows[i] & follows[near] & (rank[np.minimum(near, n - 1)] < rank[i])) | (near == 0)] = 0
        todo = np.flatnonzero(j >= 0)
        while len(todo):
            p, q = at[i[todo]] + h[todo], at[j[todo]] + h[todo]
            diff = x[p] ^ x[q]
            low = diff & (~diff + _U(1))  # the lowest bit that differs lies in the first byte that differs
            h[todo] += np.where(diff == 0, 8, np.log2(np.maximum(low, _U(1)).astype(np.float64)).astype(np.int64) >> 3)
            todo = todo[(diff == 0) & (h[todo] < WIDTH)]
        h[j < 0] = 0
        out[i] = h = np.minimum(h, WIDTH)
        shared[: len(i)] = h
    return out


def repeated(data: np.ndarray, at: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which of a shard's windows also start in a document with a smaller owner id."""
    sa = suffix_array(data, at)
    same = common_prefixes(data, at, sa)[sa] >= WIDTH
    begin = np.flatnonzero(~same)
    least = np.minimum.reduceat(owner[sa], begin)
    out = np.zeros(len(at), bool)
    out[sa] = owner[sa] > np.repeat(least, np.diff(np.r_[begin, len(sa)]))
    return out


# -- merging of shards ---------------------------------------------------------------------------------


class Collision(Exception):
    """Two strings have one key; the part starts anew with other keys."""


def _verify(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    x = _words(data, "<u8")
    for i in (0, 8, 16, 24, 32, 40, WIDTH - 8):
        if (x[a + i] != x[b + i]).any():
            raise Collision


def merge(data: np.ndarray, a: tuple, b: tuple) -> tuple:
    """Merge two sorted tables (key, start, least owner) of distinct strings: b's keys are searched in a."""
    i = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    hit = a[0][i] == b[0]
    _verify(data, a[1][i[hit]], b[1][hit])
    least = a[2].copy()
    least[i[hit]] = np.minimum(least[i[hit]], b[2][hit])
    key, at, least = (np.r_[x, y[~hit]] for x, y in zip((a[0], a[1], least), b, strict=True))
    order = np.argsort(key, kind="stable")
    return key[order], at[order], least[order]


def outranked(data: np.ndarray, start: np.ndarray, n: np.ndarray, owner: np.ndarray, array: int = ARRAY) -> np.ndarray:
    """Of runs of n windows from `start` on: which windows have a smaller owner's string, over all runs."""
    for seed in range(8):
        try:
            return _outranked(data, start, n, owner, array, seed)
        except Collision:
            continue
    raise RuntimeError("keys of eight seeds collide")


def _outranked(data, start, n, owner, array, seed):
    ends = np.cumsum(n)
    first, tables, inverses = 0, [], []
    while first < len(n):
        stop = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + array, "right")))
        own = slice(first, stop)
        size = n[own]
        at = np.repeat(start[own] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        key = _hash(data, at, WIDTH, seed)
        order = np.argsort(key)
        key, at = key[order], at[order]
        same = key[1:] == key[:-1]
        _verify(data, at[1:][same], at[:-1][same])
        begin = np.flatnonzero(np.r_[True, ~same])
        tables.append((key[begin], at[begin], np.minimum.reduceat(np.repeat(owner[own], size)[order], begin)))
        inverse = np.empty(len(order), np.int32)
        inverse[order] = np.cumsum(np.r_[True, ~same]) - 1
        inverses.append((own, key[begin], inverse))
        first = stop
    while len(tables) > 1:
        tables = [merge(data, *tables[i : i + 2]) if i + 1 < len(tables) else tables[i] for i in range(0, len(tables), 2)]
    key, _, least = tables[0]
    return np.concatenate([np.repeat(owner[own], n[own]) > least[np.searchsorted(key, k)][inverse] for own, k, inverse in inverses])


# -- the job -----------------------------------------------------------------------------------------


def _zip(*arrays: np.ndarray, tail: bytes = b"") -> bytes:
    import zstandard

    return zstandard.compress(b"".join(a.tobytes() for a in arrays) + tail, 3)


def _unzip(body: bytes) -> bytes:
    import zstandard

    return zstandard.decompress(body)


def _texts(row: dict) -> tuple[np.ndarray, list[bytes]]:
    """doc ids and texts of a slice."""
    sizes, data = np.frombuffer(row["sizes"], np.int64), _unzip(row["body"])
    ends = np.cumsum(sizes)
    return np.frombuffer(row["docs"], np.int64), [data[b - n : b] for n, b in zip(sizes, ends, strict=True)]


def _part(key: np.ndarray, n_parts: int) -> np.ndarray:
    return ((_mix(key) >> _U(11)) % _U(n_parts)).astype(np.int32)


def _distinct(key: np.ndarray, begins: np.ndarray, n_parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchor hashes of a slice by part and hash, and their parts."""
    k = np.unique(key[begins])
    part = _part(k, n_parts)
    order = np.argsort(part, kind="stable")
    return k[order], part[order]


def _ask(row: dict, n_parts: int):
    """For each part the hashes of a slice: 32 bits of each; others that share them only bring more windows in."""
    *_, key, begins = windows(_texts(row)[1])
    if not len(key):
        return
    k, part = _distinct(key, begins, n_parts)
    bounds = np.searchsorted(part, np.arange(n_parts + 1))
    for p in np.flatnonzero(np.diff(bounds)):
        own = k[bounds[p] : bounds[p + 1]]
        yield {"slice": row["slice"], "part": int(p), "hashes": (own & _U(0xFFFFFFFF)).astype("<u4").tobytes()}


def _answer(asked: list[dict], hot_shards: int):
    """Two bits for each hash of each slice that asked: another slice has it, `hot_shards` slices have it."""
    sizes = [len(x["hashes"]) // 4 for x in asked]
    key = np.concatenate([np.frombuffer(x["hashes"], "<u4") for x in asked])
    order = np.argsort(key)
    begin = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    count = np.diff(np.r_[begin, len(key)])
    found = np.empty(len(key), np.int32)
    found[order] = np.repeat(np.minimum(count, hot_shards), count)
    for x, own in zip(asked, np.split(found, np.cumsum(sizes)[:-1]), strict=True):
        yield {"slice": x["slice"], "part": x["part"], "bits": np.packbits(np.r_[own > 1, own >= hot_shards]).tobytes()}


def _route(row: dict, answers: list[dict], n_parts: int, fan: int, buckets: int):
    """Windows of a slice that go on, packed in runs, one row for each part (hot ones apart) that gets something; and spans removed here."""
    docs, texts = _texts(row)
    data, at, doc, offset, anchor, key, begins = windows(texts)
    if not len(at):
        return
    k, part = _distinct(key, begins, n_parts)
    first_of = np.searchsorted(part, np.arange(n_parts + 1))
    elsewhere, hot = np.zeros(len(k), bool), np.zeros(len(k), bool)
    for x in answers:
        a, b = first_of[x["part"]], first_of[x["part"] + 1]
        elsewhere[a:b], hot[a:b] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=2 * (b - a)).astype(bool).reshape(2, -1)
    order = np.argsort(k)
    run = np.flatnonzero(begins)
    size = np.diff(np.r_[run, len(at)])
    which = np.searchsorted(k[order], key[run])  # of each run its hash
    low, high = np.full(len(k), len(docs)), np.full(len(k), -1)
    np.minimum.at(low, which, doc[run])
    np.maximum.at(high, which, doc[run])
    which_w = np.repeat(which, size)
    elsewhere, hot = elsewhere[order], hot[order]
    live = np.flatnonzero((elsewhere | (low < high))[which_w])
    if not len(live):
        return
    gone = repeated(data, at[live], docs[doc[live]])
    spans = b""
    if gone.any():
        spans = _zip(*(x.astype("<i8") for x in _spans(doc[live[gone]], offset[live[gone]])))
    sent = live[~gone]
    sent = sent[elsewhere[which_w[sent]]]
    is_hot = hot[which_w[sent]]
    sub = np.where(is_hot, (anchor[sent] - at[sent]) // HOT_RUN, -1)
    new = np.r_[True, (sent[1:] != sent[:-1] + 1) | begins[sent[1:]] | (sub[1:] != sub[:-1])] if len(sent) else np.empty(0, bool)
    first = np.flatnonzero(new)
    n = np.diff(np.r_[first, len(sent)])
    sub, is_hot, lead = sub[first], is_hot[first], sent[first]
    bucket = row["slice"] % buckets
    to = _part(key[lead], n_parts)
    to[is_hot] = (_part(_hash(data, anchor[lead[is_hot]] - HOT_RUN * sub[is_hot], WIDTH - HOT_RUN + 1), n_parts) + bucket) % n_parts
    yield from _pack(row["slice"], bucket, docs, data, doc[lead], offset[lead], at[lead], n, to, is_hot, spans, n_parts)


def _pack(slice_: int, bucket: int, docs, data, doc, place, start, n, to, is_hot, spans: bytes, n_parts: int):
    """Rows for the parts `to` of runs of n windows; hot runs have their bucket, others -1. spans go with any row."""
    code = 2 * to + is_hot
    order = np.lexsort((place, doc, code))
    code, doc, place, start, n = code[order], doc[order], place[order], start[order], n[order]
    begin = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.empty(0, np.int64)
    for a, b in zip(begin, np.r_[begin[1:], len(code)][: len(begin)], strict=True):
        size = n[a:b] + WIDTH - 1
        text = data[np.repeat(start[a:b] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        used, ordinal = np.unique(doc[a:b], return_inverse=True)
        arrays = (used.astype("<i4"), *(np.diff(x, prepend=0).astype("<i4") for x in (ordinal, place[a:b])), n[a:b].astype("u1"))  # differences take less space
        yield {"slice": slice_, "part": int(code[a]) >> 1, "bucket": bucket if code[a] & 1 else -1, "docs": docs[used].tobytes(), "counts": [len(used), int(b - a)], "body": _zip(*arrays, tail=text.tobytes()), "spans": spans}
        spans = b""
    if spans:
        yield {"slice": slice_, "part": slice_ % n_parts, "bucket": -1, "docs": b"", "counts": [0, 0], "body": b"", "spans": spans}


def _spans(ordinal: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge the windows at (document, offset), in any order: document, start, end of each run."""
    if not len(ordinal):
        return (np.empty(0, np.int64),) * 3
    order = np.lexsort((offset, ordinal))
    d, o = ordinal[order], offset[order]
    new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (o[1:] > o[:-1] + WIDTH)])
    last = np.r_[new[1:], len(d)] - 1
    return d[new], o[new], o[last] + WIDTH


def _judge(packed: list[dict], n_parts: int, fan: int, last: bool):
    """Removed spans of one part for each slice that sent something; before the last round also the hot runs that go on."""
    spans = [(x["slice"], x["spans"]) for x in packed if x["spans"]]
    packed = [x for x in packed if x["counts"][1]]
    got, texts, base = [], [], 0
    for x in packed:
        body, at, own = _unzip(x["body"]), 0, []
        u, k = x["counts"]
        for kind, size in (("<i4", u), ("<i4", k), ("<i4", k), ("u1", k)):
            own.append(np.frombuffer(body, kind, size, at).astype(np.int64))
            at += size * np.dtype(kind).itemsize
        own[1:3] = map(np.cumsum, own[1:3])
        x["body"] = b""
        docs = np.frombuffer(x["docs"], np.int64)
        size = own[3] + WIDTH - 1
        got.append((own[0][own[1]], docs[own[1]], own[2], own[3], base + np.cumsum(size) - size))
        texts.append(body[at:])
        base += int(size.sum())
    if packed:
        data = np.frombuffer(b"".join(texts) + b"\0" * 8, np.uint8)
        del texts
        _, owner, _, n, start = (np.concatenate(x) for x in zip(*got, strict=True))
        gone = outranked(data, start, n, owner)
        bounds = np.cumsum([int(x[3].sum()) for x in got])
        for x, (doc, owner, place, n, start), out in zip(packed, got, np.split(gone, bounds[:-1]), strict=True):
            run = np.repeat(np.arange(len(n)), n)
            within = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
            if out.any():
                spans.append((x["slice"], _zip(*(y.astype("<i8") for y in _spans(doc[run[out]], place[run[out]] + within[out])))))
            if x["bucket"] >= 0 and not last and not out.all():
                run, within = run[~out], within[~out]
                first = np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | (within[1:] != within[:-1] + 1)])
                run, within, n = run[first], within[first], np.diff(np.r_[first, len(run)])
                ids = np.zeros(int(doc.max()) + 1, np.int64)
                ids[doc] = owner
                bucket = x["bucket"] // fan
                to = np.full(len(run), (x["part"] - x["bucket"] + bucket) % n_parts)
                yield from _pack(x["slice"], bucket, ids, data, doc[run], place[run] + within, start[run] + within, n, to, np.ones(len(run), bool), b"", n_parts)
    for slice_, found in spans:
        yield {"slice": slice_, "part": None, "bucket": None, "docs": None, "counts": None, "body": None, "spans": found}


def _inputs(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), text.alias("text"))


def _by_group(f, schema, column: str = "part"):
    """mapInArrow function: f(rows of one value of a sorted column) -> rows."""

    def run(batches):
        held, at = [], None
        for batch in batches:
            for row in batch.to_pylist():
                if held and row[column] != at:
                    yield from _batches(f(held), schema)
                    held = []
                at = row[column]
                held.append(row)
        if held:
            yield from _batches(f(held), schema)

    return run


def _by_row(f, schema):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield from _batches(f(batch.slice(i, 1).to_pylist()[0]), schema)

    return run


def _batches(rows, schema, most: int = 256):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _cut(row: dict):
    docs, texts = _texts(row)
    found = [np.frombuffer(_unzip(x), "<i8").reshape(3, -1) for x in row["spans"] or ()]
    doc, a, b = np.concatenate(found, axis=1) if found else np.empty((3, 0), np.int64)
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    for i, data in enumerate(texts):
        begin, end = a[bounds[i] : bounds[i + 1]], np.maximum.accumulate(b[bounds[i] : bounds[i + 1]])
        if len(begin):
            new = np.r_[True, begin[1:] > end[:-1]]
            begin, end = begin[new], end[np.r_[np.flatnonzero(new)[1:], len(end)] - 1]
        kept = b"".join(data[x:y] for x, y in zip([0, *end.tolist()], [*begin.tolist(), len(data)], strict=True))
        doc_id = int(docs[i])
        yield {"doc_id": None if doc_id == LAST else doc_id, "kept": kept, "n_bytes": len(data), "n_removed": len(data) - len(kept), "n_spans": len(begin)}


def remove_repeats(documents: DataFrame, slice_bytes: int = SLICE, part_bytes: int = PART, hot_shards: int = HOT_SHARDS, fan: int = FAN) -> DataFrame:
    """doc_id, kept (binary), n_bytes, n_removed, n_spans of every document."""
    docs = _inputs(documents)

    def pack(batches):
        task = TaskContext.get().partitionId()
        for i, part in enumerate(slices(batches, most=slice_bytes)):
            texts = [t.encode() for t in part.column("text").to_pylist()]
            row = [[task << 32 | i], [part.column("doc").to_numpy().tobytes()], [np.array(list(map(len, texts)), np.int64).tobytes()], [_zip(tail=b"".join(texts))]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, sliced.types, strict=True)], names=sliced.names)

    sliced = _schema(_SLICE)
    shards = saved(docs.mapInArrow(pack, _SLICE), "none")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_parts = max(1, -(-total // part_bytes))
    buckets = max(1, -(-(total // slice_bytes) // fan))
    asks = shards.mapInArrow(_by_row(lambda row: _ask(row, n_parts), _schema(_ASKED)), _ASKED)
    answers = asks.repartitionById(n_parts, F.col("part")).sortWithinPartitions("part").mapInArrow(_by_group(lambda rows: _answer(rows, hot_shards), _schema(_ANSWERED)), _ANSWERED)
    by_shard = answers.groupBy("slice").agg(F.collect_list(F.struct("part", "bits")).alias("answers"))  # one for each part at most
    sent = shards.join(by_shard, "slice").select("slice", "docs", "sizes", "body", "answers")
    packed = sent.mapInArrow(_by_row(lambda row: _route(row, row["answers"], n_parts, fan, buckets), _schema(_PACKED)), _PACKED)
    spans = []
    while True:  # a single round up to `fan` shards; each further one takes only what is left of hot runs
        last = buckets == 1
        dealt = packed.repartitionById(n_parts, F.col("part")).sortWithinPartitions("part")
        judged = saved(dealt.mapInArrow(_by_group(lambda rows, last=last: _judge(rows, n_parts, fan, last), _schema(_PACKED)), _PACKED), "none")
        spans.append(judged.where("part is null").select("slice", "spans"))
        if last:
            break
        packed, buckets = judged.where("part is not null"), -(-buckets // fan)
    found = spans[0]
    for more in spans[1:]:
        found = found.union(more)
    found = found.groupBy("slice").agg(F.collect_list("spans").alias("spans"))
    return shards.join(found, "slice", "left").select("docs", "sizes", "body", "spans").mapInArrow(_by_row(_cut, _schema(_OUT)), _OUT)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Every window of every text as a row: for small tables.
OP5_SQL = """with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, row_number() over () as r from documents),
w as (select r, doc_id, i, substr(h, 2 * i + 1, 100) as s from (select r, doc_id, h, unnest(range(greatest(length(h) // 2 - 49, 0))) as i from d)),
m as (select s, min(doc_id) as least from w group by s having count(*) > 1),
g as (select r, i from w join m using (s) where doc_id > least),
k as (select r, i, sum(new) over (partition by r order by i) as n from (select r, i, case when i > lag(i) over (partition by r order by i) + 50 then 1 else 0 end as new from g)),
p as (select r, min(i) as a, max(i) + 50 as b from k group by r, n),
c as (select r, coalesce(lag(b) over (partition by r order by a), 0) as x, a as y from p union all select r, max(b), 1000000000 from p group by r),
kept as (select r, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' order by x) as h from c join d using (r) group by r),
n as (select r, sum(b - a)::bigint as n_removed, count(*) as n_spans from p group by r)
select doc_id, (length(d.h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept.h, d.h))) as kept_sha256
from d left join n using (r) left join kept using (r)"""


def brute(docs: list[tuple]) -> list[tuple]:
    """By definition, for tests: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    least: dict[bytes, int] = {}
    for doc, text in docs:
        data = (text or "").encode()
        for i in range(len(data) - WIDTH + 1):
            w = data[i : i + WIDTH]
            least[w] = min(least.get(w, LAST), LAST if doc is None else doc)
    out = []
    for doc, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - WIDTH + 1):
            if least[data[i : i + WIDTH]] < (LAST if doc is None else doc):
                gone[i : i + WIDTH] = b"\1" * WIDTH
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone, strict=True) if not g)).hexdigest()))
    return out
