"""Language identification as multilingual mixture inference.

Each language has a distribution over hashed byte trigrams of lower-cased words, learned from labelled documents. A
document is a mixture of languages: expectation-maximisation over its distinct trigrams gives the proportions. The set
of languages is chosen by penalised likelihood: of the nested sets of the one to `most_languages` largest languages,
each refitted, the one with the best log-likelihood less half a log count for each language. Trigrams overlap, so
log-likelihoods count a third. The prediction is the largest proportion in the chosen set.

Learning uses labelled documents outside the held-out quarter only, at most about `max_train` of them by a hash of
doc_id. Predictions see nothing but the text. Work is done on numpy arrays over a few megabytes of text at a time.

Cases: null texts and texts without a letter give `und` with score 0, as does everything if no document is labelled;
empty tables give empty results; repeated rows are judged alike; of equal shares the language first by name counts; other
columns pass through, and a new column whose name is taken gets underscores after it; a very long text is read whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, sampled, slices, table

BITS = 16
UNKNOWN = "und"
_BLANK = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_LETTER = re.compile(r"[^\W\d_]")


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text index, trigram bin) of the texts, sorted, with counts. Whole texts, words framed by blanks."""
    parts = [b" " + b" ".join((t or "").lower().encode().translate(_BLANK).split()) + b" " for t in texts]
    sizes = np.array([max(len(p) - 2, 0) for p in parts], dtype=np.int64)
    flat = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.uint32)
    if len(flat) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    code = flat[:-2] | flat[1:-1] << np.uint32(8) | flat[2:] << np.uint32(16)
    bins = (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    starts = np.cumsum([0, *map(len, parts[:-1])])
    at = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keys = np.sort(np.repeat(np.arange(len(parts), dtype=np.uint64), sizes) << np.uint64(BITS) | bins[at].astype(np.uint64))
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    count = np.diff(np.r_[first, len(keys)])
    return (keys[first] >> np.uint64(BITS)).astype(np.int64), (keys[first] & np.uint64((1 << BITS) - 1)).astype(np.int64), count


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2


def train(documents: DataFrame, max_train: int = 20_000) -> tuple[list[str], np.ndarray] | None:
    """Language names and their trigram distributions (bins x languages)."""
    usable = documents.where(F.coalesce(~held_out(), F.lit(False)) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = usable.count()
    usable = usable.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    usable = sampled(usable, "doc_id", max_train / max(n, 1))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for part in slices(batches):
            langs = part.column("lang").to_pylist()
            doc, bin_, k = grams(part.column("text").to_pylist())
            for name in set(langs):
                own = np.array([x == name for x in langs])[doc]
                sums[name] = sums.get(name, 0) + np.bincount(bin_[own], k[own], 1 << BITS)
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.float64())], names=["lang", "bin", "n"])

    counted = usable.select("lang", "text").mapInArrow(count, "lang string, bin int, n double").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    if counted.empty:  # at most one row for each language and bin
        return None
    names = sorted(counted["lang"].unique())
    table_ = np.zeros((1 << BITS, len(names)))
    np.add.at(table_, (counted["bin"].to_numpy(), counted["lang"].map({x: i for i, x in enumerate(names)}).to_numpy()), counted["n"].to_numpy())
    total = table_.sum(axis=0)
    background = table_.sum(axis=1, keepdims=True) + 0.5
    background /= background.sum()
    return names, ((table_ + 1000 * background) / (total + 1000)).astype(np.float32)


def _em(p: np.ndarray, count: np.ndarray, doc: np.ndarray, first: np.ndarray, n: np.ndarray, weight: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (texts x languages) after some rounds, and the log-likelihood of each text."""
    for _ in range(rounds):
        r = p * weight[doc]
        s = r.sum(axis=1)
        r *= (count / s)[:, None]
        weight = np.add.reduceat(r, first, axis=0) / n[:, None]
    s = np.einsum("ij,ij->i", p, weight[doc])
    return weight, np.add.reduceat(count * np.log(np.maximum(s, 1e-30)), first)


def proportions(texts: list[str | None], p: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Language proportions of each text over the chosen set; zeros for texts without trigrams."""
    out = np.zeros((len(texts), p.shape[1]), dtype=np.float32)
    doc, bin_, count = grams(texts)
    if not len(doc):
        return out
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    which, dense = doc[first], np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(doc)]))
    count = count.astype(np.float32)
    n = np.add.reduceat(count, first)
    q = p[bin_]
    languages = p.shape[1]
    weight, _ = _em(q, count, dense, first, n, np.full((len(first), languages), 1 / languages, np.float32), rounds)
    order = np.argsort(-weight, axis=1, kind="stable")
    single = np.add.reduceat(count[:, None] * np.log(q), first, axis=0)
    top = np.argmax(single, axis=1)
    best = np.zeros_like(weight)
    best[np.arange(len(first)), top] = 1
    penalty = 0.5 * np.log(np.maximum(n, 2))
    value = single[np.arange(len(first)), top] / 3 - penalty
    for k in range(2, languages + 1):  # nested sets, until no text gains by one more
        keep = np.zeros_like(weight)
        np.put_along_axis(keep, order[:, :k], 1, axis=1)
        start = keep * np.maximum(weight, 1e-3)
        refit, fit = _em(q, count, dense, first, n, start / start.sum(axis=1, keepdims=True), max(2, rounds // 2))
        better = fit / 3 - k * penalty > value
        if not better.any():
            break
        best[better], value[better] = refit[better], (fit / 3 - k * penalty)[better]
    out[which] = best
    return out


def identify(documents: DataFrame, model: tuple[list[str], np.ndarray] | None) -> DataFrame:
    """All columns but text, and lang_pred, score and languages (name and share of the chosen set, largest first)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        fitted = shared.value

        def predict(texts):
            out = {"lang_pred": [UNKNOWN] * len(texts), "score": [0.0] * len(texts), "languages": [[]] * len(texts)}
            if fitted:
                names, p = fitted
                for i, w in enumerate(proportions(texts, p)):
                    if texts[i] and _LETTER.search(texts[i]):
                        order = np.argsort(-w, kind="stable")
                        out["lang_pred"][i], out["score"][i] = names[order[0]], min(1.0, float(w[order[0]]))
                        out["languages"][i] = [{"lang": names[k], "share": float(w[k])} for k in order if w[k] > 0]
            return out

        return predict

    return map_texts(documents, make, "lang_pred string, score double, languages array<struct<lang:string,share:double>>")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = train(documents)
    found = identify(documents.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", F.round("score", 4).alias("score"))
