"""Quality rules with an isolation forest on the rules' statistics.

Each document's statistics are computed in one pass over its whole text. Each rule's statistic is divided by the
rule's limit and clipped to 0..2, so that random splits cut between "within the rule" and "beyond it". The trees are
grown on labelled good rows that pass the base rules, with split values drawn over the range that all labelled rows
span: where junk lies and good rows do not, a split isolates at once and the path is short. The threshold on the
anomaly score is calibrated on the labelled rows: the best difference of caught junk and lost good rows among the
thresholds that lose at most `most_lost` of the good rows; of equal ones the one that keeps more.

The fit takes at most about `max_labelled` labelled rows, drawn by a hash of doc_id; everything else covers all rows.

Cases: null, empty and blank texts have no words and fail the base rules; without usable labelled rows of both
classes only the base rules decide; rows with a null label or doc_id are not used in the fit; repeated rows are
judged alike, and a score equal to the threshold is kept; empty tables give empty results; other columns pass through, and
a new column whose name is taken gets underscores after it; a very long text is measured whole.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, sampled, table

#: Fixed values of the base rules.
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\r\x0b\x0c"
#: The rules' limits: symbols a word, share of repeated lines, share of words in repeated windows, mean word length.
SYMBOLS_A_WORD = 0.1
DUPLICATE_LINES = 0.3
REPEATED_WORDS = 0.5
WORD_LENGTH = (3.0, 10.0)

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def repeated_words(words: list) -> int:
    """Words that stand in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    v = len(ids)
    if v >= 1 << 21:  # three ids don't fit one long: number the pairs first
        pair = np.unique(x[:-1] * v + x[1:], return_inverse=True)[1]
        keys = pair[:-1] * v + x[2:]
    else:
        keys = (x[:-2] * v + x[1:-1]) * v + x[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    mark = np.zeros(n, dtype=bool)
    at = np.concatenate([order[1:][same], order[:-1][same]])
    for k in range(3):
        mark[at + k] = True
    return int(mark.sum())


def statistics(text: str | None) -> tuple[int, ...]:
    t = text or ""
    words = t.encode().split()  # on bytes: space and \t to \r only
    lines = [x for x in t.split("\n") if x.strip(BLANKS)]
    return len(words), len(t) - sum(map(t.count, BLANKS)), sum(map(t.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def base_failed(s: np.ndarray) -> np.ndarray:
    return (s[:, 0] < LEAST_WORDS) | (100 * s[:, 4] > MOST_REPEATED_PERCENT * s[:, 0])


def features(s: np.ndarray) -> np.ndarray:
    n, lines = np.maximum(s[:, 0], 1), np.maximum(s[:, 5], 1)
    length = s[:, 1] / n
    low, high = WORD_LENGTH
    beyond = np.maximum(low - length, 0) / low + np.maximum(length - high, 0) / high
    return np.clip(np.c_[s[:, 2] / n / SYMBOLS_A_WORD, s[:, 3] / lines / DUPLICATE_LINES, s[:, 4] / n / REPEATED_WORDS, 2 * beyond], 0, 2)


def _expected(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Complete binary trees in arrays: node i has the children 2i + 1 and 2i + 2."""

    def __init__(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, n_trees: int = 128, sample: int = 256, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.sample = min(sample, len(rows))
        self.depth = max(1, math.ceil(math.log2(max(2, self.sample))))
        size = 2 ** (self.depth + 1) - 1
        self.feature = np.full((n_trees, size), -1, dtype=np.int16)
        self.value = np.zeros((n_trees, size))
        self.path = np.zeros((n_trees, size))
        for t in range(n_trees):
            self._grow(t, 0, 0, rows[rng.choice(len(rows), self.sample, replace=False)], low.copy(), high.copy(), rng)

    def _grow(self, t, node, depth, rows, low, high, rng) -> None:
        open_ = np.flatnonzero(high > low)
        if depth == self.depth or len(rows) <= 1 or not len(open_):
            self.path[t, node] = depth + _expected(len(rows))
            return
        f = rng.choice(open_)
        v = rng.uniform(low[f], high[f])
        self.feature[t, node], self.value[t, node] = f, v
        left = rows[:, f] < v
        below, above = high.copy(), low.copy()
        below[f] = above[f] = v
        self._grow(t, 2 * node + 1, depth + 1, rows[left], low, below, rng)
        self._grow(t, 2 * node + 2, depth + 1, rows[~left], above, high, rng)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for anomalies."""
        total, at = np.zeros(len(rows)), np.arange(len(rows))
        for t in range(len(self.feature)):
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(self.depth):
                f = self.feature[t, node]
                step = 2 * node + 1 + (rows[at, np.maximum(f, 0)] >= self.value[t, node])
                node = np.where(f >= 0, step, node)
            total += self.path[t, node]
        return 2 ** (-total / len(self.feature) / max(float(_expected(self.sample)), 1e-9))


def calibrate(documents: DataFrame, labels: DataFrame, max_labelled: int = 20_000, most_lost: float = 0.005) -> tuple[IsolationForest, float] | None:
    """The forest and the largest score that is kept; None where the labels don't hold both classes."""
    usable = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null")
    n = usable.count()
    usable = sampled(usable, "doc_id", max_labelled / max(n, 1))
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    found = _measured(docs.join(F.broadcast(usable), "doc_id")).drop("doc_id").collect()  # bounded by max_labelled
    if not found:
        return None
    rows = np.array([tuple(r[1:]) for r in found], dtype=float)
    good = np.array([r.quality == 1 for r in found])
    passed = ~base_failed(rows)
    rows, good = features(rows[passed]), good[passed]
    if good.sum() < 2 or good.all():
        return None
    rows, good = (x[np.lexsort((*rows.T, good))] for x in (rows, good))  # the same fit whatever the order of rows
    forest = IsolationForest(rows[good], rows.min(axis=0), rows.max(axis=0))
    score = forest.score(rows)
    return forest, _threshold(score[good], score[~good], most_lost)


def _threshold(good: np.ndarray, junk: np.ndarray, most_lost: float) -> float:
    """Half-way between the best cut and the next score below."""
    cuts = np.unique(np.r_[good, junk])
    lost = 1 - np.searchsorted(np.sort(good), cuts, "right") / len(good)
    caught = 1 - np.searchsorted(np.sort(junk), cuts, "right") / len(junk)
    gain = np.where(lost <= most_lost, caught - lost, -1)
    best = int(len(gain) - 1 - np.argmax(gain[::-1]))
    return float(cuts[best] + cuts[min(best + 1, len(cuts) - 1)]) / 2


def _measured(documents: DataFrame) -> DataFrame:
    names = [x.split()[0] for x in STATS.split(", ")]

    def make():
        return lambda texts: dict(zip(names, np.array(list(map(statistics, texts)), dtype=np.int64).reshape(-1, len(names)).T, strict=True))

    return map_texts(documents, make, STATS)


def assess(documents: DataFrame, model: tuple[IsolationForest, float] | None, column: str = "text") -> DataFrame:
    """All columns but the text column, and the statistics, base_failed, score (null without a model) and kept."""
    names = [x.split()[0] for x in STATS.split(", ")]
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        fitted = shared.value

        def judge(texts):
            rows = np.array(list(map(statistics, texts)), dtype=np.int64).reshape(-1, len(names))
            failed = base_failed(rows)
            out = dict(zip(names, rows.T, strict=True)) | {"base_failed": failed, "score": [None] * len(rows), "kept": ~failed}
            if fitted:
                score = fitted[0].score(features(rows.astype(float)))
                out |= {"score": score, "kept": ~failed & (score <= fitted[1])}
            return out

        return judge

    return map_texts(documents, make, f"{STATS}, base_failed boolean, score double, kept boolean", column)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = calibrate(documents, table(spark, sf_dir, "labels"))
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return assess(docs, model).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 6).alias("score"))
