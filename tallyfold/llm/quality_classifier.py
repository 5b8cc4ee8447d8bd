"""Quality: document scores by the Bradley-Terry model, learned from pairs of a better and a worse document.

A score is linear in a document's features, and the better one of a pair wins with the probability that a logistic function
gives the difference of their scores. So the loss is logistic on differences of features, over pairs of a document labelled 1
and one labelled 0. Documents are then kept from a quantile of the scores on.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, remainder_of_id

#: The training sample: labelled documents of either label, at most. Only their features reach the driver.
TRAIN_GOOD, TRAIN_BAD = 4000, 4000
#: Groups of word shapes, and the words of a window.
SHAPES, WINDOW = 96, 8
STEPS, PAIRS, FOLDS, PENALTY = 400, 4096, 4, 1e-3
THRESHOLD = 0.7
MOST_WORDS = 300_000
_words = re.compile(WORD).findall
_twice = re.compile(r"(.)\1+", re.DOTALL)
#: What is measured of a word: its length, shares of upper case, of digits, of marks and of exclamation, no letter at all, equal to the word before.
TRAITS = 7
#: Features: traits' means, their largest means in a window, figures of the whole text, and shares of shapes.
WHOLE = 6
WIDTH = 2 * TRAITS + WHOLE + SHAPES


class _Kinds(dict):
    """Characters by kind: letters by case, digits as 0, all else as it is."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = out = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return out


def outline_traits(outline: str) -> list[float]:
    """Traits of a word by the kinds of its characters, and the group of its shape, in which runs of one kind count once."""
    n, upper, digits = len(outline), outline.count("A"), outline.count("0")
    letters = upper + outline.count("a")
    marks = n - letters - digits - sum(map(outline.count, ".,;:!?'\"-()"))
    group = crc32(_twice.sub(r"\1", outline).encode("utf-8", "surrogatepass")) % SHAPES
    return [min(n, 40) / 10, upper / n if letters > 1 else 0.0, digits / n, marks / n, outline.count("!") / n, float(letters + digits == 0), group]


class Measurer:
    """Features of whole texts; each word's kinds of characters are found once, and measured once for all words that share them."""

    def __init__(self) -> None:
        self.kinds, self.words, self.outlines = _Kinds(), {}, {}
        self.outline_of, self.traits = [], np.zeros((1024, TRAITS))

    def features(self, text: str | None) -> np.ndarray:
        """WIDTH numbers of a text; a text without words has zeros."""
        out = np.zeros(WIDTH)
        words = _words(text or "")
        if not words:
            return out
        ids, outlines = self._known(words)
        rows = self.traits[outlines]
        shapes = rows[:, -1].astype(np.int64)
        rows[:, -1] = 0
        rows[1:, -1] = ids[1:] == ids[:-1]
        out[:TRAITS] = rows.mean(0)
        n = min(WINDOW, len(words))
        total = np.concatenate([np.zeros((1, TRAITS)), np.cumsum(rows, 0)])
        out[TRAITS : 2 * TRAITS] = ((total[n:] - total[:-n]) / n).max(0)
        lines = [x for x in text.split("\n") if x.strip()]
        distinct = len(np.unique(ids)) / len(ids)
        chars = sum(map(len, words))
        at = 2 * TRAITS
        out[at : at + WHOLE] = [1.0, np.log1p(len(words)), distinct * np.log1p(len(words)), 1 - len(set(lines)) / max(len(lines), 1), np.log1p(len(words) / max(len(lines), 1)), 1 - chars / max(len(text), 1)]
        out[at + WHOLE :] = np.sqrt(np.bincount(shapes, minlength=SHAPES) / len(words))
        return out

    def _known(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of words and of their outlines."""
        if len(self.words) > MOST_WORDS:
            self.words.clear()
            self.outline_of.clear()
        seen, outlines, of = self.words, self.outlines, self.outline_of
        if len(outlines) > MOST_WORDS:
            self.__init__()
            return self._known(words)
        ids = []
        for w in words:
            i = seen.get(w)
            if i is None:
                i = seen[w] = len(of)
                outline = w.translate(self.kinds)
                k = outlines.get(outline)
                if k is None:
                    k = outlines[outline] = len(outlines)
                    if k == len(self.traits):
                        self.traits = np.concatenate([self.traits, np.zeros_like(self.traits)])
                    self.traits[k] = outline_traits(outline)
                of.append(k)
            ids.append(i)
        return np.array(ids), np.array([of[i] for i in ids])


@dataclass
class Model:
    """Weights of centred and scaled features, and the score's slope and middle: the raw score where it is THRESHOLD."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    cut: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.raw(x) - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def rank_weights(better: np.ndarray, worse: np.ndarray, seed: int = 0) -> np.ndarray:
    """Weights by Adam on the logistic loss of differences of features, over pairs drawn anew in each step."""
    rng = np.random.default_rng(seed)
    w, first, second = (np.zeros(better.shape[1]) for _ in range(3))
    for step in range(1, STEPS + 1):
        d = better[rng.integers(len(better), size=PAIRS)] - worse[rng.integers(len(worse), size=PAIRS)]
        lost = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        grad = PENALTY * w - d.T @ lost / PAIRS
        first += 0.1 * (grad - first)
        second += 0.01 * (grad * grad - second)
        w -= 0.05 * (1 - step / (STEPS + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return w


def weighted_quantile(values: np.ndarray, weights: np.ndarray, share: float) -> float:
    """The middle between the last value within ``share`` of the weight and the next one."""
    order = np.argsort(values, kind="stable")
    v, total = values[order], np.cumsum(weights[order]) / weights.sum()
    i = int(np.searchsorted(total, share, side="right"))
    return float((v[max(i - 1, 0)] + v[min(i, len(v) - 1)]) / 2)


def train(x: np.ndarray, good: np.ndarray, share: float | None = None, seed: int = 0) -> Model:
    """A model from features and labels; share: of label 1 in all labelled documents, if the sample's is another.

    The cut is the quantile of scores below which there are as many documents as are labelled 0, and the slope makes probabilities
    of scores. Both come from scores of documents that were left out (FOLDS parts). With one label only all documents score alike.
    """
    x, y = np.asarray(x, np.float64).reshape(-1, WIDTH), np.asarray(good, np.float64)
    if not len(y) or y.min() == y.max():
        sure = y.mean() if len(y) else 0.5
        odds = np.log(0.99 / 0.01) * (2 * sure - 1)
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 1.0, float(np.log(THRESHOLD / (1 - THRESHOLD)) - odds))
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = np.clip((x - centre) / scale, -8, 8)
    folds = np.empty(len(y), np.int64)
    for label in (0, 1):  # each part has its share of either label
        folds[y == label] = np.arange((y == label).sum()) % FOLDS
    raw = np.zeros(len(y))
    weights = rank_weights(z[y == 1], z[y == 0], seed)
    for f in range(FOLDS):
        rest, own = folds != f, folds == f
        both = y[rest].min() < y[rest].max()
        raw[own] = z[own] @ (rank_weights(z[rest & (y == 1)], z[rest & (y == 0)], seed) if both else weights)
    share = min(max(y.mean() if share is None else share, 1e-4), 1 - 1e-4)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    cut = weighted_quantile(raw, weight, 1 - share)
    return Model(centre, scale, weights, _slope(raw - cut, y, weight), cut)


def _slope(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The slope of a logistic curve through THRESHOLD at 0 that fits labels best, by bisection on the derivative."""
    base, low, high = np.log(THRESHOLD / (1 - THRESHOLD)), 0.05, 20.0
    for _ in range(60):
        a = (low + high) / 2
        p = 1 / (1 + np.exp(-np.clip(a * raw + base, -30, 30)))
        low, high = (a, high) if (weight * (y - p) * raw).sum() > 0 else (low, a)
    return float((low + high) / 2)


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float | None]:
    """Features, labels and the share of label 1 in all labelled documents that are not held out.

    Of either label a bounded sample is drawn by a hash of the id. Executors measure whole texts, and only features are collected. A document
    with several labels is good if all say so; of rows with the same id the smallest text counts.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (remainder_of_id() != 2))
    known = known.groupBy(F.col("doc_id").alias("_qc_id")).agg(F.min(F.col("quality").cast("int")).alias("_qc_good"))
    share = known.agg(F.avg("_qc_good")).first()[0]
    order = [F.md5(F.col("_qc_id").cast("string").cast("binary")), "_qc_id"]
    some = known.where("_qc_good = 1").orderBy(*order).limit(TRAIN_GOOD).unionByName(known.where("_qc_good = 0").orderBy(*order).limit(TRAIN_BAD))
    joined = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_qc_id"))
    texts = joined.groupBy("_qc_id", "_qc_good").agg(F.min("text").alias("text"))

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measurer = Measurer()
        for whole in batches:
            for i in range(0, whole.num_rows, 200):
                b = whole.slice(i, 200)
                found = [measurer.features(t).astype(np.float32).tolist() for t in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.float32()))], names=["id", "good", "x"])

    rows = texts.select(F.col("_qc_id").cast("bigint").alias("id"), F.col("_qc_good").alias("good"), "text").mapInArrow(measure, "id long, good int, x array<float>").collect()
    rows.sort(key=lambda r: r["id"])
    return np.array([r["x"] for r in rows], np.float64).reshape(-1, WIDTH), np.array([r["good"] for r in rows], np.int64), share


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    return train(*training_sample(docs, labels))


def quality_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document, one row for each input row.

    The score depends on the text alone. Null texts, and texts without words, have the score of zero features. Whole texts of any length
    are read; columns other than doc_id and text are not.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measurer = Measurer()
        for whole in batches:
            for i in range(0, whole.num_rows, 200):
                b = whole.slice(i, 200)
                score = model.score(np.stack([measurer.features(t) for t in b.column(1).to_pylist()]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def best_scores(scores: DataFrame, share: float, accuracy: int = 10_000) -> DataFrame:
    """The rows of ``scores`` from the quantile on above which a share of all lies; equal scores stay together.

    The quantile is ``percentile_approx``, a mergeable sketch whose rank is off by 1 / accuracy at most.
    """
    cut = scores.agg(F.percentile_approx("score", F.lit(1.0 - share), F.lit(accuracy)).alias("_qc_cut"))
    return scores.join(F.broadcast(cut), F.col("score") >= F.col("_qc_cut")).drop("_qc_cut")


def quality_report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from the threshold on) of every document."""
    out = quality_scores(docs, fit(docs, labels))
    return out.select("doc_id", (remainder_of_id() == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
