"""Toxicity: bags of subword embeddings, averaged into a linear softmax and trained jointly."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder_of_id

#: The training sample: documents with label 1 and with label 0, at most. Their whole texts are used.
TRAIN_TOXIC, TRAIN_CLEAN = 1000, 3000
BUCKETS, WIDTH, GRAMS = 1 << 17, 8, (3, 4, 5, 6)
#: Words of a window. A document's features are the logits of its most toxic window's average and of its whole bag's average.
WINDOW = 2
#: Subwords of fewer training documents are nothing to learn from, and stay zero.
LEAST_DOCUMENTS = 4
ROUNDS_ALL, ROUNDS_MAX, FOLDS = 40, 40, 2
THRESHOLD = 0.3
MOST_WORDS = 400_000


@dataclass
class Model:
    """Subword embeddings, the softmax's two rows and biases, and the scale of document scores."""

    table: np.ndarray
    rows: np.ndarray
    bias: np.ndarray
    scale: tuple[float, ...]

    def subword_logits(self) -> np.ndarray:
        """What each subword adds to the difference of the two logits; averages of these are windows' logits."""
        return self.table @ (self.rows[1] - self.rows[0])


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams of each word in brackets, and where each word's begin."""
    raw = [b"<" + w.encode("utf-8", "surrogatepass") + b">" for w in words]
    sizes = np.array([len(r) for r in raw], np.int64)
    codes = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    left = np.repeat(start + sizes, sizes) - np.arange(len(codes))
    word = np.repeat(np.arange(len(words)), sizes)
    found, owner = [], []
    key = np.zeros(len(codes), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        shifted = np.zeros(len(codes), np.uint64)
        shifted[: len(codes) - n + 1] = codes[n - 1 :]
        key = (key + shifted + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
        if n in GRAMS:
            on = left >= n
            found.append((key[on] + np.uint64(n)) % np.uint64(BUCKETS))
            owner.append(word[on])
    buckets, owners = np.concatenate(found).astype(np.int64), np.concatenate(owner)
    order = np.argsort(owners, kind="stable")
    return buckets[order], np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(words)))[:-1]]).astype(np.int64)


def word_means(values: np.ndarray, buckets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    sizes = np.diff(np.append(starts, len(buckets)))
    return np.add.reduceat(values[buckets], starts) / sizes


class Bags:
    """Subwords of many words, in chunks of words, so what is worked on at once is small."""

    def __init__(self, words: list[str], chunk: int = 20_000) -> None:
        self.words, self.chunks = len(words), []
        for i in range(0, len(words), chunk):
            buckets, starts = subwords(words[i : i + chunk])
            sizes = np.diff(np.append(starts, len(buckets)))
            self.chunks.append((slice(i, i + len(starts)), buckets.astype(np.int32), starts, sizes))

    def means(self, values: np.ndarray) -> np.ndarray:
        """The mean of each word's subwords' values."""
        return np.concatenate([word_means(values, buckets, starts) for _, buckets, starts, _ in self.chunks])

    def documents(self, texts: list[np.ndarray]) -> np.ndarray:
        """How many texts (of word numbers) each subword occurs in."""
        flat, sizes = np.concatenate([b for _, b, _, _ in self.chunks]), np.concatenate([s for *_, s in self.chunks])
        starts, total = np.cumsum(sizes) - sizes, np.zeros(BUCKETS, np.int64)
        for own in texts:
            own = np.unique(own)
            n = sizes[own]
            total[np.unique(flat[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[own], n)])] += 1
        return total

    def spread(self, by_word: np.ndarray) -> np.ndarray:
        """For each subword the sum of what its words hand to it, in equal parts to all their subwords."""
        total = np.zeros(BUCKETS)
        for at, buckets, _, sizes in self.chunks:
            total += np.bincount(buckets, np.repeat(by_word[at] / sizes, sizes), BUCKETS)
        return total


def words_of(text: str) -> list[str]:
    return text.lower().split()


def windows(ends: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and past-the-last words, and documents, of all windows of documents laid end to end.

    A document of fewer words is one window; ends: where documents end, each with a word at least.
    """
    begin = np.concatenate([[0], ends[:-1]])
    owner = np.repeat(np.arange(len(ends)), ends - begin)
    first = np.arange(len(owner))
    last = np.minimum(first + width, ends[owner])
    on = (first + width <= ends[owner]) | (first == begin[owner])
    return first[on], last[on], owner[on]


def train(texts: list[list[str]], toxic: np.ndarray, share: float | None = None, seed: int = 0) -> Model:
    """Embeddings and softmax by Adam on whole passes.

    First every window has its document's label; then only the window that the model holds for the most toxic
    of its document has it, and by and by the words that make documents toxic stand out. All sums over
    windows run over subwords, as a word's vector is the mean of its subwords' vectors. The average over a whole
    document alone is too weak where a few words of many make it toxic, so both are features. Scores are made
    probabilities on documents that the model which scored them has not seen; share: of toxic documents in all
    labelled ones, if the sample's is another.
    """
    kept = [i for i, t in enumerate(texts) if t]
    texts, y = [texts[i] for i in kept], toxic[kept].astype(np.float64)
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.0
        return Model(np.zeros((BUCKETS, WIDTH)), np.zeros((2, WIDTH)), np.zeros(2), (0.0, 0.0, 0.0, float(np.log(max(rate, 1e-3) / (1 - min(rate, 0.999))))))
    model = _train(texts, y, seed)
    folds = np.arange(len(y)) % FOLDS
    tops = np.zeros((len(y), 2))
    for f in range(FOLDS):
        rest = np.flatnonzero(folds != f)
        own = np.flatnonzero(folds == f)
        if len(own) == 0 or y[rest].min() == y[rest].max():
            continue
        part = _train([texts[i] for i in rest], y[rest], seed)
        tops[own] = Scorer(part.subword_logits(), part.bias, part.scale).tops([" ".join(texts[i]) for i in own])[0]
    own_share = y.mean()
    share = own_share if share is None else min(max(share, 1e-4), 1 - 1e-4)
    weight = np.where(y > 0, share / own_share, (1 - share) / (1 - own_share))
    model.scale = calibrate(tops, np.array([len(t) for t in texts]), y, weight)
    return model


def _train(texts: list[list[str]], y: np.ndarray, seed: int) -> Model:
    rng = np.random.default_rng(seed)
    model = Model(rng.uniform(-1, 1, (BUCKETS, WIDTH)) / WIDTH, rng.uniform(-0.1, 0.1, (2, WIDTH)), np.zeros(2), (1.0, 0.0, 0.0, 0.0))
    vocabulary: dict[str, int] = {}
    ids = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for t in texts for w in t), np.int64)
    ends = np.cumsum([len(t) for t in texts])
    bags = Bags(list(vocabulary))
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    all_first, all_last, all_owner = windows(ends)
    begin = np.searchsorted(all_owner, np.arange(len(y)))
    live = (bags.documents(np.split(ids, ends[:-1])) >= LEAST_DOCUMENTS)[:, None]
    model.table *= live
    values = [model.table, model.rows, model.bias]
    first_m, second_m = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for step in range(1, ROUNDS_ALL + ROUNDS_MAX + 1):
        u = model.rows[1] - model.rows[0]
        total = np.concatenate([[0.0], np.cumsum(bags.means(model.subword_logits())[ids])])
        first, last, owner = all_first, all_last, all_owner
        means = (total[last] - total[first]) / (last - first)
        if step > ROUNDS_ALL:
            best = np.flatnonzero(means == np.maximum.reduceat(means, begin)[owner])
            top = best[np.searchsorted(owner[best], np.arange(len(y)))]
            means, first, last, owner = means[top], first[top], last[top], owner[top]
        share = weight[owner] / np.bincount(owner, minlength=len(y))[owner]
        p = 1 / (1 + np.exp(-(means + model.bias[1] - model.bias[0])))
        g = (p - y[owner]) * share
        per = g / (last - first)
        edge = np.bincount(first, per, len(ids) + 1) - np.bincount(last, per, len(ids) + 1)
        by_bucket = bags.spread(np.bincount(ids, np.cumsum(edge)[:-1], bags.words))
        d_u = by_bucket @ model.table
        grads = [(by_bucket[:, None] * u + 1e-7 * model.table) * live, np.stack([-d_u, d_u]), np.array([-g.sum(), g.sum()])]
        for v, d, m, s in zip(values, grads, first_m, second_m, strict=True):
            m += 0.1 * (d - m)
            s += 0.02 * (d * d - s)
            v -= 0.03 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.98**step)) + 1e-9)
    return model


def features(tops: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """A longer text has more windows, so its largest logit says less."""
    return np.stack([tops[:, 0], tops[:, 1], np.log1p(n_words), np.ones(len(tops))], axis=1)


def calibrate(tops: np.ndarray, n_words: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Weights of the features that make probabilities of them, by Newton's method with a small penalty."""
    x, start = features(tops, n_words), np.array([1.0, 0.0, 0.0, 0.0])
    w, penalty = start.copy(), 1e-3 * np.array([1.0, 1.0, 1.0, 1e-3])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) / len(y) + penalty * (w - start)
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x / len(y) + np.diag(penalty)
        move = np.clip(np.linalg.solve(hess, grad), -1, 1)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return tuple(map(float, w))


class Scorer:
    """Scores of whole texts; the subwords of a word are looked up once."""

    def __init__(self, logits: np.ndarray, bias: np.ndarray, scale: tuple[float, ...]) -> None:
        self.logits, self.shift, self.scale = logits, bias[1] - bias[0], np.array(scale)
        self.memo: dict[str, int] = {}
        self.words = np.zeros(0)

    def tops(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of each text's most toxic window and of all its words, neutral without words, and the texts' words."""
        memo, new, rows = self.memo, [], []
        if len(memo) > MOST_WORDS:
            memo.clear()
            self.words = self.words[:0]
        for text in texts:
            row = []
            for w in words_of(text or ""):
                i = memo.get(w)
                if i is None:
                    i = memo[w] = len(self.words) + len(new)
                    new.append(w)
                row.append(i)
            rows.append(row)
        if new:
            self.words = np.concatenate([self.words, word_means(self.logits, *subwords(new))])
        top = np.zeros((len(rows), 2))
        for i, row in enumerate(rows):
            if row:
                z = self.words[row]
                total = np.concatenate([[0.0], np.cumsum(z)])
                n = min(WINDOW, len(row))
                top[i] = (total[n:] - total[:-n]).max() / n, total[-1] / len(row)
        return top + self.shift, np.array([len(row) for row in rows])

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = features(*self.tops(texts)) @ self.scale
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[list[str]], np.ndarray, float | None]:
    """Texts, labels and the share of toxic documents in all labelled ones, from a bounded sample of labelled rows that are not held out, chosen by a hash.

    A document with several labels is toxic if one says so; of rows with the same id the smallest text counts. Texts are used whole.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder_of_id() != 2))
    known = known.groupBy(F.col("doc_id").alias("_tx_id")).agg(F.max(F.col("toxic").cast("int")).alias("_tx_toxic"))
    share = known.agg(F.avg("_tx_toxic")).first()[0]
    order = [F.md5(F.col("_tx_id").cast("string").cast("binary")), "_tx_id"]
    some = known.where("_tx_toxic = 1").orderBy(*order).limit(TRAIN_TOXIC).unionByName(known.where("_tx_toxic = 0").orderBy(*order).limit(TRAIN_CLEAN))
    joined = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(some), F.col("doc_id") == F.col("_tx_id"))
    rows = joined.groupBy("_tx_id", "_tx_toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r["_tx_id"])
    same: dict[str, str] = {}
    return [[same.setdefault(w, w) for w in words_of(r["text"])] for r in rows], np.array([r["_tx_toxic"] for r in rows], np.int64), share


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    return train(*training_sample(docs, labels))


def toxicity_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document, one row for each input row.

    The score depends on the text alone. Texts that are null or have no word get the score of a neutral window.
    Whole texts of any length are read; columns other than doc_id and text are not.
    """
    bias, scale = model.bias, model.scale
    shared = docs.sparkSession.sparkContext.broadcast(model.subword_logits().astype(np.float32))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, bias, scale)
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                b = whole.slice(i, 500)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scorer.score(b.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def toxicity_report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from the threshold on) of every document."""
    out = toxicity_scores(docs, fit(docs, labels))
    return out.select("doc_id", (remainder_of_id() == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
