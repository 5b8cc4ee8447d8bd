"""Periodic runs of words: an online sparse dynamic programme over diagonals, the lags at which words repeat.

For each word the earlier places where the same words stand are lags, and a lag that was matched right before grows by one. When
a lag is matched no longer its run is told at once, if it is long enough. A run of period q has q words at
least, and six in any case, that equal those q words before. So lags from W to 2 W - 1 (W a power of two from 8 on)
are only looked for where W words repeat within that distance, and shorter lags where six do: a lag then enters with
that length, and every lag that can make a run still does. Within a run, further periods are multiples of its own and tell
nothing new, so a window of at least two periods of a known run looks only before that run.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD

#: A run has at least so many words, and two periods.
LEAST = 12
#: Words that are worked on at once, unless one text has more.
CHUNK = 200_000
_words = re.compile(WORD).findall

Run = tuple[int, int, int]  # start, length, period


def _numbered(texts: list[list[str]]) -> np.ndarray:
    """Numbers of words laid end to end; a word has one number in a text and another in the next, -1 if it stands there once."""
    sizes = [len(t) for t in texts]
    memo: dict[str, int] = {}
    word = np.fromiter((memo.setdefault(w, len(memo)) for t in texts for w in t), np.int64, sum(sizes))
    return _repeated(np.repeat(np.arange(len(texts)), sizes) * (len(memo) + 1) + word, np.arange(len(word)), len(word))


def _repeated(keys: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """For n places the numbers of the keys that stand at some of them, -1 elsewhere and for keys that stand once."""
    out = np.full(n, -1, np.int64)
    if len(keys):
        _, number, counts = np.unique(keys, return_inverse=True, return_counts=True)
        more = counts[number] > 1
        out[at[more]] = number[more]
    return out


def _longer(codes: np.ndarray, shift: int) -> np.ndarray:
    """Numbers of repeated windows that are longer by ``shift`` than those that codes number."""
    n = len(codes)
    if shift >= n:
        return np.full(n, -1, np.int64)
    a, b = codes[:-shift], codes[shift:]
    at = np.flatnonzero((a >= 0) & (b >= 0))
    return _repeated(a[at] * (n + 1) + b[at], at, n)


def _diagonals(codes: np.ndarray, window: int, lags: range, runs: dict[tuple[int, int], int]) -> None:
    """Adds the runs of some lags, (start, length) -> smallest period, going through the places of repeated windows in order."""
    at = np.flatnonzero(codes >= 0)
    if not len(at):
        return
    order = at[np.argsort(codes[at], kind="stable")]
    code = codes[order]
    fresh = np.concatenate([[True], code[1:] != code[:-1]])
    head = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    # The places from which on a window has nothing new to find, as it lies in a known run.
    before = np.full(len(codes), len(codes), np.int64)
    for (start, length), period in runs.items():
        if 2 * period <= window <= length:
            before[start : start + length - window + 1] = start
    last = np.concatenate([[-1], order[:-1]])
    live = ~fresh & (order - last < lags.stop) & (order[head] <= np.minimum(order - lags.start, before[order] - 1))
    ranks = np.flatnonzero(live)
    ranks = ranks[np.argsort(order[ranks], kind="stable")]
    places, heads, bounds = order.tolist(), head[ranks].tolist(), before[order[ranks]].tolist()
    active: dict[int, int] = {}
    word = -1

    def close(lag: int, matched: int, end: int) -> None:
        length = matched + lag
        if length >= max(LEAST, 2 * lag):
            key = end + window - length, length
            runs[key] = min(lag, runs.get(key, lag))

    for rank, first, bound in zip(ranks.tolist(), heads, bounds, strict=True):
        here = places[rank]
        if here != word + 1:
            for lag, matched in active.items():
                close(lag, matched, word)
            active = {}
        low = bisect_left(places, here - lags.stop + 1, first, rank)
        high = bisect_right(places, min(here - lags.start, bound - 1), low, rank)
        grown = {here - p: active.pop(here - p, window - 1) + 1 for p in places[low:high]}
        for lag, matched in active.items():
            close(lag, matched, word)
        active, word = grown, here
    for lag, matched in active.items():
        close(lag, matched, word)


def runs_of(texts: list[list[str]]) -> list[list[Run]]:
    """All runs of each text (a list of words), by start and then period."""
    one = _numbered(texts)
    four = _longer(_longer(one, 1), 2)
    runs: dict[tuple[int, int], int] = {}
    _diagonals(_longer(four, 2), 6, range(1, 8), runs)
    window, codes = 8, _longer(four, 4)
    most = max(map(len, texts), default=0)
    while 2 * window <= most and (codes >= 0).any():
        _diagonals(codes, window, range(window, 2 * window), runs)
        codes, window = _longer(codes, window), 2 * window
    ends = np.cumsum([len(t) for t in texts])
    out: list[list[Run]] = [[] for _ in texts]
    for (start, length), period in runs.items():
        i = int(np.searchsorted(ends, start, side="right"))
        out[i].append((int(start - (ends[i] - len(texts[i]))), int(length), int(period)))
    return [sorted(own, key=lambda r: (r[0], r[2])) for own in out]


def kept_words(words: list[str], runs: list[Run]) -> list[str]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]


def planted(doc_id: int | None, words: list[str]) -> list[str]:
    """Every tenth text by a hash of its id goes on periodically from some word on."""
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    again = words[a : a + p]
    return words[:a] + (again * ((n - a) // p + 1))[: n - a]


def _read(batches: Iterable[pa.RecordBatch], plant: bool) -> Iterator[tuple[list, list, list[list[str]], list[list[Run]]]]:
    """Ids, texts, words and runs of documents, as many at once as have CHUNK words."""
    ids, texts, each, size = [], [], [], 0
    for b in batches:
        for i in range(0, b.num_rows, 100):
            some = b.slice(i, 100)
            for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                words = _words(text or "")
                ids.append(doc_id)
                texts.append(text)
                each.append(planted(doc_id, words) if plant else words)
                size += len(words)
                if size >= CHUNK or len(ids) >= 5000:
                    yield ids, texts, each, runs_of(each)
                    ids, texts, each, size = [], [], [], 0
    if ids:
        yield ids, texts, each, runs_of(each)


def _told(docs: DataFrame, each, schema: str, plant: bool = False) -> DataFrame:
    """Rows that ``each`` (id, text, words, runs) makes of every document."""
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [(name, kinds[kind]) for name, kind in (f.split() for f in schema.split(", "))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for read in _read(batches, plant):
            rows = [row for one in zip(*read, strict=True) for row in each(*one)]
            columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, start, length and period of every run of every document, a row each.

    A run is a stretch of words with a smallest period, of LEAST words and two periods at least, that no neighbouring word extends.
    Null and empty texts have none. Whole texts of any length are read; columns other than doc_id and text are not.
    """
    return _told(docs, lambda i, text, words, runs: [(i, *r) for r in runs], "doc_id long, start long, length long, period long")


def collapse_runs(docs: DataFrame) -> DataFrame:
    """doc_id and the text without the words that a run holds after its first period; a text without runs stays as it is, a null one null.

    Words of a text that changes are joined by single spaces.
    """
    return _told(docs, lambda i, text, words, runs: [(i, " ".join(kept_words(words, runs)) if runs else text)], "doc_id long, text string")


REPORT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _report(doc_id: int | None, text: str | None, words: list[str], runs: list[Run]) -> list[tuple]:
    sha = lambda text: hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
    start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return [(doc_id, len(runs), start, length, period, 1000 * length // period if runs else None, sha(lines), sha(" ".join(kept_words(words, runs))))]


def runs_report(docs: DataFrame, plant: bool = True) -> DataFrame:
    """Number of runs, the longest one, and digests of all runs and of the words that are kept, of every document.

    plant: whether every tenth document goes on periodically first. One row for each input row, repeated ids included; a null id is hashed as the
    empty text. Of runs of the same length the first one is told. Null and empty texts have no run.
    """
    return _told(docs, _report, REPORT, plant)
