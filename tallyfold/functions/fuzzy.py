"""Fuzzy similarities of strings by longest common subsequences, as Arrow UDFs.

The ratio of two strings is 2 * LCS / (length + length). A row of the dynamic programme is one Python
integer, with a bit for each character of the shorter string.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _positions(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def common_length(a: str, b: str, where: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence; where: positions of the characters of ``a``."""
    at = _positions(a) if where is None else where
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    if not a and not b:
        return 100.0
    return 200.0 * common_length(a, b) / (len(a) + len(b))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio of the shared words, and those with either side's other words; 0 for an empty side."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    shared, only_a, only_b = (sorted(x) for x in (left & right, left - right, right - left))
    if shared and (not only_a or not only_b):
        return 100.0
    base = " ".join(shared)
    with_a, with_b = " ".join([*shared, *only_a]), " ".join([*shared, *only_b])
    best = ratio(with_a, with_b)
    return max(best, ratio(base, with_a), ratio(base, with_b)) if shared else best


#: Characters of a seed, and how many windows are aligned by the promise of their seeds before all others are looked at.
SEED, FIRST = 3, 96
#: Pairs are looked at together, in runs of about so many characters. Strings of more than WIDE characters are aligned window by window.
TOGETHER, WIDE = 1 << 18, 256
#: Windows of a pair that are aligned at once where all of them are looked at, and of one that is aligned window by window.
STEP, FEW = 256, 8
#: Number of each code point among the characters of the string at hand; 0: it is none of them.
_NUMBER = np.zeros(0x110000, np.int32)


@dataclass
class Sought:
    """A string that is sought in a longer one, and the windows of that.

    page: numbers of the longer string's characters, with as many zeros as the shorter one has characters before and behind, so that
    a window cut short at the ends is as wide as the others. Window i begins at i in it. size: lengths of both;
    bound: the largest possible ratio, 0 or less for windows that are left out or aligned.
    """

    a: str
    b: str
    letters: np.ndarray
    page: np.ndarray
    size: np.ndarray
    bound: np.ndarray
    best: float = 0.0

    def pick(self, most: int) -> np.ndarray:
        """The most promising windows that may beat the best."""
        on = np.flatnonzero(self.bound > self.best)
        return on if len(on) <= most else on[np.argpartition(-self.bound[on], most)[:most]]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def sought(a: str, b: str) -> Sought:
    """``a`` in ``b``, which is not shorter, with the bounds of all windows.

    Each character that a window and ``a`` do not share destroys SEED seeds of ``a`` at most. So a window that holds c of its seeds
    differs in (seeds of a - c) / SEED characters at least. It also shares no more characters than it has of those in ``a``. Whole windows that neither begin nor
    end with a character of ``a`` are left out, as their neighbours are as good.
    """
    x, y, n, m = _codes(a), _codes(b), len(a), len(b)
    distinct = np.unique(x)
    _NUMBER[distinct] = np.arange(1, len(distinct) + 1)
    page = np.zeros(m + 2 * n, np.int32)
    letters, page[n : n + m] = _NUMBER[x], _NUMBER[y]
    _NUMBER[distinct] = 0
    own = page > 0
    count = np.zeros(len(page) + 1, np.int32)
    np.cumsum(own, out=count[1:])
    most = count[n:] - count[:-n]
    size = np.full(len(most), 2 * n, np.int32)
    size[:n] = np.arange(n, 2 * n)
    size[m:] = np.minimum(size[m:], np.arange(2 * n, n - 1, -1))
    if n >= SEED:
        k = len(distinct) + 1
        few = k <= 100
        kind = np.int32 if few else np.int64
        seeds = lambda t: (t[:-2].astype(kind) * kind(k) + t[1:-1]) * kind(k) + t[2:]
        if few:
            known = np.zeros(k**SEED, bool)
            known[seeds(letters)] = True
            there = known[seeds(page)]
        else:
            there = np.isin(seeds(page), seeds(letters))
        count = np.zeros(len(there) + 1, np.int32)
        np.cumsum(there, out=count[1:])
        wide = n - SEED + 1
        lost = np.maximum(0, (wide + SEED - 1 - (count[wide:] - count[:-wide])) // SEED)
        most = np.minimum(most, (size - lost) // 2)
    bound = 200.0 * most / size
    bound[n : m + 1] *= own[n : m + 1] | own[2 * n - 1 : m + n]
    bound[0] = bound[-1] = 0.0
    return Sought(a, b, letters, page, size, bound)


def common_lengths(asked: list[tuple[Sought, np.ndarray]]) -> list[np.ndarray]:
    """``common_length`` of each string with some of its windows; all windows of strings of like length go step by step together."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(asked)
    groups: dict[int, list[int]] = {}
    for i, (s, at) in enumerate(asked):
        n = len(s.a)
        if n > WIDE:
            where, begin = _positions(s.a), at - n
            out[i] = np.array([common_length(s.a, s.b[max(0, lo) : lo + n], where) for lo in begin.tolist()], np.int64)
        elif len(at):
            groups.setdefault(-(-n // 64), []).append(i)
    for words, members in groups.items():
        some = [asked[i] for i in members]
        # A row of bits for each character of each string, and before them one without bits for all other characters.
        rows = np.cumsum([0, *(int(s.letters.max()) + 1 for s, _ in some)])
        bits = np.zeros((words, rows[-1]), np.uint64)
        ends = np.cumsum([0, *(len(at) for _, at in some)])
        steps = np.zeros((max(len(s.a) for s, _ in some), ends[-1]), np.intp)
        for (s, at), row, lo, hi in zip(some, rows.tolist(), ends.tolist(), ends[1:].tolist(), strict=False):
            i = np.arange(len(s.a))
            np.bitwise_or.at(bits, (i >> 6, row + s.letters), np.uint64(1) << (i & 63).astype(np.uint64))
            steps[: len(i), lo:hi] = s.page[i[:, None] + at] + row
        state = np.full((words, ends[-1]), ~np.uint64(0))
        for step in steps:
            carry = None
            for w in range(words):
                row = state[w]
                hit = row & bits[w].take(step)
                total = row + hit
                if w + 1 < words or carry is not None:
                    over = total < row
                    if carry is not None:
                        total += carry
                        over |= total < carry
                    carry = over.astype(np.uint64)
                row ^= hit
                row |= total
        found = 64 * words - np.bitwise_count(state).sum(axis=0, dtype=np.int64)
        for i, lo, hi in zip(members, ends.tolist(), ends[1:].tolist(), strict=False):
            out[i] = found[lo:hi]
    return out


def _align(pairs: list[Sought], most: int) -> list[Sought]:
    """Aligns the most promising windows of each pair; the pairs that have others which may beat the best."""
    asked = [(s, s.pick(most if len(s.a) <= WIDE else min(most, FEW))) for s in pairs]
    for (s, at), found in zip(asked, common_lengths(asked), strict=True):
        if len(at):
            s.best = max(s.best, float((200.0 * found / s.size[at]).max()))
            s.bound[at] = 0.0
    return [s for s in pairs if (s.bound > s.best).any()]


def _all_windows(pairs: list[Sought]) -> None:
    """Aligns all windows that may be better than the best.

    A window shares at most so many characters as both have in any order, which bounds its ratio more closely.
    """
    for s in pairs:
        n, most = len(s.a), np.zeros(len(s.bound), np.int32)
        for letter, wanted in enumerate(np.bincount(s.letters)[1:].tolist(), 1):
            count = np.zeros(len(s.page) + 1, np.int32)
            np.cumsum(s.page == letter, out=count[1:])
            most += np.minimum(count[n:] - count[:-n], wanted)
        s.bound = np.minimum(s.bound, 200.0 * most / s.size)
    while pairs:
        pairs = _align(pairs, STEP)


def partial_ratios(pairs: list[tuple[str, str]]) -> list[float]:
    """For each pair, the best ratio of the shorter string with a window of the longer one, windows at its ends cut short.

    Windows are aligned in the order of what their seeds promise, until the next one cannot beat the best. A string that stands there but for some
    characters is so found and settled in a few windows. If FIRST of them settle nothing, the string is hardly there, and all
    windows are gone through. Many pairs are aligned together, a step of all their windows at a time.
    """
    out, held, used = [0.0] * len(pairs), [], 0

    def settle() -> None:
        left = [s for _, s in held]
        for most in (min(1, FIRST), FIRST - 1):
            left = _align(left, most) if most > 0 else left
        if left:
            _all_windows(left)
        for at, s in held:
            out[at] = s.best
        held.clear()

    for i, (a, b) in enumerate(pairs):
        if len(a) > len(b):
            a, b = b, a
        if not a:
            out[i] = 0.0 if b else 100.0
        elif a in b:
            out[i] = 100.0
        else:
            held.append((i, sought(a, b)))
            used += len(b)
        if used >= TOGETHER:
            settle()
            used = 0
    settle()
    return out


def partial_ratio(a: str, b: str) -> float:
    return partial_ratios([(a, b)])[0]


@F.pandas_udf(T.DoubleType())
def token_set_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else token_set_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


#: From this share on a quote counts as found.
CLOSE = 0.85


@F.pandas_udf(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("close", T.BooleanType())]))
def partial_score_udf(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """``partial_ratio`` as a share, rounded to four places as a double rounds, and whether the share itself is CLOSE."""
    on = [i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x is not None and y is not None]
    shares: list[float | None] = [None] * len(a)
    for i, found in zip(on, partial_ratios([(a.iloc[i], b.iloc[i]) for i in on]), strict=True):
        shares[i] = found / 100
    return pd.DataFrame({"score": pd.Series([None if s is None else round(s, 4) for s in shares], dtype="float64"), "close": pd.Series([s is not None and s >= CLOSE for s in shares], dtype="bool")})
