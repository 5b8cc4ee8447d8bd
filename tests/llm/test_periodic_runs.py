"""Periodic runs against a walk along every diagonal."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

from tallyfold.llm import periodic_runs as pr


def walk(words: list[str]) -> list[tuple[int, int, int]]:
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        same = [words[i] == words[i - q] for i in range(q, n)] + [False]
        begin = None
        for i, equal in enumerate(same):
            if equal and begin is None:
                begin = i
            if not equal and begin is not None:
                length = i - begin + q
                if length >= max(12, 2 * q):
                    found[begin, length] = min(q, found.get((begin, length), q))
                begin = None
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def samples(seed: int, count: int) -> list[list[str]]:
    rng, out = random.Random(seed), []
    for _ in range(count):
        n, kind = rng.randrange(130), rng.randrange(4)
        if kind == 0:
            words = [rng.choice("ab") for _ in range(n)]
        elif kind == 1:
            words = [rng.choice("abcdefghij") for _ in range(n)]
        elif kind == 2:
            words = ([rng.choice("abc") for _ in range(rng.randrange(1, 40))] * n)[:n]
            for _ in range(rng.randrange(4)):
                if n:
                    words[rng.randrange(n)] = "z"
        else:
            words = []
            while len(words) < n:
                words += ["a"] * rng.randrange(1, 30) + ["b"] * rng.randrange(2)
        out.append(words)
    return out


def test_runs_equal_a_walk_along_all_diagonals():
    texts = samples(7, 600)
    assert pr.runs_of(texts) == [walk(t) for t in texts]
    assert pr.runs_of([]) == [] and pr.runs_of([[]]) == [[]]


def test_long_and_hostile_texts():
    same, steps, lines = ["a"] * 200_000, (["a"] * 99 + ["b"]) * 500, [f"w{i}" for i in range(20)] * 2000
    assert pr.runs_of([same, lines]) == [[(0, 200_000, 1)], [(0, 40_000, 20)]]
    assert pr.runs_of([steps])[0][0] == (0, 99, 1) and (0, 50_000, 100) in pr.runs_of([steps])[0] and len(pr.runs_of([steps])[0]) == 501


def test_report_equals_brute_force(spark):
    rng = random.Random(11)
    texts = [" ".join(t) for t in samples(13, 150)] + [None, "", " \n\t ", "one", "a\x1fb " * 40, "é é " * 13, "x " * 5000] + [" ".join(str(rng.randrange(99)) for _ in range(n)) for n in range(0, 400, 9)]
    rows = [(i if i % 50 else i * 10**12, t) for i, t in enumerate(texts)] + [(None, "a " * 20), (5, "b " * 20), (5, "b " * 20)]
    want = []
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str("" if doc_id is None else doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = walk(words)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        top = sorted(runs, key=lambda r: (-r[1], r[0], r[2]))[:1]
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        one = (*top[0], 1000 * top[0][1] // top[0][2]) if top else (None,) * 4
        want.append((doc_id, len(runs), *one, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as start", "'x' as runs_sha256", "2 as n_runs").repartition(3)
    assert sorted(map(repr, map(tuple, pr.runs_report(docs).collect()))) == sorted(map(repr, want))
    assert sum(r[1] > 0 for r in want) > 40


def test_found_and_collapsed(spark):
    docs = spark.createDataFrame([(1, "so it  goes " * 6 + "on."), (2, None), (3, "kept  as it is\n"), (4, "")], "doc_id long, text string")
    assert [tuple(r) for r in pr.find_runs(docs).collect()] == [(1, 0, 18, 3)]
    assert {r["doc_id"]: r["text"] for r in pr.collapse_runs(docs).collect()} == {1: "so it goes on.", 2: None, 3: "kept  as it is\n", 4: ""}
    none = docs.where("doc_id < 0")
    assert pr.runs_report(none).collect() == [] and pr.find_runs(none).collect() == []
