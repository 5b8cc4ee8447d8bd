"""Quality scores by pairs: training against plain sums over all pairs, and held-out accuracy."""

from __future__ import annotations

import random
import zlib

import numpy as np

from tallyfold.llm import quality_classifier as qc


def auc(scores, labels):
    good, bad = scores[labels == 1], scores[labels == 0]
    return ((good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2).item()


def test_weights_lower_the_loss_of_all_pairs():
    rng = np.random.default_rng(1)
    better, worse = rng.normal(0.4, 1, (80, 5)), rng.normal(-0.4, 1, (60, 5))
    loss = lambda w: np.log1p(np.exp(-((better[:, None] - worse) @ w))).mean() + qc.PENALTY * (w @ w) / 2
    w = qc.rank_weights(better, worse)
    steps = [w + d * np.eye(5)[i] for i in range(5) for d in (-0.15, 0.15)]
    assert loss(w) < 0.9 * loss(np.zeros(5)) and min(map(loss, steps)) > loss(w) - 2e-3


def test_traits_of_words():
    assert qc.outline_traits("A")[:6] == [0.1, 0.0, 0.0, 0.0, 0.0, 0.0]
    assert qc.outline_traits("AAA!!")[:6] == [0.5, 0.6, 0.0, 0.0, 0.4, 0.0] and qc.outline_traits("|")[5] == 1.0
    assert qc.outline_traits("Aaaa")[6] == qc.outline_traits("Aa")[6] and "Été7*".translate(qc._Kinds()) == "Aaa0*"


def test_features_do_not_depend_on_what_came_before(monkeypatch):
    texts = [None, "", "\n \t", "a", "A b\nA b\nC", "same same same x", "é" * 90_000, " ".join(f"w{i}" for i in range(3000)), "IST!! 12 *** |"]
    alone = [qc.Measurer().features(t) for t in texts]
    monkeypatch.setattr(qc, "MOST_WORDS", 5)
    one = qc.Measurer()
    for _ in range(2):
        assert all(np.array_equal(one.features(t), x) for t, x in zip(texts, alone, strict=True))
    assert not alone[0].any() and alone[3].any() and all(np.isfinite(x).all() for x in alone)


def documents(n: int, seed: int = 0):
    """Prose, and texts of which a part is junk of one of four sorts."""
    rng, rows, labels = random.Random(seed), [], []
    junk = [lambda w: w.upper() + "!!", lambda w: w + rng.choice(["***", "###"]), lambda w: f"{w} |", lambda w: f"{w} {w} {w} {w}"]
    for i in range(n):
        words = ["".join(rng.choice("abcdeéfghi") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(3, 120))]
        good = rng.random() < 0.8
        if not good:
            make, at = rng.choice(junk), rng.randrange(0, max(1, len(words) // 2))
            words[at:] = [make(w) for w in words[at:]]
        rows.append((i, " ".join(words)))
        labels.append((i, int(good)))
    return rows, labels


def test_held_out_documents(spark):
    rows, labels = documents(900)
    extra = [(10**6, None), (10**6 + 1, ""), (None, "no id"), (5, rows[5][1]), (10**6 + 2, "z" * 300_000)]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string").selectExpr("*", "1 as quality", "2 as score", "'x' as _qc_id", "3 as good", "4 as x")
    marks = spark.createDataFrame([*labels, (7, None), (None, 1), (8 * 10**6, 0)], "doc_id long, quality int").selectExpr("*", "'t' as text")
    got = qc.quality_report(docs, marks).collect()
    assert len(got) == len(rows) + len(extra)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    label = dict(labels)
    own = [r for r in got if r["held_out"] and r["doc_id"] in label]
    y = np.array([label[r["doc_id"]] for r in own])
    assert len(own) > 150 and auc(np.array([r["score"] for r in own]), y) > 0.97
    assert np.mean([r["predicted"] == label[r["doc_id"]] for r in own]) > 0.93
    # Labels of held-out documents change nothing.
    turned = marks.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - quality else quality end as quality")
    score = lambda rows: sorted((str(r["doc_id"]), r["score"]) for r in rows)
    assert score(qc.quality_report(docs, turned).collect()) == score(got)


def test_labels_of_one_kind_and_none(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 1)], "doc_id long, quality int")
    assert {r["predicted"] for r in qc.quality_report(docs, labels).collect()} <= {0, 1}
    assert qc.quality_report(docs, labels.where("doc_id < 0")).count() == 2 and qc.quality_report(docs.where("doc_id < 0"), labels).count() == 0


def test_best_scores(spark):
    scores = spark.createDataFrame([(i, (i // 2) / 50) for i in range(100)], "doc_id long, score double")
    kept = qc.best_scores(scores, 0.25)
    assert {r["doc_id"] for r in kept.collect()} == set(range(kept.agg({"doc_id": "min"}).first()[0], 100)) and 25 <= kept.count() <= 28
