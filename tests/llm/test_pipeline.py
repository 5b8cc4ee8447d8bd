from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from tallyfold.llm import mixing
from tallyfold.llm.common import read_table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    """Documents of two made-up languages with copies, personal data and texts without letters."""
    rng = np.random.default_rng(1)
    parts = {"aa": ["ka", "ri", "mo", "tu", "le", "na"], "bb": ["sch", "ung", "eit", "och", "ver", "ber"]}
    rows = []
    for i in range(120):
        lang = "aa" if i % 2 else "bb"
        words = ["".join(rng.choice(parts[lang], rng.integers(2, 4))) for _ in range(80)]
        rows.append([i, " ".join(words), lang, f"s{i % 3}", 0])
    for i in range(120, 140):
        rows.append([i, rows[i - 120][1], rows[i - 120][2], "s0", 0])
    rows.append([200, "123 456 ...", None, "s1", 0])
    rows.append([201, None, "aa", "s1", 0])
    for r in rows[:40]:
        r[1] = f"{r[1]} mail ab.{r[0]:02}@mail.example.com now"
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([tuple(r) for r in rows], DOCS).write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_stages_and_run(spark, folder):
    docs = read_table(spark, folder, "documents")
    columns, kept = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        kept[name] = docs.collect()
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    ids = {name: [r["doc_id"] for r in rows] for name, rows in kept.items()}
    assert sorted(ids["language_id"]) == list(range(140))
    # Copies whose originals have had an address put behind them are still near copies.
    assert sorted(ids["ngram_join"]) == list(range(120))
    texts = {r["doc_id"]: r["text"] for r in kept["pii"]}
    assert not any(f"ab.{i:02}@" in texts[i] for i in range(40)) and all("@mail.example.com" in texts[i] for i in range(40))
    assert set(ids["mixing"]) == {r["doc_id"] for r in mixing.mix_report(docs_of(spark, kept["pii"])).collect() if r["kept"]}
    assert {r["doc_id"] for r in kept["best_fit_packing"]} == set(ids["mixing"])
    run = corpus_pipeline.run(spark, folder)
    piece = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    assert sorted(map(piece, run.collect())) == sorted(map(piece, kept["best_fit_packing"]))


def docs_of(spark, rows):
    return spark.createDataFrame([tuple(r) for r in rows], DOCS)


def test_odd_rows_and_clashing_columns_go_through(spark, tmp_path):
    """Nulls, repeated rows, and columns named as the stages' own; then an empty table."""
    words = "plain words of a text that is long enough to be read"
    rows = [(None, words, None, None, None), (1, None, "en", "s", 1), (2, "", "en", "s", 0), (3, words, "en", "s", 1), (3, words, "en", "s", 1), (4, "12 34", None, "s", 1), (5, f"{words} and then some more of them", "en", None, 1)]
    odd = spark.createDataFrame(rows, DOCS).selectExpr("*", "'clash' as piece", "'clash' as length", "1 as class", "'x' as rate", "'x' as score", "'x' as tokens", "'x' as key", "'x' as topic", "7 as _id", "8 as _hash", "9 as _ng_hash", "10 as _NG_ID", "'x' as _salt", "11 as _ng_gone")
    for name, df in (("odd", odd), ("empty", odd.limit(0))):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
        docs = read_table(spark, str(tmp_path / name), "documents")
        for stage, fn in corpus_pipeline.STAGES[:-1]:
            docs = fn(spark, docs, str(tmp_path / name))
            assert docs.columns == odd.columns, stage
        found = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path / name)).collect()}
        assert found <= {None, 3, 5} and (name == "odd" or not found)
