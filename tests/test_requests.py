"""Requests to a model: each asked once, and what their answers change."""

from __future__ import annotations

import json
import random
from datetime import date

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyfold import tables
from tallyfold.operators import facts, link, requests
from tallyfold.schemas import RELATIONS
from tallyfold.sources import memo, pages


def test_each_request_is_asked_once(spark, tmp_path):
    asked = spark.createDataFrame([(f"k{i % 6}", "m", "p", f"r{i % 6}") for i in range(12)], "key string, model string, purpose string, request string")

    def provider(batch: pd.Series) -> list:
        for r in batch:
            with open(tmp_path / "calls", "a") as f:
                f.write(f"{r}\n")
        return [(None, None, "llm_other") if r == "r3" else (f"answer to {r}", {"tokens": 1}, None) for r in batch]

    known = spark.createDataFrame([("k0", "m", "p", "r0", "known", None)], memo.RECORD)
    answered, new = memo.answers(asked, known, "record", provider)
    got = {r["key"]: (r["response"], r["error"]) for r in answered.collect()}
    assert new.count() == 4 and answered.count() == 12 and new.count() == 4
    assert got["k0"] == ("known", None) and got["k3"] == (None, "llm_other") and got["k1"] == ("answer to r1", None)
    assert sorted((tmp_path / "calls").read_text().split()) == [f"r{i}" for i in range(1, 6)]


def test_plain_numbers(spark):
    rng = random.Random(5)
    drawn = [rng.uniform(-1, 1) * 10 ** rng.randint(-12, 24) for _ in range(300)] + [rng.randint(-9999, 9999) * 10.0 ** rng.randint(-9, 20) for _ in range(300)]
    cases = [1.0, -2.5, 12345678.25, 0.0, -0.0, 0.001, 1e15, 1e16, 0.0001, 0.00001, 0.30000000000000004, 0.00012345678901234, 2e23, 2**-44, 2.5e-300, 1.7976931348623157e308, float("inf"), float("nan"), *drawn]
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, v double").select("i", requests.plain_number(F.col("v")).alias("t")).collect()
    assert {r["i"]: r["t"] for r in rows} == {i: repr(v) for i, v in enumerate(cases)}


def test_page_requests_are_cut(spark):
    df = spark.createDataFrame([("d", 0, None, "z" * 7000), ("d", 1, "ii", None)], "document_id string, page_index int, label string, text string")
    long, short = (r["request"] for r in requests.page_requests(df, [f"a{i}" for i in range(200)]).orderBy("page_index").collect())
    assert long.count("z") == requests.MOST_PAGE_TEXT and "a149" in long and "a150" not in long
    assert short.endswith("text:\n") and "label: ii" in short


def test_link_job_judges_what_is_open(spark):
    schema = "id long, document_id string, entity_key string, attribute_key string, value_num double, unit string, period_key string, estimate_type string, basis_key string, attributed_to string, evidence_verified boolean, publication_date date"
    row = lambda i, d, v: (i, d, "plant", "output", v, "USD", "2020-01-01:2020-12-31", "actual", "", None, True, date(2021, 1, 1))
    views = spark.createDataFrame([row(1, "a", 10.0), row(2, "b", 20.0), row(3, "c", 30.0)], schema)
    text = lambda c: F.lit(None).cast("string").alias(c)
    whole = views.select("*", F.col("entity_key").alias("entity"), F.col("attribute_key").alias("attribute"), F.lit("q").alias("quote"), F.lit(0).alias("page_index"), *[text(c) for c in ("value_raw", "unit_raw", "scale_raw", "period_raw", "measurement_basis", "page_label", "verify_method")], F.lit(None).cast("date").alias("period_start"), F.lit(None).cast("date").alias("period_end"))
    documents = spark.createDataFrame([(d, d, None, None, None) for d in "abc"], "document_id string, filename string, title string, publisher string, publication_date date")
    none = spark.createDataFrame([], RELATIONS)
    asked = requests.judgement_requests(link.rule_pass(views, views, none), whole, documents)
    keys = {(r["fact_a_id"], r["fact_b_id"]): r["key"] for r in asked.collect()}
    told = {"verdict": "superseded", "dimension": "vintage", "explanation": "newer", "confidence": 0.9, "winner": "b"}
    records = spark.createDataFrame([(keys[1, 2], "m", "p", "", json.dumps(told), None), (keys[1, 3], "m", "p", "", "no json", None)], memo.RECORD)
    made, counts = requests.link_job(views, views, none, whole, documents, records)
    got = {(r["fact_a_id"], r["fact_b_id"]): (r["verdict"], r["status"], r["attempts"]) for r in made.collect()}
    assert got == {(1, 2): ("superseded", "final", 0), (1, 3): ("contradicts", "pending_llm", 1), (2, 3): ("contradicts", "pending_llm", 0)}
    assert {(r["status"], r["verdict"]): r["n"] for r in counts.collect()} == {("final", "superseded"): 1, ("pending_llm", "contradicts"): 2}


def test_uploads_are_checked(spark):
    files = spark.createDataFrame([("a", bytearray(b"one")), ("b", bytearray(b"two")), ("c", bytearray(b"six"))], "document_id string, content binary")
    known = files.select("document_id", F.length("content").cast("long").alias("size_bytes"), F.sha2(F.when(F.col("document_id") == "b", F.encode(F.lit("other"), "utf-8")).otherwise(F.col("content")), 256).alias("sha256")).where("document_id != 'c'")
    assert {r["document_id"]: r["ok"] for r in pages.intact(files, known).collect()} == {"a": True, "b": False, "c": False}


def test_fact_views_leave_out_duplicates(spark):
    rows = [(1, "a", "k", 1.0, False), (2, "a", "k", 2.0, True), (3, "a", "k", None, False), (4, "z", "k", 4.0, None)]
    made = spark.createDataFrame(rows, "id long, document_id string, attribute_key string, value_num double, is_duplicate boolean").withColumns({c: F.lit("x") for c in ("entity_key", "unit", "period_key", "estimate_type", "basis_key", "attributed_to")} | {"evidence_verified": F.lit(True)})
    documents = spark.createDataFrame([("a", date(2020, 1, 1)), ("z", None)], "document_id string, publication_date date")
    assert {(r["id"], r["publication_date"]) for r in link.fact_views(made, documents).collect()} == {(1, date(2020, 1, 1)), (4, None)}


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, name, default=None):
            return {"spark.master": "spark://host:7077"}.get(name, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_dir(Session())


def test_numbers_are_consecutive(spark):
    df = spark.range(100).select((F.col("id") * 7 % 100).alias("o"))
    assert [(r["o"], r["id"]) for r in facts.numbered(df, ["o"], 5).orderBy("o").collect()] == [(i, i + 5) for i in range(100)]


def test_records_are_kept_and_replayed(spark):
    folder, calls = f"{tables.shared_dir(spark)}/kept", []
    asked = spark.createDataFrame([(f"{i:02x}k", "m", "p", f"r{i}") for i in range(20)], "key string, model string, purpose string, request string")
    told = lambda texts: [(None, None, "llm_other") if t == "r7" else (f"answer to {t}", {"output": 1}, None) for t in texts]
    assert {r["error"] for r in memo.stored_answers(asked, folder, "none").collect()} == {"llm_cache_miss"}
    for _ in range(2):  # the same run again adds nothing twice
        memo.stored_answers(asked.limit(10), folder, "a", "record", told)
    first = memo.kept(spark, folder).count()
    memo.stored_answers(asked, folder, "b", "record", told)
    assert memo.kept(spark, folder).groupBy("key").count().where("count > 1").count() == 0 and first == 9
    got = {r["request"]: (r["response"], r["error"]) for r in memo.stored_answers(asked, folder, "c").collect()}
    assert got["r3"] == ("answer to r3", None) and got["r7"] == (None, "llm_cache_miss") and len(got) == 20 and calls == []
    assert memo.kept(spark, folder, asked.where("request = 'r3'")).count() == 1


def test_a_run_that_records_for_the_first_time_is_written_once(spark, monkeypatch):
    folder, labels = f"{tables.shared_dir(spark)}/once", []
    monkeypatch.setattr(memo, "stored", lambda df, label: labels.append(label) or tables.stored(df, label))
    asked = spark.createDataFrame([(f"{i:02x}k", "m", "p", f"r{i}") for i in range(20)], "key string, model string, purpose string, request string")
    told = lambda texts: [(f"answer to {t}", {"output": 1}, None) for t in texts]
    memo.stored_answers(asked, folder, "a", "record", told)
    assert labels == ["answers"] and {tuple(r) for r in memo.kept(spark, folder).select("key", "model", "request", "response").collect()} == {(f"{i:02x}k", "m", f"r{i}", f"answer to r{i}") for i in range(20)}


def test_files_are_read_with_their_digests(spark, tmp_path):
    import hashlib

    for name, content in (("a.pdf", b"one"), ("b.pdf", b""), ("c.bin", bytes(range(256)))):
        (tmp_path / name).write_bytes(content)
    got = {r["storage_path"].rsplit("/", 1)[1]: (r["size_bytes"], r["sha256"], bytes(r["content"])) for r in pages.read_binary(spark, str(tmp_path)).collect()}
    assert got == {n: (len(c), hashlib.sha256(c).hexdigest(), c) for n, c in (("a.pdf", b"one"), ("c.bin", bytes(range(256))))}
