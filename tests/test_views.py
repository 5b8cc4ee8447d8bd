from __future__ import annotations

from datetime import date

from tallyfold.plans import views
from tallyfold.sources import layers, memo, pages

FACTS = "id long, document_id string, entity string, attribute string, quote string, entity_key string, attribute_key string, value_num double, unit string, period_key string, estimate_type string, is_duplicate boolean, evidence_verified boolean"


def layer(spark):
    row = lambda i, d, v, p="p1", dup=False: (i, d, "India", "GDP growth", "quote", "india", "gdp growth", v, "percent", p, "actual", dup, i != 3)
    facts = spark.createDataFrame([row(1, "a", 6.4), row(2, "b", 6.5), row(3, "b", 7.0, "p2"), row(4, "b", 6.5, dup=True)], FACTS)
    documents = spark.createDataFrame([("a", "a.pdf", "A", date(2025, 1, 30)), ("b", "b.pdf", "B", date(2025, 5, 29))], "document_id string, filename string, title string, publication_date date")
    relations = spark.createDataFrame([(1, 2, "superseded", "final", 0.9, 2), (1, 3, "context_explained", "final", 0.9, None)], "fact_a_id long, fact_b_id long, verdict string, status string, confidence double, winner_fact_id long")
    failures = spark.createDataFrame([(1, "verify", "quote_not_found", "a"), (2, "link", "llm_other", None)], "id long, stage string, kind string, document_id string")
    page_rows = spark.createDataFrame([("a", 0, "done", 0), ("a", 1, "failed", 3), ("b", 0, "pending", 0)], "document_id string, page_index int, status string, attempts int")
    return facts, documents, relations, failures, page_rows


def test_timeline(spark):
    facts, documents, relations, *_ = layer(spark)
    rows = views.timeline("india", "gdp growth", facts, documents, relations).collect()
    assert [(r["id"], r["is_current"], r["superseded_by"]) for r in rows] == [(1, False, 2), (2, True, None), (3, True, None)]


def test_listings(spark):
    facts, documents, relations, failures, _ = layer(spark)
    assert [r["id"] for r in views.list_facts(facts, documents, q="gdp", limit=2, offset=1).collect()] == [2, 3]
    assert [r["id"] for r in views.list_facts(facts, documents, verified=False).collect()] == [3]
    assert views.list_facts(facts, documents, include_duplicates=True).count() == 4
    assert [r["verdict"] for r in views.list_relations(relations, facts, document="a").collect()] == ["superseded", "context_explained"]
    assert [r["id"] for r in views.list_failures(failures).collect()] == [2, 1]
    assert views.fact_detail(3, facts, documents, relations).count() == 1


def test_summaries(spark):
    facts, documents, relations, failures, page_rows = layer(spark)
    (entry,) = views.attribute_schema(facts).collect()
    assert (entry["display_name"], entry["n"], entry["units"]) == ("GDP growth", 3, ["percent"])
    stats = {r["name"]: r["n"] for r in views.layer_stats(documents, page_rows, facts, relations, failures).collect()}
    assert (stats["facts"], stats["attributes"], stats["verdict:superseded"], stats["kind:llm_other"]) == (3, 1, 1, 1)
    states = {r["document_id"]: r["state"] for r in views.document_progress(page_rows, facts).collect()}
    assert states == {"a": "extracted", "b": "processing"}


def test_scope_and_copy(spark):
    facts, documents, relations, failures, page_rows = layer(spark)
    scope = views.export_scope(documents, page_rows, facts, relations, failures, documents.where("document_id = 'a'"))
    assert {n: t.count() for n, t in scope.items()} == {"documents": 1, "pages": 2, "facts": 1, "relations": 2, "failures": 2, "attribute_schema": 1}
    tables = {"documents": documents, "pages": page_rows, "facts": facts, "relations": relations, "failures": failures}
    again = layers.copy_layer(tables, tables)
    assert {n: t.count() for n, t in again.items()} == {n: t.count() for n, t in tables.items()} | {"failures": 2}
    left = layers.delete_documents(tables, documents.where("document_id = 'a'"))
    assert (left["facts"].count(), left["relations"].count()) == (3, 0)
    assert layers.next_id(facts) == 5


def test_latest_version(spark):
    rows = spark.createDataFrame([("p", 1, "pending"), ("p", 2, "done"), ("q", 1, "pending")], "page string, version int, status string")
    assert {(r["page"], r["status"]) for r in layers.latest(rows, ["page"]).collect()} == {("p", "done"), ("q", "pending")}


def test_pages(spark):
    texts = ["Some prose that goes on.\nmore prose\n212", "", "Chapter Four\n\nprose and prose and prose", "prose prose prose prose\nPage xiv\n", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = pages.inventory(df).orderBy("i").collect()
    assert [r["label"] for r in rows] == ["212", None, None, "xiv", None]
    assert [r["status"] for r in rows] == ["pending", "skipped", "pending", "pending", "skipped"]


def test_registration(spark):
    schema = "sha256 string, size_bytes long, status string"
    new = spark.createDataFrame([("x", 5, "uploading"), ("x", 5, "uploading"), ("y", 5, "uploading"), ("z", 10**9, "uploading")], schema)
    known = spark.createDataFrame([("y", 5, "uploaded"), ("x", 5, "uploading")], schema)
    assert [r["sha256"] for r in pages.register(new, known).collect()] == ["x"]


def test_memo(spark):
    requests = spark.createDataFrame([("k1", "m", "p", "r1"), ("k2", "m", "p", "r2"), ("k2", "m", "p", "r2")], "key string, model string, purpose string, request string")
    records = spark.createDataFrame([("k1", "old")], "key string, response string")
    replay, none = memo.answers(requests, records)
    assert {(r["key"], r["response"], r["error"]) for r in replay.collect()} == {("k1", "old", None), ("k2", None, "llm_cache_miss")} and none.count() == 0
    got, new = memo.answers(requests, records, "record", lambda s: [(f"new {x}", None, None) for x in s])
    assert sorted(r["response"] for r in got.collect()) == ["new r2", "new r2", "old"] and [r["key"] for r in new.collect()] == ["k2"]


def test_json_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "key": "k",\n "model": "m", "purpose": "p", "response": {"verdict": "x"}, "usage": {"input": 3}\n}')
    (r,) = memo.read_records(spark, str(tmp_path)).collect()
    assert r["key"] == "k" and r["usage"] == {"input": 3}
