"""Requests asked again, against a model that is played here."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold.operators import rounds
from tallyfold.sources import memo


def test_each_page_is_asked_until_it_is_settled(spark):
    pages = spark.createDataFrame([("d", i, f"page {i}", "m", "extract") for i in range(6)] + [("e", 0, None, None, "extract"), ("d", 0, "page 0", "m", "extract")], "document_id string, page_index int, request string, model string, purpose string")

    def provider(texts):
        out = []
        for t in texts:
            page, cap, again = t.split("\n")[0][-1], int(t.split("at most ")[1].split(" ")[0]), "not valid" in t
            if page == "1" and cap > 10 or page == "2":
                out.append((None, None, "tool_use_failed"))
            elif page == "3" and not again or page == "4":
                out.append(("[]", None, None))
            elif page == "5":
                out.append((None, None, "llm_quota"))
            else:
                out.append(('{"facts": []}', None, None))
        return out

    none = spark.createDataFrame([], memo.RECORD)
    got = rounds.asked_in_rounds(pages.where("request is not null"), lambda calls: memo.answers(calls, none, "live", provider)[0])
    rows = sorted((r["page_index"], r["cap"], r["calls"], r["error"], r["response"]) for r in got.collect() if r["page_index"])
    good = '{"facts": []}'
    assert rows == [(1, 10, 3, None, good), (2, 3, 5, "tool_use_failed", None), (3, 40, 2, None, good), (4, 40, 2, "llm_json", None), (5, 40, 1, "llm_quota", None)]
    assert got.count() == 7 and got.where("page_index = 0").select("calls", "response").distinct().collect() == [(1, good)]
    assert [(r["page_index"], r["kind"]) for r in rounds.reduced_failures(got).collect()] == [(1, "fact_cap_reduced")]
    assert rounds.asked_in_rounds(pages.where("page_index > 9"), lambda calls: memo.answers(calls, none)[0]).count() == 0


def test_records_may_have_errors(spark):
    asked = spark.createDataFrame([("a", "m", "p", "x"), ("b", "m", "p", "y"), ("c", "m", "p", "z")], "key string, model string, purpose string, request string")
    records = spark.createDataFrame([("a", "told", None), ("b", None, "tool_use_failed")], "key string, response string, error string")
    told = {r["key"]: (r["response"], r["error"]) for r in memo.answers(asked, records)[0].collect()}
    assert told == {"a": ("told", None), "b": (None, "tool_use_failed"), "c": (None, "llm_cache_miss")}
    assert memo.answers(asked, records)[0].columns == [*asked.columns, "response", "error"]


def test_rounds_join_records_once_each(spark):
    pages = spark.createDataFrame([(i, f"page {i}", "m", "extract", f"own {i}") for i in range(4)], "page_index long, request string, model string, purpose string, key string")
    text = lambda i, cap: f"page {i}\nat most {cap} facts"
    records = spark.createDataFrame([(text(0, 40), '{"facts": []}', None), (text(1, 40), None, "tool_use_failed"), (text(1, 20), '{"facts": [1]}', None)], "text string, response string, error string")
    records = records.select(memo.request_key(F.lit("extract"), F.col("text")).alias("key"), "response", "error")
    plans = []

    def ask(calls):
        told = memo.answers(calls, records)[0]
        plans.append(told.drop("request", "key")._jdf.queryExecution().optimizedPlan().toString())
        return told

    got = rounds.asked_in_rounds(pages, ask)
    rows = sorted((r["page_index"], r["key"], r["cap"], r["calls"], r["error"], r["response"]) for r in got.collect())
    lost = "llm_cache_miss"
    assert rows == [(0, "own 0", 40, 1, None, '{"facts": []}'), (1, "own 1", 20, 2, None, '{"facts": [1]}'), (2, "own 2", 40, 1, lost, None), (3, "own 3", 40, 1, lost, None)]
    # A round's rows are the calls: they are neither gathered by text first nor joined with the answers afterwards.
    assert len(plans) == 2 and all(p.count("Join") == 1 and p.count("Aggregate") == 1 for p in plans)
