"""The stored index against full passes over all facts."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tallyfold.operators import block, postings
from tallyfold.schemas import VIEW
from tallyfold.streaming.incremental import link_batch
from tallyfold.tables import shared_dir

from test_operators import greedy, views


def drawn(spark, n: int, seed: int):
    rng = random.Random(seed)
    attributes, entities = ["gdp growth", "gdp growth real", "gdp growths", "export", "growth total"], ["india", "government india", "china", "", "north india", "china north"]
    return views(spark, *[{"id": i, "document_id": str(rng.randrange(7)), "attribute_key": rng.choice(attributes), "entity_key": rng.choice(entities), "value_num": rng.choice([None, 1.0, 2.0]), "unit": rng.choice(["count", "pp"])} for i in range(n)]).coalesce(1)


def test_bounded_lists_give_the_greedy_pass(spark, monkeypatch):
    monkeypatch.setattr(block, "BLOCK", 8)  # so that lists go on and rounds follow
    df = drawn(spark, 150, 3)
    made = [tuple(r) for r in block.scored_pairs(df).collect()]
    for most in (2, 6):
        assert {(r["a_id"], r["b_id"]) for r in block.build_candidates(df, most).collect()} == greedy(made, most)


def test_batches_are_paired_as_in_a_full_pass(spark, monkeypatch):
    monkeypatch.setattr(postings, "MOST_RUNS", 2)
    df = drawn(spark, 90, 1)
    index = postings.Index(spark, f"{shared_dir(spark)}/index-test", bucket=5)
    for i in range(2):
        postings.append(index, df.where((F.col("id") % 4 == i)).select(*VIEW), i)
    new = df.where("id % 4 = 2").select(*VIEW)
    before = postings.manifest(index, 4)
    live = postings.append(index, new, 2)
    assert {r["run"] for r in live.select("run").distinct().collect()} == {"m2", "b2"}
    # A batch that is run again sees what was there before it.
    assert sorted(map(tuple, postings.manifest(index, 4).collect())) == sorted(map(tuple, before.collect()))
    every = df.where("id % 4 < 3")
    ids = {r["id"] for r in new.select("id").collect()}
    pairs, facts = postings.candidates(index, new, live, 2)
    got = {tuple(r) for r in pairs.collect()}
    assert got == {tuple(r) for r in block.build_candidates(every, 2).collect() if {r["a_id"], r["b_id"]} & ids}
    assert {r["id"] for r in facts.collect()} >= {i for a, b, _ in got for i in (a, b)}
    assert {r["id"] for r in postings.unknown(index, df, live).collect()} == {i for i in range(90) if i % 4 == 3}
    # Only the buckets of the asked keys are read.
    keys = spark.createDataFrame([("group", "india|2024-04-01:2025-03-31|count"), ("count", "a:export")], "kind string, key string")
    some = postings.touched(index, keys, live)
    assert {r["kind"] for r in some.collect()} == {"group", "count"} and some.count() < live.where("kind in ('group', 'count')").count()


def test_large_classes_are_paired_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(block, "CHUNK", 4)
    df = drawn(spark, 80, 5)
    made = {tuple(r) for r in block.scored_pairs(df).select("a_id", "b_id", "score").collect()}
    new = df.where("id % 5 = 0").select("id")
    rows = block.paired(df, ["value_num", "unit"], new).collect()
    assert {(r["a_id"], r["b_id"], r["score"]) for r in rows} == {m for m in made if m[0] % 5 == 0 or m[1] % 5 == 0}
    known = {r["id"]: (r["document_id"], r["unit"], r["value_num"], r["attribute_key"]) for r in df.collect()}
    assert all((r["a_unit"], r["a_value_num"]) == known[r["a_id"]][1:3] and (r["b_unit"], r["b_value_num"]) == known[r["b_id"]][1:3] for r in rows)
    assert all(a < b and known[a][0] != known[b][0] and known[a][1] == known[b][1] for a, b, _ in made)
    sizes = block._chunks(block.members(df), []).selectExpr("size(facts) as n").collect()
    assert sum(r["n"] for r in sizes) == df.where("value_num is not null").count() and max(r["n"] for r in sizes) < 20
    # Pairs of facts are made where the arrays meet: no exchange is by a fact of a pair.
    plan = block.paired(df, ["value_num"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(a_id" not in plan and "hashpartitioning(probe" not in plan


def test_large_batches_by_one_pass_and_small_ones_by_the_index_have_the_same_relations(spark):
    df, folder, got = drawn(spark, 40, 7), f"{shared_dir(spark)}/batches", []
    link_batch(spark, df.where("id % 4 = 0"), folder, 0, 2)
    for large in (0.0, float("inf")):  # always a pass over all facts, and never; the second batch also has facts that are there already
        link_batch(spark, df.where("id % 4 <= 1"), folder, 1, 2, bucket=16, large=large)
        made = spark.read.parquet(f"{folder}/relations").where("method = 'rule'")
        got.append(sorted((r["batch"], r["fact_a_id"], r["fact_b_id"], r["verdict"]) for r in made.collect()))
    assert got[0] == got[1] and {g[0] for g in got[0]} == {0, 1}


def test_names_stand_in_the_index_once_and_not_for_each_fact(spark):
    facts = views(spark, *[{"id": i, "document_id": str(i % 3), "attribute_key": "gdp growth", "entity_key": "north india", "value_num": 1.0, "unit": "pp"} for i in range(40)])
    live = postings.append(postings.Index(spark, f"{shared_dir(spark)}/index-names"), facts.select(*VIEW), 0)
    rows = {r["kind"]: r["n"] for r in live.groupBy("kind").agg(F.sum("rows").alias("n")).collect()}
    assert rows["each"] == 2 and rows["chosen"] == 1 and rows["word"] == 2 and sum(rows.values()) <= 3 * 40


def test_a_capped_pass_for_new_facts_leaves_other_families(spark, monkeypatch):
    df = drawn(spark, 120, 11).where("entity_key in ('india', 'china', 'government india')")
    seen, pass_over = [], block.passed
    monkeypatch.setattr(block, "passed", lambda own, *a: seen.append(own.count()) or pass_over(own, *a))
    new = df.where("entity_key = 'china' and id % 3 = 0").select("id")
    ids = {r["id"] for r in new.collect()}
    got = {tuple(r) for r in block.candidates_of(df, new, 2).collect()}
    assert got == {tuple(r) for r in block.build_candidates(df, 2).collect() if {r["a_id"], r["b_id"]} & ids} and got
    assert seen[0] < seen[1]
