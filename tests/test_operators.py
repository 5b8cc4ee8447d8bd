from __future__ import annotations

import json
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import block, classify, facts, ground, link, tieout
from tallyfold.schemas import VIEW

SCHEMA = "id long, document_id string, entity_key string, attribute_key string, value_num double, unit string, period_key string, estimate_type string, basis_key string, attributed_to string, evidence_verified boolean, publication_date date"
BASE = {"id": 1, "document_id": "a", "entity_key": "india", "attribute_key": "gdp growth", "value_num": 6.4, "unit": "percent", "period_key": "2024-04-01:2025-03-31", "estimate_type": "actual", "basis_key": "", "attributed_to": None, "evidence_verified": True, "publication_date": date(2025, 1, 30)}


def views(spark, *changes):
    return spark.createDataFrame([tuple((BASE | c)[k] for k in VIEW) for c in changes], SCHEMA)


CASES = [
    ({}, ("corroborates", "final", "none")),
    ({"value_num": 6.5, "estimate_type": "revised", "publication_date": date(2025, 5, 29)}, ("superseded", "final", "vintage")),
    ({"value_num": 6.5, "estimate_type": "revised"}, ("superseded", "pending_llm", "vintage")),
    ({"value_num": 6.5, "estimate_type": "third_party", "publication_date": date(2025, 5, 29)}, ("superseded", "pending_llm", "vintage")),
    ({"period_key": "2023-04-01:2024-03-31"}, ("context_explained", "final", "period")),
    ({"value_num": 7.0, "estimate_type": "projection"}, ("context_explained", "final", "estimate_type")),
    ({"estimate_type": "projection"}, ("corroborates", "final", "estimate_type")),
    ({"value_num": 8.1}, ("contradicts", "pending_llm", "value")),
    ({"period_key": "unknown"}, ("unresolved", "pending_llm", "period")),
    ({"attributed_to": "agency"}, ("corroborates", "final", "attribution")),
    ({"attributed_to": "agency", "value_num": 9.0}, ("unresolved", "pending_llm", "attribution")),
    ({"unit": "pp"}, None),
    ({"value_num": None}, None),
]


@pytest.mark.parametrize(("change", "expected"), CASES)
def test_rules(spark, change, expected):
    df = views(spark, {}, {"id": 2, "document_id": "b"} | change)
    pairs = classify.as_pairs(spark.createDataFrame([(1, 2)], "a_id long, b_id long"), df)
    got = classify.classify_pairs(pairs).collect()
    assert [(r["verdict"], r["status"], r["dimension"]) for r in got] == ([expected] if expected else [])


def test_bases_and_confidence(spark):
    df = views(spark, {"basis_key": "x"}, {"id": 2, "basis_key": "y", "value_num": 8.0, "evidence_verified": False})
    (r,) = classify.classify_pairs(classify.as_pairs(spark.createDataFrame([(1, 2)], "a_id long, b_id long"), df)).collect()
    assert (r["verdict"], r["dimension"], r["confidence"]) == ("unresolved", "basis", 0.25)


def greedy(pairs, most):
    """The pass in order, one pair after the other."""
    had, out = {}, set()
    for a, b, *_ in sorted(pairs, key=lambda p: (p[3], -p[2], p[4])):
        if had.get(a, 0) < most and had.get(b, 0) < most:
            out.add((a, b))
            had[a], had[b] = had.get(a, 0) + 1, had.get(b, 0) + 1
    return out


@pytest.mark.parametrize("most", [1, 2, 3])
def test_cap_is_the_greedy_pass(spark, most):
    rng = random.Random(most)
    rows = {}
    for _ in range(120):
        a, b = sorted(rng.sample(range(30), 2))
        rows[a, b] = (a, b, rng.choice([0.5, 0.75, 1.0]), *rng.choice([(a, b), (b, a)]))
    df = spark.createDataFrame(list(rows.values()), "a_id long, b_id long, score double, probe long, partner long")
    assert {(r["a_id"], r["b_id"]) for r in block.capped_pairs(df, most).collect()} == greedy(list(rows.values()), most)


def test_blocking(spark):
    df = views(
        spark,
        {"entity_key": "india"}, {"id": 2, "document_id": "b", "entity_key": "government india"}, {"id": 3, "document_id": "b", "entity_key": "china"}, {"id": 4, "document_id": "b", "unit": "pp"},
        {"id": 5, "document_id": "c", "attribute_key": "gdp growth real"}, {"id": 6, "document_id": "c", "value_num": None}, {"id": 7, "document_id": "d", "entity_key": ""}, {"id": 8, "document_id": "e", "attribute_key": ""},
        {"id": 9, "document_id": "e", "attribute_key": "gdp growths"},
    )
    got = {(r["a_id"], r["b_id"]): r["score"] for r in block.scored_pairs(df).collect()}
    assert {(1, 2), (1, 5), (2, 5), (1, 7), (2, 7), (3, 7), (5, 7)} <= set(got)
    assert not {(1, 3), (1, 4), (1, 6), (1, 8)} & set(got)
    assert got[1, 5] == pytest.approx(2 / 3) and got[1, 9] == pytest.approx(2 * 10 / 21)


def test_blocking_cap(spark):
    df = views(spark, *[{"id": i, "document_id": str(i)} for i in range(1, 62)])
    pairs = block.build_candidates(df).collect()
    n = {}
    for r in pairs:
        for k in ("a_id", "b_id"):
            n[r[k]] = n.get(r[k], 0) + 1
    assert max(n.values()) == 50


def test_tieout(spark):
    add = lambda i, d, a, v, **k: {"id": i, "document_id": d, "attribute_key": a, "value_num": v, "unit": "count"} | k
    df = views(spark, add(1, "a", "rural", 63713.0), add(2, "a", "urban", 34422.0), add(3, "b", "total", 98135.0))
    (e,) = tieout.arithmetic_edges(df).collect()
    assert (e["big_id"], e["small_id"], e["total_id"]) == (1, 2, 3)
    assert e["explanation"] == "63,713 + 34,422 = 98,135 (rural + urban = total)"
    assert tieout.derived_relations(tieout.arithmetic_edges(df)).count() == 2
    one = views(spark, add(1, "a", "rural", 6.0), add(2, "a", "urban", 4.0), add(3, "a", "total", 10.0))
    assert tieout.arithmetic_edges(one).count() == 0
    assert tieout.arithmetic_edges(df.withColumn("unit", F.lit("percent"))).count() == 0


def test_link_is_incremental(spark):
    df = views(spark, {}, {"id": 2, "document_id": "b", "value_num": 8.0}, {"id": 3, "document_id": "c"})
    none = spark.createDataFrame([], "fact_a_id long, fact_b_id long")
    first = link.rule_pass(df, df, none)
    assert first.count() == 3
    assert link.rule_pass(df, df, first).count() == 0
    assert link.rule_pass(df, df.where("id = 3"), none).count() == 2


@pytest.mark.parametrize(("most", "new"), [(1, [1, 12, 20]), (2, [3, 11, 19])])
def test_new_facts_are_paired_as_in_a_full_pass(spark, most, new):
    rng = random.Random(most)
    attributes, entities = ["gdp growth", "gdp growth real", "gdp growths", "export"], ["india", "government india", "china", ""]
    rows = [{"id": i, "document_id": str(i % 7), "attribute_key": rng.choice(attributes), "entity_key": rng.choice(entities), "value_num": float(rng.randrange(1, 9)), "unit": "count"} for i in range(1, 21)]
    df, ids = views(spark, *rows).coalesce(1), spark.createDataFrame([(i,) for i in new], "id long").coalesce(1)
    whole = {tuple(r) for r in block.build_candidates(df, most).collect() if {r["a_id"], r["b_id"]} & set(new)}
    assert whole and {tuple(r) for r in block.candidates_of(df, ids, most).collect()} == whole


def test_new_facts_are_tied_out_as_in_a_full_pass(spark):
    rng = random.Random(5)
    df = views(spark, *[{"id": i, "document_id": str(i % 4), "attribute_key": f"part {i % 5}", "value_num": float(rng.randrange(1, 9)), "unit": "count", "entity_key": rng.choice("xyz")} for i in range(1, 41)])
    ids = spark.createDataFrame([(5,), (30,)], "id long")
    edges = [r for r in tieout.arithmetic_edges(df).collect() if {r["big_id"], r["small_id"], r["total_id"]} & {5, 30}]
    assert edges and sorted(map(tuple, tieout.arithmetic_edges(df, ids).collect())) == sorted(map(tuple, edges))


def test_adjudication(spark):
    df = views(spark, {}, {"id": 2, "document_id": "b", "value_num": 8.0, "evidence_verified": False})
    rel = link.rule_pass(df, df, spark.createDataFrame([], "fact_a_id long, fact_b_id long"))
    schema = "fact_a_id long, fact_b_id long, verdict string, dimension string, explanation string, confidence double, winner string, error string"
    told = spark.createDataFrame([(1, 2, "superseded", "odd", "newer", 0.8, "b", None)], schema)
    (r,) = link.adjudicate(rel, told, df).collect()
    assert (r["verdict"], r["dimension"], r["status"], r["method"], r["winner_fact_id"], r["confidence"]) == ("superseded", "none", "final", "llm", 2, 0.4)
    bad = spark.createDataFrame([(1, 2, None, None, None, None, None, "llm_other")], schema)
    for _ in range(3):
        rel = link.adjudicate(rel, bad, df)
    (r,) = rel.collect()
    assert (r["status"], r["attempts"], r["verdict"]) == ("failed", 3, "contradicts")


def test_grounding(spark):
    page = "Real GDP grew by 6.4 per cent in 2024-25, as per the First Advance Estimates of the office."
    rows = [("GDP grew by 6.4 per cent", "text"), ("gdp GREW, by 6.4 per-cent", "text"), ("Real GDP grw by 6.4 per cnt in 2024-25", "text"), ("nothing of the kind at all here", "text"), ("nothing of the kind at all here", "image"), ("  ", "text"), (None, "text")]
    df = spark.createDataFrame([(i, q, page, s) for i, (q, s) in enumerate(rows)], "i int, quote string, text string, src string")
    got = [r["grounding"]["method"] for r in ground.verify_quotes(df, source="src").orderBy("i").collect()]
    assert got == ["exact", "normalized", "fuzzy", "not_found", "image_only", "not_found", "not_found"]


def test_a_page_is_taken_apart_once(spark, capsys):
    df = spark.createDataFrame([("GDP grw by 6.4", "Real GDP grew by 6.4 per cent.")], "quote string, text string")
    ground.verify_quotes(df).explain()
    assert capsys.readouterr().out.count("regexp_replace(lower(coalesce(text") == 1


def test_page_to_facts(spark):
    page = "Real GDP grew by 6.4 per cent in 2024-25. Exports were US$ 45.6 bn."
    fact = {"entity": "India", "attribute": "Growth of real GDP", "value": "6.4", "unit": "per cent", "period": "2024-25", "quote": "GDP grew by 6.4 per cent", "estimate_type": "advance_estimate"}
    listed = [fact, fact | {"attribute": "Exports", "value": "45.6", "unit": "US$", "scale": "bn", "quote": "Exports were US$ 45.6 bn"}, fact | {"quote": "a chart", "quote_source": "image", "attribute": "Chart"}, fact | {"quote": "Real GDP grew"}, fact | {"entity": ""}, {"value": 3}]
    answers = spark.createDataFrame([("d", 0, json.dumps({"page_kind": "prose", "facts": listed})), ("d", 1, "no json"), ("d", 2, None)], "document_id string, page_index int, answer string")
    found = facts.candidates(answers)
    assert facts.parse_failures(found).count() == 3
    pages = spark.createDataFrame([("d", i, None, page) for i in range(3)], "document_id string, page_index int, label string, text string")
    documents = spark.createDataFrame([("d", date(2025, 1, 30), None)], "document_id string, publication_date date, fiscal_year_start_month int")
    made = facts.build_facts(found, pages, documents).orderBy("id").collect()
    assert [r["is_duplicate"] for r in made] == [False, False, False, True]
    assert [r["verify_method"] for r in made] == ["exact", "exact", "image_only", "exact"]
    assert made[1]["value_num"] == pytest.approx(4.56e10) and made[0]["period_key"] == "2024-04-01:2025-03-31"
    assert made[0]["validator_flags"] == ["period_after_publication"]
    kinds = {r["kind"] for r in ground.evidence_failures(facts.build_facts(found, pages, documents)).collect()}
    assert kinds == {"image_only_evidence", "validator"}


def test_classes_of_one_document_make_no_pairs(spark):
    facts = views(spark, {"id": 1, "document_id": "a"}, {"id": 2, "document_id": "a"}, {"id": 3, "document_id": "a", "entity_key": "government india"}, {"id": 4, "document_id": "b", "entity_key": "government india"})
    between = block.class_pairs(block.classes(block.members(facts)))
    # The class of the first two facts is in one document, and so not paired with itself.
    assert between.where("p_class = q_class").count() == 1 and between.count() == 3
    assert {(r["a_id"], r["b_id"]) for r in block.build_candidates(facts, 1).collect()} == {(1, 4)}


def test_capped_pairs_are_made_where_they_are_taken(spark):
    facts = views(spark, *[{"id": i, "document_id": str(i % 3)} for i in range(300)]).coalesce(1)
    made = [tuple(r) for r in block.scored_pairs(facts).collect()]
    kept = block.build_candidates(facts, 4)
    assert {(r["a_id"], r["b_id"]) for r in kept.collect()} == greedy(made, 4)
    # Facts and classes are all that is shuffled for the pass: no list of pairs is.
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(family" in plan and "hashpartitioning(p#" not in plan and "Window" not in plan


def test_tieout_shuffles_facts_once(spark):
    facts = views(spark, *[{"id": i, "document_id": str(i), "attribute_key": f"a{i}", "value_num": float(i + 1), "unit": "count"} for i in range(40)])
    edges = tieout.arithmetic_edges(facts)
    want = {(b - 1, s - 1, b + s - 1) for b in range(1, 41) for s in range(1, b) if b + s <= 40}
    assert {(r["big_id"], r["small_id"], r["total_id"]) for r in edges.collect()} == want
    assert tieout.arithmetic_edges(facts.unionByName(facts.limit(1).withColumn("id", F.lit(99).cast("long")))).count() == 0
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.split("== Initial Plan ==")[-1] and plan.split("== Initial Plan ==")[-1].count("Exchange") == 1
