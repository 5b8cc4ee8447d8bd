"""Arithmetic tie-outs: two parts printed somewhere that add up to a total printed elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import printed_amount, values_equal

# Units that add up, and sizes of groups that are searched.
ADDITIVE = ["count", "INR", "USD", "sq_ft"]
LEAST, MOST = 3, 40
KEY = ["entity_key", "period_key", "unit"]


def arithmetic_edges(facts: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """(big_id, small_id, total_id, place, explanation): big + small = total, as closely as the unit is printed.

    The three share entity, period and unit, have three attributes and come from two documents at least. Only
    groups of LEAST to MOST facts are searched, so a group fits a row, in which its facts meet: facts are shuffled once, and no pairs are. Both parts are below the total.
    With ``new`` (id) only groups that such a fact belongs to are searched, and each edge has one.
    """
    some = facts.where(F.col("unit").isin(*ADDITIVE) & (F.col("value_num") > 0) & F.expr("entity_key is not null and period_key is not null"))
    if new is not None:
        some = some.join(new.select("id", F.lit(True).alias("is_new")).distinct(), "id", "left").fillna(False, ["is_new"])
    else:
        some = some.withColumn("is_new", F.lit(True))
    group = Window.partitionBy(*KEY)
    some = some.select(*KEY, "id", "document_id", "attribute_key", "value_num", "is_new", F.count(F.lit(1)).over(group).alias("_n"), F.max("is_new").over(group).alias("_new"))
    held = some.where(F.col("_n").between(LEAST, MOST) & F.col("_new")).groupBy(*KEY).agg(F.collect_list(F.struct("id", "document_id", "attribute_key", "value_num", "is_new")).alias("facts"))
    named = lambda d, p, *kept: d.select("unit", *kept, F.explode("facts").alias("f")).select("unit", *kept, *[F.col(f"f.{c}").alias(f"{p}_{c}") for c in ("id", "document_id", "attribute_key", "value_num", "is_new")])
    ordered = (F.col("s_value_num") < F.col("b_value_num")) | ((F.col("s_value_num") == F.col("b_value_num")) & (F.col("s_id") < F.col("b_id")))
    small = named(held, "s", "facts")
    parts = named(small, "b", *[c for c in small.columns if c != "unit"]).where(ordered & (F.col("s_attribute_key") != F.col("b_attribute_key")))
    three = named(parts, "t", *[c for c in parts.columns if c not in ("unit", "facts")]).where(
        F.expr("s_is_new or b_is_new or t_is_new")
        & (F.col("b_value_num") < F.col("t_value_num"))
        & ~F.col("t_attribute_key").isin(F.col("s_attribute_key"), F.col("b_attribute_key"))
        & ~((F.col("s_document_id") == F.col("b_document_id")) & (F.col("b_document_id") == F.col("t_document_id")))
        & values_equal(F.col("s_value_num") + F.col("b_value_num"), F.col("t_value_num"), F.col("unit"))
    )
    amount = lambda p: printed_amount(F.col(f"{p}_value_num"))
    told = F.concat(amount("b"), F.lit(" + "), amount("s"), F.lit(" = "), amount("t"), F.lit(" ("), "b_attribute_key", F.lit(" + "), "s_attribute_key", F.lit(" = "), "t_attribute_key", F.lit(")"))
    return three.select(F.col("b_id").alias("big_id"), F.col("s_id").alias("small_id"), F.col("t_id").alias("total_id"), F.struct("s_value_num", "s_id", "b_value_num", "b_id").alias("place"), told.alias("explanation"))


def derived_relations(edges: DataFrame) -> DataFrame:
    """Relations between each part and its total; of several edges for a pair that with the smallest parts tells."""
    part = F.explode(F.array("big_id", "small_id")).alias("part")
    rows = edges.select(part, "total_id", "place", "explanation")
    rows = rows.select(F.least("part", "total_id").alias("fact_a_id"), F.greatest("part", "total_id").alias("fact_b_id"), F.struct("place", "explanation").alias("e"))
    return rows.groupBy("fact_a_id", "fact_b_id").agg(F.min("e").alias("e")).select(
        "fact_a_id", "fact_b_id", F.lit("derived").alias("verdict"), F.lit("final").alias("status"), F.lit("arithmetic").alias("method"),
        F.lit("none").alias("dimension"), F.lit("arithmetic tie-out: parts sum to total").alias("hypothesis"),
        F.lit(0.85).alias("confidence"), F.lit(None).cast("long").alias("winner_fact_id"), F.col("e.explanation").alias("explanation"),
    )
