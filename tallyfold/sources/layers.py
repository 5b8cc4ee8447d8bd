"""Copies and versions of the layer's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def copy_layer(source: dict[str, DataFrame], target: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The target's tables after it has taken over the source's documents, with the same ids.

    What the target has of those documents goes, relations with their facts, and what the source has comes. Tables: documents,
    pages, facts, relations, failures and, if there is one, llm_cache, whose known keys stay as they are.
    """
    ids = source["documents"].select("document_id").distinct()
    gone = target["facts"].join(ids, "document_id", "left_semi").select(F.col("id").alias("_id"))
    out = {}
    for name in ("documents", "pages", "facts", "failures"):
        out[name] = target[name].join(ids, "document_id", "left_anti").unionByName(source[name].join(ids, "document_id", "left_semi"))
    own = source["facts"].join(ids, "document_id", "left_semi").select(F.col("id").alias("_id"))
    kept = target["relations"].join(gone, F.col("fact_a_id") == F.col("_id"), "left_anti").join(gone, F.col("fact_b_id") == F.col("_id"), "left_anti")
    out["relations"] = kept.unionByName(source["relations"].join(own, F.col("fact_a_id") == F.col("_id"), "left_semi"))
    if "llm_cache" in source:
        out["llm_cache"] = target["llm_cache"].unionByName(source["llm_cache"].join(target["llm_cache"].select("key"), "key", "left_anti"))
    return out


def delete_documents(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The tables without some documents (document_id), their pages, facts and relations; failures stay."""
    ids = gone.select("document_id").distinct()
    facts = tables["facts"].join(ids, "document_id", "left_semi").select(F.col("id").alias("_id"))
    out = {n: tables[n].join(ids, "document_id", "left_anti") for n in ("documents", "pages", "facts")}
    out["relations"] = tables["relations"].join(facts, F.col("fact_a_id") == F.col("_id"), "left_anti").join(facts, F.col("fact_b_id") == F.col("_id"), "left_anti")
    return tables | out


def next_id(df: DataFrame, column: str = "id") -> Column | int:
    """One more than the largest id, 1 for an empty table."""
    return (df.agg(F.max(column)).first()[0] or 0) + 1


def latest(versions: DataFrame, key: list[str], version: str = "version") -> DataFrame:
    """The last version of each row of an append-only table."""
    rest = [c for c in versions.columns if c not in key]
    top = versions.groupBy(*key).agg(F.max_by(F.struct(*rest), version).alias("_v"))
    return top.select(*key, *[F.col(f"_v.{c}").alias(c) for c in rest])
