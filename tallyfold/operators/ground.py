"""Grounding: whether a quote stands on its page, and how it was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fuzzy import partial_score_udf
from ..functions.text import strip

RESULT = "struct<verified:boolean,score:double,method:string>"


def _spaced(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")


def _bare(spaced: Column) -> Column:
    return F.replace(spaced, F.lit(" "), F.lit(""))


def _result(verified: bool, score: Column | float, method: str) -> Column:
    score = F.lit(score) if isinstance(score, float) else score
    return F.struct(F.lit(verified).alias("verified"), score.alias("score"), F.lit(method).alias("method"))


def _as_it_is(quote: Column, page: Column) -> Column:
    q = strip(F.coalesce(quote, F.lit("")))
    return F.when(q == "", _result(False, 0.0, "not_found")).when(F.coalesce(page, F.lit("")).contains(q), _result(True, 1.0, "exact"))


def _normalized(quote: Column, spaced_page: Column) -> Column:
    return F.when(_bare(spaced_page).contains(_bare(_spaced(F.coalesce(quote, F.lit(""))))), _result(True, 1.0, "normalized"))


def exact_tiers(quote: Column, page: Column) -> Column:
    """The result of the tiers without alignment, null if they do not find the quote."""
    return F.coalesce(_as_it_is(quote, page), _normalized(quote, _spaced(F.coalesce(page, F.lit("")))))


def verify_quotes(rows: DataFrame, quote: str = "quote", page: str = "text", source: str | None = None) -> DataFrame:
    """All columns and ``grounding`` (verified, score, method).

    The text as it is, then without case and punctuation, then a close alignment; a quote from an image that is not found
    says so. Only rows that the first two tiers leave are aligned: for the others nulls go to the function. Rows are read
    once, and a page's words are told once for both tiers. A null page is empty, a null quote is not found.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    tried = rows.withColumn("_tier", _as_it_is(F.col(quote), F.col(page)))
    tried = tried.withColumn("_spaced", F.when(F.col("_tier").isNull(), _spaced(text(page))))
    tried = tried.withColumn("_tier", F.coalesce("_tier", _normalized(F.col(quote), F.col("_spaced"))))
    left = lambda spaced: F.when(F.col("_tier").isNull(), F.trim(spaced))
    rest = tried.withColumn("_score", partial_score_udf(left(_spaced(text(quote))), left(F.col("_spaced"))))
    score = F.col("_score.score")
    lost = _result(False, score, "not_found")
    if source:
        lost = F.when(F.col(source) == "image", _result(False, 0.0, "image_only")).otherwise(lost)
    close = F.when(F.col("_score.close"), _result(True, score, "fuzzy")).otherwise(lost)
    return rest.withColumn("grounding", F.coalesce("_tier", close)).drop("_tier", "_spaced", "_score")


def evidence_failures(facts: DataFrame) -> DataFrame:
    """(document_id, fact_id, stage, kind, message) of facts that are not grounded or have flags."""
    method = F.col("verify_method")
    entry = lambda stage, kind, message: F.struct(F.lit(stage).alias("stage"), F.lit(kind).alias("kind"), message.alias("message"))
    quote = F.substring(F.coalesce("quote", F.lit("")), 1, 200)
    found = F.array(
        F.when(method == "not_found", entry("verify", "quote_not_found", quote)),
        F.when(method == "image_only", entry("verify", "image_only_evidence", quote)),
        F.when(F.size("validator_flags") > 0, entry("validate", "validator", F.array_join("validator_flags", ", "))),
    )
    rows = facts.select("document_id", F.col("id").alias("fact_id"), F.explode(F.filter(found, lambda f: f.isNotNull())).alias("f"))
    return rows.select("document_id", "fact_id", "f.stage", "f.kind", "f.message")
