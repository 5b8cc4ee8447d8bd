"""From pages' answers to facts: split, check, normalise, key, ground and mark duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import canonical_key, fact_key
from ..functions.numbers import normalize_unit, scale_known, to_base_value, values_equal
from ..functions.periods import UNKNOWN, period_key, period_or_dates
from ..schemas import CANDIDATE, ENVELOPE, ESTIMATE_TYPES, QUOTE_SOURCES, VALUE_KINDS
from ..tables import stored
from .classify import plausibility_flags
from .ground import verify_quotes

DEFAULTS = {"value_kind": "number", "estimate_type": "unknown", "quote_source": "text", "confidence": 0.5}
LONGEST_QUOTE = 600


def candidates(pages: DataFrame) -> DataFrame:
    """A row for each fact in the pages' answers: document_id, page_index, ordinal, raw and the CANDIDATE columns.

    pages: document_id, page_index and answer (JSON). ``problem`` is null for facts that are fit, else says why one is not.
    Missing fields take their defaults; fields that are not known are ignored. An answer that is no JSON gives one
    row with a problem and no fact.
    """
    read = pages.withColumn("_e", F.from_json("answer", ENVELOPE))
    broken = F.col("answer").isNotNull() & (F.col("_e").isNull() | F.col("_e.facts").isNull())
    facts = F.when(broken, F.array(F.lit(None).cast("string"))).otherwise(F.coalesce("_e.facts", F.array().cast("array<string>")))
    rows = read.select("document_id", "page_index", F.posexplode(facts).alias("ordinal", "raw"))
    rows = rows.withColumn("_f", F.from_json("raw", CANDIDATE, {"mode": "PERMISSIVE"}))
    field = lambda n: F.coalesce(F.col(f"_f.{n}"), F.lit(DEFAULTS[n])) if n in DEFAULTS else F.col(f"_f.{n}")
    rows = rows.select("document_id", "page_index", "ordinal", "raw", *[field(n).alias(n) for n in CANDIDATE.names])
    empty = lambda c: F.coalesce(F.length(c), F.lit(0)) == 0
    problem = F.when(F.col("raw").isNull(), "answer is not valid")
    for c in ("entity", "attribute", "value", "quote"):
        problem = problem.when(empty(c), f"{c} is empty")
    problem = problem.when(F.length("quote") > LONGEST_QUOTE, "quote is too long").when(~F.col("confidence").between(0, 1), "confidence is out of range")
    for c, known in (("value_kind", VALUE_KINDS), ("estimate_type", ESTIMATE_TYPES), ("quote_source", QUOTE_SOURCES)):
        problem = problem.when(~F.col(c).isin(*known), f"{c} is unknown")
    return rows.withColumn("problem", problem)


def parse_failures(found: DataFrame) -> DataFrame:
    """Failures for the candidates that are not fit."""
    return found.where(F.col("problem").isNotNull()).select("document_id", F.lit("parse").alias("stage"), F.lit("llm_json").alias("kind"), F.substring("problem", 1, 500).alias("message"))


def build_facts(found: DataFrame, pages: DataFrame, documents: DataFrame, first_id: int = 1, fy_start_month: int = 4) -> DataFrame:
    """Facts of the fit candidates, with evidence, normalised values, keys, flags and duplicates marked.

    pages: document_id, page_index, label, text. documents: document_id, publication_date, fiscal_year_start_month (null: the
    default). Ids rise with document, page and ordinal from ``first_id`` on.
    """
    fit = found.where(F.col("problem").isNull()).drop("problem", "raw")
    rows = fit.join(pages.select("document_id", "page_index", F.col("label").alias("page_label"), F.col("text").alias("_page")), ["document_id", "page_index"])
    rows = rows.join(documents.select("document_id", "publication_date", F.coalesce("fiscal_year_start_month", F.lit(fy_start_month)).alias("_fy")), "document_id")
    rows = verify_quotes(rows, "quote", "_page", "quote_source")
    number = to_base_value(F.col("value"), F.col("unit"), F.col("scale"))
    rows = rows.withColumns(
        {
            "unit_raw": F.col("unit"),
            "value_num": F.when(F.col("value_kind") == "number", number),
            "canonical_unit": normalize_unit(F.col("unit")),
            "_period": period_or_dates(F.col("period"), F.col("period_start"), F.col("period_end"), F.col("_fy")),
            "entity_key": canonical_key(F.col("entity")),
            "attribute_key": canonical_key(F.col("attribute")),
            "basis_key": canonical_key(F.col("measurement_basis")),
        }
    ).withColumn("period_key", period_key(F.col("_period")))
    rows = rows.withColumns(
        {
            "fact_key": fact_key(*[F.col(c) for c in ("entity_key", "attribute_key", "period_key", "canonical_unit", "estimate_type", "basis_key")]),
            "period_kind": F.coalesce("_period.kind", F.lit(UNKNOWN)),
            "validator_flags": plausibility_flags(
                F.col("estimate_type"), F.col("canonical_unit"), F.col("value_num"), F.col("_period.end"), F.col("publication_date"),
                scale_known(F.col("canonical_unit"), F.col("unit_raw"), F.col("scale"), F.col("value")),
            ),
        }
    )
    rows = rows.select(
        "document_id", "page_index", "page_label", "ordinal", "entity", "attribute", F.col("value").alias("value_raw"), "value_kind", "unit_raw",
        F.col("scale").alias("scale_raw"), F.col("period").alias("period_raw"), "estimate_type", "measurement_basis", "attributed_to", "quote", "quote_source",
        "confidence", "notes", "value_num", F.col("canonical_unit").alias("unit"), F.col("_period.start").alias("period_start"), F.col("_period.end").alias("period_end"),
        "period_kind", "entity_key", "attribute_key", "period_key", "basis_key", "fact_key", F.col("grounding.verified").alias("evidence_verified"),
        F.col("grounding.score").alias("verify_score"), F.col("grounding.method").alias("verify_method"), "validator_flags", "publication_date",
    )
    return mark_duplicates(numbered(rows, ["document_id", "page_index", "ordinal"], first_id))


def numbered(rows: DataFrame, order: list[str], first_id: int = 1) -> DataFrame:
    """Rows with consecutive ids in an order.

    Rows are dealt by ranges of the order, which splits large documents too. A row's id is its place in its range after
    the rows of earlier ranges; only the ranges' counts, a row each, meet in one task.
    """
    # Ranges are found by reading the rows once more, so they are made once before.
    rows = stored(rows, "unnumbered")
    ranged = stored(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(starts), "_part").withColumn("id", F.col("_start") + place + (first_id - 1)).drop("_part", "_start")


def mark_duplicates(facts: DataFrame) -> DataFrame:
    """``is_duplicate`` for facts whose value equals that of the first with their document and key, by id.

    The first is never a duplicate; without a number, neither it nor the fact makes one.
    """
    by_key = Window.partitionBy("document_id", "fact_key").orderBy("id")
    first, place = F.first("value_num").over(by_key), F.row_number().over(by_key)
    same = F.coalesce(values_equal(F.col("value_num"), F.col("_first"), F.col("unit")), F.lit(False))
    return facts.withColumns({"_first": first, "_place": place}).withColumn("is_duplicate", (F.col("_place") > 1) & same).drop("_first", "_place")
