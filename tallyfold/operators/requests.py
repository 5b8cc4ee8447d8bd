"""Requests to an external model, and what its answers change: metadata of documents, facts to be told, work that is open."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bind
from ..plans.views import MOST_VOCABULARY, claimable
from ..schemas import DOCUMENT_META
from ..sources.memo import answers, request_key
from .link import MOST_ATTEMPTS, PAIR, adjudicate, counts_by, rule_pass

# How much of a text a request carries.
MOST_PAGE_TEXT, FIRST_PAGES = 6000, 3


def plain_number(value: Column) -> Column:
    """A double as the fewest digits that name it, with a point, and an exponent from 1e16 on and below 0.0001. Below 1e-307 digits may be too many."""

    def placed(text: Column) -> Column:
        bare = F.ltrim(text, F.lit("-"))
        power = F.substring_index(bare, "e", -1).cast("int")
        digits = F.rtrim(F.replace(F.substring_index(bare, "e", 1), F.lit(".")), F.lit("0"))
        first, rest = F.left(digits, F.lit(1)), F.substring(digits, 2, 20)
        pointed = F.concat(F.left(F.rpad(digits, power + 1, F.lit("0")), power + 1), F.lit("."), F.coalesce(F.nullif(F.substring(digits, power + 2, F.lit(20)), F.lit("")), F.lit("0")))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
        scientific = F.concat(first, F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""), F.substring(text, F.instr(text, "e"), F.lit(9)))
        shown = F.when((power >= 16) | (power < -4), scientific).when(power < 0, small).otherwise(pointed)
        return F.concat(F.when(text.startswith("-"), "-").otherwise(""), shown)

    def fewest(v: Column) -> Column:
        text = lambda n: F.format_string(f"%.{n - 1}e", v)
        return F.coalesce(*[F.when(text(n).cast("double") == v, text(n)) for n in (15, 16)], text(17))

    finite = lambda v: ~(F.isnan(v) | F.abs(v).isin(float("inf")))
    odd = lambda v: F.when(F.isnan(v), "nan").when(v > 0, "inf").otherwise("-inf")
    return bind(value.cast("double"), lambda v: F.when(finite(v), bind(fewest(v), placed)).when(v.isNotNull(), odd(v)))


def describe_facts(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, description) of facts: all that a judge of a pair may read of one, a line for each property.

    documents: document_id, title, filename, publisher, publication_date. What a fact does not state is said to be missing.
    """
    named = documents.select("document_id", F.coalesce("title", "filename").alias("_title"), F.coalesce("publisher", F.lit("unknown")).alias("_publisher"), F.coalesce(F.col("publication_date").cast("string"), F.lit("unknown")).alias("_published"))
    rows = facts.drop("publication_date").join(named, "document_id")
    has = lambda c: F.coalesce(F.col(c), F.lit(""))
    or_else = lambda c, other: F.when(has(c) != "", F.col(c)).otherwise(other)
    dates = F.when(F.col("period_start").isNotNull() & F.col("period_end").isNotNull(), F.concat(F.lit(" ("), F.col("period_start").cast("string"), F.lit(" to "), F.col("period_end").cast("string"), F.lit(")")))
    number = F.coalesce(plain_number(F.col("value_num")), F.lit("None"))
    told = [
        ("entity", F.col("entity")),
        ("attribute", F.col("attribute")),
        ("value", F.rtrim(F.concat_ws(" ", has("value_raw"), has("unit_raw"), has("scale_raw")))),
        ("normalised value", F.concat_ws(" ", number, "unit")),
        ("period", F.concat(or_else("period_raw", F.lit("unknown")), F.coalesce(dates, F.lit("")))),
        ("estimate type", F.col("estimate_type")),
        ("measurement basis", or_else("measurement_basis", F.lit("not stated"))),
        ("attributed to", or_else("attributed_to", F.lit("the document itself"))),
        ("document", F.concat("_title", F.lit("; publisher: "), "_publisher", F.lit("; published: "), "_published")),
        ("page label", F.coalesce("page_label", F.col("page_index").cast("string"))),
        ("evidence verified", F.concat(F.initcap(F.col("evidence_verified").cast("string")), F.lit(" ("), F.coalesce("verify_method", F.lit("")), F.lit(")"))),
        ("quote", F.concat(F.lit('"'), has("quote"), F.lit('"'))),
    ]
    return rows.select("id", F.concat_ws("\n", *[F.concat(F.lit(f"{name}: "), F.coalesce(c, F.lit(""))) for name, c in told]).alias("description"))


def page_requests(pages: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(document_id, page_index, request) of pages: known attributes, as many as MOST_VOCABULARY, and the first MOST_PAGE_TEXT characters."""
    terms = ", ".join(vocabulary[:MOST_VOCABULARY]) or "(none yet)"
    text = F.substring(F.coalesce("text", F.lit("")), 1, MOST_PAGE_TEXT)
    lines = F.concat_ws("\n", F.concat(F.lit("page: "), F.col("page_index").cast("string"), F.lit(", label: "), F.coalesce("label", F.lit("none"))), F.lit(f"known attributes: {terms}"), F.lit("text:"), text)
    return pages.select("document_id", "page_index", lines.alias("request"))


def metadata_requests(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, request, key) of documents without metadata: their first pages' texts in order, a blank line between them.

    A document's FIRST_PAGES first pages are ranked before they are gathered, so no group holds more. Up to twice MOST_PAGE_TEXT characters
    are carried. A document without pages has an empty text.
    """
    rank = F.row_number().over(Window.partitionBy("document_id").orderBy("page_index"))
    first = pages.select("document_id", "page_index", F.coalesce("text", F.lit("")).alias("text")).withColumn("k", rank).where(F.col("k") <= FIRST_PAGES)
    texts = first.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_index", "text"))).alias("p"))
    joined = texts.select("document_id", F.substring(F.array_join(F.col("p.text"), "\n\n"), 1, 2 * MOST_PAGE_TEXT).alias("text"))
    open_ones = documents.where(~F.coalesce("meta_done", F.lit(False))).select("document_id", "filename").join(joined, "document_id", "left")
    request = F.concat(F.lit("file: "), F.coalesce("filename", F.lit("")), F.lit("\nfirst pages:\n"), F.coalesce("text", F.lit("")))
    out = open_ones.select("document_id", request.alias("request"))
    return out.withColumn("key", request_key(F.lit("meta"), F.col("request")))


def with_metadata(documents: DataFrame, told: DataFrame, fy_start_month: int = 4) -> DataFrame:
    """Documents with what answers (document_id, response, error) say of them, and meta_done.

    response: JSON of DOCUMENT_META. What an answer leaves out, or states in no valid form, stays as it was; a document has the default fiscal
    year then. A document whose metadata is done, or that has no answer, or an error, or a malformed one, stays as it is: extraction
    goes on without.
    """
    read = told.where(F.col("error").isNull()).select("document_id", F.from_json("response", DOCUMENT_META).alias("_m"))
    # A malformed answer is read as one without any property.
    read = read.where(F.coalesce(*[F.col(f"_m.{c}").cast("string") for c in DOCUMENT_META.names]).isNotNull()).dropDuplicates(["document_id"])
    rows = documents.join(read, "document_id", "left")
    new = F.col("_m").isNotNull() & ~F.coalesce("meta_done", F.lit(False))
    text = lambda c: F.nullif(F.col(f"_m.{c}"), F.lit(""))
    date = F.when(F.col("_m.publication_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(F.col("_m.publication_date"), "yyyy-MM-dd"))
    month = F.when(F.col("_m.fiscal_year_start_month").between(1, 12), F.col("_m.fiscal_year_start_month"))
    values = {"title": text("title"), "publisher": text("publisher"), "publication_date": date, "document_type": text("document_type")}
    out = {c: F.when(new, F.coalesce(v, F.col(c))).otherwise(F.col(c)) for c, v in values.items()}
    out["fiscal_year_start_month"] = F.when(new, F.coalesce(month, F.lit(fy_start_month))).otherwise(F.col("fiscal_year_start_month"))
    out["meta_done"] = F.coalesce("meta_done", F.lit(False)) | new
    return rows.withColumns(out).select(*documents.columns)


def metadata_failures(told: DataFrame) -> DataFrame:
    """Failures of metadata requests that got an error."""
    bad = told.where(F.col("error").isNotNull())
    return bad.select("document_id", F.lit("meta").alias("stage"), F.col("error").alias("kind"), F.substring(F.coalesce("response", F.col("error")), 1, 2000).alias("message"))


def open_pages(pages: DataFrame, now: Column, retry_failed: bool = False) -> DataFrame:
    """Pages that can be worked on, by document and index. retry_failed gives failed ones all their attempts back."""
    if retry_failed:
        pages = pages.withColumn("attempts", F.when(F.col("status") == "failed", 0).otherwise(F.col("attempts")))
    return pages.where(claimable(F.col("status"), F.col("attempts"), F.col("updated_at"), now)).orderBy("document_id", "page_index")


def _open(relations: DataFrame) -> DataFrame:
    rows = relations if "attempts" in relations.columns else relations.withColumn("attempts", F.lit(0))
    return rows.where((F.col("status") == "pending_llm") & (F.col("attempts") < MOST_ATTEMPTS))


def open_relations(relations: DataFrame) -> DataFrame:
    """Relations that wait for a judgement and have attempts left, in order."""
    return _open(relations).orderBy(*PAIR)


def judgement_requests(relations: DataFrame, facts: DataFrame, documents: DataFrame) -> DataFrame:
    """(fact_a_id, fact_b_id, request, key) of open relations: the rule's guess and both facts' descriptions."""
    rows = _open(relations).select(*PAIR, "hypothesis")
    asked = rows.select(F.explode(F.array(*PAIR)).alias("id")).distinct()
    told = describe_facts(facts.join(asked, "id", "left_semi"), documents)
    for p in ("a", "b"):
        rows = rows.join(told.select(F.col("id").alias(f"fact_{p}_id"), F.col("description").alias(f"_{p}")), f"fact_{p}_id")
    request = F.concat(F.lit("guess: "), "hypothesis", F.lit("\n\nfact a\n"), "_a", F.lit("\n\nfact b\n"), "_b")
    return rows.select(*PAIR, request.alias("request"), request_key(F.lit("adjudicate"), request).alias("key"))


JUDGEMENT = "verdict string, dimension string, explanation string, confidence double, winner string"


def link_job(
    views: DataFrame, unpaired: DataFrame, existing: DataFrame, facts: DataFrame, documents: DataFrame, records: DataFrame,
    mode: str = "replay", provider: Callable[[pd.Series], list] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(relations, counts by status and verdict): new relations by rules join the existing ones, and what is open is judged.

    A relation without a recorded answer stays open and spends no attempt; a malformed answer counts as an error.
    """
    made = rule_pass(views, unpaired, existing)
    every = existing.unionByName(made, allowMissingColumns=True).withColumn("attempts", F.coalesce("attempts", F.lit(0)) if "attempts" in existing.columns else F.lit(0))
    asked = judgement_requests(every, facts, documents)
    model = {"model": F.lit("judge"), "purpose": F.lit("adjudicate")}
    told, _ = answers(asked.withColumns(model), records, mode, provider)
    read = told.where(~F.coalesce(F.col("error"), F.lit("")).isin("llm_cache_miss", "llm_off")).withColumn("_j", F.from_json("response", JUDGEMENT))
    error = F.coalesce("error", F.when(F.col("_j.verdict").isNull(), "llm_json"))
    out = adjudicate(every, read.select(*PAIR, "_j.*", error.alias("error")), facts)
    return out, counts_by(out, "status", "verdict")
