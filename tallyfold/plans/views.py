"""Read queries over the layer's tables: listings, timelines, the emergent schema, statistics, scopes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import SEVERITY

MOST_VOCABULARY, MOST_ENTITIES = 150, 10


def severity(verdict: Column) -> Column:
    """Rank of a verdict, the gravest first; unknown ones last."""
    return reduce(lambda c, v: c.when(verdict == v[1], v[0]), list(enumerate(SEVERITY))[1:], F.when(verdict == SEVERITY[0], 0)).otherwise(len(SEVERITY))


def _where(df: DataFrame, *conditions: Column | None) -> DataFrame:
    return reduce(lambda d, c: d.where(c), [c for c in conditions if c is not None], df)


def list_facts(
    facts: DataFrame, documents: DataFrame, document: str | None = None, attribute: str | None = None, entity: str | None = None,
    verified: bool | None = None, q: str | None = None, include_duplicates: bool = False, limit: int = 200, offset: int = 0,
) -> DataFrame:
    """Facts with their document's filename, by id. ``%`` and ``_`` in the texts to look for are wildcards."""
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must be 1 to 1000 and offset 0 or more")
    like = lambda c, v: F.col(c).like(f"%{v.lower()}%")
    any_text = None if not q else F.col("entity").ilike(f"%{q}%") | F.col("attribute").ilike(f"%{q}%") | F.col("quote").ilike(f"%{q}%")
    some = _where(
        facts,
        None if include_duplicates else ~F.col("is_duplicate"),
        F.col("document_id") == document if document else None,
        like("attribute_key", attribute) if attribute else None,
        like("entity_key", entity) if entity else None,
        F.col("evidence_verified") == verified if verified is not None else None,
        any_text,
    )
    return some.join(documents.select("document_id", "filename"), "document_id").orderBy("id").offset(offset).limit(limit)


def list_documents(documents: DataFrame, pages: DataFrame, facts: DataFrame) -> DataFrame:
    """Documents with their pages by status and their facts without duplicates, in the order in which they were created."""
    by_status = pages.groupBy("document_id", "status").agg(F.count(F.lit(1)).alias("n"))
    counts = by_status.groupBy("document_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("pages"))
    own = facts.where(~F.col("is_duplicate")).groupBy("document_id").agg(F.count(F.lit(1)).alias("facts_count"))
    rows = documents.join(counts, "document_id", "left").join(own, "document_id", "left")
    return rows.withColumn("facts_count", F.coalesce("facts_count", F.lit(0))).orderBy("created_at", "document_id")


def with_facts(relations: DataFrame, facts: DataFrame, *columns: str) -> DataFrame:
    """Relations with columns of both their facts, as a_ and b_ columns."""
    for p in ("a", "b"):
        relations = relations.join(facts.select(F.col("id").alias(f"fact_{p}_id"), *[F.col(c).alias(f"{p}_{c}") for c in columns]), f"fact_{p}_id")
    return relations


def list_relations(
    relations: DataFrame, facts: DataFrame, verdict: str | None = None, status: str | None = None, document: str | None = None,
    attribute: str | None = None, limit: int = 200, offset: int = 0,
) -> DataFrame:
    """Relations, gravest and surest first, then by their facts' ids."""
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must be 1 to 1000 and offset 0 or more")
    either = lambda test: test("a") | test("b")
    some = _where(
        with_facts(relations, facts, "document_id", "attribute_key", "entity_key"),
        F.col("verdict") == verdict if verdict else None,
        F.col("status") == status if status else None,
        either(lambda p: F.col(f"{p}_document_id") == document) if document else None,
        either(lambda p: F.col(f"{p}_attribute_key").like(f"%{attribute.lower()}%")) if attribute else None,
    )
    return some.orderBy(severity(F.col("verdict")), F.desc("confidence"), "fact_a_id", "fact_b_id").offset(offset).limit(limit)


def list_failures(failures: DataFrame, stage: str | None = None, kind: str | None = None, document: str | None = None, limit: int = 500) -> DataFrame:
    """Failures, the latest (largest id) first."""
    if not 1 <= limit <= 2000:
        raise ValueError("limit must be 1 to 2000")
    wanted = {"stage": stage, "kind": kind, "document_id": document}
    return _where(failures, *[F.col(c) == v for c, v in wanted.items() if v]).orderBy(F.desc("id")).limit(limit)


def fact_detail(fact_id: int, facts: DataFrame, documents: DataFrame, relations: DataFrame) -> DataFrame:
    """A fact's relations, gravest first, with the fact and its document. Two equi-joins stand for an OR of ids."""
    fact = facts.where(F.col("id") == fact_id).join(documents.select("document_id", "filename"), "document_id", "left")
    both = [relations.where(F.col(c) == fact_id).withColumn("fact_id", F.lit(fact_id).cast("long")) for c in ("fact_a_id", "fact_b_id")]
    own = fact.select(F.col("id").alias("fact_id"), "filename", "entity_key", "attribute_key", "value_num", "unit")
    return own.join(both[0].unionByName(both[1]), "fact_id", "left").orderBy(severity(F.col("verdict")), "fact_a_id", "fact_b_id")


def timelines(facts: DataFrame, documents: DataFrame, relations: DataFrame) -> DataFrame:
    """Vintages of every entity and attribute: for each period its facts by publication, the last of which is current.

    superseded_by: the winner of a relation that the fact lost, the largest if there are several, else the current fact. For
    one timeline, filter by entity_key and attribute_key; the filter reaches the scan.
    """
    some = facts.where(~F.col("is_duplicate")).drop("publication_date").join(documents.select("document_id", "publication_date", "title"), "document_id")
    latest = Window.partitionBy("entity_key", "attribute_key", "period_key").orderBy(F.desc_nulls_last("publication_date"), F.desc("id"))
    some = some.withColumn("_last", F.first("id").over(latest))
    lost = relations.where((F.col("verdict") == "superseded") & F.col("winner_fact_id").isNotNull())
    loser = F.when(F.col("winner_fact_id") == F.col("fact_a_id"), F.col("fact_b_id")).otherwise(F.col("fact_a_id"))
    winners = lost.groupBy(loser.alias("id")).agg(F.max("winner_fact_id").alias("_winner"))
    current = F.col("_last") == F.col("id")
    out = some.join(winners, "id", "left").withColumns({"is_current": current, "superseded_by": F.when(~current, F.coalesce("_winner", "_last"))})
    return out.select("entity_key", "attribute_key", "period_key", "publication_date", F.col("title").alias("document_title"), "id", "value_num", "unit", "is_current", "superseded_by")


def timeline(entity_key: str, attribute_key: str, facts: DataFrame, documents: DataFrame, relations: DataFrame) -> DataFrame:
    one = timelines(facts, documents, relations).where((F.col("entity_key") == entity_key) & (F.col("attribute_key") == attribute_key))
    return one.orderBy("period_key", F.asc_nulls_first("publication_date"), "id")


def attribute_schema(facts: DataFrame) -> DataFrame:
    """What each attribute is called, and its count, units, first entities and estimate types.

    The name is the most frequent one, ties go to the smaller. Entities are ranked as distinct rows before ten of them
    are gathered, so no group of them is held whole.
    """
    some = facts.where(~F.col("is_duplicate"))
    by_key = Window.partitionBy("attribute_key")
    names = some.groupBy("attribute_key", "attribute").agg(F.count(F.lit(1)).alias("n"))
    names = names.groupBy("attribute_key").agg(F.min(F.struct((-F.col("n")).alias("minus"), "attribute")).alias("top"), F.sum("n").alias("n"))
    entities = some.select("attribute_key", "entity").distinct().withColumn("k", F.row_number().over(by_key.orderBy("entity"))).where(F.col("k") <= MOST_ENTITIES)
    entities = entities.groupBy("attribute_key").agg(F.array_sort(F.collect_list("entity")).alias("entities"))
    kinds = some.groupBy("attribute_key").agg(F.array_sort(F.collect_set("unit")).alias("units"), F.array_sort(F.collect_set("estimate_type")).alias("estimate_types"))
    out = names.join(entities, "attribute_key").join(kinds, "attribute_key")
    return out.select("attribute_key", F.col("top.attribute").alias("display_name"), "n", "units", "entities", "estimate_types").orderBy(F.desc("n"), "attribute_key")


def attribute_vocabulary(facts: DataFrame, limit: int = MOST_VOCABULARY) -> DataFrame:
    """The most frequent attributes by their largest name; ties by key."""
    some = facts.where(~F.col("is_duplicate")).groupBy("attribute_key").agg(F.max("attribute").alias("attribute"), F.count(F.lit(1)).alias("n"))
    return some.orderBy(F.desc("n"), "attribute_key").limit(limit)


def layer_stats(documents: DataFrame, pages: DataFrame, facts: DataFrame, relations: DataFrame, failures: DataFrame) -> DataFrame:
    """(name, n): counts of the tables, of distinct attributes, and of relations and failures by kind."""
    own = facts.where(~F.col("is_duplicate"))
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
    each = lambda df, c: df.groupBy(F.concat(F.lit(f"{c}:"), c).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    parts = [one(documents, "documents"), one(pages, "pages"), one(own, "facts"), one(relations, "relations"), one(failures, "failures")]
    parts += [own.agg(F.countDistinct("attribute_key").alias("n")).select(F.lit("attributes").alias("name"), "n"), each(relations, "verdict"), each(failures, "kind")]
    return reduce(DataFrame.unionByName, parts)


def document_progress(pages: DataFrame, facts: DataFrame, most_attempts: int = 3) -> DataFrame:
    """Pages by status and facts of each document, what can still be claimed, and the document's state."""
    count = lambda c: F.count_if(c)
    is_in = F.col("status").isin
    by_doc = pages.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("total"),
        count(is_in("done")).alias("done"),
        count(is_in("skipped")).alias("skipped"),
        count(is_in("failed")).alias("failed"),
        count(is_in("pending", "processing")).alias("pending"),
        count(is_in("pending", "processing") | (is_in("failed") & (F.col("attempts") < most_attempts))).alias("remaining"),
    )
    own = facts.where(~F.col("is_duplicate")).groupBy("document_id").agg(F.count(F.lit(1)).alias("facts_count"))
    state = F.when((F.col("pending") == 0) & (F.col("remaining") == 0), "extracted").otherwise("processing")
    calls = F.ceil(F.col("remaining") / F.greatest(F.col("done"), F.lit(1)))
    return by_doc.join(own, "document_id", "left").withColumns({"facts_count": F.coalesce("facts_count", F.lit(0)), "state": state, "estimated_calls": calls})


def claimable(status: Column, attempts: Column, updated: Column, now: Column, most_attempts: int = 3, lease_s: int = 300) -> Column:
    """Whether a page can be worked on: open, failed with attempts left, or held for longer than the lease."""
    stale = F.unix_timestamp(updated) < F.unix_timestamp(now) - lease_s
    return (status == "pending") | ((status == "failed") & (attempts < most_attempts)) | ((status == "processing") & stale)


def export_scope(documents: DataFrame, pages: DataFrame, facts: DataFrame, relations: DataFrame, failures: DataFrame, scope: DataFrame | None = None) -> dict[str, DataFrame]:
    """The layer's tables for some documents (document_id), or for all.

    A relation is in scope if either fact is, a failure if its document is or if it has none.
    """
    ids = (documents if scope is None else scope).select("document_id").distinct()
    own = facts.join(ids, "document_id", "left_semi")
    keys = own.select(F.col("id").alias("_id"))
    a, b = (F.col(c) == F.col("_id") for c in ("fact_a_id", "fact_b_id"))
    left = relations.join(keys, a, "left_semi")
    right = relations.join(keys, b, "left_semi").join(keys, a, "left_anti")
    return {
        "documents": documents.join(ids, "document_id", "left_semi"),
        "pages": pages.join(ids, "document_id", "left_semi"),
        "facts": own,
        "relations": left.unionByName(right),
        "failures": failures.where("document_id is null").unionByName(failures.join(ids, "document_id", "left_semi")),
        "attribute_schema": attribute_schema(facts),
    }


def export_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, row): every row of a scope as one JSON object. Written as text, tables are parts of one export, whatever their size."""
    parts = [t.select(F.lit(name).alias("table"), F.to_json(F.struct(*sorted(t.columns))).alias("row")) for name, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)
