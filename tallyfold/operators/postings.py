"""A stored inverted index of facts, so that a batch of new facts is linked without reading the history.

The index is a set of runs, one for each batch until several are merged. A run has rows of these kinds, each under a key:

* ``each``: a name under every word of it; found by the rarest word of a new fact's name
* ``chosen``: a name under the word of it that was the rarest then; found by all words of a new fact's name
* ``fact``: a named fact under unit and name; found by new facts whose names match that name
* ``bare``: a fact without a name under unit and attribute word; found by all new facts
* ``word``: a name under unit and attribute word of one of its facts; found by new facts without a name
* ``group``: what tie-outs read of a fact that adds up, under entity, period and unit
* ``id``: a fact under its id
* ``count``: an attribute word or name word and the number of its facts

Names match if one holds all words of the other, so ``each`` finds the names that hold a new fact's, and ``chosen``, with any word of
theirs, those that a new fact's holds. Names stand there once a run, whatever the number of their facts, so a run has about three rows for a fact
of a name with several. A run's kind is dealt into buckets by a hash of the key, so many that a bucket has some BUCKET
rows whatever the history's size; a key with more rows has buckets of its own. The manifest says which buckets there are; a
lookup reads those of its keys and no others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import entities_match, tokens
from ..schemas import VIEW
from ..tables import stored
from .block import ANCHORS, MOST_PARTNERS, capped_pairs, near_enough
from .tieout import ADDITIVE
from .tieout import KEY as TIED_BY

#: Rows of a bucket, and runs from which on small ones are merged.
BUCKET, MOST_RUNS = 16_384, 8
FACT = "id long, document_id string, entity_key string, attribute_key string, value_num double, unit string, period_key string, estimate_type string, basis_key string, attributed_to string, evidence_verified boolean, publication_date date"
ROW = f"key string, n long, {FACT}"
MANIFEST = "run string, kind string, bucket long, buckets long, rows long"
KINDS = ("each", "chosen", "fact", "bare", "word", "group", "id", "count")
#: What tie-outs read of a fact.
TIED = (*TIED_BY, "id", "document_id", "attribute_key", "value_num")
#: Kinds that hold names alone.
NAMES = ("each", "chosen", "word")


@dataclass(frozen=True)
class Index:
    """A folder with an index; bucket: rows of a bucket."""

    spark: SparkSession
    path: str
    bucket: int = BUCKET


def _read(spark: SparkSession, paths: list[str], schema: str, base: str | None = None) -> DataFrame | None:
    try:
        reader = spark.read.schema(schema)
        return (reader.option("basePath", base) if base else reader).parquet(*paths)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def manifest(index: Index, below: int | None = None) -> DataFrame:
    """The live buckets: those of the last version, or of the last one below a given one."""
    every = _read(index.spark, [f"{index.path}/manifest"], f"{MANIFEST}, version long")
    if every is None:
        return index.spark.createDataFrame([], MANIFEST)
    if below is not None:
        every = every.where(F.col("version") < below)
    last = every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == F.lit(last)).drop("version")


def _publish(index: Index, live: DataFrame, version: int) -> None:
    """One small file, which is renamed into place, makes a version."""
    stored(live, "manifest").coalesce(1).write.mode("overwrite").parquet(f"{index.path}/manifest/version={version}")


def _words(facts: DataFrame) -> DataFrame:
    return facts.withColumns({"words": F.array_distinct(tokens(F.col("attribute_key"))), "names": F.array_distinct(tokens(F.coalesce("entity_key", F.lit(""))))})


def _pairable() -> Column:
    return F.col("value_num").isNotNull() & (F.coalesce("attribute_key", F.lit("")) != "")


def _key(*parts: Column | str) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts])


def _group_key() -> Column:
    return _key("entity_key", "period_key", "unit")


def _name_key() -> Column:
    return _key("unit", "entity_key")


def _adds_up() -> Column:
    return F.col("unit").isin(*ADDITIVE) & (F.col("value_num") > 0)


def _entries(index: Index, facts: DataFrame, live: DataFrame) -> DataFrame:
    """All rows of a run, with their kinds. Of a name the rarest word so far is chosen; any word of it would do, but one that few names have is found by few.

    Words are looked at once for each unit, attribute and name, and not for each fact.
    """
    pairable, named = facts.where(_pairable()), F.size("names") > 0
    classes = stored(_words(pairable.groupBy("unit", "attribute_key", "entity_key").agg(F.count(F.lit(1)).alias("facts"))), "classes")
    called = classes.where(named).groupBy("entity_key", "names").agg(F.sum("facts").alias("facts"))
    names = stored(called.select("entity_key", "facts", F.explode("names").alias("w")), "names")
    counted = stored(names.groupBy("w").agg(F.sum("facts").alias("n")), "counted")
    n = counted
    if live.limit(1).count():
        before = counts(index, counted.select(F.concat(F.lit("n:"), "w").alias("key")), live).select(F.substring("key", 3, 1 << 20).alias("w"), "n")
        n = counted.unionByName(before).groupBy("w").agg(F.sum("n").alias("n"))
    rarest = names.join(n, "w").groupBy("entity_key").agg(F.min(F.struct("n", "w")).alias("m")).select("entity_key", F.col("m.w").alias("w"))
    none = lambda c: F.lit(None).cast(facts.schema[c].dataType).alias(c)
    own = lambda rows, kind, key, kept=tuple(VIEW): rows.select(F.lit(kind).alias("kind"), key.alias("key"), F.lit(None).cast("long").alias("n"), *[F.col(c) if c in kept else none(c) for c in VIEW])
    count = lambda rows, mark: rows.select(F.lit("count").alias("kind"), F.concat(F.lit(mark), "w").alias("key"), "n", *[none(c) for c in VIEW])
    by_word = classes.where(named).select("unit", "entity_key", F.explode("words").alias("w")).distinct()
    attributes = classes.groupBy("attribute_key", "words").agg(F.sum("facts").alias("facts")).select("facts", F.explode("words").alias("w")).groupBy("w").agg(F.sum("facts").alias("n"))
    of_names = F.size(tokens(F.coalesce("entity_key", F.lit("")))) > 0
    bare = _words(pairable.where(~of_names)).withColumn("w", F.explode("words"))
    parts = [
        own(names, "each", F.col("w"), ("entity_key",)), own(rarest, "chosen", F.col("w"), ("entity_key",)), own(by_word, "word", _key("unit", "w"), ("entity_key",)),
        own(pairable.where(of_names), "fact", _name_key()), own(bare, "bare", _key("unit", "w")), own(facts.where(_adds_up()), "group", _group_key(), TIED),
        own(facts, "id", F.col("id").cast("string"), ("id",)), count(attributes, "a:"), count(counted, "n:"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _write_run(index: Index, entries: DataFrame, run: str) -> DataFrame:
    """Writes a run and gives its part of the manifest. Keys of many rows are salted, so no task writes one whole."""
    rows = stored(entries, "entries")
    sizes = {r["kind"]: r["n"] for r in rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    deal = F.create_map(*[F.lit(x) for k in KINDS for x in (k, max(1, -(-sizes.get(k, 0) // index.bucket)))])
    dealt = rows.withColumn("_key", F.xxhash64("key")).withColumn("buckets", deal[F.col("kind")].cast("long")).withColumn("bucket", F.pmod("_key", "buckets"))
    # A key of many rows makes its bucket large, so only keys of large buckets are counted, by their hashes.
    large = stored(dealt.groupBy("kind", "bucket").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1.5 * index.bucket), "large").select("kind", "bucket")
    if large.limit(1).count():
        many = dealt.select("kind", "bucket", "_key").join(large, ["kind", "bucket"], "left_semi").groupBy("kind", "_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > index.bucket)
        many = stored(many, "many")
        dealt = dealt.join(F.broadcast(many) if sum(sizes.values()) // index.bucket < 1_000_000 else many, ["kind", "_key"], "left")
    else:
        dealt = dealt.withColumn("_n", F.lit(None).cast("long"))
    light = F.col("_n").isNull()
    dealt = dealt.withColumn("bucket", F.when(light, F.col("bucket")).otherwise(F.col("buckets") + F.pmod("_key", F.lit(1 << 40))))
    salt = F.when(light, 0).otherwise(F.pmod(F.xxhash64("id", "entity_key"), F.ceil(F.col("_n") / index.bucket)))
    at = f"{index.path}/runs/run={run}"
    dealt.withColumn("_salt", salt).repartition("kind", "bucket", "_salt").drop("_salt", "_n", "_key").write.mode("overwrite").partitionBy("kind", "bucket", "buckets").parquet(at)
    back = index.spark.read.schema(f"{ROW}, kind string, bucket long, buckets long").parquet(at)
    return back.groupBy("kind", "bucket", "buckets").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(run).alias("run"), "kind", "bucket", "buckets", "rows")


def append(index: Index, facts: DataFrame, batch: int) -> DataFrame:
    """The manifest with a batch's facts (VIEW) in it. The same batch again takes the place of what it wrote.

    Batches are numbered upward. Before, small runs are merged if there are MOST_RUNS.
    """
    if batch < 0:
        raise ValueError("batches are numbered from 0")
    live = stored(manifest(index, 2 * batch), "live")
    live = _merged(index, live, batch)
    _publish(index, live.unionByName(_write_run(index, _entries(index, facts, live), f"b{batch}")), 2 * batch + 1)
    return stored(manifest(index, 2 * batch + 2), "live")


def _merged(index: Index, live: DataFrame, batch: int) -> DataFrame:
    """The live buckets after small runs have become one; a row is so rewritten a number of times that grows with the logarithm of the runs."""
    sizes = sorted((r["n"], r["run"]) for r in live.groupBy("run").agg(F.sum("rows").alias("n")).collect())
    if len(sizes) < MOST_RUNS:
        return live
    total, some = 0, []
    for n, run in sizes:
        if len(some) > 1 and n > 2 * total:
            break
        total, some = total + n, [*some, run]
    rows = _paths_read(index, live.where(F.col("run").isin(some)))
    counts = rows.where("kind = 'count'").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    kept = rows.where("kind != 'count'").select("kind", "key", "n", *VIEW)
    of_names = F.col("kind").isin(*NAMES)
    made = kept.where(~of_names).unionByName(kept.where(of_names).dropDuplicates(["kind", "key", "entity_key"])).unionByName(counts, allowMissingColumns=True)
    merged = stored(live.where(~F.col("run").isin(some)).unionByName(_write_run(index, made, f"m{batch}")), "live")
    _publish(index, merged, 2 * batch)
    return merged


def _paths_read(index: Index, buckets: DataFrame) -> DataFrame:
    """The rows of some buckets; their paths are bounded by the keys that are looked up, and nothing else is listed."""
    paths = [f"{index.path}/runs/run={r['run']}/kind={r['kind']}/bucket={r['bucket']}/buckets={r['buckets']}" for r in buckets.select("run", "kind", "bucket", "buckets").distinct().collect()]
    schema = f"{ROW}, run string, kind string, bucket long"
    rows = _read(index.spark, sorted(paths), schema, f"{index.path}/runs") if paths else None
    return index.spark.createDataFrame([], schema) if rows is None else rows


def touched(index: Index, keys: DataFrame, live: DataFrame) -> DataFrame:
    """The live buckets that hold rows of some keys (kind, key)."""
    dealt = live.select("run", "kind", "buckets").distinct()
    own = keys.select("kind", "key").distinct().join(dealt, "kind")
    hashed = F.xxhash64("key")
    both = own.select("run", "kind", "buckets", F.explode(F.array(F.pmod(hashed, "buckets"), F.col("buckets") + F.pmod(hashed, F.lit(1 << 40)))).alias("bucket")).distinct()
    return live.join(both, ["run", "kind", "buckets", "bucket"], "left_semi")


def lookup(index: Index, keys: DataFrame, live: DataFrame) -> DataFrame:
    """All rows of the index under some keys (kind, key)."""
    keys = stored(keys.select("kind", "key").distinct(), "keys")
    return _paths_read(index, touched(index, keys, live)).join(keys, ["kind", "key"], "left_semi")


def counts(index: Index, words: DataFrame, live: DataFrame) -> DataFrame:
    """(key, n): how many facts have some words; keys are those of ``count``."""
    return lookup(index, words.select(F.lit("count").alias("kind"), "key"), live).groupBy("key").agg(F.sum("n").alias("n"))


def anchors(index: Index, sets: DataFrame, live: DataFrame) -> DataFrame:
    """(attribute_key, anchors): each key's rarest words as all facts count them; ties go to the smaller word."""
    words = stored(sets.select("attribute_key").distinct().select("attribute_key", F.explode(F.array_distinct(tokens(F.col("attribute_key")))).alias("word")), "words")
    n = counts(index, words.select(F.concat(F.lit("a:"), "word").alias("key")).distinct(), live).select(F.substring("key", 3, 1 << 20).alias("word"), "n")
    rank = F.row_number().over(Window.partitionBy("attribute_key").orderBy("n", "word"))
    return words.join(n, "word").withColumn("rank", rank).where(F.col("rank") <= ANCHORS).groupBy("attribute_key").agg(F.collect_list("word").alias("anchors"))


def partners(index: Index, some: DataFrame, live: DataFrame) -> DataFrame:
    """Pairs of facts ``some`` (VIEW) with any fact of the index, as p_ and q_ columns of VIEW, probe first, both ways where both hold.

    A probe finds a partner that has one of its anchors, from another document, of the same unit, whose name matches.
    """
    own = stored(_words(some.select(*VIEW).where(_pairable())), "some")
    nameless = F.size("names") == 0
    names = stored(own.where(~nameless).select("entity_key", "names").distinct().select("entity_key", "names", F.explode("names").alias("w")), "names")
    n = counts(index, names.select(F.concat(F.lit("n:"), "w").alias("key")).distinct(), live).select(F.substring("key", 3, 1 << 20).alias("w"), "n")
    rarest = names.join(n, "w").groupBy("entity_key", "names").agg(F.min(F.struct("n", "w")).alias("m")).select("entity_key", "names", F.col("m.w").alias("w"))
    asked = rarest.select("entity_key", "names", F.lit("each").alias("kind"), F.col("w").alias("key")).unionByName(names.select("entity_key", "names", F.lit("chosen").alias("kind"), F.col("w").alias("key")))
    found = lookup(index, asked, live).select("kind", "key", F.col("entity_key").alias("_y"))
    met = found.join(asked, ["kind", "key"]).where(entities_match(F.col("names"), F.array_distinct(tokens(F.col("_y"))))).select("entity_key", "_y").distinct()
    wanted = own.select("id", "unit", "entity_key").join(met, "entity_key").select("id", F.lit("fact").alias("kind"), _key("unit", "_y").alias("key"))
    by_word = stored(own.select("id", "unit", nameless.alias("nameless"), F.explode("words").alias("w")).select("id", "unit", "nameless", _key("unit", "w").alias("key")), "by-word")
    wanted = wanted.unionByName(by_word.select("id", F.lit("bare").alias("kind"), "key"))
    if (alone := by_word.where("nameless").select("id", "unit", F.lit("word").alias("kind"), "key")).limit(1).count():
        called = lookup(index, alone, live).select("key", F.col("entity_key").alias("_y")).join(alone, "key")
        wanted = wanted.unionByName(called.select("id", F.lit("fact").alias("kind"), _key("unit", "_y").alias("key")))
    wanted = stored(wanted.distinct(), "wanted")
    side = lambda rows, p: rows.select(*[F.col(c).alias(f"{p}_{c}") for c in VIEW])
    hits = lookup(index, wanted, live).select("kind", "key", *[F.col(c).alias(f"y_{c}") for c in VIEW]).join(wanted.select("kind", "key", F.col("id").alias("x_id")), ["kind", "key"]).drop("kind", "key")
    both = hits.join(side(own, "x"), "x_id").where("x_document_id != y_document_id and x_id != y_id and x_unit = y_unit")
    both = stored(both.dropDuplicates(["x_id", "y_id"]), "hits")
    rare = stored(anchors(index, both.select(F.col("x_attribute_key").alias("attribute_key")).unionByName(both.select(F.col("y_attribute_key").alias("attribute_key"))), live), "anchors")
    for p in ("x", "y"):
        both = both.join(rare.select(F.col("attribute_key").alias(f"{p}_attribute_key"), F.col("anchors").alias(f"{p}_anchors")), f"{p}_attribute_key")
    words = lambda p: tokens(F.col(f"{p}_attribute_key"))
    both = both.where(entities_match(F.array_distinct(tokens(F.coalesce("x_entity_key", F.lit("")))), F.array_distinct(tokens(F.coalesce("y_entity_key", F.lit(""))))))
    way = lambda p, q: both.where(F.arrays_overlap(f"{p}_anchors", words(q))).select(*[F.col(f"{p}_{c}").alias(f"p_{c}") for c in VIEW], *[F.col(f"{q}_{c}").alias(f"q_{c}") for c in VIEW])
    return way("x", "y").unionByName(way("y", "x")).dropDuplicates(["p_id", "q_id"])


def scored_partners(index: Index, some: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, facts): candidate pairs of some facts as ``block.scored_pairs`` has them, and all facts in them (VIEW)."""
    both = stored(partners(index, some, live), "partners")
    pairs = stored(near_enough(both), "pairs")
    facts = both.select(*[F.col(f"p_{c}").alias(c) for c in VIEW]).unionByName(both.select(*[F.col(f"q_{c}").alias(c) for c in VIEW]))
    inside = pairs.select(F.col("a_id").alias("id")).unionByName(pairs.select(F.col("b_id").alias("id"))).distinct()
    return pairs, facts.dropDuplicates(["id"]).join(inside, "id", "left_semi").select(*VIEW)


def candidates(index: Index, new: DataFrame, live: DataFrame, most: int | None = MOST_PARTNERS) -> tuple[DataFrame, DataFrame]:
    """(pairs, facts): the pairs with a new fact (VIEW) that a full pass over all facts of the index would give, and the facts in them.

    As ``block.candidates_of``: pairs of new facts and of their partners, then of partners of facts above the cap. All pairs come out of
    the index, so what is read follows the new facts' entities.
    """
    pairs, seen = scored_partners(index, new, live)
    if most is None:
        return pairs.select("a_id", "b_id", "score"), seen
    known = stored(new.select("id").distinct(), "known")
    fresh = stored(seen.join(known, "id", "left_anti"), "fresh")
    first = True
    while fresh.limit(1).count():
        made, more = scored_partners(index, fresh, live)
        known = stored(known.unionByName(fresh.select("id")), "known")
        pairs = stored(pairs.unionByName(made).dropDuplicates(["a_id", "b_id"]), "pairs")
        seen = stored(seen.unionByName(more).dropDuplicates(["id"]), "seen")
        sides = pairs.select(F.col("a_id").alias("id"), F.col("b_id").alias("other")).unionByName(pairs.select(F.col("b_id").alias("id"), F.col("a_id").alias("other")))
        above = sides.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).join(known, "id", "left_semi")
        next_ids = sides.join(above.select("id"), "id", "left_semi").select(F.col("other").alias("id")).distinct().join(known, "id", "left_anti")
        fresh, first = stored(seen.join(next_ids, "id", "left_semi"), "fresh"), False
    mark = new.select("id").distinct()
    kept = capped_pairs(pairs, most)
    ours = kept.join(mark.select(F.col("id").alias("a_id")), "a_id", "left_semi").unionByName(kept.join(mark.select(F.col("id").alias("b_id")), "b_id", "left_semi")).distinct()
    return ours.select("a_id", "b_id", "score"), seen


def groups(index: Index, new: DataFrame, live: DataFrame) -> DataFrame:
    """All facts of the tie-out groups that new facts belong to: VIEW, of which columns that no tie-out reads are null."""
    keys = new.where(_adds_up()).select(F.lit("group").alias("kind"), _group_key().alias("key"))
    return lookup(index, keys, live).select(*VIEW)


def unknown(index: Index, facts: DataFrame, live: DataFrame) -> DataFrame:
    """The facts whose ids the index does not have."""
    keys = facts.select(F.lit("id").alias("kind"), F.col("id").cast("string").alias("key"))
    return facts.join(lookup(index, keys, live).select("id").distinct(), "id", "left_anti")
