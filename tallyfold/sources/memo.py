"""Recorded answers of an external model: requests are joined with them by key."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import stored

RECORD = "key string, model string, purpose string, request string, response string, usage map<string,long>"
ANSWER = f"{RECORD}, error string"
MODES = ("off", "live", "record", "replay")
#: So many keys go to all tasks that read a store.
FEW = 10_000


def request_key(*parts: Column) -> Column:
    """The key of a request: sha256 of its parts as JSON, in order; binary parts stand in by their own sha256."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(p, F.lit("")) for p in parts])), 256)


def _packed(key: str) -> Column:
    """A key as bytes, half as many if it is a digest; others begin with a byte of their own."""
    k = F.col(key)
    return F.when(k.rlike("^[0-9a-f]{64}$"), F.unhex(k)).when(k.isNotNull(), F.concat(F.lit(b"k"), k.cast("binary")))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A folder of JSON files, one record each; requests and responses stay JSON text."""
    return spark.read.schema(RECORD).option("multiLine", True).json(path)


def kept(spark: SparkSession, path: str, keys: DataFrame | None = None, run: str | None = None, exact: bool = True) -> DataFrame:
    """The records of a store (RECORD), those of one run, or those of some keys (key) if given: then only the parts of their first two digits are read.

    exact: whether records of other keys in these parts are sorted out even where keys are many; a join with the keys does that anyway.
    """
    try:
        every = spark.read.schema(f"{RECORD}, run string, part string").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RECORD)
    every = every if run is None else every.where(F.col("run") == run)
    if keys is not None:
        parts = keys.groupBy(F.substring("key", 1, 2).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()  # 256 at most
        every = every.where(F.col("part").isin([r["p"] for r in parts]))
        few = sum(r["n"] for r in parts) <= FEW
        if few or exact:
            own = keys.select("key").distinct()
            every = every.join(F.broadcast(own) if few else own, "key", "left_semi")
    return every.drop("run", "part")


def keep(records: DataFrame, path: str, run: str) -> None:
    """Writes the records (RECORD) of a run into a store, in the place of what that run wrote before."""
    part = records.withColumn("part", F.substring("key", 1, 2))
    part.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/run={run}")


def stored_answers(requests: DataFrame, path: str, run: str, mode: str = "replay", provider: Callable[[pd.Series], list] | None = None) -> DataFrame:
    """``answers`` from a store, to which the record mode adds what is new. In record mode what was answered before is not asked again."""
    told, new = answers(requests, kept(requests.sparkSession, path, requests, exact=False), mode, provider)
    if mode == "record":
        # What this run wrote before is kept; where it wrote nothing, nothing is replaced, and so nothing that is read here.
        own = kept(requests.sparkSession, path, run=run)
        if own.limit(1).count():
            told, new = stored(told, "answered"), stored(own.unionByName(new.select(*own.columns)), "new-records")
        keep(new, path, run)
    return told


def answers(requests: DataFrame, records: DataFrame, mode: str = "replay", provider: Callable[[pd.Series], list[tuple[str | None, dict | None, str | None]]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(answered, new records) of requests (key, model, purpose, request).

    answered: all requests with response and error. replay: only records answer, and other requests stay open with
    the error "llm_cache_miss". record: what records lack is asked of the provider and becomes a new record.
    live: all is asked and nothing recorded. off: nothing is answered. Equal requests are asked once. Records may have errors, which replay then gives.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    spark = requests.sparkSession
    none = spark.createDataFrame([], RECORD)
    if mode == "off":
        return requests.withColumns({"response": F.lit(None).cast("string"), "error": F.lit("llm_off")}), none
    recorded = F.col("error") if "error" in records.columns else F.lit(None).cast("string")
    held = records.select("key", "response", recorded.alias("_error")) if mode != "live" else none.select("key", "response", F.lit(None).cast("string").alias("_error"))
    if mode == "replay":  # keys only meet here, so they are shuffled as bytes
        held = held.select(_packed("key").alias("_packed"), "response", "_error").dropDuplicates(["_packed"])
        both = requests.withColumn("_packed", _packed("key")).join(held, "_packed", "left").drop("_packed")
    else:
        both = requests.join(held.dropDuplicates(["key"]), "key", "left")
    if mode == "replay":
        return both.withColumn("error", F.coalesce("_error", F.when(F.col("response").isNull(), "llm_cache_miss"))).drop("_error"), none
    both = both.drop("_error")
    if provider is None:
        raise ValueError(f"mode {mode} needs a provider")

    def ask(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            told = provider(f["request"])
            yield f.assign(**{"response": [t[0] for t in told], "usage": [t[1] for t in told], "error": [t[2] for t in told]})

    missing = both.where(F.col("response").isNull()).dropDuplicates(["key"])
    # Stored, so that each request is asked once however often the results are read, with all that a record holds.
    asked = stored(missing.select("key", "model", "purpose", "request").mapInPandas(ask, ANSWER), "answers")
    out = both.join(asked.select("key", F.col("response").alias("_r"), "error"), "key", "left")
    new = asked.where("error is null").drop("error")
    return out.withColumn("response", F.coalesce("response", "_r")).drop("_r"), new if mode == "record" else none
