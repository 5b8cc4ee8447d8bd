"""A stored layer whose documents are replaced or deleted as one step: readers see all of a change or nothing."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import stored

#: By what a table's rows are dealt into buckets: a document's rows share one, and a relation lies with its first fact.
KEYS = {"documents": "document_id", "pages": "document_id", "facts": "document_id", "failures": "document_id", "relations": "fact_a_id", "llm_cache": "key"}
MANIFEST = "name string, bucket int, written long"


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class LayerStore:
    """A folder with the tables of KEYS, whose schemas are given.

    Each change writes the buckets that it alters to folders of its own version, and last a manifest that names, for every table
    and bucket, the version that wrote it. A change that ends before its manifest is there has changed nothing; the next one takes its
    number and its place. The manifest has at most tables times ``buckets`` rows. One writer at a time, any number of readers: what an
    earlier manifest names stays where it is.
    """

    spark: SparkSession
    path: str
    schemas: dict[str, str]
    buckets: int = 16
    #: Told the name of each table that has been written, and "manifest" just before the switch.
    on_step: object = field(default=None, compare=False)

    def manifest(self) -> tuple[int, list[tuple[str, int, int]]]:
        """The last version, 0 for an empty store, and its (table, bucket, version that wrote it)."""
        try:
            every = self.spark.read.schema(f"{MANIFEST}, version long").parquet(f"{self.path}/manifest")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0, []
        last = every.agg(F.max("version")).first()[0]
        if last is None:
            return 0, []
        rows = every.where(F.col("version") == last).collect()
        return last, [(r["name"], r["bucket"], r["written"]) for r in rows if r["written"] is not None]

    def read(self, name: str, only: set[int] | None = None, entries: list[tuple[str, int, int]] | None = None) -> DataFrame:
        """A table as the last manifest, or the given entries, have it, or some of its buckets."""
        live = self.manifest()[1] if entries is None else entries
        base = f"{self.path}/tables/{name}"
        paths = [f"{base}/written={v}/_bucket={b}" for n, b, v in live if n == name and (only is None or b in only)]
        if not paths:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(*paths)

    def tables(self) -> dict[str, DataFrame]:
        """All tables of one version."""
        live = self.manifest()[1]
        return {n: self.read(n, entries=live) for n in self.schemas}

    def replace(self, source: dict[str, DataFrame]) -> int:
        """Takes over all documents of ``source`` with what hangs on them, ids as they are; gives the version.

        Goes: those documents here, their pages, facts and failures, and relations with one of their facts on either side. Comes: the source's rows of
        them, and its relations whose first fact is of them. A record of llm_cache whose key is known stays as it is. Only buckets with a changed row
        are read whole and written; of the relations the two ids are read to find them. The same source again leaves the same rows.
        """
        ids = stored(source["documents"].select("document_id").where("document_id is not null").distinct(), "replaced")
        new = {n: source[n].join(ids, "document_id", "left_semi") for n in ("documents", "pages", "facts", "failures") if n in source}
        own = new["facts"].select(F.col("id").alias("_id"))
        new["relations"] = source["relations"].join(own, F.col("fact_a_id") == F.col("_id"), "left_semi")
        if "llm_cache" in source:
            new["llm_cache"] = source["llm_cache"]
        return self._change(ids, new, ("documents", "pages", "facts", "failures"))

    def delete(self, documents: DataFrame) -> int:
        """Takes out documents (document_id), their pages, facts and relations; failures stay, as the record of what went wrong."""
        return self._change(stored(documents.select("document_id").where("document_id is not null").distinct(), "deleted"), {}, ("documents", "pages", "facts"))

    def _touched(self, rows: DataFrame, key: str) -> set[int]:
        return {r[0] for r in rows.select(_bucket(key, self.buckets)).distinct().collect()}  # at most as many as there are buckets

    def _change(self, ids: DataFrame, new: dict[str, DataFrame], cascade: tuple[str, ...]) -> int:
        last, live = self.manifest()
        version = last + 1
        mine = self._touched(ids, "document_id")
        gone = stored(self.read("facts", mine, live).join(ids, "document_id", "left_semi").select(F.col("id").alias("_id")).distinct(), "gone")
        for name in self.schemas:
            key = KEYS[name]
            columns = self.spark.createDataFrame([], self.schemas[name]).columns
            coming = new[name].select(*columns) if name in new else None
            if coming is not None and name not in cascade:
                coming = stored(coming, name)  # read for its buckets, and to be written
            buckets = set(mine) if name in cascade else set()
            if name == "relations":
                held = self.read(name, entries=live)
                lost = held.join(gone, F.col("fact_a_id") == F.col("_id"), "left_semi").select(key).union(held.join(gone, F.col("fact_b_id") == F.col("_id"), "left_semi").select(key))
                buckets |= self._touched(lost, key)
            if coming is not None and name not in cascade:
                buckets |= self._touched(coming, key)
            rows = self.read(name, buckets, live)
            if name in cascade:
                rows = rows.join(ids, "document_id", "left_anti")
            elif name == "relations":
                rows = rows.join(gone, F.col("fact_a_id") == F.col("_id"), "left_anti").join(gone, F.col("fact_b_id") == F.col("_id"), "left_anti")
            if coming is not None:
                rows = rows.unionByName(coming.join(rows.select("key"), "key", "left_anti").dropDuplicates(["key"]) if name == "llm_cache" else coming)
            live = [e for e in live if e[0] != name or e[1] not in buckets]
            at = f"{self.path}/tables/{name}/written={version}"
            # rebalance splits the bucket of a document that has very many rows
            rows.withColumn("_bucket", _bucket(key, self.buckets)).hint("rebalance", F.col("_bucket")).write.mode("overwrite").partitionBy("_bucket").parquet(at)
            back = self.spark.read.schema(f"{self.schemas[name]}, _bucket int").parquet(at) if buckets else None
            live += [(name, r[0], version) for r in back.select("_bucket").distinct().collect()] if back is not None else []
            self._step(name)
        self._step("manifest")
        entries = self.spark.createDataFrame(live or [(None, None, None)], MANIFEST)
        entries.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")  # one file, renamed into place
        return version

    def _step(self, name: str) -> None:
        if self.on_step:
            self.on_step(name)

