"""Incremental linking: each micro-batch of facts is linked with all that came before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import postings
from ..operators.block import MOST_PARTNERS
from ..operators.link import indexed_rule_pass, rule_pass
from ..schemas import VIEW
from ..tables import stored

#: A batch with this share of the facts that came before, or more, is linked by a pass over all facts.
LARGE = 1 / 8


def link_batch(spark: SparkSession, batch: DataFrame, folder: str, batch_id: int, most: int | None = MOST_PARTNERS, bucket: int = postings.BUCKET, large: float = LARGE) -> None:
    """Adds a batch of fact views to ``folder``/facts and ``folder``/index, and its new relations to ``folder``/relations.

    Each batch has its own folders and is written whole, so a batch that is run again replaces what it wrote. Facts that are
    there already are not paired again. Of the history only the index's buckets of the new facts' words and groups are read, unless the batch is
    ``large`` against it: its keys then lie in all buckets, and one pass over the stored facts costs less than looking each of them up. The relations are the same.
    """
    index = postings.Index(spark, f"{folder}/index", bucket)
    before = stored(postings.manifest(index, 2 * batch_id), "live")
    known = before.where("kind = 'id'").agg(F.sum("rows")).first()[0] or 0
    fresh = batch.select(*VIEW).dropDuplicates(["id"])
    (postings.unknown(index, fresh, before) if known else fresh).write.mode("overwrite").parquet(f"{folder}/facts/batch={batch_id}")
    fresh = spark.read.schema(postings.FACT).parquet(f"{folder}/facts/batch={batch_id}")
    live = postings.append(index, fresh, batch_id)
    if fresh.count() >= large * known:
        every = spark.read.schema(f"{postings.FACT}, batch long").parquet(f"{folder}/facts").where(F.col("batch") <= batch_id).drop("batch")
        made = rule_pass(every, fresh, spark.createDataFrame([], "fact_a_id long, fact_b_id long"), most)
    else:
        made = indexed_rule_pass(index, fresh, live, most)
    made.write.mode("overwrite").parquet(f"{folder}/relations/batch={batch_id}")


def link_stream(facts: DataFrame, folder: str, checkpoint: str, most: int | None = MOST_PARTNERS) -> StreamingQuery:
    """Links a stream of fact views until its source is used up. Rows there stay as they are."""
    spark = facts.sparkSession
    writer = facts.writeStream.foreachBatch(lambda batch, i: link_batch(spark, batch, folder, i, most))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
