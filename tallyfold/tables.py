"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only a session on a single machine may be without one and gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tallyfold-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: How many times larger rows may be in memory than in a compressed file. Spark takes a file's size for its table's when it looks for
#: tables that are small enough to broadcast, and those go through the driver.
COMPRESSED = 20


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df``, written to the shared folder and read again."""
    spark = df.sparkSession
    if spark.conf.get("spark.sql.sources.fileCompressionFactor", None) is None:
        spark.conf.set("spark.sql.sources.fileCompressionFactor", str(COMPRESSED))
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
