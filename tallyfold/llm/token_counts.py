"""Token counts by a scan for separators in flat token files, stitched across blocks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_folder, write_table
from .tokens import encoder, vocabulary

#: The separator is the vocabulary's end of text, which no ordinary text yields; ids fit 16 bits.
SEPARATOR, DTYPE, BLOCK_BYTES = 50_256, "<u2", 1 << 20
FLAT = "file string, block long, data binary, place long, doc_id long"


def flat_tokens(docs: DataFrame, block_bytes: int = BLOCK_BYTES, vocab: tuple[str, str] | None = None) -> DataFrame:
    """Documents as flat token files, without an index: each partition of ``docs`` is a file.

    Returns rows of two kinds: (file, block, data) are a file's bytes in blocks that ignore where documents
    end; (file, place, doc_id) say which document is where in a file, not how long it is. Null texts are empty
    documents: a separator alone.
    """
    paths = vocab or vocabulary()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(*paths, plain=True).encode, np.array([SEPARATOR], DTYPE).tobytes()
        file, block, place, rest = f"{TaskContext.get().partitionId():08d}", 0, 0, b""

        def blocks(parts: list[bytes], first: int) -> pa.RecordBatch:
            n = len(parts)
            nulls = [pa.nulls(n, pa.int64())] * 2
            return pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array(range(first, first + n), pa.int64()), pa.array(parts, pa.binary()), *nulls], names=["file", "block", "data", "place", "doc_id"])

        for b in batches:
            n = b.num_rows
            nulls = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([file] * n), *nulls, pa.array(range(place, place + n), pa.int64()), b.column(0)], names=["file", "block", "data", "place", "doc_id"])
            place += n
            held = [rest]
            size = len(rest)
            for text in b.column(1):
                ids = np.frombuffer(encode(text.as_py() or ""), "<u4").astype(DTYPE).tobytes() + end
                held.append(ids)
                size += len(ids)
                if size >= 8 * block_bytes:
                    rest = b"".join(held)
                    cut = len(rest) // block_bytes * block_bytes
                    parts = [rest[i : i + block_bytes] for i in range(0, cut, block_bytes)]
                    yield blocks(parts, block)
                    block += len(parts)
                    rest = rest[cut:]
                    held, size = [rest], len(rest)
            rest = b"".join(held)
        parts = [rest[i : i + block_bytes] for i in range(0, len(rest), block_bytes)]
        if parts:
            yield blocks(parts, block)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, FLAT)


def read_flat(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Flat token files of a folder as (file, block, data).

    Files are read in ranges, as records of ``block_bytes`` bytes, by as many tasks as there are ranges; no row holds more than a block.
    The last block of a file is shorter, so a file's size need not be a multiple.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    at = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 1) / block_bytes))).alias("block")
    wanted = files.select("path", "length", at)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for name, length, block in zip(*[b.column(c).to_pylist() for c in ("path", "length", "block")], strict=True):
                system, at = fs.FileSystem.from_uri(name if "://" in name else "file://" + name.removeprefix("file:"))
                with system.open_input_file(at) as f:
                    f.seek(block * block_bytes)
                    data = f.read(min(block_bytes, length - block * block_bytes))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int64()), pa.array([data], pa.binary())], names=["file", "block", "data"])

    return wanted.repartition("path", "block").mapInArrow(run, "file string, block long, data binary")


def scan_blocks(blocks: DataFrame, separator: int = SEPARATOR, dtype: str = DTYPE) -> DataFrame:
    """Documents of flat files and their token counts, without separators: file, place, n_tokens.

    blocks: (file, block, data), blocks numbered from 0 and whole numbers of ids long. Each block is
    searched by itself for separators. A prefix scan over a file's blocks, of four numbers each, then says where the
    document that a block begins in started and how many came before; the blocks' own counts join it only after that. Tokens after
    the last separator of a file are its last document; an empty document counts 0.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data in b.column("data"):
                ids = np.frombuffer(data.as_buffer(), dtype)
                ends = np.flatnonzero(ids == separator)
                out.append((len(ids), ends))
            cols = [
                b.column("file"), b.column("block"),
                pa.array([n for n, _ in out], pa.int64()),
                pa.array([len(e) for _, e in out], pa.int64()),
                pa.array([int(e[0]) if len(e) else None for _, e in out], pa.int64()),
                pa.array([int(e[-1]) if len(e) else None for _, e in out], pa.int64()),
                pa.array([np.diff(e) - 1 for _, e in out], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["file", "block", "n", "ends", "first", "last", "inner"])

    found = write_table(blocks.select("file", "block", "data").mapInArrow(run, "file string, block long, n long, ends long, first long, last long, inner array<long>"), "token-blocks")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    at = found.select("file", "block", "n", "ends", "last").withColumns({"_at": F.coalesce(F.sum("n").over(before), F.lit(0)), "_place": F.coalesce(F.sum("ends").over(before), F.lit(0))})
    at = at.withColumn("_stop", F.col("_at") + F.col("last") + 1)
    at = at.withColumns({"_from": F.coalesce(F.max("_stop").over(before), F.lit(0)), "_next": F.lead("block").over(Window.partitionBy("file").orderBy("block"))})
    at = at.select("file", "block", "_at", "_place", "_stop", "_from", "_next").join(found, ["file", "block"])
    total = F.col("_at") + F.col("n")
    left = total - F.coalesce("_stop", "_from")
    open_end = F.when(F.col("_next").isNull() & (left > 0), F.array(left)).otherwise(F.array().cast("array<bigint>"))
    closed = F.when(F.col("ends") > 0, F.concat(F.array(F.col("_at") + F.col("first") - F.col("_from")), F.col("inner"))).otherwise(F.array().cast("array<bigint>"))
    docs = at.select("file", "_place", F.posexplode(F.concat(closed, open_end)).alias("i", "n_tokens"))
    return docs.select("file", (F.col("_place") + F.col("i")).alias("place"), "n_tokens")


def count_tokens(docs: DataFrame, block_bytes: int = BLOCK_BYTES, vocab: tuple[str, str] | None = None) -> DataFrame:
    """doc_id and n_tokens of every document, counted in the flat files that are written of them."""
    spark = docs.sparkSession
    path = new_folder(spark, "flat-tokens")
    flat_tokens(docs, block_bytes, vocab).write.option("compression", "zstd").parquet(path)
    flat = spark.read.schema(FLAT).parquet(path)
    counts = scan_blocks(flat.where(F.col("block").isNotNull()).select("file", "block", "data"))
    return flat.where(F.col("place").isNotNull()).select("file", "place", "doc_id").join(counts, ["file", "place"]).select("doc_id", "n_tokens")
