"""Sharding by Hilbert curve: quantised metadata, sorted by curve index, cut into equal runs."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import write_table

#: Levels of a dimension are 2**BITS; with three dimensions the curve has 4096 cells.
BITS = 4
#: Aimed-at rows of one sub-bucket of all rows, and the most sub-buckets.
SUB_ROWS, MOST_SUBS = 1000, 65_536


def hilbert_rank(cell: tuple[int, ...], bits: int) -> int:
    """Place of a cell of a ``2**bits`` wide grid along the Hilbert curve.

    The cell's coordinates are undone level by level (Gray code with rotations), then interleaved.
    """
    x, n = list(cell), len(cell)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(n):
            if x[i] >> level & 1:
                x[0] ^= low
            else:
                swap = (x[0] ^ x[i]) & low
                x[0] ^= swap
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = 0
    for level in range(bits - 1, 0, -1):
        if x[-1] >> level & 1:
            turn ^= (1 << level) - 1
    out = 0
    for level in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | (v ^ turn) >> level & 1
    return out


@lru_cache
def curve(dims: int, bits: int) -> list[int]:
    """Curve index of each cell, cells numbered row by row."""
    side = 1 << bits
    return [hilbert_rank(tuple(c >> bits * (dims - 1 - d) & (side - 1) for d in range(dims)), bits) for c in range(side**dims)]


def category_level(value: Column, bits: int = BITS) -> Column:
    """A level for a category: a hash, as categories have no order. Null has the level of the empty text."""
    return (F.crc32(F.coalesce(value.cast("string"), F.lit("")).cast("binary")) % (1 << bits)).cast("int")


def size_level(value: Column, bits: int = BITS) -> Column:
    """floor(log2) of a size, cut off at the last level; sizes below 1 and null count as 1."""
    return F.least(F.floor(F.log2(F.greatest(F.coalesce(value, F.lit(1)), F.lit(1)).cast("double"))), F.lit((1 << bits) - 1)).cast("int")


def hilbert_index(levels: list[Column], bits: int = BITS) -> Column:
    if not 1 <= len(levels) * bits <= 12:
        raise ValueError("the curve's table has at most 4096 cells: dimensions x bits must be 1 to 12")
    cell = F.lit(0)
    for level in levels:
        cell = cell * (1 << bits) + level
    return F.element_at(F.array([F.lit(v) for v in curve(len(levels), bits)]), (cell + 1).cast("int"))


def shard_rows(df: DataFrame, levels: list[Column], keep: dict[str, Column], order: list[str], shards: int, bits: int = BITS) -> DataFrame:
    """Rows sorted along the curve and cut into ``shards`` runs whose counts differ by one at most.

    df: any table. keep: output columns by name (names starting with ``_hs_`` are taken); order: those
    of them that order rows within a cell. Returns ``keep``, ``shard`` and ``slot`` (gapless from 0).

    No task sorts the whole table: cells are split into sub-buckets by a hash of the row, sub-buckets are
    counted, and a row's rank is the count before its sub-bucket plus its place there. A hot cell
    so has as many parts as there are sub-buckets. Identical rows are ties that may change
    places, with the same rows as result. Nulls in ``order`` sort first. An empty table gives none.
    """
    spark = df.sparkSession
    thin = write_table(df.select(hilbert_index(levels, bits).alias("_hs_cell"), *[c.alias(k) for k, c in keep.items()]), "hilbert")
    n = thin.count()
    subs = min(MOST_SUBS, -(-n // SUB_ROWS) or 1)
    thin = thin.withColumn("_hs_sub", F.pmod(F.xxhash64(*order), F.lit(subs)).cast("int"))
    counts = thin.groupBy("_hs_cell", "_hs_sub").agg(F.count(F.lit(1)).alias("_hs_n"))
    in_cell = counts.withColumn("_hs_before", F.sum("_hs_n").over(Window.partitionBy("_hs_cell").orderBy("_hs_sub")) - F.col("_hs_n"))
    # At most one row for each of the curve's 4096 cells.
    cells = thin.groupBy("_hs_cell").agg(F.count(F.lit(1)).alias("_hs_n"))
    cells = cells.select("_hs_cell", (F.sum("_hs_n").over(Window.orderBy("_hs_cell")) - F.col("_hs_n")).alias("_hs_start"))
    starts = in_cell.drop("_hs_n").join(F.broadcast(cells), "_hs_cell").select("_hs_cell", "_hs_sub", (F.col("_hs_start") + F.col("_hs_before")).alias("_hs_first"))
    place = F.row_number().over(Window.partitionBy("_hs_cell", "_hs_sub").orderBy(*order)) - 1
    ranked = thin.join(starts.hint("shuffle_hash"), ["_hs_cell", "_hs_sub"]).withColumn("_hs_rank", F.col("_hs_first") + place)
    each, more = divmod(n, shards)
    long_rows, rank = more * (each + 1), F.col("_hs_rank")
    div = lambda a, b: F.floor(a / F.lit(max(b, 1))).cast("bigint")
    return ranked.select(
        *keep,
        F.when(rank < long_rows, div(rank, each + 1)).otherwise(more + div(rank - long_rows, each)).cast("int").alias("shard"),
        F.when(rank < long_rows, rank % (each + 1)).otherwise((rank - long_rows) % max(each, 1)).cast("bigint").alias("slot"),
    )


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Documents in shards along a Hilbert curve of source, language and size; law ``rows``.

    Null and empty texts have size 1 and crc 0. Repeated rows and ids are rows like any other. Columns
    other than doc_id, text, lang and source are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("bigint") + 1
    out = shard_rows(
        docs,
        [category_level(F.col("source")), category_level(F.col("lang")), size_level(size)],
        {"doc_id": F.col("doc_id").cast("bigint"), "size": size, "text_crc32": F.crc32(text.cast("binary"))},
        ["doc_id", "text_crc32"],
        shards,
    )
    return out.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """The documents' rows, a folder for each shard; rows of a shard are sorted by slot.

    Files then hold narrow ranges of all three dimensions, so their min/max statistics prune them.
    Needs unique ids; a repeated id keeps each of its rows once.
    """
    plan = shard_documents(docs, shards).select("doc_id", F.col("text_crc32").alias("_hs_crc"), "shard", "slot").dropDuplicates(["doc_id", "_hs_crc"])
    own = docs.drop("shard", "slot").withColumn("_hs_crc", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    both = own.join(plan, own["doc_id"].eqNullSafe(plan["doc_id"]) & (own["_hs_crc"] == plan["_hs_crc"])).select(*[own[c] for c in own.columns if c != "_hs_crc"], "shard", "slot")
    both.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
