"""Best-fit packing by residuals: partitions pack locally, then underfull bins merge up a tree."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_table
from .tokens import encoder, vocabulary

LENGTH, END = 1024, 2
#: Items of a partition, and the nodes that a node of the tree merges.
ITEMS, FAN_IN = 20_000, 16
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, length: int) -> list[int]:
    """Starts of a document's pieces: one if it fits, else full pieces after a first that may be shorter."""
    return [0] if n <= length else [0, *range(n % length or length, n, length)]


def token_pieces(docs: DataFrame, length: int = LENGTH, end: int = END, vocab: tuple[str, str] | None = None) -> DataFrame:
    """A row for each piece of each document's ids, which end with ``end``; a null text is empty."""
    paths = vocab or vocabulary()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = encoder(*paths).encode, np.array([end], "<u4").tobytes()
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encode(text.as_py() or "") + last
                n = len(ids) // 4
                starts = cut(n, length)
                for i, (at, to) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                    rows.append((doc_id, i, at, to - at, zlib.crc32(ids[4 * at : 4 * to])))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, PIECE)


def best_fit(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each item, and the bins' fills; items go by falling size to the tightest bin.

    Bins with the same free space are a stack; the set of free spaces that occur is a bit mask, in which
    the tightest fit is the lowest bit from the item's size on.
    """
    place, offset, fills = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    stacks: list[list[int]] = [[] for _ in range(length + 1)]
    there = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = there >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            at = stacks[free].pop()
            if not stacks[free]:
                there ^= 1 << free
        else:
            at, free = len(fills), length
            fills.append(0)
        place[i], offset[i] = at, fills[at]
        fills[at] += size
        if free > size:
            stacks[free - size].append(at)
            there |= 1 << free - size
    return place, offset, fills


def worth_carrying(fills: list[int], length: int) -> np.ndarray:
    """Whether a bin goes up the tree.

    After best fit no two bins of a node fit together, so at most one is half full or less, and a merge
    needs such a bin of another node. Nodes that merge have FAN_IN of those at most: of the other
    bins of a node, only the FAN_IN least filled can be of use. All others are final, so carrying
    fewer bins costs nothing, and a node reads FAN_IN * (FAN_IN + 1) bins at most.
    """
    out = np.zeros(len(fills), bool)
    out[np.argsort(fills, kind="stable")[: FAN_IN + 1]] = True
    return out & (np.array(fills, np.int64) < length)


def pack(pieces: DataFrame, length: int = LENGTH, items: int = ITEMS) -> DataFrame:
    """Pieces in sequences of ``length`` tokens at most: adds sequence_id and a gapless offset.

    pieces: any columns with a ``length`` of 1 to ``length`` (names starting with ``_bp_`` are taken); they are read
    several times, so give a written table. Full pieces are sequences by themselves. The others are dealt
    evenly over partitions of about ``items`` rows, each of which packs by best fit. Its underfull bins
    then merge in a tree, as items of further best-fit rounds. Repeated rows are packed one by one; an
    empty table gives none.
    """
    n = pieces.where(F.col("length") < length).count()
    nodes = max(1, -(-n // items))
    names = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", _bp_bin long, _bp_offset long, _bp_fill long, _bp_up boolean"

    def local(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [f for f in frames if len(f)]
        if not got:
            return
        rows = pd.concat(got, ignore_index=True)
        place, offset, fills = best_fit(rows["length"].to_numpy(), length)
        up = worth_carrying(fills, length)
        first = TaskContext.get().partitionId() << 32
        yield rows.assign(_bp_bin=first + place, _bp_offset=offset, _bp_fill=np.array(fills, np.int64)[place], _bp_up=up[place])

    packed = write_table(pieces.where(F.col("length") < length).repartition(nodes).mapInPandas(local, schema), "packed")
    moves = merge_tree(packed, nodes, length)
    placed = packed.join(moves, "_bp_bin", "left").select(
        *names,
        (2 * F.coalesce("_bp_root", "_bp_bin")).alias("sequence_id"),
        (F.col("_bp_offset") + F.coalesce("_bp_base", F.lit(0))).cast("bigint").alias("offset"),
    )
    full = pieces.where(F.col("length") >= length).select(*names, (2 * F.monotonically_increasing_id() + 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return placed.unionByName(full)


def merge_tree(packed: DataFrame, nodes: int, length: int) -> DataFrame:
    """Where carried bins end: _bp_bin, its sequence's first bin _bp_root, and its _bp_base there."""
    bins = packed.where("_bp_up").select("_bp_bin", F.col("_bp_fill")).distinct()
    moves = bins.select("_bp_bin", F.col("_bp_bin").alias("_bp_root"), F.lit(0).cast("bigint").alias("_bp_base"), (F.col("_bp_bin") / F.lit(1 << 32)).cast("bigint").alias("_bp_node"), "_bp_fill", F.lit(True).alias("_bp_up"))
    moves = write_table(moves, "packed-bins")

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_bp_root", ignore_index=True)
        place, offset, fills = best_fit(rows["_bp_fill"].to_numpy(), length)
        head = rows["_bp_root"].to_numpy()[np.lexsort((offset, place))][np.cumsum([0, *np.bincount(place)[:-1]])]
        up = worth_carrying(fills, length)
        return pd.DataFrame({"_bp_root": rows["_bp_root"], "_bp_to": head[place], "_bp_by": offset, "_bp_size": np.array(fills, np.int64)[place], "_bp_on": up[place]})

    while nodes > 1:
        nodes = -(-nodes // FAN_IN)
        parent = (F.col("_bp_node") / F.lit(FAN_IN)).cast("bigint")
        moves = moves.withColumn("_bp_node", parent)
        items = moves.where(F.col("_bp_up") & (F.col("_bp_root") == F.col("_bp_bin"))).select("_bp_node", "_bp_root", "_bp_fill")
        step = items.groupBy("_bp_node").applyInPandas(merge, "_bp_root long, _bp_to long, _bp_by long, _bp_size long, _bp_on boolean")
        moves = moves.join(step, "_bp_root", "left").select(
            "_bp_bin",
            F.coalesce("_bp_to", "_bp_root").alias("_bp_root"),
            (F.col("_bp_base") + F.coalesce("_bp_by", F.lit(0))).alias("_bp_base"),
            "_bp_node",
            F.coalesce("_bp_size", "_bp_fill").alias("_bp_fill"),
            F.coalesce("_bp_on", F.lit(False)).alias("_bp_up"),
        )
        moves = write_table(moves, "packed-bins")
    return moves.select("_bp_bin", "_bp_root", "_bp_base")


def pack_documents(docs: DataFrame, length: int = LENGTH, vocab: tuple[str, str] | None = None) -> DataFrame:
    """All pieces of all documents in sequences; columns of PIECE, sequence_id and offset."""
    return pack(write_table(token_pieces(docs, length, vocab=vocab), "pieces"), length)
