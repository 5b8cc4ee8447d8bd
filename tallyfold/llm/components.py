"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_table

MOST_ROUNDS = 60
#: Edges a task: the tasks of a round grow with its edges, from LEAST_TASKS on, and not with the session's shuffle partitions.
TASK_EDGES, LEAST_TASKS = 20_000, 8
#: Up to so many edges no node has so many that a task could not hold its edges, and hubs are not looked for.
NO_HUBS = TASK_EDGES * LEAST_TASKS
#: A node with more edges than LEAST_HUB, and than the edges' count over MOST_HUBS, is a hub: its edges are dealt to SALTS tasks.
LEAST_HUB, MOST_HUBS, SALTS = 64, 50_000, 32


def _tasks(df: DataFrame, count: int) -> DataFrame:
    return df.coalesce(max(LEAST_TASKS, -(-count // TASK_EDGES)))


def _to_least(edges: DataFrame, count: int) -> DataFrame:
    """(a, b, m): each edge with the smallest b of its a.

    There are at most 2 * MOST_HUBS hubs, however many edges there are, so their list is small enough to broadcast.
    """
    least = _tasks(edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), count)
    if count <= NO_HUBS:
        return _tasks(edges.join(least.select("a", "m"), "a"), count)
    hub = F.col("n") > max(LEAST_HUB, -(-count // MOST_HUBS))
    hubs = F.broadcast(least.where(hub).select("a", F.lit(True).alias("hub")))
    dealt = edges.join(hubs, "a", "left").withColumn("salt", F.when(F.col("hub"), F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).otherwise(0))
    every = least.select("a", "m", F.explode(F.when(hub, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    return _tasks(dealt.join(every, ["a", "salt"]), count).select("a", "b", "m")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the component's smallest node.

    Each round lets every node's larger neighbours, then all its neighbours that are not larger, point to the
    smallest neighbour, until each component is a star. Rounds grow with the logarithm of the
    longest path. Both halves of a round are written to the shared folder, so lineage stays short and no join is planned or run
    twice: the driver keeps a record of each task and each plan. Edges without a second node and an empty table give no rows.
    """
    real = edges.where(F.col("a") != F.col("b"))
    now = write_table(real.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, count = None, now.count()
    for _ in range(MOST_ROUNDS):
        both = _tasks(now, count).select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        near = _to_least(both, 2 * count).withColumn("m", F.least("a", "m"))
        large = write_table(near.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b"), "edges")
        small = _to_least(_tasks(large, count), count)
        star = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        now = write_table(_tasks(star.where("a != b").distinct(), count), "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, count = state, state[0]
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
