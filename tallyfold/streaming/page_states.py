"""The states of pages as a stream: a log of what happened to each page, folded into status, attempts and leases."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.layers import latest

#: How often a page may be worked on, and after how many seconds the lease of a claim has ended.
MOST_ATTEMPTS, LEASE_S = 3, 300

EVENT = "document_id string, page_index long, seq long, kind string, at long"
PAGE_STATE = "document_id string, page_index long, status string, attempts int, claims long, refused long, updated long"
_KEPT = "status string, attempts int, claims long, refused long, updated long, last long"


def _stepped(state: tuple, kind: str, at: int, most_attempts: int, lease_s: int) -> tuple:
    """The state (status, attempts, claims, refused, updated) after an event; events that a status does not allow change nothing."""
    status, attempts, claims, refused, updated = state
    if status is None:
        first = {"registered": "pending", "skipped": "skipped"}.get(kind)
        return (first, 0, 0, 0, at) if first else state
    if kind == "claimed":
        free = status == "pending" or (status == "failed" and attempts < most_attempts) or (status == "processing" and updated < at - lease_s)
        return ("processing", attempts + 1, claims + 1, refused, at) if free else (status, attempts, claims, refused + 1, updated)
    if kind == "retry" and status == "failed":
        return status, 0, claims, refused, at
    if status == "processing" and kind in ("done", "failed"):
        return kind, attempts, claims, refused, at
    if status == "processing" and kind == "paused":
        return "pending", attempts - 1, claims, refused, at
    return state


def page_changes(events: DataFrame, most_attempts: int = MOST_ATTEMPTS, lease_s: int = LEASE_S) -> DataFrame:
    """The new state (PAGE_STATE) of each page that a micro-batch of ``events`` (EVENT, a stream; more columns do no harm) touches.

    Kinds: registered and skipped make a page, if it is not there; claimed takes one that is pending, failed with attempts left, or held
    for longer than the lease, and is refused otherwise; done and failed end a claim; paused gives it back, without
    an attempt spent; retry gives a failed page its attempts again. Leases are told from the times of the events, so a rerun ends alike. Events are
    applied by seq, which must not go down from one micro-batch to a later one: an event that is no newer than the last is a repetition and
    does nothing. Rows with a null in any column of EVENT are no events.

    Spark's state store keeps one row a page. What a task holds of a page is its events of one micro-batch, which
    the source's limits (``maxFilesPerTrigger``, ``maxBytesPerTrigger``) bound, and which are folded one by one.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        *state, last = kept.get if kept.exists else (None, 0, 0, 0, None, None)
        state = tuple(state)
        # Pages have few events each, which plain tuples sort much faster than frames.
        new = [e for f in frames for e in zip(*[f[c].tolist() for c in ("seq", "kind", "at")], strict=True)]
        for seq, kind, at in sorted(new):
            if last is None or seq > last:
                state, last = _stepped(state, kind, at, most_attempts, lease_s), seq
        kept.update((*state, last))
        if state[0] is not None:
            yield pd.DataFrame([(*key, *state)], columns=["document_id", "page_index", "status", "attempts", "claims", "refused", "updated"])

    names = [c.split(" ")[0] for c in EVENT.split(", ")]
    whole = events.select(*names).where(" and ".join(f"{n} is not null" for n in names))
    return whole.groupBy("document_id", "page_index").applyInPandasWithState(fold, PAGE_STATE, _KEPT, "update", GroupStateTimeout.NoTimeout)


def fold_stream(events: DataFrame, folder: str, checkpoint: str, most_attempts: int = MOST_ATTEMPTS, lease_s: int = LEASE_S, written: Callable[[int], None] | None = None) -> StreamingQuery:
    """Folds all events that the source has now, and adds the changed states to ``folder``; ``current`` reads them.

    A micro-batch has a folder of its own and is written whole, from the state before it: one that was cut short, at any point, is
    done again and replaces what it wrote. written: told the number of a batch whose states are there.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        if written:
            written(number)

    changed = page_changes(events, most_attempts, lease_s)
    return changed.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """Each page's last state (PAGE_STATE)."""
    return latest(spark.read.schema(f"{PAGE_STATE}, batch long").parquet(folder), ["document_id", "page_index"], "batch").drop("batch")


def document_states(states: DataFrame, most_attempts: int = MOST_ATTEMPTS) -> DataFrame:
    """Each document's pages by status, the pages that can be worked on yet, and its state.

    A document is uploaded until a page of it is claimed, extracted when nothing is left to do, and processing in between.
    """
    has = lambda *s: F.col("status").isin(*s)
    left = has("pending", "processing") | (has("failed") & (F.col("attempts") < most_attempts))
    counts = {n: F.count_if(has(n)) for n in ("pending", "processing", "done", "failed", "skipped")} | {"remaining": F.count_if(left), "_claims": F.sum("claims")}
    counted = states.groupBy("document_id").agg(*[c.alias(n) for n, c in counts.items()])
    state = F.when(F.col("remaining") == 0, "extracted").when(F.col("_claims") == 0, "uploaded").otherwise("processing")
    return counted.withColumn("state", state).drop("_claims")
