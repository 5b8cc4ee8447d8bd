"""States of pages, folded from a log by a stream that is cut short on the way."""

from __future__ import annotations

import random

import pytest
from pyspark.errors import StreamingQueryException

from tallyfold.streaming import page_states as ps


def folded(spark, tmp_path, batches, crash_in=(), **options):
    """Appends each batch of events, and runs the stream after each; in some the first run ends after its states are written."""
    source, out, check = (f"file://{tmp_path}/{n}" for n in ("in", "out", "check"))
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, ps.EVENT + ", document string").write.mode("append").parquet(source)
        stream = lambda told: ps.fold_stream(spark.readStream.schema(ps.EVENT).parquet(source), out, check, written=told, **options)
        if i in crash_in:

            def crash(number):
                raise RuntimeError("lost")

            with pytest.raises(StreamingQueryException):
                stream(crash).awaitTermination()
        stream(None).awaitTermination()
    return ps.current(spark, out)


def test_attempts_leases_pauses_and_retries(spark, tmp_path):
    log = [
        ("d", 1, 1, "registered", 0), ("d", 2, 2, "registered", 0), ("d", 3, 3, "skipped", 0), ("e", 1, 4, "registered", 0), ("d", 9, 5, "claimed", 0),
        ("d", 1, 6, "claimed", 10), ("d", 1, 7, "claimed", 310), ("d", 1, 8, "claimed", 311), ("d", 1, 9, "done", 400), ("d", 1, 10, "failed", 401), ("d", 1, 11, "claimed", 9000), ("d", 3, 12, "claimed", 9),
        *[("d", 2, 20 + 2 * k + j, kind, 1000 + k) for k in range(4) for j, kind in enumerate(("claimed", "failed"))],
        (None, 1, 40, "registered", 0), ("d", None, 41, "registered", 0), ("d", 1, None, "retry", 0), ("d", 1, 42, None, 0), ("d", 1, 43, "no such kind", 0),
    ]
    rest = [("d", 2, 60, "retry", 2000), ("d", 2, 61, "claimed", 2001), ("d", 2, 62, "paused", 2002), ("d", 2, 62, "paused", 2002), ("d", 2, 21, "claimed", 1000)]
    more = lambda rows: [(*r, "clash") for r in rows]
    states = folded(spark, tmp_path, [more(log), more(rest), []], crash_in=(0, 1))
    got = {(r["document_id"], r["page_index"]): tuple(r)[2:] for r in states.collect()}
    assert got == {("d", 1): ("done", 2, 2, 2, 400), ("d", 2): ("pending", 0, 4, 1, 2002), ("d", 3): ("skipped", 0, 0, 1, 0), ("e", 1): ("pending", 0, 0, 0, 0)}
    docs = {r["document_id"]: r.asDict() for r in ps.document_states(states).collect()}
    assert docs["e"]["state"] == "uploaded" and docs["d"]["state"] == "processing" and docs["d"]["remaining"] == 1 and docs["d"]["skipped"] == 1
    spent = spark.createDataFrame([("x", 1, "failed", 3, 3, 0, 1), ("x", 2, "done", 1, 1, 0, 1), ("y", 1, "failed", 2, 2, 0, 1)], ps.PAGE_STATE)
    assert {r["document_id"]: r["state"] for r in ps.document_states(spent).collect()} == {"x": "extracted", "y": "processing"}
    assert ps.document_states(states.where("false")).count() == 0


def test_batches_end_as_one_fold_does(spark, tmp_path):
    rng, log, at = random.Random(3), [], 0
    for seq in range(600):
        at += rng.randint(0, 120)
        log.append(("hot" if rng.random() < 0.4 else f"d{rng.randint(0, 3)}", rng.randint(0, 2), seq, rng.choice(["registered", "claimed", "claimed", "done", "failed", "failed", "paused", "retry", "skipped"]), at))
    want = {}
    for doc, page, _, kind, t in log:
        want[doc, page] = ps._stepped(want.get((doc, page), (None, 0, 0, 0, None)), kind, t, 3, 300)
    parts = [[(*r, "") for r in rng.sample(log[a : a + 150], 150)] for a in range(0, 600, 150)]
    got = {(r["document_id"], r["page_index"]): tuple(r)[2:] for r in folded(spark, tmp_path, parts, crash_in=(2,)).collect()}
    assert got == {k: v for k, v in want.items() if v[0]}
