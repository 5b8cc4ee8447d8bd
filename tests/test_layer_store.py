"""The stored layer: replaced and deleted documents, and changes that end halfway."""

from __future__ import annotations

import pytest

from tallyfold.sources import layers
from tallyfold.sources.layer_store import KEYS, LayerStore

SCHEMAS = {
    "documents": "document_id string, title string", "pages": "document_id string, page_index long", "facts": "id long, document_id string, value_num double", "failures": "id long, document_id string, kind string",
    "relations": "fact_a_id long, fact_b_id long, verdict string", "llm_cache": "key string, response string",
}
FIRST = {
    "documents": [("a", "A"), ("b", "B"), ("c", "C")], "pages": [("a", 0), ("a", 1), ("b", 0)], "facts": [(1, "a", 1.0), (2, "a", 2.0), (3, "b", 3.0), (4, "c", None)], "failures": [(1, "a", "x"), (2, None, "y"), (3, "c", "z")],
    "relations": [(1, 3, "p"), (3, 2, "q"), (3, 4, "r"), (None, 4, "s")], "llm_cache": [("k", "old")],
}
SECOND = {
    "documents": [("a", "A2"), ("d", "D")], "pages": [("a", 0), ("d", 0), ("zz", 0)], "facts": [(1, "a", 1.5), (9, "d", 9.0)], "failures": [(4, "d", "w"), (5, None, "v")],
    "relations": [(1, 3, "p2"), (9, 3, "t"), (3, 9, "u")], "llm_cache": [("k", "new"), ("m", "new"), ("m", "new")],
}


def frames(spark, rows):
    return {n: spark.createDataFrame(rows[n], SCHEMAS[n]) for n in SCHEMAS}


def contents(tables):
    return {n: sorted(map(tuple, t.select(*[c.split(' ')[0] for c in SCHEMAS[n].split(', ')]).collect()), key=repr) for n, t in tables.items()}


def test_replace_is_whole_or_nothing(spark, tmp_path):
    store = LayerStore(spark, f"file://{tmp_path}/layer", SCHEMAS, buckets=5)
    assert contents(store.tables()) == {n: [] for n in KEYS} and store.manifest() == (0, [])
    assert store.replace(frames(spark, FIRST)) == 1
    before = contents(store.tables())
    # failures without a document and relations without a first fact belong to no document that is taken over
    assert before["facts"] == sorted(FIRST["facts"], key=repr) and before["failures"] == [(1, "a", "x"), (3, "c", "z")] and before["relations"] == [(1, 3, "p"), (3, 2, "q"), (3, 4, "r")]
    for failing in ("documents", "relations", "manifest"):

        def fail(step, failing=failing):
            if step == failing:
                raise RuntimeError("lost")

        with pytest.raises(RuntimeError):
            LayerStore(spark, store.path, SCHEMAS, 5, fail).replace(frames(spark, SECOND))
        assert contents(store.tables()) == before and store.manifest()[0] == 1
    held = store.tables()
    want = contents(layers.copy_layer(frames(spark, SECOND), held))
    want["llm_cache"] = [("k", "old"), ("m", "new")]
    assert store.replace(frames(spark, SECOND)) == 2 and contents(store.tables()) == want
    assert want["relations"] == [(1, 3, "p2"), (3, 4, "r"), (9, 3, "t")]
    assert contents(held) == before  # a reader of the earlier version is not disturbed
    assert store.replace(frames(spark, SECOND)) == 3 and contents(store.tables()) == want


def test_delete_and_untouched_buckets(spark, tmp_path):
    store = LayerStore(spark, f"file://{tmp_path}/layer", SCHEMAS, buckets=64)
    more = FIRST | {"documents": FIRST["documents"] + [(f"x{i}", "X") for i in range(40)], "facts": FIRST["facts"] + [(100 + i, f"x{i}", 0.0) for i in range(40)]}
    store.replace(frames(spark, more))
    store.delete(spark.createDataFrame([("a", 1), ("none", 2), (None, 3), ("a", 1)], "document_id string, title int"))
    got = contents(store.tables())
    assert got["relations"] == [(3, 4, "r")] and got["failures"] == [(1, "a", "x"), (3, "c", "z")] and ("a", "A") not in got["documents"] and len(got["facts"]) == 42
    written = [v for n, _, v in store.manifest()[1] if n == "facts"]
    assert written.count(1) > 20 and written.count(2) <= 2  # a's bucket alone was written again
    store.delete(store.tables()["documents"])
    assert contents(store.tables()) == {n: [] for n in KEYS} | {"failures": [(1, "a", "x"), (3, "c", "z")], "llm_cache": [("k", "old")]}
    store.replace({n: t.where("false") for n, t in frames(spark, FIRST).items()})
    assert store.tables()["documents"].count() == 0
