"""Queries against their SQL on rows that the given tables have few of."""

from __future__ import annotations

import duckdb

import __spark_entry__


def test_page_that_begins_with_a_cut_copy_of_its_quote(spark, tmp_path):
    base = [f"{a}{b}" for a in ("lyer", "haat") for b in ("an", "er", "on", "ti", "re")]
    base[0] = "to"
    rest = [f"{a}m{b}" for a in "bcdfg" for b in "bcdfghjkpq"]
    texts = [" ".join([*base[1:], *rest[:21], *base, *rest, *rest]), " ".join([*rest[:30], *base, *rest, *rest]), None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in __spark_entry__.queries()["quote_grounding_edits"](spark, str(tmp_path)).collect()}
    sql = duckdb.connect()
    sql.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(sql.execute(__spark_entry__.oracle_sql()["quote_grounding_edits"]).fetchall())
    assert all(s for d, s in got if d < 2)


def test_parts_of_the_stream_are_written_and_read_by_many_tasks(spark):
    from pathlib import Path

    from tallyfold.tables import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file://"))
    before, key = set(folder.glob("stream-*")), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        got = {tuple(r) for r in __spark_entry__.queries()["stream_link"](spark, "/root/testdata/sf0.001").collect()}
    finally:
        spark.conf.unset(key)
    (made,) = set(folder.glob("stream-*")) - before
    assert len(list(made.glob("in/*.parquet"))) > 4 and {p.name for p in made.glob("out/relations/batch=*")} == {"batch=0", "batch=1"}
    sql = duckdb.connect()
    sql.execute("create view orders as select * from '/root/testdata/sf0.001/orders.parquet'")
    assert got == set(sql.execute(__spark_entry__.oracle_sql()["stream_link"]).fetchall()) and got
