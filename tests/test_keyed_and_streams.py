from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from periodiq.operators import keyed, matching, rollups
from periodiq.session import publish
from periodiq.streaming import ingest


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "k int, n string, p string")
    new = spark.createDataFrame([(2, "", "y"), (3, "c", None)], "k int, n string, p string")
    assert rows(keyed.upsert_coalesce(old, new, ["k"])) == [(1, "a", None), (2, "b", "y"), (3, "c", None)]
    assert rows(keyed.upsert_last(old, new, ["k"])) == [(1, "a", None), (2, "", "y"), (3, "c", None)]
    assert rows(keyed.insert_ignore(old, new, ["k"], F.col("n"))) == [(1, "a", None), (2, "b", "x"), (3, "c", None)]
    assert keyed.upsert_last(old.limit(0), new.limit(0), ["k"]).count() == 0


def test_one_row_per_key_with_ties_and_nulls(spark):
    d = spark.createDataFrame([(None, 1, "a"), (None, 1, "b"), (1, None, "c"), (1, 2, "d"), (1, 2, "d")], "k int, o int, v string")
    assert rows(keyed.latest_per_key(d, ["k"], F.col("o"))) == [(1, 2, "d"), (None, 1, "b")]
    assert rows(keyed.first_per_key(d, ["k"], F.col("o"))) == [(1, None, "c"), (None, 1, "a")]


def test_frontier_and_segments(spark):
    d = spark.createDataFrame([("f", i) for i in (0, 1, 2, 4, 5, 9, 9)] + [("g", 3)], "g string, i int")
    assert rows(keyed.completion_frontier(d, "g", "i")) == [("f", 2, 3), ("g", 3, 0)]


def test_spikes(spark):
    d = spark.createDataFrame([("a", 2000, 1), ("a", 2001, 1), ("a", 2002, 9), ("b", 2001, 1), ("b", 2002, 9), ("c", 2000, 5), ("c", 2001, 9), ("c", 2002, 6)], "k string, y int, n int")
    assert rows(keyed.spikes(d, "k", "y", "n", 3, 2).select("k")) == [("a",)]


def test_cascade_order_and_misses(spark):
    q = spark.createDataFrame([(1, "i1", ["x", "n2"]), (2, None, ["zz"]), (3, "", None)], "id int, issn string, names array<string>")
    t = spark.createDataFrame([(10, "n2", None), (11, "x", None), (12, "q", "i1")], "id int, name string, issn string")
    s = [(1, "issn", F.col("issn")), (2, "name", F.col("names"))]
    m = matching.cascade_match(matching.key_rows(q, "id", s), matching.key_rows(t, "id", [(1, "issn", F.col("issn")), (2, "name", F.col("name"))]))
    assert rows(matching.with_misses(q, "id", m).select("query_id", "target_id", "status", "kind")) == [(1, 12, "found", "issn"), (2, None, "not_found", None), (3, None, "not_found", None)]


def test_rollups(spark):
    d = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "x"), ("b", None)], "k string, v string")
    assert rows(rollups.histogram(d, "k", F.col("v")).select("k", rollups.histogram_text("histogram"))) == [("a", "x=2;y=1")]
    assert rows(rollups.top_values(d, "k", F.col("v"), 1).select("k", "value", "n")) == [("a", "x", 2)]
    assert rows(rollups.condensed_pivot(d, "k", "v", ["x", "z"], F.lit("!"))) == [("a", "!", ""), ("b", "", "")]


def test_streams_resume_without_repeats(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "k int, v int, ts timestamp"
    t = datetime(2024, 1, 1)
    for part in ([(1, 1, t), (1, 2, t), (2, 1, t)], [(2, 5, t), (3, 1, t)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        ingest.append_once(ingest.new_rows(spark, src, schema), ["k"], out, cp)
    assert rows(spark.read.schema(schema).parquet(out).select("k")) == [(1,), (2,), (3,)]
    root, cp2 = str(tmp_path / "table"), str(tmp_path / "cp2")
    for _ in range(2):
        ingest.upsert_stream(ingest.new_rows(spark, src, schema), ["k"], F.col("v"), root, cp2)
    assert rows(ingest.read_version(spark, root, schema).select("k", "v")) == [(1, 2), (2, 5), (3, 1)]
    ttl = ingest.within_ttl(ingest.new_rows(spark, src, schema), "ts", "1 hour", ["k"])
    q = ttl.writeStream.format("memory").queryName("ttl_rows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("ttl_rows").count() == 3


def test_read_through(spark):
    keys = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    t = datetime(2024, 1, 2)
    cache = spark.createDataFrame([(1, "old", t), (2, "gone", datetime(2023, 1, 1))], "k int, v string, e timestamp")
    answers, fresh = ingest.read_through(keys, cache, lambda d: d.select("k", F.lit("new").alias("v"), F.lit(t).alias("e")), "k", "e", F.lit(datetime(2024, 1, 1)))
    assert rows(answers.select("k", "v")) == [(1, "old"), (2, "new")]
    assert rows(fresh.select("k")) == [(2,)]


def test_resume_guard_audit_and_registration(spark, tmp_path):
    cp = str(tmp_path / "job")
    ingest.guard_resume(spark, cp, "fast", "/in")
    ingest.guard_resume(spark, cp, "fast", "/in")
    with pytest.raises(ValueError):
        ingest.guard_resume(spark, cp, "full", "/in")
    log = str(tmp_path / "log")
    for n in (1, 2):
        ingest.audit(spark, log, "sync", "a", n, F.current_timestamp())
    assert spark.read.parquet(log).count() == 2
    known = spark.createDataFrame([("a", 1), ("b", 2)], "name string, level int")
    assert rows(ingest.register_sources(known, spark.createDataFrame([("a", 9)], "name string, level int"))) == [("a", 9), ("b", 2)]


def test_publish_replaces_whole_folders(spark, tmp_path):
    staged, target = str(tmp_path / "staged"), str(tmp_path / "table")
    for n in (1, 2):
        spark.range(n).write.parquet(staged)
        publish(spark, staged, target)
    assert spark.read.parquet(target).count() == 2
    with pytest.raises(RuntimeError):
        publish(spark, staged, target)
    assert spark.read.parquet(target).count() == 2


def test_top_rows_of_a_hot_key(spark):
    d = spark.range(3000).selectExpr("'hot' as k", "cast(id as string) as v").unionByName(spark.createDataFrame([("b", "x")], "k string, v string"))
    assert rows(keyed.first_distinct(d, "k", "v", "v", 2)) == [("b", "x", 1), ("hot", "0", 1), ("hot", "1", 2)]
