"""Streams that keep tables and lists: what a batch rewrites, what a restart changes, and entries that end."""

import pytest
from pyspark.sql import functions as F

from granary.streaming import upserts as U


def rows(spark, *pairs):
    return spark.createDataFrame([(k, v, n) for n, (k, v) in enumerate(pairs)], "k long, v string, n long")


def table(spark, path):
    return {r.k: r.v for r in U.snapshot(spark, path).collect()}


def test_batches_rewrite_only_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    assert U.snapshot(spark, path) is None
    many = rows(spark, *[(i, f"a{i}") for i in range(200)])
    assert U.merge_batch(many, 0, path, ["k"], "n", buckets=16) == 16
    assert table(spark, path) == {i: f"a{i}" for i in range(200)}
    reader = U.snapshot(spark, path)  # goes on with its files while two keys change
    again = rows(spark, (3, "x"), (3, "b3"), (999, "new")).withColumn("n", F.col("n") + 1000)
    written = U.merge_batch(again, 1, path, ["k"], "n", buckets=16)
    assert 1 <= written <= 2
    want = {i: f"a{i}" for i in range(200)} | {3: "b3", 999: "new"}
    assert table(spark, path) == want and reader.count() == 200
    versions = lambda: sorted(str(p.relative_to(tmp_path)) for p in (tmp_path / "t").glob("b*/v*"))
    before = versions()
    assert len(before) in (16 + written, 17 + written) and not list((tmp_path / "t").glob("_stage*"))
    assert U.merge_batch(again, 1, path, ["k"], "n", buckets=16) == 0 and versions() == before  # a replay changes nothing
    late = rows(spark, (3, "older")).withColumn("n", F.lit(-1).cast("long"))
    U.merge_batch(late, 2, path, ["k"], "n", buckets=16)
    assert table(spark, path) == want
    U.merge_batch(rows(spark, (3, "c3")).withColumn("n", F.lit(5000).cast("long")), 3, path, ["k"], "n", buckets=16)
    bucket = next(p.parent for p in (tmp_path / "t").glob("b*/v3"))
    assert sorted(p.name for p in bucket.glob("v*")) == ["v2", "v3"]  # older versions are gone
    assert table(spark, path) == want | {3: "c3"}


def test_a_batch_that_failed_is_repeated(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    U.merge_batch(rows(spark, (1, "a"), (2, "b")), 0, path, ["k"], "n", buckets=4)
    new = rows(spark, (1, "c"), (3, "d")).withColumn("n", F.col("n") + 10)

    def lost(self, number, told):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(U.Manifests, "write", lost)
        with pytest.raises(OSError, match="lost"):
            U.merge_batch(new, 1, path, ["k"], "n", buckets=4)
    assert table(spark, path) == {1: "a", 2: "b"}  # the manifest names the files of before
    U.merge_batch(new, 1, path, ["k"], "n", buckets=4)
    assert table(spark, path) == {1: "c", 2: "b", 3: "d"}


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    data, path, check = str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c")
    stream = lambda: spark.readStream.schema("k long, v string, n long").parquet(data)
    rows(spark, (1, "a"), (2, "b")).write.parquet(data)
    U.upsert_into(stream(), path, ["k"], "n", check, buckets=4)
    rows(spark, (2, "c"), (3, "d")).withColumn("n", F.col("n") + 10).write.mode("append").parquet(data)
    U.upsert_into(stream(), path, ["k"], "n", check, buckets=4)
    U.upsert_into(stream(), path, ["k"], "n", check, buckets=4)
    assert table(spark, path) == {1: "a", 2: "c", 3: "d"}


def test_watched_keys_end_and_are_renewed(spark, tmp_path):
    pytest.importorskip("google.protobuf")  # Spark's own Python state needs it
    from granary.streaming import watchlist as L

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    data = str(tmp_path / "in")
    batches = [
        [("a", "watch", 0), ("b", "watch", 0), ("a", "trade", 30)],
        [("b", "watch", 50), ("c", "trade", 55), ("z", "trade", 90)],
        [("b", "trade", 100), ("z", "trade", 200)],
        [("z", "trade", 400)],
    ]
    for i, batch in enumerate(batches):
        made = spark.createDataFrame(batch, "key string, kind string, s long").select("key", "kind", F.timestamp_seconds(F.col("s") + 1000).alias("ts"))
        made.coalesce(1).write.mode("append").parquet(data)
        q = L.watched(spark.readStream.schema(made.schema).parquet(data), "key", 60, "0 seconds").writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {(r.key, r.state, r.at_ms // 1000 - 1000) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", "begun", 0), ("a", "hit", 30), ("a", "ended", 60), ("b", "begun", 0), ("b", "renewed", 50), ("b", "hit", 100), ("b", "ended", 110)}
