"""A table that a stream of keyed rows keeps up to date, in buckets of keys of which a batch rewrites only those it touches."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.operators.upserts import keep_last


class Manifests:
    """Numbered JSON files under a table's folder: for each bucket the version that holds its rows. The newest is the table."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.root = spark.sparkContext._jvm, path.rstrip("/")
        self.where = self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifests")
        self.files = self.where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, text: str):
        return self.jvm.org.apache.hadoop.fs.Path(text)

    def newest(self) -> dict | None:
        if not self.files.exists(self.where):
            return None
        names = [x.getPath().getName() for x in self.files.listStatus(self.where)]
        numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            return None
        source = self.files.open(self.path(f"{self.where}/{max(numbers)}.json"))
        try:
            return json.loads(bytes(source.readAllBytes()).decode())
        finally:
            source.close()

    def write(self, number: int, told: dict) -> None:
        """Appears whole or not at all: written beside, then renamed. One that is there already stays as it is."""
        draft, final = self.path(f"{self.where}/_{number}.draft"), self.path(f"{self.where}/{number}.json")
        out = self.files.create(draft, True)
        out.write(json.dumps(told).encode())
        out.close()
        if not self.files.rename(draft, final):
            self.files.delete(draft, False)

    def drop(self, text: str) -> None:
        self.files.delete(self.path(text), True)


def snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The table as the newest manifest has it; None before the first batch."""
    told = Manifests(spark, path).newest()
    if not told or not told["buckets"]:
        return None
    return spark.read.schema(T.StructType.fromJson(told["schema"])).parquet(*[f"{path}/b{b}/v{v}" for b, v in sorted(told["buckets"].items())])


def merge_batch(batch: DataFrame, epoch: int, path: str, keys: list[str], order: str, buckets: int = 64, keep: int = 1) -> int:
    """Puts the last row of each key of a batch into the table; the number of buckets written. An epoch that the table has seen already
    changes nothing. Of a bucket `keep` earlier versions stay for readers that have begun; older ones go."""
    spark = batch.sparkSession
    manifests = Manifests(spark, path)
    told = manifests.newest() or {"epoch": -1, "buckets": {}, "old": {}, "schema": json.loads(batch.schema.json())}
    if told["epoch"] >= epoch:
        return 0
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    new = keep_last(batch, keys, F.desc(order)).withColumn("_bucket", bucket).persist()
    try:
        touched = [r[0] for r in new.select("_bucket").distinct().collect()]  # at most `buckets`
        held = [b for b in touched if str(b) in told["buckets"]]
        if held:
            before = spark.read.schema(T.StructType.fromJson(told["schema"])).parquet(*[f"{path}/b{b}/v{told['buckets'][str(b)]}" for b in held])
            merged = keep_last(before.withColumn("_bucket", bucket).unionByName(new), keys, F.desc(order))
        else:
            merged = new
        stage = f"{path}/_stage{epoch}"
        merged.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(stage)
    finally:
        new.unpersist()
    for b in touched:
        to = f"{path}/b{b}/v{epoch}"
        manifests.drop(to)  # what an attempt that failed may have left
        manifests.files.mkdirs(manifests.path(f"{path}/b{b}"))
        manifests.files.rename(manifests.path(f"{stage}/_bucket={b}"), manifests.path(to))
        if str(b) in told["buckets"]:
            told["old"].setdefault(str(b), []).append(told["buckets"][str(b)])
        told["buckets"][str(b)] = epoch
    gone = []
    for b in touched:
        old = told["old"].get(str(b), [])
        gone += [f"{path}/b{b}/v{v}" for v in old[: max(len(old) - keep, 0)]]
        told["old"][str(b)] = old[max(len(old) - keep, 0) :]
    told["epoch"] = epoch
    manifests.write(epoch, told)
    for text in [*gone, stage]:
        manifests.drop(text)
    return len(touched)


def upsert_into(stream: DataFrame, path: str, keys: list[str], order: str, checkpoint: str, buckets: int = 64):
    """Keeps at path the last row of each key of a stream, by micro-batches. Read it with snapshot()."""

    def write(batch: DataFrame, epoch: int) -> None:
        merge_batch(batch, epoch, path, keys, order, buckets)

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
