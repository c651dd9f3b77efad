"""A log of backtest runs: append-only, each configuration written once; latest and passing runs by family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What says which run it is; metrics and verdicts are its results.
CONFIGURATION = ("model_family", "data_snapshot_date", "train_window", "test_window", "features_active", "alt_data_signals")
SCHEMA = "run_id string, model_family string, data_snapshot_date date, train_window string, test_window string, features_active array<string>, alt_data_signals array<string>, metrics map<string,double>, pass_fail map<string,boolean>, all_passed boolean, run_date timestamp, notes string"


def run_key() -> Column:
    """A hash of a run's configuration; the order of features and signals doesn't count."""
    parts = [F.to_json(F.struct(F.array_sort(c).alias("x") if c in ("features_active", "alt_data_signals") else F.col(c).cast("string").alias("x"))) for c in CONFIGURATION]
    return F.sha2(F.concat_ws("\n", *parts), 256)


def log(spark: SparkSession, path: str) -> DataFrame:
    """All runs at path; none where nothing has been written yet."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path)


def record(runs: DataFrame, path: str) -> int:
    """Appends the runs whose configuration the log has not got; the number written. Of rows of one configuration the one of the least run
    date counts. A repeated call, also after one that failed, adds nothing twice: Spark's commit shows a write's files whole or not at all."""
    spark = runs.sparkSession
    keyed = runs.withColumn("run_id", run_key())
    first = keyed.withColumn("_r", F.row_number().over(W.partitionBy("run_id").orderBy("run_date"))).where("_r = 1").drop("_r")
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    new = first.join(log(spark, path).select("run_id"), "run_id", "left_anti").select(*names).persist()
    try:
        n = new.count()
        if n:
            new.coalesce(1).write.mode("append").parquet(path)
    finally:
        new.unpersist()
    return n


def latest(runs: DataFrame, by: list[str], limit: int = 10, passing: bool = False) -> DataFrame:
    """The newest runs of each group, those of equal dates by id; with `passing` only runs whose must-pass metrics all passed."""
    held = runs.where("all_passed") if passing else runs
    return held.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc_nulls_last("run_date"), "run_id"))).where(F.col("rank") <= limit)


def compared(runs: DataFrame, a: str, b: str) -> DataFrame:
    """(metric, before, after, delta, before_passed, after_passed) of two run ids; an unknown id raises."""
    both = {r.run_id: r for r in runs.where(F.col("run_id").isin(a, b)).collect()}
    if missing := sorted({a, b} - set(both)):
        raise ValueError(f"runs not found: {missing}")
    flat = runs.where(F.col("run_id").isin(a, b)).select("run_id", F.explode("metrics").alias("metric", "value"))
    of = lambda x: F.max(F.when(F.col("run_id") == x, F.col("value")))
    sums = flat.groupBy("metric").agg(of(a).alias("before"), of(b).alias("after"))
    return sums.select("metric", "before", "after", (F.col("after") - F.col("before")).alias("delta"), F.lit(both[a].all_passed).alias("before_passed"), F.lit(both[b].all_passed).alias("after_passed"))


def from_gates(gated: DataFrame, window: str, family: str, features: list[str], snapshot: str, train: str = "train_window", test: str = "test_window") -> DataFrame:
    """Runs of the log's shape from rows (window, metric, value, passed, must_pass), one run for each window."""
    pairs = lambda value: F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", value))))
    sums = gated.groupBy(window).agg(pairs(F.col("value")).alias("metrics"), pairs(F.col("passed")).alias("pass_fail"), F.bool_and(F.col("passed") | ~F.col("must_pass")).alias("all_passed"))
    texts = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    return sums.select(
        F.lit(family).alias("model_family"), F.lit(snapshot).cast("date").alias("data_snapshot_date"), F.concat(F.lit(f"{train}:"), F.col(window).cast("string")).alias("train_window"), F.concat(F.lit(f"{test}:"), F.col(window).cast("string")).alias("test_window"),
        texts(features).alias("features_active"), texts([]).alias("alt_data_signals"), "metrics", "pass_fail", "all_passed", F.current_timestamp().alias("run_date"), F.lit(None).cast("string").alias("notes"),
    )
