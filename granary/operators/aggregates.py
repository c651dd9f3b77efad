"""Pivots, calibration, ranking quality, agreement and drift as grouped aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pivot_facts(facts: DataFrame, keys: list[str], name: str, features: dict[str, Column]) -> DataFrame:
    """One row for each key with a column of each feature, the largest of its values; one aggregation, no pivot job."""
    return facts.groupBy(*keys).agg(*[F.max(F.when(F.col(name) == k, v)).alias(k) for k, v in features.items()])


def bins(rows: DataFrame, p: str, n: int = 10) -> Column:
    """The bin of a probability: low edges belong to the bin, 1 to the last; null outside 0 to 1."""
    return F.when((F.col(p) >= 0) & (F.col(p) <= 1), F.least(F.floor(F.col(p) * n), F.lit(n - 1))).cast("int")


def calibration(rows: DataFrame, y: str, p: str, n: int = 10) -> DataFrame:
    """bin, n, mean_p, mean_y of each of n bins; empty bins have n 0 and null means."""
    held = rows.withColumn("bin", bins(rows, p, n)).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("mean_y"))
    every = rows.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    return every.join(held, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def calibration_error(rows: DataFrame, y: str, p: str, n: int = 10, by: list[str] | None = None) -> DataFrame:
    """Expected calibration error, 0 without rows; rows outside 0 to 1 count in the total alone."""
    by = by or []
    held = rows.withColumn("bin", bins(rows, p, n)).groupBy(*by, "bin").agg(F.count("*").alias("k"), F.abs(F.avg(p) - F.avg(F.col(y).cast("double"))).alias("gap"))
    return held.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("bin").isNotNull(), F.col("k") * F.col("gap"))) / F.sum("k"), F.lit(0.0)).alias("ece"))


#: Ranges of scores that are sorted by themselves.
RANGES = 64


def auc(rows: DataFrame, y: str, score: str, by: list[str] | None = None, least: int = 10) -> DataFrame:
    """Area under the ROC curve from rank sums, ties at their mean rank; 0 with fewer than `least` rows or one class.
    Rows are first counted by score, so no task sorts more than the distinct scores of a group; without groups the scores
    are cut into RANGES by approximate quantiles, so none sorts all of them."""
    by = by or []
    counts = rows.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(*by, score).agg(F.count("*").alias("_n"), F.sum(F.col(y).cast("long")).alias("_pos"))
    w = W.partitionBy(*by).orderBy(score).rowsBetween(W.unboundedPreceding, -1)
    below = F.coalesce(F.sum("_n").over(w), F.lit(0))
    if not by:
        cuts = counts.agg(F.percentile_approx(score, [i / RANGES for i in range(1, RANGES)])).first()[0] or []
        counts = counts.withColumn("_range", sum(((F.col(score) > c).cast("int") for c in cuts), F.lit(0)))
        sums = counts.groupBy("_range").agg(F.sum("_n").alias("_all"))  # RANGES rows
        earlier = F.coalesce(F.sum("_all").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        counts = counts.join(F.broadcast(sums.select("_range", earlier.alias("_earlier"))), "_range")
        inside = W.partitionBy("_range").orderBy(score).rowsBetween(W.unboundedPreceding, -1)
        below = F.col("_earlier") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    ranked = counts.withColumn("_rank", below + (F.col("_n") + 1) / 2)
    sums = ranked.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum("_pos").alias("pos"), F.sum(F.col("_rank") * F.col("_pos")).alias("_ranks"))
    neg = F.col("n") - F.col("pos")
    area = (F.col("_ranks") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * neg)
    return sums.select(*by, "n", F.when((F.col("n") >= least) & (F.col("pos") > 0) & (neg > 0), area).otherwise(0.0).alias("auc"))


def precision_recall(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall and F1, zero where undefined."""
    p = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    r = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return {"precision": p, "recall": r, "f1": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))}


def majority(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each key, ties to the one seen first, and the share that disagrees."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    w = W.partitionBy(*keys)
    best = counts.withColumn("_r", F.row_number().over(w.orderBy(F.desc("_n"), "_first"))).withColumn("_all", F.sum("_n").over(w))
    return best.where("_r = 1").select(*keys, F.col(value).alias("majority"), (1 - F.col("_n") / F.col("_all")).alias("disagreement"))


def pairwise_agreement(rows: DataFrame, item: list[str], run: str, value: str) -> DataFrame:
    """Items in common and share of equal values of each two runs."""
    a, b = rows.select(*item, F.col(run).alias("run_a"), F.col(value).alias("_va")), rows.select(*item, F.col(run).alias("run_b"), F.col(value).alias("_vb"))
    both = a.join(b, item).where("run_a < run_b")
    return both.groupBy("run_a", "run_b").agg(F.count("*").alias("n"), F.avg(F.col("_va").eqNullSafe(F.col("_vb")).cast("double")).alias("agreement"))


def drift(rows: DataFrame, run: str, value: str, values: list[str]) -> DataFrame:
    """Sum of absolute differences of the counts of each value between each two runs."""
    counts = rows.groupBy(run).agg(*[F.count_if(F.col(value) == v).alias(f"_{v}") for v in values])
    a, b = counts.select(F.col(run).alias("run_a"), *[F.col(f"_{v}").alias(f"a_{v}") for v in values]), counts.select(F.col(run).alias("run_b"), *[F.col(f"_{v}").alias(f"b_{v}") for v in values])
    total = sum((F.abs(F.col(f"a_{v}") - F.col(f"b_{v}")) for v in values), F.lit(0))
    return a.join(b, F.col("run_a") < F.col("run_b")).select("run_a", "run_b", total.cast("long").alias("drift"))
