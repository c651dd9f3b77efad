"""Top rows, capped selection, splits by time, neighbours and percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_by(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """DISTINCT ON: the first row of each key by order."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def capped(rows: DataFrame, group: str, most: int, total: int, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """Greedy selection in order with at most `most` rows of a group and `total` in all: the same as the first `most` of
    each group and then the first `total` of those."""
    by = by or []
    some = rows.withColumn("_g", F.row_number().over(W.partitionBy(*by, group).orderBy(*order))).where(F.col("_g") <= most)
    top = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    return some.withColumn("pick", F.row_number().over(top.orderBy(*order))).where(F.col("pick") <= total).drop("_g")


def walk_forward(rows: DataFrame, date: str, windows: list[tuple[str, str, str, str]]) -> DataFrame:
    """Rows with `window` and `split` for each (label, train_end, test_start, test_end) that they are in; training data
    is all up to train_end. A row is repeated once for each window, without a join."""
    d = F.col(date)
    split = lambda w: F.when(d <= F.lit(w[1]).cast("date"), "train").when((d >= F.lit(w[2]).cast("date")) & (d <= F.lit(w[3]).cast("date")), "test")
    each = F.explode(F.array(*[F.struct(F.lit(w[0]).alias("window"), split(w).alias("split")) for w in windows])).alias("_w")
    return rows.select("*", each).select(*rows.columns, "_w.window", "_w.split").where("split is not null")


def percentile_of(rows: DataFrame, by: list[str], value: str, at: str, least: int = 20) -> DataFrame:
    """Share (in whole percent) of a group's values at or below the group's `at`; null with fewer than `least`."""
    n = F.count(value)
    return rows.groupBy(*by).agg(F.when(n >= least, F.floor(100 * F.count_if(F.col(value) <= F.col(at)) / n + 0.5)).alias("percentile"))


def nearest(rows: DataFrame, by: list[str], pairs: list[tuple[str, str, float]], k: int, tie: str) -> DataFrame:
    """The k rows of each group with the least mean of the relative distances that are known; 999 where none is."""
    gaps = [F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.abs(F.col(a) - F.col(b)) / scale) for a, b, scale in pairs]
    known = sum((g.isNotNull().cast("int") for g in gaps), F.lit(0))
    d = F.when(known > 0, sum((F.coalesce(g, F.lit(0.0)) for g in gaps), F.lit(0.0)) / known).otherwise(999.0)
    far = rows.withColumn("distance", d)
    return far.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy("distance", tie))).where(F.col("rank") <= k)


def hashed_sample(rows: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """n rows in an order drawn by hash: the same rows each time."""
    return rows.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(n)
