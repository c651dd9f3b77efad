"""Reads of date intervals of a key without pairs of rows: sums and maxima over dyadic blocks of days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of blocks: one of level k is 2^k days. Longer intervals take several blocks of the last level, some ninety years.
LEVELS = 15


def day(date: Column) -> Column:
    return F.datediff(date, F.lit("1970-01-01").cast("date"))


def _down(x: Column, k: Column) -> Column:
    return F.call_function("shiftright", x, k)


def _levels() -> Column:
    return F.sequence(F.lit(0), F.lit(LEVELS))


def blocks_of(d: Column) -> Column:
    """The block (k, b) of each level that a day is in."""
    return F.transform(_levels(), lambda k: F.struct(k.alias("k"), _down(d, k).alias("b")))


def cover(low: Column, high: Column) -> Column:
    """The few blocks that make up the days from low to high: of each level at most one at either end, of the last one all between."""
    first, end = low, high + 1

    def of_level(k: Column) -> Column:
        a, b = -_down(-first, k), _down(end, k)
        odd = lambda x: F.pmod(x, F.lit(2)) == 1
        ends = F.array(F.when((a < b) & odd(a), a), F.when((a < b) & odd(b), b - 1))
        whole = F.when(a < b, F.sequence(a, F.greatest(b - 1, a))).otherwise(F.array().cast("array<int>"))
        return F.transform(F.when(k < LEVELS, ends).otherwise(whole), lambda x: F.when(x.isNotNull(), F.struct(k.alias("k"), x.alias("b"))))

    return F.filter(F.flatten(F.transform(_levels(), of_level)), lambda x: x.isNotNull())


def ranged(left: DataFrame, right: DataFrame, on: str, low: Column, high: Column, time: str, left_id: str, value: str | None = None) -> DataFrame:
    """(left_id, n, most): for each left row with right rows of its key from the day low to the day high, how many they are and the
    greatest value. Right rows are added up by day, then in each level's blocks, so a left row meets some twenty sums at most,
    however many rows its key has; keys and blocks together deal them to tasks. Rows with nulls meet nothing."""
    v = F.col(value) if value else F.lit(None).cast("double")
    days = right.where(F.col(on).isNotNull() & F.col(time).isNotNull()).groupBy(F.col(on).alias("_on"), day(F.col(time)).alias("_day")).agg(F.count("*").alias("_n"), F.max(v).alias("_v"))
    sums = days.select("_on", "_n", "_v", F.explode(blocks_of(F.col("_day"))).alias("_at")).groupBy("_on", "_at.k", "_at.b").agg(F.sum("_n").alias("_n"), F.max("_v").alias("_v"))
    asked = left.where(F.col(on).isNotNull()).select(F.col(left_id).alias("_id"), F.col(on).alias("_on"), F.explode(cover(day(low), day(high))).alias("_at")).select("_id", "_on", "_at.*")
    return asked.join(sums, ["_on", "k", "b"]).groupBy(F.col("_id").alias(left_id)).agg(F.sum("_n").alias("n"), F.max("_v").alias("most"))
