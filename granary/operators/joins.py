"""Joins by time, by preference and by containment, planned as equi-joins with residual conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.operators.intervals import ranged


def _timeline(left: DataFrame, right: DataFrame, on: str, left_time: str, right_time: str, value: Column, strict: bool) -> DataFrame:
    """Rows of both sides on one time line for each key: _on, _time, _side (0 right rows that count at their own time, 1 left
    rows, 2 right rows that count after it), _month, _v of right rows and _l of left rows. Right rows without a key or time drop out."""
    r = right.where(F.col(on).isNotNull() & F.col(right_time).isNotNull()).select(F.col(on).alias("_on"), F.col(right_time).alias("_time"), F.lit(2 if strict else 0).alias("_side"), value.alias("_v"))
    l = left.select(F.col(on).alias("_on"), F.col(left_time).alias("_time"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"))  # noqa: E741
    return r.unionByName(l, allowMissingColumns=True).withColumn("_month", F.date_trunc("month", "_time"))


def _within_months(rows: DataFrame, of_months: Column, before: Column, inside: Column) -> DataFrame:
    """Left rows of a time line with _before, over the key's earlier months, and _inside, over the earlier rows of its own. No
    task holds more than one month's rows of a key, however many rows the key has; left rows without a key or time, which
    have neither, are spread by their hash. The rows are read twice: steps that follow each other should start from one table."""
    months = rows.where("_on is not null and _month is not null").groupBy("_on", "_month").agg(of_months.alias("_m"))
    earlier = W.partitionBy("_on").orderBy("_month").rowsBetween(W.unboundedPreceding, -1)
    months = months.select("_on", "_month", before.over(earlier).alias("_before"))
    lost = F.col("_on").isNull() | F.col("_month").isNull()
    own = W.partitionBy("_on", "_month", "_spread").orderBy("_time", "_side", "_v").rowsBetween(W.unboundedPreceding, 0)
    spread = rows.withColumn("_spread", F.when(lost, F.pmod(F.xxhash64("_l"), F.lit(64))).otherwise(0))
    return spread.join(months, ["_on", "_month"], "left").withColumn("_inside", inside.over(own)).where("_side = 1")


def asof(left: DataFrame, right: DataFrame, on: str, left_time: str, right_time: str, values: list[str], tie: str, left_id: str, strict: bool = False, hot: bool = True) -> DataFrame:
    """For each left row the right row of its key that is latest at or before its time (before it if strict), of equal
    times the one with the greatest tie: both sides on one time line, the last right row seen so far. Each row moves once;
    no pair of rows is made. Where no key can have many rows (hot=False), a key's time line is not cut into months."""
    value = F.struct(F.col(right_time).alias("_time"), F.col(tie).alias("_tie"), *[F.col(v).alias(f"_v_{v}") for v in values])
    rows = _timeline(left, right, on, left_time, right_time, value, strict)
    if hot:
        found = _within_months(rows, F.max("_v"), F.last("_m", ignorenulls=True), F.last("_v", ignorenulls=True))
    else:
        whole = W.partitionBy("_on").orderBy("_time", "_side", "_v").rowsBetween(W.unboundedPreceding, 0)
        found = rows.withColumn("_inside", F.last("_v", ignorenulls=True).over(whole)).where("_side = 1").withColumn("_before", F.lit(None))
    best = F.coalesce("_inside", "_before").alias("_b")
    return found.select("_l", best).select("_l.*", F.col("_b._time").alias(right_time), *[F.col(f"_b._v_{v}").alias(v) for v in values])


def latest(right: DataFrame, on: str, order: list[Column], values: list[str]) -> DataFrame:
    """The first row of each key by order: join it on the key."""
    w = W.partitionBy(on).orderBy(*order)
    return right.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(on, *values)


def prior_sum(left: DataFrame, right: DataFrame, on: str, left_id: str, left_time: str, right_time: str, value: str, name: str) -> DataFrame:
    """Adds the sum of the right values of the same key before each left row's time: running sums, of months and then in one."""
    rows = _timeline(left, right, on, left_time, right_time, F.col(value), True)
    found = _within_months(rows, F.sum("_v"), F.sum("_m"), F.sum("_v"))
    total = F.coalesce(F.col("_before") + F.col("_inside"), "_before", "_inside")
    return found.select("_l", total.alias("_total")).select("_l.*", F.col("_total").alias(name))


def within(left: DataFrame, right: DataFrame, on: str, low: Column, high: Column, time: str, name: str, left_id: str) -> DataFrame:
    """Flags left rows that have a right row of their key with low < time <= high, in days."""
    met = ranged(left, right, on, F.date_add(low, 1), high, time, left_id).select(left_id, F.lit(True).alias(name))
    return left.join(met, left_id, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def preferred(left: DataFrame, left_id: str, ways: list[tuple[DataFrame, Column, Column]], order: list[str], values: list[str]) -> DataFrame:
    """One of several joins for each left row: ways are (right, left key, right key) from the most to the least preferred, each an
    equi-join of its own instead of a disjunction; inside a way the first right row by order, ascending. Of the right rows of a key only that
    one is joined, so a key that many rows of both sides have makes no pairs."""
    best = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"_v_{c}") for c in values])
    parts = None
    for rank, (right, own, other) in enumerate(ways):
        firsts = right.groupBy(other.alias("_key")).agg(F.min(best).alias("_b")).where("_key is not null")
        part = left.select(F.col(left_id).alias("_id"), own.alias("_key")).join(firsts, "_key").select("_id", F.struct(F.lit(rank).alias("pref"), "_b").alias("_p"))
        parts = part if parts is None else parts.unionByName(part)
    met = parts.groupBy("_id").agg(F.min("_p").alias("_p")).select(F.col("_id").alias(left_id), *[F.col(f"_p._b._v_{c}").alias(c) for c in values], F.col("_p.pref").alias("pref"))
    return left.join(met, left_id, "left")


def side_by_side(tables: list[DataFrame], key: str) -> DataFrame:
    """Tables with at most one row for each key and columns of different names as one, with nulls where a table lacks the key: a union that
    is summed up by key, so a task holds one table of groups, where a chain of joins sorts both sides of each join at once."""
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t, allowMissingColumns=True)
    return every.groupBy(key).agg(*[F.first(c, ignorenulls=True).alias(c) for c in every.columns if c != key])
