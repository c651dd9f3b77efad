"""Mutations of keyed tables as functions from the old table and the incoming rows to the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_last(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key by order."""
    last = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(last)).where("_rank = 1").drop("_rank")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows replace those of the same key: one shuffle of both on the key."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return keep_last(both, keys, F.desc("_new")).drop("_new")


def merge(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """Column by column: `fill` takes the incoming value if there is one, `greatest` and `least` compare, `new` and `old`
    take a side where it has the key. Both tables have each key once."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    pick = {
        "fill": lambda a, b: F.coalesce(b, a),
        "greatest": lambda a, b: F.greatest(a, b),
        "least": lambda a, b: F.least(a, b),
        "new": lambda a, b: F.coalesce(b, a),
        "old": lambda a, b: F.coalesce(a, b),
    }
    cols = [F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")).alias(k) for k in keys]
    return joined.select(*cols, *[pick[r](F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) for c, r in rules.items()])


def merged_maps(old: Column, new: Column) -> Column:
    """Entries of both; the incoming value of a key wins."""
    a, b = F.coalesce(old, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), F.coalesce(new, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old, keys, "left_anti"))


def update_from(old: DataFrame, found: DataFrame, keys: list[str], changes: dict[str, Column], where: Column | None = None) -> DataFrame:
    """Sets columns of rows that `found` has the key of (and `where` holds for); found has each key once."""
    joined = old.join(found.withColumn("_found", F.lit(True)), keys, "left")
    hit = F.col("_found").isNotNull() & (F.lit(True) if where is None else where)
    return joined.select(*[F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in old.columns])


def redact(rows: DataFrame, columns: list[str], note: str, text: str, when: Column) -> DataFrame:
    """Nulls columns of the rows that `when` holds for and adds a note to one of them."""
    noted = F.concat_ws(" ", F.col(note), F.lit(text))
    return rows.withColumns({**{c: F.when(~when, F.col(c)) for c in columns}, note: F.when(when, noted).otherwise(F.col(note))})
