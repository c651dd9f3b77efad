"""Joins of short texts to longer ones that contain them, over an inverted index of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a gram; texts of fewer letters are looked up by all of theirs.
GRAM = 3
#: Texts of a gram that one part of the index holds: more are several parts, so no frequent gram is one task.
PART = 20_000


def grams(text: Column, size: int) -> Column:
    """The distinct runs of so many characters."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (size - 1), F.lit(1)))
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def containing(needles: DataFrame, texts: DataFrame, needle: str, text: str, best: list[Column], part: int = PART) -> DataFrame:
    """(needle, best): for each distinct needle the least struct of `best` over the rows whose text contains it.

    Of equal texts only the best row is indexed, under each of its grams. A needle is looked up under its rarest gram alone,
    and not at all if one of its grams is nowhere; contains() decides. A gram that many texts have is spread over parts, to which its
    needles are copied. Empty and null needles and texts never match."""
    size = lambda x: F.least(F.length(x), F.lit(GRAM))
    held = texts.where(F.length(text) > 0).groupBy(F.col(text).alias("_text")).agg(F.min(F.struct(*best)).alias("_best"))
    # short needles are rare grams of one or two characters, so the index has these as well
    every = F.concat(*[grams(F.col("_text"), k) for k in range(1, GRAM + 1)])
    index = held.select("_text", "_best", F.explode(every).alias("_gram"))
    counts = index.groupBy("_gram").agg(F.count("*").alias("_n"))
    asked = needles.where(F.length(needle) > 0).select(F.col(needle).alias("_needle")).distinct()
    own = F.when(size("_needle") == GRAM, grams(F.col("_needle"), GRAM)).otherwise(F.array("_needle"))
    known = asked.select("_needle", F.explode(own).alias("_gram")).join(counts, "_gram", "left")
    rarest = known.groupBy("_needle").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("_r")).where("_r.n > 0")
    many = F.ceil(F.col("_r.n") / part).cast("long")
    looked = rarest.select("_needle", F.col("_r.gram").alias("_gram"), many.alias("_parts"), F.explode(F.sequence(F.lit(0).cast("long"), many - 1)).alias("_part"))
    # the index keeps the grams that a needle is looked up under, each row in the part that its text's hash says
    wanted = looked.select("_gram", "_parts").distinct()
    dealt = index.join(wanted, "_gram").withColumn("_part", F.pmod(F.xxhash64("_text"), F.col("_parts"))).drop("_parts")
    hits = looked.drop("_parts").join(dealt, ["_gram", "_part"]).where(F.contains("_text", "_needle"))
    return hits.groupBy("_needle").agg(F.min("_best").alias("_best"))


def by_name(left: DataFrame, right: DataFrame, left_id: str, left_name: Column, right_name: Column, values: list[str], exact: list[Column], near: list[Column]) -> DataFrame:
    """left with the values of the right row of the same name, the first by `exact`; where there is none, of the first by
    `near` whose name contains the left one. how says which it was; empty names match nothing. `exact` and `near` are aliased
    columns of right that order its rows; the ids at their end make them unique."""
    l = left.withColumn("_name", F.nullif(left_name, F.lit("")))  # noqa: E741
    r = right.withColumn("_full", F.nullif(right_name, F.lit(""))).where("_full is not null")
    taken = F.struct(*[F.col(v).alias(v) for v in values]).alias("_values")
    same = r.groupBy(F.col("_full").alias("_name")).agg(F.min(F.struct(F.struct(*exact).alias("_order"), taken)).alias("_same"))
    met = l.join(same, "_name", "left")
    rest = met.where(F.col("_same").isNull() & F.col("_name").isNotNull()).select("_name")
    found = containing(rest, r, "_name", "_full", [F.struct(*near).alias("_order"), taken]).select(F.col("_needle").alias("_name"), F.col("_best").alias("_near"))
    out = met.join(found, "_name", "left")
    how = F.when(F.col("_same").isNotNull(), "exact").when(F.col("_near").isNotNull(), "contains")
    pick = lambda v: F.when(F.col("_same").isNotNull(), F.col(f"_same._values.{v}")).otherwise(F.col(f"_near._values.{v}")).alias(v)
    return out.select(*left.columns, *[pick(v) for v in values], how.alias("how"))
