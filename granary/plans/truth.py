"""Reconciliation of facts of several sources to one value for each field, and the gates that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.parsing import tier_of, tier_rank

#: Confidence of the winner's tier, bonus for each further fact and its limit, loss by conflict.
BASE, BONUS, MOST, LOSS = {"A": 0.92, "B": 0.78, "C": 0.58}, 0.02, 0.08, {"major": 0.35, "minor": 0.15, "none": 0.0}
#: Completeness that each tier needs.
NEEDED = {"A": 0.60, "B": 0.70, "C": 0.85}


def _from(table: dict, key: Column) -> Column:
    out = F.lit(None)
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def differs(a: Column, b: Column) -> Column:
    """Whether two numbers are more than five percent apart (of at least one)."""
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0)) > 0.05


def reconcile(facts: DataFrame, keys: list[str], value: str, source: str, time: str, tie: str) -> DataFrame:
    """For each key the value of the best tier, then the latest; the conflict state of the first fact that differs from
    it, latest first; how many facts there are, their sources, and a confidence."""
    f = facts.where(F.col(value).isNotNull()).withColumn("tier", tier_of(F.col(source)))
    w = W.partitionBy(*keys)
    best = w.orderBy(F.desc(tier_rank(F.col("tier"))), F.desc_nulls_last(time), F.asc(tie))
    won = f.withColumns({"_won": F.first(F.struct(F.col(value).alias("v"), F.col("tier").alias("t"), F.col(time).alias("d"))).over(best.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    odd = differs(F.col(value), F.col("_won.v"))
    first_odd = F.min_by(F.when(odd, F.col("tier")), F.when(odd, F.struct((-F.unix_date(time)).alias("a"), F.col(tie).alias("b"))))
    sums = won.groupBy(*keys).agg(F.first("_won").alias("_w"), first_odd.alias("_odd"), F.count("*").alias("n_facts"), F.array_sort(F.collect_set(source)).alias("sources"))
    state = F.when(F.col("_odd").isNull(), "none").when(tier_rank(F.col("_odd")) >= 2, "major").otherwise("minor")
    out = sums.withColumn("conflict", state)
    sure = _from(BASE, F.col("_w.t")) + F.least(F.lit(MOST), BONUS * (F.col("n_facts") - 1)) - _from(LOSS, F.col("conflict"))
    return out.select(*keys, F.col("_w.v").alias("value"), F.col("_w.t").alias("tier"), F.col("_w.d").alias("as_of"), "conflict", "n_facts", F.concat_ws(",", "sources").alias("sources"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)).alias("confidence"))


#: Fields that every round needs, and those that loans which convert and shares need besides.
ALWAYS, IF_CONVERTIBLE, IF_SHARES = ("round_type", "instrument_type", "amount_raised"), ("valuation_cap", "discount_rate"), ("pre_money_valuation", "post_money_valuation")
#: Parts of an instrument's or round's name that say that it converts.
CONVERTIBLE = ("safe", "note", "convertible", "debt")


def needed_fields(instrument: Column, round_type: Column) -> Column:
    """The fields that a round of an instrument must have to be complete."""
    named = F.lower(F.concat_ws("\n", instrument, round_type))
    of = lambda fields: F.array(*map(F.lit, ALWAYS + fields))
    return F.when(named.rlike("|".join(CONVERTIBLE)), of(IF_CONVERTIBLE)).otherwise(of(IF_SHARES))


def roll_up(truths: DataFrame, key: str, field: str, needed: list[str] | Column) -> DataFrame:
    """One row for each round: completeness over the needed fields (a list, or a column that is the same for all rows of a
    round, such as needed_fields), mean confidence, conflicts, best tier and a band."""
    needed = needed if isinstance(needed, Column) else F.array(*map(F.lit, needed))
    sums = truths.withColumn("_needed", needed).groupBy(key).agg(
        (F.count_if(F.array_contains("_needed", F.col(field))) / F.max(F.size("_needed"))).alias("completeness"),
        F.avg("confidence").alias("confidence"),
        F.count_if(F.col("conflict") != "none").alias("conflicts"),
        F.min("tier").alias("tier"),
        F.max("as_of").alias("as_of"),
    )
    c, k, done = F.col("confidence"), F.col("conflicts"), F.col("completeness")
    return sums.withColumn("band", F.when((c >= 0.8) & (k == 0) & (done >= 0.85), "high").when((c >= 0.65) & (k <= 1) & (done >= 0.6), "medium").otherwise("low"))


def gate(rounds: DataFrame) -> DataFrame:
    """Adds passed and reason to rolled-up rounds."""
    need = _from(NEEDED, F.col("tier"))
    reasons = F.concat_ws(
        ",",
        F.when(F.col("completeness") < need, F.concat(F.lit("core_term_completeness<"), F.format_string("%.2f", need))),
        F.when(F.col("conflicts") > 0, "valuation_conflicts>0"),
        F.when(F.col("tier") == "C", "source_tier_c"),
        F.when(F.col("band") == "low", "low_confidence"),
    )
    return rounds.withColumn("reason", F.nullif(reasons, F.lit(""))).withColumn("passed", F.col("reason").isNull())


def money(amount: Column, pre: Column, equity: Column) -> dict[str, Column]:
    """Pre- and post-money: from the pre-money and the equity share, else from the amount and the share."""
    share = (equity > 0) & (equity < 1)
    post = F.when(pre.isNotNull() & share, pre / (1 - equity)).when(pre.isNotNull(), pre + amount).when(equity > 0, F.try_divide(amount, equity))
    return {"pre": F.coalesce(pre, F.greatest(F.lit(0.0), post - amount)), "post": post}


def adviser(assets: Column, registered: Column) -> dict[str, Column]:
    #: Assets of a first-tier adviser and the tiers' scores.
    tier = F.when(registered & (assets >= 1e9), "A").when(registered, "B").otherwise("C")
    return {"tier": tier, "quality": F.when(tier == "A", 1.0).when(tier == "B", 0.75).otherwise(0.45)}
