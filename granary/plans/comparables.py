"""Comparable cohorts, valuation confidence and scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Cohorts from narrow to wide, by the columns they share.
LEVELS = (("sector", "country"), ("sector",), ("country",), ("stage",), ())
#: Weights of source tiers; least outcomes, prices and weighted coverage of a confidence.
TIER_WEIGHT = {"A": 1.0, "B": 0.7, "C": 0.35}
CONFIDENCE = (("high", 200, 400, 0.75), ("medium", 50, 120, 0.55))


def cohort_levels(targets: DataFrame, pool: DataFrame, target_id: str, least: int = 20) -> DataFrame:
    """For each target the narrowest cohort with at least `least` deals: level (from 1), n and failure rate. Cohorts are
    counted once for each value of their columns, targets look their counts up."""
    found = None
    for i, cols in enumerate(LEVELS, 1):
        sums = pool.groupBy(*cols).agg(F.count("*").alias("n"), F.avg("failed").alias("failure_rate"))
        sums = sums.where(F.col("n") >= least).withColumn("level", F.lit(i))
        part = targets.join(sums, list(cols)) if cols else targets.join(F.broadcast(sums))
        part = part.select(target_id, "level", "n", "failure_rate")
        found = part if found is None else found.unionByName(part)
    return found.withColumn("_r", F.row_number().over(W.partitionBy(target_id).orderBy("level"))).where("_r = 1").drop("_r")


#: Rows that a cohort has at least, of outcomes or of prices.
LEAST = 20


def lattice(rows: DataFrame, measures: list[Column]) -> DataFrame:
    """Measures of every cohort in one pass of grouping sets: by sector, country and stage in any mixture that a target can ask for. _g says
    which of the three are left open (4 sector, 2 country, 1 stage)."""
    a, b, c = F.col("sector"), F.col("country"), F.col("stage")
    sets = [[a, b, c], [a, b], [a, c], [a], [b, c], [b], [c], []]
    return rows.groupingSets(sets, a, b, c).agg(*measures, F.grouping_id().alias("_g"))


def attempts() -> Column:
    """The cohorts that a target asks for, from narrow to wide: (level, _g, sector, country, stage), those of a column that it lacks left
    out. A stage, where there is one, is asked for on all levels but the last."""
    none, stage = F.lit(None).cast("string"), F.col("stage")
    open_stage = stage.isNull().cast("int")
    one = lambda level, g, s, c, st: F.struct(F.lit(level).alias("level"), g.cast("int").alias("_g"), s.alias("sector"), c.alias("country"), st.alias("stage"))
    made = [
        F.when(F.col("sector").isNotNull() & F.col("country").isNotNull(), one(1, open_stage, F.col("sector"), F.col("country"), stage)),
        F.when(F.col("sector").isNotNull(), one(2, 2 + open_stage, F.col("sector"), none, stage)),
        F.when(F.col("country").isNotNull(), one(3, 4 + open_stage, none, F.col("country"), stage)),
        F.when(stage.isNotNull(), one(4, F.lit(6), none, none, stage)),
        one(5, F.lit(7), none, none, none),
    ]
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def comparables(targets: DataFrame, outcomes: DataFrame, prices: DataFrame, target_id: str, least: int = LEAST, exact: bool = True) -> DataFrame:
    """For each target (sector, country, stage, each may be null) the narrowest cohort with `least` outcomes or `least` prices, and its figures.

    outcomes have failed and amount, prices have price, revenue, amount, tier and weight. Both are summed up for all cohorts in one
    pass each; a target only looks up its five. Medians are exact, in memory that grows with a cohort's distinct values; with
    exact=False they come from mergeable sketches."""
    middle = (lambda c: F.median(c)) if exact else (lambda c: F.percentile_approx(c, 0.5, F.lit(10_000)))
    ratio = lambda a, b: F.when((F.col(a) > 0) & (F.col(b) > 0), F.col(a) / F.col(b))
    by_outcome = lattice(outcomes, [F.count("*").alias("outcome_n"), F.avg("failed").alias("failure_rate"), middle(F.when(F.col("amount") > 0, F.col("amount"))).alias("median_raised")])
    tier = [F.count_if(F.col("tier") == x).alias(f"tier_{x.lower()}") for x in "ABC"]
    multiples = [f for name, c in (("revenue", ratio("price", "revenue")), ("proxy", ratio("price", "amount"))) for f in (F.count(c).alias(f"{name}_n"), middle(c).alias(f"{name}_multiple"))]
    by_price = lattice(prices, [F.count("*").alias("price_n"), (F.sum(F.round(F.col("weight") * 100).cast("long")) / F.count("*") / 100).alias("coverage"), *tier, *multiples])
    asked = targets.select(target_id, F.explode(attempts()).alias("_a")).select(target_id, "_a.*")
    keys = ["_g", "sector", "country", "stage"]

    def looked(left: DataFrame, right: DataFrame) -> DataFrame:
        r = right.select(*[F.col(k).alias(f"_r{k}") for k in keys], *[c for c in right.columns if c not in keys])
        same = F.col("_g") == F.col("_r_g")
        for k in keys[1:]:
            same = same & F.col(k).eqNullSafe(F.col(f"_r{k}"))
        return left.join(r, same, "left").drop(*[f"_r{k}" for k in keys])

    both = looked(looked(asked, by_outcome), by_price).fillna(0, ["outcome_n", "price_n", "tier_a", "tier_b", "tier_c", "revenue_n", "proxy_n"]).fillna(0.0, ["coverage"])
    figures = ["outcome_n", "failure_rate", "median_raised", "price_n", "coverage", "tier_a", "tier_b", "tier_c", "revenue_n", "revenue_multiple", "proxy_n", "proxy_multiple"]
    enough = (F.col("outcome_n") >= least) | (F.col("price_n") >= least)
    # beside the cohort itself: prices that share all that the target names, and those of its stage
    chosen = F.min(F.when(enough, F.struct("level", *figures))).alias("_b")
    best = both.groupBy(target_id).agg(chosen, F.min_by("price_n", "level").alias("matched_n"), F.max(F.when(F.col("level") == 4, F.col("price_n"))).alias("_stage_n")).where("_b is not null")
    best = best.select(target_id, "_b.*", "matched_n", "_stage_n")
    best = best.withColumn("aligned_n", F.when(F.col("level") < 5, F.col("price_n")).otherwise(F.coalesce("_stage_n", "price_n"))).drop("_stage_n")
    basis = F.when((F.col("revenue_n") > 0), "revenue_multiple").when(F.col("proxy_n") > 0, "raise_proxy_multiple")
    return best.withColumns({"basis": basis, "confidence": source_confidence(F.col("outcome_n"), F.col("price_n"), F.col("coverage"))})


#: Least sizes of revenue and proxy cohorts for each confidence, rows below which a sample is limited, least coverage and share of
#: the best tier, most share of proxies, and official signals below which these are sparse.
LARGE, MODERATE, PROXIES, LIMITED, COVERED, BEST_TIER, PROXY_SHARE, OFFICIAL = 250, 60, 120, 80, 0.60, 0.30, 0.55, 20


def valued(found: DataFrame, official: Column) -> DataFrame:
    """comparables() with valuation (low, medium, high) and penalty, the points that weak evidence costs; official counts the signals of
    registries. A cohort without any multiple has low confidence and is charged for sparse signals alone."""
    c = F.col
    by_revenue, some = c("revenue_n") > 0, (c("revenue_n") > 0) | (c("proxy_n") > 0)
    tier = F.when(c("tier_a") > 0, "A").otherwise("B")
    start = F.when(by_revenue & (c("revenue_n") >= LARGE) & (c("matched_n") >= LIMITED) & (c("confidence") != "low") & tier.isin("A", "B"), "high").when((by_revenue & (c("revenue_n") >= MODERATE)) | (~by_revenue & (c("proxy_n") >= PROXIES)), "medium").otherwise("low")
    total = c("tier_a") + c("tier_b") + c("tier_c")
    share = lambda a, b: F.when(b > 0, a / b)
    few = lambda n: (n > 0) & (n < LIMITED)
    faults = [
        (c("coverage") < COVERED, 1),
        (F.coalesce(share(c("tier_a"), total), F.lit(0.0)) < BEST_TIER, 1),
        (~by_revenue | (F.coalesce(share(c("proxy_n"), c("revenue_n") + c("proxy_n")), F.lit(1.0)) > PROXY_SHARE), 1),
        (few(c("aligned_n")), 1),
        (few(c("matched_n")), 2),
    ]
    sparse = F.coalesce(official, F.lit(0)) < OFFICIAL
    points = sum((F.when(f, n).otherwise(0) for f, n in faults), F.lit(0))
    value = downgraded(F.when(some, start).otherwise("low"), *[some & f for f, _ in faults], sparse)
    return found.withColumns({"valuation": value, "penalty": (F.when(some, points).otherwise(0) + sparse.cast("int")).cast("int")})


def first_of_sources(parts: list[DataFrame], key: str) -> DataFrame:
    """Rows of several sources, the first source that has a key wins."""
    both = None
    for i, p in enumerate(parts):
        own = p.withColumn("_source", F.lit(i))
        both = own if both is None else both.unionByName(own)
    return both.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy("_source"))).where("_r = 1").drop("_r", "_source")


#: Sources of companies by tier; all others are of tier C.
TIER_SOURCES = {"A": ("sec_edgar", "sec_dera_cf", "companies_house", "sec_cf_filings", "transaction_rounds_truth"), "B": ("sec_form_d", "manual", "academic")}


def company_tier(source: Column) -> Column:
    low = F.lower(F.coalesce(source, F.lit("unknown")))
    return F.when(low.isin(*TIER_SOURCES["A"]), "A").when(low.isin(*TIER_SOURCES["B"]), "B").otherwise("C")


def stage_bucket(stage: Column) -> Column:
    low = F.lower(stage)
    series = low.contains("series") & (low.contains("a") | low.contains("b"))
    return F.when(low.contains("seed"), "seed").when(low.contains("early") | series, "early_growth")


def latest_revenues(campaigns: DataFrame, filings: DataFrame) -> DataFrame:
    """(company_id, revenue): of the latest campaign with a good label and revenue, else of the latest annual filing."""
    first = lambda rows, order: rows.where("revenue > 0").groupBy("company_id").agg(F.max_by("revenue", F.struct(*order)).alias("revenue"))
    by_campaign = first(campaigns.where("label_tier <= 2"), ["date", "id"]).withColumnRenamed("revenue", "_campaign")
    by_filing = first(filings, ["date", "id"]).withColumnRenamed("revenue", "_filing")
    return by_campaign.join(by_filing, "company_id", "full_outer").select("company_id", F.coalesce("_campaign", "_filing").alias("revenue"))


def pricing_cohort(transactions: DataFrame, outcomes: DataFrame, features: DataFrame, rounds: DataFrame, revenues: DataFrame) -> DataFrame:
    """Prices of four sources as (key, sector, country, stage, price, revenue, amount, source, tier, weight); of rows with a
    key the first source's stays. A cap stands in for a missing price, which makes tier C where nothing vouches for it; failed
    gates, low confidence and weak labels lower a tier."""
    pre, cap, tier = F.col("pre_money"), F.col("cap"), F.col("tier")
    price = F.when(pre > 0, pre).otherwise(cap)
    proxy = (F.coalesce(pre, F.lit(0.0)) == 0) & (cap > 0)
    as_is, low = F.col("tier"), F.lit("C")

    def rows(df: DataFrame, key: Column, value: Column, source: Column, level: Column, stage: str = "stage") -> DataFrame:
        return df.where(value > 0).select(key.alias("key"), "sector", "country", stage_bucket(F.col(stage)).alias("stage"), value.alias("price"), "revenue", "amount", source.alias("source"), level.alias("tier"))

    key = lambda prefix, *more: F.concat(F.lit(f"{prefix}:"), F.col("id").cast("string"), *more)
    gate, band = F.coalesce("gate_pass", F.lit(False)), F.coalesce("band", F.lit("low"))
    tx = F.when(~gate | (band == "low"), low).when((band == "medium") & (tier == "A"), "B").otherwise(F.coalesce(as_is, low))
    own = company_tier(F.col("company_source"))
    label = F.coalesce("label_tier", F.lit(3))
    labelled = F.when(label >= 3, low).when((label == 2) & (own == "A"), "B").otherwise(own)
    name = F.coalesce("source", F.lower(F.coalesce("company_source", F.lit("unknown"))))
    suffix = lambda c: F.when(c, ":valuation_cap_proxy").otherwise("")
    parts = [
        rows(transactions, key("tx"), price, F.when(gate, "transaction_rounds_truth").otherwise("transaction_rounds_truth:gate_failed"), tx),
        rows(outcomes.where(F.col("label_tier") <= 3), key("co"), pre, F.concat(F.lit("crowdfunding_outcomes:"), F.coalesce("company_source", F.lit("unknown"))), labelled),
        rows(features, key("tfw", F.when(proxy, ":cap").otherwise(":pre")), price, F.concat(F.lit("training_features"), suffix(proxy)), F.when(proxy, low).otherwise("B")),
        rows(rounds.join(revenues, "company_id", "left"), key("round"), price, F.concat(F.lit("funding_rounds:"), name, suffix(proxy)), F.when(proxy, low).otherwise(own), "round_type"),
    ]
    weight = F.lit(None).cast("double")
    for t, w in TIER_WEIGHT.items():
        weight = F.when(F.col("tier") == t, w).otherwise(weight)
    return first_of_sources(parts, "key").withColumn("weight", weight)


def source_confidence(outcomes: Column, prices: Column, coverage: Column) -> Column:
    out = F.lit("low")
    for name, a, b, c in reversed(CONFIDENCE):
        out = F.when((outcomes >= a) & (prices >= b) & (coverage >= c), name).otherwise(out)
    return out


def downgraded(start: Column, *penalties: Column) -> Column:
    """A confidence lowered one step for each penalty that holds."""
    rank = F.when(start == "high", 2).when(start == "medium", 1).otherwise(0)
    for p in penalties:
        rank = rank - F.coalesce(p, F.lit(False)).cast("int")
    return F.when(rank >= 2, "high").when(rank == 1, "medium").otherwise("low")


def scenario(pre_money: Column, revenue: Column, stage: Column, confidence: Column, median: Column, signal: Column) -> dict[str, Column]:
    """Entry multiple, retention and multiples on money of a bear, base and bull exit; null without both figures."""
    entry = F.when((pre_money > 0) & (revenue > 0), pre_money / revenue)
    st = F.lower(F.coalesce(stage, F.lit("")))
    kept = F.when(st.contains("seed"), 0.35).when(st.contains("early"), 0.55).otherwise(0.45)
    kept = F.greatest(F.lit(0.2), kept - F.when(confidence == "high", 0.0).when(confidence == "medium", 0.03).otherwise(0.06))
    exit_ = F.when(median > 0, median).otherwise(8.0) * F.when(signal == "aggressive", 0.75).when(signal == "attractive", 1.15).otherwise(1.0)
    out = {"entry_multiple": entry, "retention": F.when(entry.isNotNull(), kept)}
    for name, factor, floor in (("bear", 0.6, 1.0), ("base", 1.1, 1.5), ("bull", 2.2, 3.0)):
        out[f"{name}_moic"] = F.when(entry.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(25.0), F.greatest(F.lit(floor), exit_ * factor) / entry * kept)))
    return out


def realised(outcome: Column, multiple: Column) -> Column:
    return F.coalesce(multiple, F.when(outcome == "failed", 0.0).when(outcome == "trading", 1.0).when(outcome == "exited", 3.0))
