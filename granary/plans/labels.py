"""Outcome labels and their tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.intervals import ranged
from granary.operators.joins import asof

#: Forms that end an offering, annual reports, progress updates.
ENDED, ANNUAL, PROGRESS = ("C-TR", "C-TR-W", "C-W", "C-U-W", "C/A-W"), ("C-AR", "C-AR/A"), ("C-U",)


def uk_label(status: Column, overdue: Column, last_accounts: Column) -> dict[str, Column]:
    low = F.lower(status)
    ended = low.isin("dissolved", "liquidation", "administration", "converted-closed")
    late = F.coalesce(overdue, F.lit(False))
    return {
        "tier": F.when(ended, 1).when((low == "active") & last_accounts.isNotNull() & ~late, 1).when(low == "active", 2).otherwise(3),
        "outcome": F.when(ended, "failed").when(low == "active", "trading").otherwise("unknown"),
        "detail": F.when(ended, F.replace(low, F.lit("-"), F.lit("_"))).when((low == "active") & late, "active_distress_signals").otherwise(F.coalesce(low, F.lit("no_match"))),
    }


def us_label(status: Column, news: Column, verified: Column, seen: Column) -> dict[str, Column]:
    return {
        "tier": F.when(status.isNull(), 3).when(verified, 1).when((status != "") | seen, 2).otherwise(3),
        "outcome": F.when(news == "shutdown", "failed").when(news.isin("acquired", "ipo"), "exited").when((news == "operating") | (status != ""), "trading").otherwise("unknown"),
    }


def rebuilt(outcomes: DataFrame, companies: DataFrame) -> DataFrame:
    """outcomes (company_id, outcome, detail, tier) with labels set anew from companies (company_id, source, status): the registry's by the
    status, American failures as tier 1 and trading ones as tier 2 at most, unknown ones as tier 3. One join and one projection
    instead of four updates."""
    told = outcomes.join(companies.select("company_id", F.col("source").alias("_source"), F.coalesce("status", F.lit("unknown")).alias("_status")), "company_id", "left")
    uk, us = F.col("_source") == "companies_house", F.col("_source").isin("sec_dera_cf", "sec_edgar")
    label = uk_label(F.col("_status"), F.lit(False), F.lit(None).cast("date"))
    outcome = F.when(uk, label["outcome"]).otherwise(F.col("outcome"))
    first = F.when(uk & (label["outcome"] == "unknown"), 3).when(uk & label["outcome"].isin("failed", "trading"), 1).when(uk, 2)
    second = F.when(us & (outcome == "failed"), 1).when(us & (outcome == "trading") & (F.col("tier") > 2), 2)
    tier = F.when(outcome == "unknown", 3).otherwise(F.coalesce(first, second, F.col("tier")))
    return told.select("company_id", outcome.alias("outcome"), F.when(uk, label["detail"]).otherwise(F.col("detail")).alias("detail"), tier.alias("tier"))


def from_filings(companies: DataFrame, filings: DataFrame, today: str) -> DataFrame:
    """Outcome, detail and tier of companies of unknown outcome, by the first rule that holds: an ending form, an annual
    report of the last 540 days, a progress update of the last 360, filings over more than two years. One aggregation
    of the filings gives all four."""
    day = F.lit(today).cast("date")
    d, form = F.col("filing_date"), F.col("form_type")
    seen = filings.groupBy("cik").agg(
        F.bool_or(form.isin(*ENDED)).alias("_ended"),
        F.bool_or(form.isin(*ANNUAL) & (d >= F.date_sub(day, 540))).alias("_annual"),
        F.bool_or(form.isin(*PROGRESS) & (d >= F.date_sub(day, 360))).alias("_progress"),
        (F.datediff(F.max(d), F.min(d)) > 730).alias("_long"),
    )
    rules = [("_ended", "failed", "terminated_or_withdrawn", 2), ("_annual", "trading", "annual_report_filed", 2), ("_progress", "trading", "progress_update_filed", 2), ("_long", "trading", "sustained_filing_activity", 3)]
    open_ = F.col("outcome") == "unknown"

    def first(i: int, default: Column) -> Column:
        out = default
        for rule in reversed(rules):
            out = F.when(open_ & F.coalesce(F.col(rule[0]), F.lit(False)), rule[i]).otherwise(out)
        return out

    joined = companies.join(seen, "cik", "left")
    return joined.select("company_id", first(1, F.col("outcome")).alias("outcome"), first(2, F.lit(None).cast("string")).alias("detail"), first(3, F.lit(None).cast("int")).alias("tier"))


def progress(rounds: DataFrame, filings: DataFrame, cutoff: str, mature_months: int = 18) -> DataFrame:
    """Rounds old enough at the cutoff, with whether a filing 6 to 24 months later shows at least twice the revenue of
    the last filing up to the round."""
    end = F.lit(cutoff).cast("date")
    own = rounds.where(F.add_months("round_date", mature_months) <= end).select("round_id", "company_id", "round_date")
    before = asof(own, filings.select("company_id", "filing_date", F.col("revenue").alias("before")), "company_id", "round_date", "filing_date", ["before"], "before", "round_id")
    since, until = F.date_add(F.add_months("round_date", 6), 1), F.least(F.add_months("round_date", 24), end)
    after = ranged(own, filings, "company_id", since, until, "filing_date", "round_id", "revenue")
    found = before.select("round_id", "before").join(after.select("round_id", "most"), "round_id", "left")
    return found.select("round_id", F.coalesce(F.col("most") >= 2 * F.col("before"), F.lit(False)).alias("progress"))
