"""As-of feature store: facts (entity, date, feature, value) with a registry, point-in-time reads and wide matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.parsing import age_months
from granary.operators.aggregates import pivot_facts
from granary.operators.upserts import upsert
from granary.operators.windows import first_by

#: Each feature's family and type.
REGISTRY = (
    ("funding_target", "campaign", "numeric"),
    ("amount_raised", "campaign", "numeric"),
    ("overfunding_ratio", "campaign", "numeric"),
    ("equity_offered_pct", "campaign", "numeric"),
    ("pre_money_valuation", "campaign", "numeric"),
    ("investor_count", "campaign", "numeric"),
    ("funding_velocity_days", "campaign", "numeric"),
    ("eis_seis_eligible", "campaign", "boolean"),
    ("platform", "campaign", "categorical"),
    ("company_age_months", "company", "numeric"),
    ("employee_count", "company", "numeric"),
    ("revenue_at_raise", "company", "numeric"),
    ("revenue_growth_rate", "company", "numeric"),
    ("total_prior_funding", "company", "numeric"),
    ("pre_revenue", "company", "boolean"),
    ("prior_vc_backing", "company", "boolean"),
    ("sector", "company", "categorical"),
    ("revenue_model_type", "company", "categorical"),
    ("country", "company", "categorical"),
    ("founder_count", "team", "numeric"),
    ("domain_experience_years", "team", "numeric"),
    ("prior_exits", "team", "boolean"),
    ("accelerator_alumni", "team", "boolean"),
    ("total_assets", "financial", "numeric"),
    ("total_debt", "financial", "numeric"),
    ("debt_to_asset_ratio", "financial", "numeric"),
    ("cash_position", "financial", "numeric"),
    ("burn_rate_monthly", "financial", "numeric"),
    ("gross_margin", "financial", "numeric"),
    ("valuation_cap", "terms", "numeric"),
    ("discount_rate", "terms", "numeric"),
    ("liquidation_pref_multiple", "terms", "numeric"),
    ("seniority_position", "terms", "numeric"),
    ("mfn_clause", "terms", "boolean"),
    ("pro_rata_rights", "terms", "boolean"),
    ("qualified_institutional", "terms", "boolean"),
    ("instrument_type", "terms", "categorical"),
    ("liquidation_participation", "terms", "categorical"),
    ("charges_count", "regulatory", "numeric"),
    ("director_disqualifications", "regulatory", "numeric"),
    ("accounts_overdue", "regulatory", "boolean"),
    ("company_status", "regulatory", "categorical"),
    ("ecf_quarterly_volume", "market_regime", "numeric"),
    ("interest_rate_regime", "market_regime", "categorical"),
    ("equity_market_regime", "market_regime", "categorical"),
    ("data_source_count", "evidence", "numeric"),
    ("field_completeness_ratio", "evidence", "numeric"),
)
FEATURES = {name: (family, kind) for name, family, kind in REGISTRY}


def typed(value: Column, kind: str) -> Column:
    """A text value as the feature's type; null if it is none."""
    return {"numeric": value.try_cast("double"), "boolean": value.try_cast("boolean"), "categorical": value}[kind]


def valid(name: Column, value: Column) -> Column:
    """Whether a value fits its feature; false for unknown features, true for null."""
    ok = F.lit(False)
    for kind in ("numeric", "boolean", "categorical"):
        own = [n for n, (_, k) in FEATURES.items() if k == kind]
        ok = F.when(name.isin(own), value.isNull() | typed(value, kind).isNotNull()).otherwise(ok)
    return ok


def written(store: DataFrame, wide: DataFrame, keys: list[str]) -> DataFrame:
    """Upserts the registered columns of wide rows as facts (keys, feature, value as text); nulls are not written."""
    own = [c for c in wide.columns if c in FEATURES]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in own])).alias("_f")
    rows = wide.select(*keys, pairs).select(*keys, "_f.feature", "_f.value").where("value is not null")
    return upsert(store, rows, [*keys, "feature"])


def as_of(facts: DataFrame, day: str, entity: str = "entity_id", feature: str = "feature_name", time: str = "as_of_date", tie: str = "fact_id") -> DataFrame:
    """The latest fact of each entity and feature at or before the day."""
    return first_by(facts.where(F.col(time) <= F.lit(day).cast("date")), [entity, feature], F.desc(time), F.desc(tie))


def training_matrix(facts: DataFrame, day: str, tier: int, features: list[str]) -> DataFrame:
    """One row for each entity: the latest facts of at most this tier; the tier is tested before facts compete."""
    last = as_of(facts.where(F.col("tier") <= tier), day)
    return pivot_facts(last, ["entity_id"], "feature_name", {f: F.col("value") for f in features})


#: Facts that count for a record's completeness.
TRACKED = ("funding_target", "amount_raised", "pre_money_valuation", "investor_count", "employee_count", "revenue_at_raise", "total_assets", "total_debt", "instrument_type", "company_status", "country", "sector")


def extracted(records: DataFrame, keys: list[str]) -> DataFrame:
    """Every registered feature of records, family by family: derived ones by their rules, the others as they are; a column
    that the records lack is null."""
    get = lambda name: F.col(name) if name in records.columns else F.lit(None).cast("string")
    some = lambda name: F.nullif(get(name).cast("string"), F.lit(""))

    def ratio(a: str, b: str) -> Column:
        return F.when(get(a).isNotNull() & get(b).isNotNull(), F.when(get(b) > 0, get(a) / get(b)).otherwise(0.0))

    sources = [some("source"), get("campaign_date"), get("round_date"), get("total_assets"), some("company_status")]
    count = lambda cols: sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    derived = {
        "overfunding_ratio": ratio("amount_raised", "funding_target"),
        "debt_to_asset_ratio": ratio("total_debt", "total_assets"),
        "company_age_months": age_months(get("incorporation_date"), get("campaign_date")),
        "pre_revenue": F.coalesce(get("revenue_at_raise") == 0, F.lit(True)),
        "company_status": F.coalesce(some("company_status"), get("current_status")),
        "charges_count": F.coalesce(get("charges_count").cast("int"), F.when(get("has_charges").cast("boolean"), 1)),
        "qualified_institutional": F.coalesce(get("qualified_institutional").cast("boolean"), get("qualified_institutional_coinvestor").cast("boolean")),
        "data_source_count": count(sources),
        "field_completeness_ratio": count([get(c) for c in TRACKED]) / len(TRACKED),
    }
    return records.select(*keys, *[derived.get(name, get(name)).alias(name) for name in FEATURES])
