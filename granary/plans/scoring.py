"""Rule scores of deals: rubric, gates, recommendation, term audit, readiness and pilot scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.parsing import clamp, entropy, half_up

#: Weights of the rubric's categories, and the score that each starts from.
WEIGHTS = {"text": 0.20, "traction": 0.18, "terms": 0.15, "team": 0.15, "financial": 0.12, "signal": 0.10, "market": 0.10}
START = 35


def points(start: float, *ladders: list[tuple[Column, float]]) -> Column:
    """start plus, of each ladder, the points of the first condition that holds."""
    total = F.lit(float(start))
    for ladder in ladders:
        part = F.lit(0.0)
        for condition, value in reversed(ladder):
            part = F.when(condition, float(value)).otherwise(part)
        total = total + part
    return total


def rubric(d: dict[str, Column]) -> dict[str, Column]:
    """Category scores from 0 to 100. d has ml, text, founder, problem, depth, revenue, pre_revenue, growth, over, target,
    raised, signal, instrument, cap, discount, maturity, interest, preference, participation,
    pro_rata, investors, days, debt, assets, cash, institution, sector, pre_money."""
    grow, over, inst = d["growth"], d["over"], F.lower(F.coalesce(d["instrument"], F.lit("")))
    bonus = F.when(over > 1, F.least(F.lit(15.0), (over - 1) * 10)).otherwise(0.0)
    traction = points(START, [(d["revenue"] > 0, 15)], [(grow > 1, 20), (grow > 0.5, 15), (grow > 0.2, 10), (grow > 0, 5), (grow.isNotNull(), -5)]) + bonus
    ratio = F.when((d["target"] != 0) & (d["raised"] != 0), d["raised"] / d["target"])
    share = F.lower(d["participation"])
    loose = inst.contains("safe") | inst.contains("convertible")
    terms = points(
        START,
        [(ratio >= 1.5, 15), (ratio >= 1, 10)],
        [(d["signal"] == "attractive", 20), (d["signal"] == "fair", 8), (d["signal"] == "aggressive", -20)],
        [(inst.contains("equity"), 4)],
        [(loose, -4)],
        [(inst.contains("debt"), -8)],
        [(loose & d["cap"].isNotNull(), 4), (loose, -6)],
        [(loose & d["discount"].between(0.1, 0.25), 3), (loose & ((d["discount"] > 0.35) | (d["discount"] < 0.05)), -2), (loose & d["discount"].isNull(), -3)],
        [(inst.contains("convertible") & d["maturity"].isNotNull(), 1), (inst.contains("convertible"), -2)],
        [(d["interest"] > 0.12, -4), (d["interest"] > 0.08, -2)],
        [(d["preference"] > 1, -8), (d["preference"] == 1, 2)],
        [(share.contains("participating") & ~share.contains("non"), -6)],
        [(d["pro_rata"], 3), (~d["pro_rata"], -1)],
        [(d["investors"] > 300, -8), (d["investors"] > 150, -4)],
        [(d["days"] <= 14, 8), (d["days"] <= 30, 4), (d["days"] > 90, -4)],
    )
    dta = F.when(d["assets"] > 0, d["debt"] / d["assets"])
    financial = points(START, [(dta < 0.3, 15), (dta < 0.5, 10), (dta < 0.8, 5), (dta.isNotNull(), -10)], [(d["cash"] > 100_000, 10), (d["cash"] > 0, 5)])
    signal = points(START, [(d["institution"], 15)], [(over > 2, 10), (over > 1.5, 5)])
    out = {
        "text": F.coalesce(F.nullif(d["text"], F.lit(0.0)), F.lit(float(START))),
        "traction": F.when(d["pre_revenue"], 30.0).otherwise(traction),
        "terms": terms,
        "team": F.coalesce(START + (d["founder"] - 50) / 50 * 30, F.lit(float(START))),
        "financial": financial,
        "signal": signal,
        "market": F.coalesce(START + ((d["problem"] + d["depth"]) / 2 - 50) / 50 * 25, F.lit(float(START))),
    }
    return {k: clamp(v, 0.0, 100.0) for k, v in out.items()}


def overall(ml: Column, categories: dict[str, Column]) -> Column:
    """Three fifths of the model's score and two fifths of the weighted categories, rounded half up."""
    weighted = sum((categories[k] * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return clamp(half_up(ml * 0.6 + weighted * 0.4), 0, 100)


#: Inputs that count for the completeness of a deal's data.
MEASURED = ("revenue", "assets", "debt", "cash", "target", "raised", "over", "pre_money", "instrument", "investors", "days", "multiple", "cohort_multiple", "sector", "growth", "text")


def completeness(d: dict[str, Column]) -> Column:
    """The share of the sixteen measured inputs that are known."""
    return sum((d[k].isNotNull().cast("int") for k in MEASURED), F.lit(0)) / len(MEASURED)


def confidence_range(completeness: Column, has_text: Column) -> Column:
    return F.when((completeness > 0.8) & has_text, 8).when((completeness > 0.5) & has_text, 15).when(completeness > 0.5, 20).otherwise(25)


def gates(d: dict[str, Column], quick: bool = True) -> Column:
    """An array of (name, passed, action) for each check that applies."""
    least = 0.40 if quick else 0.60
    check = lambda name, ok, action: F.struct(F.lit(name).alias("name"), F.coalesce(ok, F.lit(False)).alias("passed"), F.when(F.coalesce(ok, F.lit(False)), "pass").otherwise(action).alias("action"))
    evidence = (d["sample"] >= 200) & d["release_open"] & (d["auc"] >= 0.65) & (d["ece"] <= 0.10)
    always = F.array(
        check("Data Completeness", d["completeness"] >= least, "abstain"),
        check("Model Confidence", entropy(1 - d["ml"] / 100) < 0.70, "abstain"),
        check("Term Consistency", d["conflicts"] == 0, "abstain"),
        check("Segment Evidence", evidence, "abstain"),
        check("Valuation Confidence", d["valuation"] != "low", "abstain"),
    )
    kill = F.array(
        F.when(d["disqualified"], check("Director Disqualification", F.lit(False), "reject")),
        F.when(d["administration"], check("Company Status", F.lit(False), "reject")),
        F.when(d["sanctioned"], check("Sanctions Screening", F.lit(False), "reject")),
        F.when(d["overdue"], check("Accounts Overdue", F.lit(False), "flag")),
    )
    return F.concat(always, F.array_compact(kill))


def classify(score: Column, found: Column) -> Column:
    any_ = lambda action: F.exists(found, lambda g: g["action"] == action)
    clear = F.forall(found, lambda g: g["passed"])
    return F.when(any_("reject"), "pass").when(any_("abstain"), "abstain").when(clear & (score >= 65), "invest").when(clear & (score >= 50), "deep_diligence").when(score >= 40, "watch").otherwise("pass")


def term_sources(pairs: dict[str, tuple[Column, Column]]) -> dict[str, Column]:
    """Where each numeric term comes from: a table, a text, both, or both with a conflict."""
    out = {}
    for name, (db, text) in pairs.items():
        gap = F.abs(db - text)
        conflict = (gap > 0.01) & (gap / F.greatest(F.abs(db), F.abs(text), F.lit(1.0)) > 0.025)
        out[name] = F.when(db.isNotNull() & text.isNotNull(), F.when(conflict, "conflict").otherwise("db_and_derived")).when(db.isNotNull(), "db_structured").when(text.isNotNull(), "derived_text").otherwise("none")
    return out


def term_penalty(sources: dict[str, Column], confidence: Column) -> Column:
    count = lambda *kinds: sum((c.isin(*kinds).cast("int") for c in sources.values()), F.lit(0))
    return F.least(count("conflict"), F.lit(2)) + ((count("db_structured", "db_and_derived") == 0) & (confidence != "high")).cast("int")


def readiness_checks(d: dict[str, Column]) -> list[tuple[Column, str]]:
    """The ten checks of a deal's evidence, each with what is said where it fails. d has completeness, failed_gates, segment_ok,
    quarter_ok, valuation, peers, tier, tier_a, core, conflicts, warnings."""
    return [
        (d["completeness"] >= 0.60, "Data completeness is below 60%."),
        (d["failed_gates"] == 0, "One or more reliability gates failed."),
        (d["segment_ok"], "Segment backtest evidence is insufficient."),
        (d["quarter_ok"], "Quarterly evidence report is stale or not release-ready."),
        (d["valuation"] != "low", "Valuation confidence is low."),
        (d["peers"] >= 80, "Stage-country-sector comparable sample is below 80."),
        (~d["tier"].isin("C", "unknown") & (d["tier_a"] >= 0.30), "Tier-A pricing evidence share is below 30% or source tier is too weak."),
        (d["core"] >= 0.85, "Core term completeness is below 85%."),
        (d["conflicts"] == 0, "Valuation-critical term conflicts were detected across sources."),
        (d["warnings"] == 0, "Operational data fetch warnings were encountered."),
    ]


def readiness(checks: list[tuple[Column, str]]) -> dict[str, Column]:
    """How many checks pass, the status that follows and the reasons of those that fail, in order."""
    ok = [F.coalesce(c, F.lit(False)) for c, _ in checks]
    n = sum((c.cast("int") for c in ok), F.lit(0))
    reasons = F.array_compact(F.array(*[F.when(~c, reason) for c, (_, reason) in zip(ok, checks, strict=True)]))
    return {"passed": n, "status": F.when(n == len(checks), "ready").when(n / len(checks) >= 0.6, "caution").otherwise("blocked"), "reasons": reasons}


def evidence_groups(d: dict[str, Column]) -> dict[str, list[Column]]:
    """What is known of a deal in five groups: conditions over its columns."""
    has = lambda *names: [d[n].isNotNull() for n in names]
    return {
        "identity": has("company_name", "country", "campaign_date", "stage"),
        "financial": has("had_revenue", "revenue", "growth", "assets", "debt", "burn"),
        "terms": [*has("target", "raised", "pre_money", "equity", "instrument"), F.coalesce(d["core"] >= 0.6, F.lit(False)), F.coalesce(d["gate_pass"], F.lit(False))],
        "team": has("founders", "employees", "investors", "age_months"),
        "narrative": has("text_score", "excerpt"),
    }


def missing_required(d: dict[str, Column]) -> Column:
    """Names of the required facts of which no form is known."""
    needs = {
        "campaign_date": ["campaign_date"],
        "amount_or_target": ["raised", "target"],
        "revenue_or_flag": ["revenue", "had_revenue"],
        "team_or_traction": ["founders", "employees", "investors"],
        "narrative_or_text_score": ["excerpt", "text_score"],
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(*[d[c].cast("string") for c in cols]).isNull(), name) for name, cols in needs.items()]))


def sufficiency(groups: dict[str, list[Column]], complete: Column, sources: Column | None = None) -> dict[str, Column]:
    """Evidence of twenty points for each group by its share of known fields, with up to ten for completeness or, where
    that is unknown, for the number of sources."""
    part = {k: F.bround(sum((c.cast("int") for c in v), F.lit(0)) / len(v) * 20).cast("int") for k, v in groups.items()}
    other = F.least(F.lit(10), F.coalesce(sources.cast("int"), F.lit(0))) if sources is not None else F.lit(0)
    bonus = F.when(complete.isNotNull(), F.least(F.lit(10), F.bround(complete * 10).cast("int"))).otherwise(other)
    return {"score": F.least(F.lit(100), sum(part.values(), F.lit(0)) + bonus), "groups": sum(((v >= 10).cast("int") for v in part.values()), F.lit(0))} | part


def seed_score(evidence: Column, d: dict[str, Column]) -> Column:
    multiple = F.when(d["revenue"] > 0, d["valuation"] / d["revenue"])
    score = points(
        0,
        [(d["had_revenue"], 10), (~d["had_revenue"], -8)],
        [(d["revenue"] > 0, 6)],
        [(d["growth"] > 0.25, 6), (d["growth"] < -0.10, -6)],
        [(d["institution"], 10)],
        [(d["over"] > 1.15, 5)],
        [(multiple > 40, -12), (multiple > 25, -8), (multiple < 8, 3)],
        [(d["disqualified"] > 0, -25)],
        [(d["overdue"], -12)],
    )
    return clamp(35.0 + (evidence - 50.0) * 0.35 + score, 0.0, 100.0)


def seed_class(evidence: Column, groups: Column, score: Column) -> Column:
    return F.when((evidence < 45) | (groups < 2), "abstain").when(score >= 72, "invest").when(score >= 58, "deep_diligence").when(score >= 42, "watch").otherwise("pass")


#: Points that a penalty costs, and the most that all cost.
PENALTY_POINTS, MOST_POINTS = 4, 16


def penalised(score: Column, penalty: Column) -> Column:
    return F.greatest(F.lit(0), score - F.least(F.lit(MOST_POINTS), penalty * PENALTY_POINTS))


def persona_score(amount: Column, latest_amount: Column, had_revenue: Column, stage: Column) -> Column:
    """What a persona falls back on: a point for an amount, for the latest round's, and for a known stage, two for revenue and one less
    for none; nothing for what is unknown."""
    known = lambda c: F.when(F.coalesce(c, F.lit(0.0)) != 0, 1).otherwise(0)
    revenue = F.when(had_revenue, 2).when(~had_revenue, -1).otherwise(0)
    return known(amount) + known(latest_amount) + revenue + F.when(stage.isin("seed", "early_growth"), 1).otherwise(0)


def persona(kind: str, score: Column) -> dict[str, Column]:
    #: Least score, class and conviction of each persona, best first.
    ladder = {
        "conservative": [(3, "deep_diligence", 55), (1, "watch", 45), (None, "pass", 35)],
        "balanced": [(4, "invest", 70), (2, "deep_diligence", 58), (1, "watch", 48), (None, "pass", 38)],
        "aggressive": [(4, "invest", 78), (2, "deep_diligence", 64), (None, "watch", 52)],
    }[kind]
    label, sure = F.lit(ladder[-1][1]), F.lit(ladder[-1][2])
    for least, name, conviction in reversed(ladder[:-1]):
        label, sure = F.when(score >= least, name).otherwise(label), F.when(score >= least, conviction).otherwise(sure)
    return {"class": label, "conviction": sure}
