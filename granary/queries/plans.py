"""Queries of the domain plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import windows as V
from granary.plans import backtest as B
from granary.plans import comparables as C
from granary.plans import entities as E
from granary.plans import feature_store as S
from granary.plans import labels as L
from granary.plans import linkage as K
from granary.plans import operations as O
from granary.plans import scoring as R
from granary.plans import truth as T
from granary.queries.analytics import _KINDS, _WINDOWS, WINDOWS
from granary.queries.base import query


@query("fs1_validate", "SELECT deal_id, true AS number_ok, deal_id % 2 = 0 AS text_ok, false AS unknown_ok FROM deals")
def validate(t):
    text = F.when(F.col("deal_id") % 2 == 0, "12.5").otherwise("twelve")
    return t.deals.select("deal_id", S.valid(F.lit("amount_raised"), F.col("amount").cast("string")).alias("number_ok"), S.valid(F.lit("founder_count"), text).alias("text_ok"), S.valid(F.lit("no_such"), text).alias("unknown_ok"))


@query(
    "fs2_write_features",
    """WITH old AS (SELECT deal_id, deal_date, 'sector' AS feature, 'unknown' AS value FROM deals WHERE stage = 'seed' UNION ALL SELECT deal_id, deal_date, 'gross_margin', '0.5' FROM deals WHERE has_revenue),
    new AS (SELECT deal_id, deal_date, 'sector' AS feature, sector AS value FROM deals UNION ALL SELECT deal_id, deal_date, 'qualified_institutional', CASE WHEN deal_id % 2 = 0 THEN has_institution ELSE deal_id % 7 = 0 END::VARCHAR FROM deals)
    SELECT * FROM new UNION ALL SELECT o.* FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.deal_id = o.deal_id AND n.feature = o.feature)""",
)
def write_features(t):
    d = t.deals
    fact = lambda rows, name, value: rows.select("deal_id", "deal_date", F.lit(name).alias("feature"), F.lit(value).alias("value"))
    store = fact(d.where("stage = 'seed'"), "sector", "unknown").unionByName(fact(d.where("has_revenue"), "gross_margin", "0.5"))
    wide = S.extracted(records(t), ["deal_id", "deal_date"]).select("deal_id", "deal_date", "sector", "qualified_institutional")
    return S.written(store, wide, ["deal_id", "deal_date"])


@query("fs3_read_as_of", "SELECT entity_id, feature_name, fact_id, value FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, feature_name ORDER BY as_of_date DESC, fact_id DESC) AS r FROM facts WHERE as_of_date <= DATE '2024-03-31') WHERE r = 1")
def read_as_of(t):
    return S.as_of(t.facts, "2024-03-31").select("entity_id", "feature_name", "fact_id", "value")


@query(
    "fs4_training_matrix",
    "SELECT entity_id, " + ", ".join(f"max(value) FILTER (feature_name = '{k}') AS {k}" for k in _KINDS) + " FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, feature_name ORDER BY as_of_date DESC, fact_id DESC) AS r FROM facts WHERE as_of_date <= DATE '2024-12-31' AND tier <= 1) WHERE r = 1 GROUP BY 1",
)
def training_matrix(t):
    return S.training_matrix(t.facts, "2024-12-31", 1, list(_KINDS))


@query(
    "fs5_extract",
    """WITH r AS (SELECT deal_id, deal_id AS k, amount, CASE WHEN deal_id % 6 <> 0 THEN CASE WHEN deal_id % 12 = 1 THEN 0.0::DOUBLE ELSE amount * 0.8::DOUBLE END END AS target, pre_money, deal_date, sector, country, has_institution, CASE WHEN has_revenue THEN CASE WHEN deal_id % 10 = 3 THEN 0.0::DOUBLE ELSE amount / 4 END END AS rev,
      CASE WHEN deal_id % 9 <> 0 THEN CASE WHEN deal_id % 9 = 1 THEN 0.0::DOUBLE ELSE amount * 10 END END AS assets, CASE WHEN deal_id % 8 <> 0 THEN amount * (deal_id % 10) END AS debt, CASE deal_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'active' END AS status, CASE WHEN deal_id % 2 = 0 THEN 'dormant' END AS now_status FROM deals)
    SELECT deal_id, target AS funding_target, round(CASE WHEN target > 0 THEN amount / target WHEN target IS NOT NULL THEN 0.0::DOUBLE END, 6) AS overfunding_ratio, round(CASE WHEN assets IS NOT NULL AND debt IS NOT NULL THEN CASE WHEN assets > 0 THEN debt / assets ELSE 0.0::DOUBLE END END, 6) AS debt_to_asset_ratio,
    CASE WHEN k % 5 <> 0 THEN greatest(k % 900 - 100, 0) // 30 END::INTEGER AS company_age_months, rev IS NULL OR rev = 0 AS pre_revenue, coalesce(nullif(status, ''), now_status) AS company_status, CASE WHEN k % 4 = 0 THEN 3 WHEN k % 4 = 1 THEN 1 END::INTEGER AS charges_count,
    CASE WHEN k % 2 = 0 THEN has_institution ELSE k % 7 = 0 END AS qualified_institutional, (1 + 1 + (assets IS NOT NULL)::INT + (status = 'active' AND status IS NOT NULL)::INT)::INTEGER AS data_source_count,
    round(((target IS NOT NULL)::INT + 1 + (pre_money IS NOT NULL)::INT + (k % 7 <> 0)::INT + 0 + (rev IS NOT NULL)::INT + (assets IS NOT NULL)::INT + (debt IS NOT NULL)::INT + 1 + (status IS NOT NULL)::INT + 1 + 1) / 12, 6) AS field_completeness_ratio, sector, CASE WHEN k % 3 = 0 THEN 0.15::DOUBLE END AS discount_rate FROM r""",
)
def extract(t):
    wide = S.extracted(records(t), ["deal_id"])
    shown = ["funding_target", "company_age_months", "pre_revenue", "company_status", "charges_count", "qualified_institutional", "data_source_count", "sector", "discount_rate"]
    return wide.select("deal_id", *shown, *[F.round(c, 6).alias(c) for c in ("overfunding_ratio", "debt_to_asset_ratio", "field_completeness_ratio")])


def records(t):
    """Raw records of deals as the feature store reads them."""
    k, some = F.col("deal_id"), lambda n, v: F.when(F.col("deal_id") % n != 0, v)
    return t.deals.select(
        "deal_id", "deal_date", "sector", "country", F.col("amount").alias("amount_raised"), some(6, F.when(k % 12 == 1, 0.0).otherwise(F.col("amount") * 0.8)).alias("funding_target"), F.col("pre_money").alias("pre_money_valuation"), some(7, k % 400).alias("investor_count"),
        F.when(F.col("has_revenue"), F.when(k % 10 == 3, 0.0).otherwise(F.col("amount") / 4)).alias("revenue_at_raise"), some(9, F.when(k % 9 == 1, 0.0).otherwise(F.col("amount") * 10)).alias("total_assets"), some(8, F.col("amount") * (k % 10)).alias("total_debt"),
        F.col("deal_date").alias("campaign_date"), some(5, F.date_sub("deal_date", (k % 900 - 100).cast("int"))).alias("incorporation_date"), F.when(k % 3 == 0, "").when(k % 3 == 1, "active").alias("company_status"), F.when(k % 2 == 0, "dormant").alias("current_status"),
        F.when(k % 4 == 0, 3).alias("charges_count"), (k % 4 == 1).alias("has_charges"), F.when(k % 2 == 1, k % 7 == 0).alias("qualified_institutional"), F.col("has_institution").alias("qualified_institutional_coinvestor"), F.lit("safe").alias("instrument_type"), F.lit("registry").alias("source"),
        F.when(k % 3 == 0, 0.15).alias("discount_rate"),
    )


@query(
    "lb1_tiers",
    """SELECT company_id, CASE WHEN company_id % 4 IN (0, 1) THEN 1 WHEN company_id % 4 = 2 THEN 2 ELSE 3 END::INTEGER AS uk_tier, CASE company_id % 4 WHEN 0 THEN 'failed' WHEN 3 THEN 'unknown' ELSE 'trading' END AS uk_outcome,
    CASE WHEN company_id % 5 = 0 THEN 3 WHEN company_id % 2 = 0 THEN 1 ELSE 2 END::INTEGER AS us_tier, CASE company_id % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'exited' ELSE CASE WHEN company_id % 5 = 0 THEN 'unknown' ELSE 'trading' END END AS us_outcome FROM companies""",
)
def tiers(t):
    k = F.col("company_id")
    status = F.when(k % 4 == 0, "Dissolved").when(k % 4 == 3, "dormant").otherwise("Active")
    uk = L.uk_label(status, k % 4 == 2, F.when(k % 4 != 2, F.lit("2024-01-01").cast("date")))
    us = L.us_label(F.when(k % 5 != 0, "current"), F.when(k % 3 == 0, "shutdown").when(k % 3 == 1, "ipo"), k % 2 == 0, F.lit(False))
    return t.companies.select("company_id", uk["tier"].alias("uk_tier"), uk["outcome"].alias("uk_outcome"), us["tier"].alias("us_tier"), us["outcome"].alias("us_outcome"))


@query(
    "lb2_outcomes_from_filings",
    """WITH s AS (SELECT cik, bool_or(form_type IN ('C-TR', 'C-W')) AS a, bool_or(form_type = 'C-AR' AND filing_date >= DATE '2001-06-01' - 540) AS b, bool_or(form_type = 'C-U' AND filing_date >= DATE '2001-06-01' - 360) AS c, max(filing_date) - min(filing_date) > 730 AS d FROM filings GROUP BY 1),
    r AS (SELECT company_id, outcome, CASE WHEN outcome <> 'unknown' THEN 0 WHEN a THEN 1 WHEN b THEN 2 WHEN c THEN 3 WHEN d THEN 4 ELSE 0 END AS rule FROM companies LEFT JOIN s USING (cik))
    SELECT company_id, CASE rule WHEN 0 THEN outcome WHEN 1 THEN 'failed' ELSE 'trading' END AS outcome, CASE rule WHEN 1 THEN 'terminated_or_withdrawn' WHEN 2 THEN 'annual_report_filed' WHEN 3 THEN 'progress_update_filed' WHEN 4 THEN 'sustained_filing_activity' END AS detail, CASE WHEN rule = 4 THEN 3 WHEN rule > 0 THEN 2 END::INTEGER AS tier FROM r""",
)
def outcomes(t):
    return L.from_filings(t.companies, t.filings, "2001-06-01")


@query(
    "lb5_progress_labels",
    """WITH o AS (SELECT round_id, company_id % 200 AS company_id, round_date FROM rounds WHERE round_date + INTERVAL 18 MONTH <= DATE '1998-06-01'),
    b AS (SELECT o.round_id, max({'d': filing_date, 'v': revenue}) AS m FROM o JOIN filings f ON f.company_id = o.company_id AND filing_date <= round_date GROUP BY 1),
    a AS (SELECT o.round_id, max(revenue) AS v FROM o JOIN filings f ON f.company_id = o.company_id AND filing_date > round_date + INTERVAL 6 MONTH AND filing_date <= least(round_date + INTERVAL 24 MONTH, TIMESTAMP '1998-06-01') GROUP BY 1)
    SELECT o.round_id, coalesce(a.v >= 2 * b.m.v, false) AS progress FROM o LEFT JOIN b ON b.round_id = o.round_id LEFT JOIN a ON a.round_id = o.round_id""",
)
def progress(t):
    rounds = t.rounds.withColumn("company_id", F.col("company_id") % 200)
    return L.progress(rounds, t.filings, "1998-06-01")


#: Names in several scripts, an empty and a null one; what each is once normalised.
_FIRMS = ("Firm", "Альфа", "Бета", "Ωμέγα", "北京", "", None)
_NORMAL = ("firm", "alfa", "beta", "omega", "北京", "", "")


def arrivals(t):
    k = F.col("company_id")
    firm = F.element_at(F.array(*map(F.lit, _FIRMS)), (k % 7 + 1).cast("int"))
    name = F.when(k % 7 == 5, F.lit(" - ")).when(firm.isNotNull(), F.concat(firm, F.lit(" "), (k % 30).cast("string"), F.when(k % 2 == 0, " Ltd.").otherwise("")))
    source_id = F.when(k % 11 != 0, k % 400)
    return t.companies.select(k.alias("ord"), (k % 3).cast("string").alias("source"), source_id.alias("source_id"), name.alias("name"), F.when(k % 13 == 0, F.lower("country")).when(k % 17 != 0, F.col("country")).alias("country"))


_ARRIVALS = f"""arrivals AS (SELECT company_id AS ord, (company_id % 3)::VARCHAR AS source, CASE WHEN company_id % 11 <> 0 THEN company_id % 400 END AS source_id,
    CASE WHEN company_id % 7 < 5 THEN CASE company_id % 7 {" ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_NORMAL[:5]))} END || ' ' || (company_id % 30) END AS name, CASE WHEN company_id % 13 = 0 OR company_id % 17 <> 0 THEN lower(country) END AS country FROM companies)"""


@query(
    "er3_resolve",
    f"""WITH {_ARRIVALS}, l AS (SELECT *, CASE WHEN source_id IS NULL THEN ord ELSE min(ord) OVER (PARTITION BY source, source_id) END AS lead FROM arrivals), e AS (SELECT ord AS lead, CASE WHEN name IS NULL OR country IS NULL THEN ord ELSE min(ord) OVER (PARTITION BY name, country) END AS entity_id FROM l WHERE ord = lead)
    SELECT l.ord, e.entity_id, CASE WHEN l.ord <> l.lead THEN 'source_id' WHEN e.entity_id <> l.ord THEN 'name_country' ELSE 'created' END AS how FROM l JOIN e ON e.lead = l.lead""",
)
def resolve(t):
    return E.resolve(arrivals(t), "ord", "source", "source_id", "name", "country").select("ord", "entity_id", "how")


@query(
    "er5_fuzzy_clusters",
    """WITH RECURSIVE n AS (SELECT p_partkey AS id, lower(p_name) AS n, p_brand FROM part), l AS (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON a.id <> b.id AND a.p_brand = b.p_brand AND substr(a.n, 1, 4) = substr(b.n, 1, 4) AND 1 - levenshtein(a.n, b.n) / greatest(length(a.n), length(b.n)) >= 0.7),
    reach(id, other) AS (SELECT a, a FROM l UNION SELECT r.id, l.b FROM reach r JOIN l ON l.a = r.other) SELECT id, min(other) AS root FROM reach GROUP BY 1""",
)
def fuzzy(t):
    return E.fuzzy_clusters(t.part.select("p_partkey", "p_name", "p_brand"), "p_partkey", "p_name", ["p_brand"], 0.7)


def written_twice(t):
    """Customers under made-up names, and each third of them once more with a slip in the name, some without a sector."""
    k = F.col("c_custkey")
    word = lambda a, n: F.translate(F.substring(F.md5(k.cast("string")), a, n), "0123456789", "ghijklmnop")
    own = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select((k * 2).alias("id"), k.alias("truth"), F.concat_ws(" ", word(1, 8), word(11, 6)).alias("name"), F.col("n_name").alias("country"), F.col("c_mktsegment").alias("sector"))
    at = (F.col("truth") % 5 + 2).cast("int")
    cut = F.concat(F.substring("name", F.lit(1), at), F.expr("substring(name, truth % 5 + 4)"))
    slip = F.when(F.col("truth") % 2 == 0, cut).otherwise(F.concat("name", F.lit(" Ltd")))
    again = own.where("truth % 3 = 0").select((F.col("id") + 1).alias("id"), "truth", slip.alias("name"), "country", F.when(F.col("truth") % 4 != 0, F.col("sector")).alias("sector"))
    return own.unionByName(again)


@query("er5_linkage")
def linkage(t):
    links = K.linked(written_twice(t), "id", "name", ["country", "sector"])
    return K.clusters(links).select("id", "root", F.round("score", 4).alias("score"), "merged")


@query("er6_merge", "SELECT fact_id, CASE WHEN entity_id % 10 = 3 THEN entity_id - 1 ELSE entity_id END AS entity_id, false AS dropped FROM facts UNION ALL SELECT fact_id, entity_id, true FROM facts WHERE entity_id % 10 <> 3")
def merge_entities(t):
    roots = t.facts.select(F.col("entity_id").alias("id")).distinct().withColumn("root", F.when(F.col("id") % 10 == 3, F.col("id") - 1).otherwise(F.col("id")))
    f = t.facts.select("fact_id", "entity_id")
    kept = E.merged(f, roots, "entity_id", False).select("fact_id", "entity_id", F.lit(False).alias("dropped"))
    return kept.unionByName(E.merged(f, roots, "entity_id", True).select("fact_id", "entity_id", F.lit(True).alias("dropped")))


_MERGES = "chain AS (SELECT company_id AS id, company_id - company_id % 4 AS root FROM companies WHERE company_id % 4 <> 0 AND company_id % 5 <> 4)"
_MOVED = {
    "feature_store": ("facts", "entity_id", True), "backtest_holdout": ("deals", "company_id", True), "entity_links": ("filings", "company_id", False), "companies": ("companies", "company_id", False),
    "evaluations": ("deals", "company_id", False), "investments": ("rounds", "company_id", False), "anti_portfolio": ("deals", "company_id", False), "deal_funnel": ("facts", "entity_id", False), "canonical_entities": ("companies", "company_id", True),
}


def merges(t):
    """Chains of up to three: 3 into 2 into 1 into 0, broken where a link is missing."""
    k = F.col("company_id")
    pairs = t.companies.where((k % 4 != 0) & (k % 5 != 4)).select(k.alias("merge_id"))
    # a chain may only go over ids that are merged themselves; others point to its beginning at once
    before = F.col("merge_id") - 1
    linked = (before % 4 != 0) & (before % 5 != 4)
    return pairs.select("merge_id", F.when(linked, before).otherwise(F.col("merge_id") - F.col("merge_id") % 4).alias("keep_id"))


@query(
    "er6_merge_tables",
    f"WITH {_MERGES} " + " UNION ALL ".join(f"SELECT '{name}' AS name, {f'{key}' if gone else f'coalesce(root, {key})'} AS entity_id, count(*) AS n FROM {table} LEFT JOIN chain ON id = {key} {'WHERE root IS NULL' if gone else ''} GROUP BY 1, 2" for name, (table, key, gone) in _MOVED.items()),
)
def merge_tables(t):
    """Rows of each entity in nine tables after merges by chains, counted."""
    tables = {name: getattr(t, table).withColumnRenamed(key, "id" if name == "canonical_entities" else "entity_id") for name, (table, key, _) in _MOVED.items()}
    out = None
    for name, df in E.merged_tables(tables, merges(t)).items():
        part = df.groupBy(F.lit(name).alias("name"), F.col("id" if name == "canonical_entities" else "entity_id").alias("entity_id")).agg(F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query("er7_validation", "WITH c AS (SELECT country, count(*) FILTER (company_id % 7 <> 0 AND company_id % 5 <> 0) AS tp, count(*) FILTER (company_id % 7 = 0 AND company_id % 5 <> 0) AS fn, count(*) FILTER (company_id % 7 <> 0 AND company_id % 5 = 0) AS fp FROM companies GROUP BY 1), f AS (SELECT country, tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM c) SELECT country, round(2 * p * r / (p + r), 6) AS f1, CASE WHEN 2 * p * r / (p + r) >= 0.95 THEN 'excellent' WHEN 2 * p * r / (p + r) >= 0.85 THEN 'good' WHEN 2 * p * r / (p + r) >= 0.7 THEN 'fair' ELSE 'poor' END AS grade FROM f")
def validation(t):
    from granary.operators.aggregates import precision_recall

    a, b = F.col("company_id") % 7 != 0, F.col("company_id") % 5 != 0
    c = t.companies.groupBy("country").agg(F.count_if(a & b).alias("tp"), F.count_if(~a & b).alias("fn"), F.count_if(a & ~b).alias("fp"))
    f1 = precision_recall(F.col("tp"), F.col("fp"), F.col("fn"))["f1"]
    return c.select("country", F.round(f1, 6).alias("f1"), E.grade(f1).alias("grade"))


@query(
    "tt2_money",
    """WITH p AS (SELECT round_id, amount, pre_money, CASE WHEN pre_money IS NOT NULL AND equity > 0 AND equity < 1 THEN pre_money / (1 - equity) WHEN pre_money IS NOT NULL THEN pre_money + amount WHEN equity > 0 THEN amount / equity END AS post FROM rounds)
    SELECT round_id, post, coalesce(pre_money, CASE WHEN post - amount IS NULL THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, post - amount) END) AS pre FROM p""",
)
def money(t):
    m = T.money(F.col("amount"), F.col("pre_money"), F.col("equity"))
    return t.rounds.select("round_id", m["post"].alias("post"), m["pre"].alias("pre"))


_TIER = "CASE source WHEN 'sec_form_d' THEN 'A' WHEN 'manual' THEN 'B' WHEN 'academic' THEN 'B' ELSE 'C' END"
_TRUTH = f"""f AS (SELECT *, {_TIER} AS t, CASE {_TIER} WHEN 'A' THEN 3 WHEN 'B' THEN 2 ELSE 1 END AS rk FROM facts WHERE value IS NOT NULL),
    w AS (SELECT entity_id, feature_name, value AS v, t, rk, as_of_date AS d FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, feature_name ORDER BY rk DESC, as_of_date DESC NULLS LAST, fact_id) AS r FROM f) WHERE r = 1),
    o AS (SELECT entity_id, feature_name, rk AS odd FROM (SELECT f.entity_id, f.feature_name, f.rk, row_number() OVER (PARTITION BY f.entity_id, f.feature_name ORDER BY f.as_of_date DESC, f.fact_id) AS r FROM f JOIN w ON w.entity_id = f.entity_id AND w.feature_name = f.feature_name WHERE abs(f.value - w.v) / greatest(abs(f.value), abs(w.v), 1.0) > 0.05) WHERE r = 1),
    s AS (SELECT entity_id, feature_name, count(*) AS n_facts, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM f GROUP BY 1, 2),
    truth AS (SELECT w.entity_id, w.feature_name, w.v AS value, w.t AS tier, w.d AS as_of, CASE WHEN odd IS NULL THEN 'none' WHEN odd >= 2 THEN 'major' ELSE 'minor' END AS conflict, n_facts, sources,
      greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE w.t WHEN 'A' THEN 0.92::DOUBLE WHEN 'B' THEN 0.78::DOUBLE ELSE 0.58::DOUBLE END + least(0.08::DOUBLE, 0.02::DOUBLE * (n_facts - 1)) - CASE WHEN odd IS NULL THEN 0.0::DOUBLE WHEN odd >= 2 THEN 0.35::DOUBLE ELSE 0.15::DOUBLE END)) AS confidence
      FROM w JOIN s ON s.entity_id = w.entity_id AND s.feature_name = w.feature_name LEFT JOIN o ON o.entity_id = w.entity_id AND o.feature_name = w.feature_name)"""


def truths(t):
    return T.reconcile(t.facts, ["entity_id", "feature_name"], "value", "source", "as_of_date", "fact_id")


@query("tt5_reconcile", f"WITH {_TRUTH} SELECT entity_id, feature_name, value, tier, as_of, conflict, n_facts, sources, round(confidence, 6) AS confidence FROM truth")
def reconcile(t):
    return truths(t).withColumn("confidence", F.round("confidence", 6))


#: What the facts' names stand for in a round's truth.
_FIELDS = {"click": "round_type", "view": "instrument_type", "purchase": "amount_raised", "error": "valuation_cap", "signup": "pre_money_valuation"}
_INSTRUMENTS = ("SAFE", "Convertible Note", "Common Stock", None)
_ROLL = """named AS (SELECT *, CASE WHEN entity_id % 4 IN (0, 1) OR entity_id % 7 = 3 THEN ['click', 'view', 'purchase', 'error', 'none'] ELSE ['click', 'view', 'purchase', 'signup', 'none'] END AS needed FROM truth),
    rolled AS (SELECT entity_id, count(*) FILTER (list_contains(needed, feature_name)) / 5 AS completeness, avg(confidence) AS confidence, count(*) FILTER (conflict <> 'none') AS conflicts, min(tier) AS tier, max(as_of) AS as_of FROM named GROUP BY 1),
    banded AS (SELECT *, CASE WHEN confidence >= 0.8 AND conflicts = 0 AND completeness >= 0.85 THEN 'high' WHEN confidence >= 0.65 AND conflicts <= 1 AND completeness >= 0.6 THEN 'medium' ELSE 'low' END AS band FROM rolled)"""


def rolled(t):
    """Truths of rounds under four instruments; some say in the round's type that they convert."""
    of = lambda table, x: F.create_map(*[F.lit(v) for pair in table.items() for v in pair])[x]
    k = F.col("entity_id")
    instrument = F.element_at(F.array(*map(F.lit, _INSTRUMENTS)), (k % 4 + 1).cast("int"))
    named = truths(t).withColumns({"field": of(_FIELDS, F.col("feature_name")), "needed": T.needed_fields(instrument, F.when(k % 7 == 3, "Bridge note").otherwise("Seed"))})
    return T.roll_up(named, "entity_id", "field", F.col("needed"))


@query("tt6_roll_up", f"WITH {_TRUTH}, {_ROLL} SELECT entity_id, round(completeness, 6) AS completeness, round(confidence, 6) AS confidence, conflicts, tier, as_of, band FROM banded")
def roll_up(t):
    return rolled(t).withColumns({"completeness": F.round("completeness", 6), "confidence": F.round("confidence", 6)})


@query(
    "tt7_truth_gate",
    f"""WITH {_TRUTH}, {_ROLL}, n AS (SELECT *, CASE tier WHEN 'A' THEN 0.6 WHEN 'B' THEN 0.7 ELSE 0.85 END AS need FROM banded),
    r AS (SELECT entity_id, nullif(concat_ws(',', CASE WHEN completeness < need THEN 'core_term_completeness<' || printf('%.2f', need::DOUBLE) END, CASE WHEN conflicts > 0 THEN 'valuation_conflicts>0' END, CASE WHEN tier = 'C' THEN 'source_tier_c' END, CASE WHEN band = 'low' THEN 'low_confidence' END), '') AS reason FROM n) SELECT entity_id, reason, reason IS NULL AS passed FROM r""",
)
def truth_gate(t):
    return T.gate(rolled(t)).select("entity_id", "reason", "passed")


@query("tt8_advisers", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'C' WHEN s_acctbal * 1e6 >= 1e9 THEN 'A' ELSE 'B' END AS tier, CASE WHEN s_suppkey % 3 = 0 THEN 0.45::DOUBLE WHEN s_acctbal * 1e6 >= 1e9 THEN 1.0::DOUBLE ELSE 0.75::DOUBLE END AS quality FROM supplier")
def advisers(t):
    a = T.adviser(F.col("s_acctbal") * 1e6, F.col("s_suppkey") % 3 != 0)
    return t.supplier.select("s_suppkey", a["tier"].alias("tier"), a["quality"].alias("quality"))


_SPLIT = f"{_WINDOWS}, split AS (SELECT w, d.*, CASE WHEN d.deal_id % 3 = 0 THEN NULL ELSE (d.deal_id % 50 - 10) / 10.0::DOUBLE END AS growth FROM deals d, windows WHERE deal_date BETWEEN b AND c)"
_QUALITY = "CASE WHEN outcome = 'failed' THEN 0.0::DOUBLE WHEN growth IS NULL THEN 1.0::DOUBLE WHEN growth < -0.1 THEN 0.5::DOUBLE WHEN growth <= 0.1 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE + least(growth, 2.0::DOUBLE) END"


def tested(t):
    return V.walk_forward(t.deals, "deal_date", WINDOWS).where("split = 'test'").withColumn("growth", F.when(F.col("deal_id") % 3 != 0, (F.col("deal_id") % 50 - 10) / F.lit(10.0)))


@query(
    "flagship_walk_forward",
    f"""WITH {_SPLIT}, g AS (SELECT *, row_number() OVER (PARTITION BY w, sector ORDER BY score DESC, deal_id) AS g FROM split WHERE score >= 50), p AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY score DESC, deal_id) AS pick FROM g WHERE g <= 4),
    s AS (SELECT w, count(*) AS n, round(avg(failed), 6) AS failure_rate, round(avg({_QUALITY}), 6) AS quality, round(sum(amount), 2) AS invested FROM p WHERE pick <= 20 GROUP BY 1), a AS (SELECT w, round(avg(CASE WHEN score < 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS abstention FROM split GROUP BY 1)
    SELECT a.w AS "window", a.abstention, s.n, s.failure_rate, s.quality, s.invested FROM a LEFT JOIN s ON s.w = a.w""",
)
def flagship(t):
    p = B.portfolios(tested(t), ["window"], "score", 50.0)
    return p.select("window", F.round("abstention", 6).alias("abstention"), "n", F.round("failure_rate", 6).alias("failure_rate"), F.round("quality", 6).alias("quality"), F.round("invested", 2).alias("invested"))


@query("bt4_model_matrix", "SELECT deal_id, failed, coalesce(pre_money, 0.0::DOUBLE) AS pre_money, coalesce(equity, 0.0::DOUBLE) AS equity FROM deals WHERE pre_money IS NOT NULL OR equity IS NOT NULL UNION ALL SELECT deal_id, failed, NULL, NULL FROM deals WHERE pre_money IS NULL AND equity IS NULL")
def model_matrix(t):
    return B.matrix(t.deals, ["pre_money", "equity"], ["sector"]).drop("sector")


@query("bt5_train_and_score", None)
def train_and_score(t):
    rows = B.matrix(t.deals, ["pre_money", "equity", "amount"], ["sector", "country", "stage"], ("deal_date", "outcome"))
    cut = F.lit("1997-12-31").cast("date")
    inputs = ["pre_money", "equity", "amount", "sector", "country", "stage"]
    known = rows.where(F.col("outcome").isin("failed", "trading"))  # unknown and exited ones teach nothing
    return B.trained(known.where(F.col("deal_date") <= cut), rows.where(F.col("deal_date") > cut), inputs, "deal_id")[0].select("deal_id", "failed", "p_failed", "score")


@query("bt9_baselines", "SELECT deal_id, round(('0x' || substr(md5('42' || deal_id::VARCHAR), 1, 8))::BIGINT / 4294967295.0::DOUBLE * 100, 6) AS random, CASE WHEN has_revenue AND has_institution AND eis_eligible THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS heuristic FROM deals")
def baselines(t):
    return t.deals.select("deal_id", F.round(B.seeded(F.col("deal_id"), "42"), 6).alias("random"), B.heuristic(F.col("has_revenue"), F.col("has_institution"), F.col("eis_eligible")).alias("heuristic"))


@query(
    "bt11_metric_gates",
    """WITH m AS (SELECT sector, avg(score) / 75 AS survival_auc, avg(failed) / 3 AS calibration_ece, CASE WHEN sector = 'BUILDING' THEN NULL ELSE 1.4::DOUBLE END AS quality_vs_random, 0.9::DOUBLE AS failure_vs_random FROM deals GROUP BY 1),
    l AS (SELECT sector, 'survival_auc' AS metric, survival_auc AS value, survival_auc >= 0.65 AS ok FROM m UNION ALL SELECT sector, 'calibration_ece', calibration_ece, calibration_ece < 0.08 FROM m UNION ALL SELECT sector, 'quality_vs_random', quality_vs_random, quality_vs_random > 1.3 FROM m UNION ALL SELECT sector, 'failure_vs_random', failure_vs_random, failure_vs_random < 0.7 FROM m)
    SELECT sector, metric, round(value, 6) AS value, coalesce(ok, false) AS passed, true AS must_pass FROM l""",
)
def metric_gates(t):
    m = t.deals.groupBy("sector").agg((F.avg("score") / 75).alias("survival_auc"), (F.avg("failed") / 3).alias("calibration_ece"))
    m = m.withColumns({"quality_vs_random": F.when(F.col("sector") == "BUILDING", float("nan")).otherwise(1.4), "failure_vs_random": F.lit(0.9)})
    return B.gated(m, ["sector"]).withColumn("value", F.round(F.nanvl("value", F.lit(None).cast("double")), 6))


@query("bt12_compare_runs", "WITH r AS (SELECT CASE WHEN status = 'F' THEN 1 ELSE 2 END AS run, priority AS metric, round(avg(amount), 2) AS v FROM rounds WHERE status <> 'P' AND NOT (status = 'F' AND priority = '5-LOW') GROUP BY 1, 2), b AS (SELECT metric, max(v) FILTER (run = 1) AS before, max(v) FILTER (run = 2) AS after FROM r GROUP BY 1) SELECT metric, before, after, round(after - before, 2) AS delta FROM b")
def compare_runs(t):
    r = t.rounds.where("status <> 'P' and not (status = 'F' and priority = '5-LOW')").groupBy(F.when(F.col("status") == "F", 1).otherwise(2).alias("run"), "priority").agg(F.round(F.avg("amount"), 2).alias("v"))
    runs = r.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("priority", "v"))).alias("metrics"))
    return O.deltas(runs, "run", "metrics", 1, 2).withColumn("delta", F.round("delta", 2))


@query("bt15_filing_recency", "WITH l AS (SELECT r.round_id, max(f.filing_date) AS d FROM rounds r JOIN filings f ON f.round_id = r.round_id AND f.filing_date <= r.round_date GROUP BY 1) SELECT r.round_id, date_diff('day', d, r.round_date)::INTEGER AS days, CASE WHEN d IS NULL THEN 0.0::DOUBLE WHEN date_diff('day', d, r.round_date) <= 365 THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM rounds r LEFT JOIN l ON l.round_id = r.round_id")
def recency(t):
    from granary.operators.joins import asof

    left = t.rounds.select("round_id", "round_date").withColumn("key", F.col("round_id"))
    last = asof(left, t.filings.select(F.col("round_id").alias("key"), "filing_date", "filing_id"), "key", "round_date", "filing_date", [], "filing_id", "round_id")
    days = F.datediff("round_date", "filing_date")
    return last.select("round_id", days.alias("days"), F.when(days.isNull(), 0.0).when(days <= 365, 0.9).otherwise(0.5).alias("confidence"))


@query(
    "cv1_cohort_fallback",
    """WITH p AS (SELECT * FROM deals WHERE sector <> 'MACHINERY'), x AS (SELECT c.company_id, 1 AS level, g.n, g.f FROM companies c JOIN (SELECT sector, country, count(*) AS n, avg(failed) AS f FROM p GROUP BY 1, 2) g ON g.sector = c.sector AND g.country = c.country
    UNION ALL SELECT c.company_id, 2, g.n, g.f FROM companies c JOIN (SELECT sector, count(*) AS n, avg(failed) AS f FROM p GROUP BY 1) g ON g.sector = c.sector UNION ALL SELECT c.company_id, 3, g.n, g.f FROM companies c JOIN (SELECT country, count(*) AS n, avg(failed) AS f FROM p GROUP BY 1) g ON g.country = c.country
    UNION ALL SELECT c.company_id, 4, g.n, g.f FROM companies c JOIN (SELECT stage, count(*) AS n, avg(failed) AS f FROM p GROUP BY 1) g ON g.stage = c.stage UNION ALL SELECT c.company_id, 5, g.n, g.f FROM companies c, (SELECT count(*) AS n, avg(failed) AS f FROM p) g)
    SELECT company_id, level::INTEGER AS level, n, round(f, 6) AS failure_rate FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY level) AS r FROM x WHERE n >= 20) WHERE r = 1""",
)
def cohort_fallback(t):
    pool = t.deals.where("sector <> 'MACHINERY'")
    return C.cohort_levels(t.companies.select("company_id", "sector", "country", "stage"), pool, "company_id").withColumn("failure_rate", F.round("failure_rate", 6))


_COHORTS = """d AS (SELECT deal_id, sector || '-' || (company_id % 7) AS sector, country || '-' || (company_id % 11) AS country, stage, failed, amount, pre_money FROM deals),
    pr AS (SELECT *, pre_money AS price, CASE WHEN deal_id % 3 <> 0 THEN amount / 4 END AS revenue, CASE deal_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS tier, CASE deal_id % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.7::DOUBLE ELSE 0.35::DOUBLE END AS weight FROM d WHERE pre_money > 0),
    tg AS (SELECT company_id, CASE WHEN company_id % 31 = 0 THEN 'NEW' WHEN company_id % 19 <> 0 THEN sector || '-' || (company_id % 7) END AS sector, CASE WHEN company_id % 23 <> 0 THEN country || '-' || (company_id % 11) END AS country, CASE WHEN company_id % 5 <> 0 THEN stage END AS stage FROM companies),
    att AS (SELECT company_id, 1 AS level, sector AS s, country AS c, stage AS st FROM tg WHERE sector IS NOT NULL AND country IS NOT NULL UNION ALL SELECT company_id, 2, sector, NULL, stage FROM tg WHERE sector IS NOT NULL UNION ALL SELECT company_id, 3, NULL, country, stage FROM tg WHERE country IS NOT NULL
      UNION ALL SELECT company_id, 4, NULL, NULL, stage FROM tg WHERE stage IS NOT NULL UNION ALL SELECT company_id, 5, NULL, NULL, NULL FROM tg), k AS (SELECT DISTINCT s, c, st FROM att),
    o AS (SELECT s, c, st, count(deal_id) AS outcome_n, avg(failed) AS failure_rate, median(amount) FILTER (amount > 0) AS median_raised FROM k LEFT JOIN d ON (s IS NULL OR sector = s) AND (c IS NULL OR country = c) AND (st IS NULL OR stage = st) GROUP BY 1, 2, 3),
    p AS (SELECT s, c, st, count(deal_id) AS price_n, coalesce(sum(round(weight * 100)::BIGINT) / count(weight) / 100, 0) AS coverage, count(*) FILTER (tier = 'A') AS tier_a, count(*) FILTER (tier = 'B') AS tier_b, count(*) FILTER (tier = 'C') AS tier_c, count(price / revenue) AS revenue_n, median(price / revenue) AS revenue_multiple, count(price / amount) AS proxy_n, median(price / amount) AS proxy_multiple
      FROM k LEFT JOIN pr ON (s IS NULL OR sector = s) AND (c IS NULL OR country = c) AND (st IS NULL OR stage = st) GROUP BY 1, 2, 3),
    x AS (SELECT att.company_id, att.level, o.*, p.*, row_number() OVER (PARTITION BY att.company_id ORDER BY att.level) AS r FROM att JOIN o ON o.s IS NOT DISTINCT FROM att.s AND o.c IS NOT DISTINCT FROM att.c AND o.st IS NOT DISTINCT FROM att.st
      JOIN p ON p.s IS NOT DISTINCT FROM att.s AND p.c IS NOT DISTINCT FROM att.c AND p.st IS NOT DISTINCT FROM att.st WHERE outcome_n >= 20 OR price_n >= 20)"""


@query(
    "cv1_comparables",
    f"""WITH {_COHORTS} SELECT company_id, level::INTEGER AS level, outcome_n, round(failure_rate, 6) AS failure_rate, round(median_raised, 4) AS median_raised, price_n, coverage, tier_a, tier_b, tier_c, revenue_n, round(revenue_multiple, 6) AS revenue_multiple, proxy_n, round(proxy_multiple, 6) AS proxy_multiple,
    CASE WHEN revenue_n > 0 THEN 'revenue_multiple' WHEN proxy_n > 0 THEN 'raise_proxy_multiple' END AS basis, CASE WHEN outcome_n >= 200 AND price_n >= 400 AND coverage >= 0.75 THEN 'high' WHEN outcome_n >= 50 AND price_n >= 120 AND coverage >= 0.55 THEN 'medium' ELSE 'low' END AS confidence FROM x WHERE r = 1""",
)
def comparable_cohorts(t):
    """Companies, some of an unknown sector or without sector, country or stage, and the narrowest cohort of deals that is large enough."""
    found = cohorts(t).drop("matched_n", "aligned_n")
    return found.withColumns({c: F.round(c, 4 if c == "median_raised" else 6) for c in ("failure_rate", "median_raised", "revenue_multiple", "proxy_multiple")})


def cohorts(t):
    k = F.col("company_id")
    sector, country = F.concat_ws("-", "sector", (k % 7).cast("string")), F.concat_ws("-", "country", (k % 11).cast("string"))
    deals = t.deals.select("deal_id", sector.alias("sector"), country.alias("country"), "stage", "failed", "amount", "pre_money")
    d = F.col("deal_id")
    tier = F.when(d % 4 == 0, "A").when(d % 4 == 1, "B").otherwise("C")
    prices = deals.where("pre_money > 0").select("*", F.col("pre_money").alias("price"), F.when(d % 3 != 0, F.col("amount") / 4).alias("revenue"), tier.alias("tier")).withColumn("weight", F.when(F.col("tier") == "A", 1.0).when(F.col("tier") == "B", 0.7).otherwise(0.35))
    targets = t.companies.select("company_id", F.when(k % 31 == 0, "NEW").when(k % 19 != 0, sector).alias("sector"), F.when(k % 23 != 0, country).alias("country"), F.when(k % 5 != 0, F.col("stage")).alias("stage"))
    return C.comparables(targets, deals, prices, "company_id")


_VALUED = f"""{_COHORTS}, every AS (SELECT att.company_id, arg_min(price_n, level) AS matched_n, max(price_n) FILTER (level = 4) AS stage_n FROM att JOIN p ON p.s IS NOT DISTINCT FROM att.s AND p.c IS NOT DISTINCT FROM att.c AND p.st IS NOT DISTINCT FROM att.st GROUP BY 1),
    official AS (SELECT company_id, count(*) AS signals FROM filings GROUP BY 1),
    fig AS (SELECT x.*, every.matched_n, CASE WHEN level < 5 THEN price_n ELSE coalesce(stage_n, price_n) END AS aligned_n, coalesce(signals, 0) AS signals, CASE WHEN outcome_n >= 200 AND price_n >= 400 AND coverage >= 0.75 THEN 'high' WHEN outcome_n >= 50 AND price_n >= 120 AND coverage >= 0.55 THEN 'medium' ELSE 'low' END AS own FROM x JOIN every USING (company_id) LEFT JOIN official USING (company_id) WHERE r = 1),
    fault AS (SELECT *, (coverage < 0.60)::INT AS a, (CASE WHEN price_n > 0 THEN tier_a / price_n ELSE 0 END < 0.30)::INT AS b, (revenue_n = 0 OR proxy_n / (revenue_n + proxy_n) > 0.55)::INT AS c_, (aligned_n > 0 AND aligned_n < 80)::INT AS d_, (matched_n > 0 AND matched_n < 80)::INT AS e, (signals < 20)::INT AS f, revenue_n > 0 OR proxy_n > 0 AS priced,
      CASE WHEN revenue_n >= 250 AND matched_n >= 80 AND own <> 'low' THEN 2 WHEN revenue_n >= 60 OR (revenue_n = 0 AND proxy_n >= 120) THEN 1 ELSE 0 END AS rank FROM fig),
    valued AS (SELECT company_id, CASE WHEN priced THEN a + b + c_ + d_ + 2 * e ELSE 0 END + f AS penalty, CASE WHEN NOT priced THEN 'low' WHEN rank - (a + b + c_ + d_ + e + f) >= 2 THEN 'high' WHEN rank - (a + b + c_ + d_ + e + f) = 1 THEN 'medium' ELSE 'low' END AS valuation FROM fault)"""


def valued_companies(t):
    """Each company's valuation confidence and penalty; its filings are the official signals."""
    signals = t.filings.groupBy("company_id").agg(F.count("*").alias("signals"))
    return C.valued(cohorts(t).join(signals, "company_id", "left"), F.col("signals")).select("company_id", "valuation", "penalty")


@query("cv3_penalties", f"WITH {_VALUED} SELECT company_id, valuation, penalty::INTEGER AS penalty FROM valued")
def penalties(t):
    return valued_companies(t)


_ORIGINS = ("sec_edgar", "Companies_House", "manual", "web", "sec_form_d")
_ORIGIN = "CASE {0} % 6 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_ORIGINS)) + " END"


@query(
    "cv2_pricing_sources",
    f"""WITH c AS (SELECT company_id, sector, country, stage, {_ORIGIN.format('company_id')} AS origin FROM companies), o AS (SELECT *, CASE WHEN lower(origin) IN ('sec_edgar', 'sec_dera_cf', 'companies_house', 'sec_cf_filings', 'transaction_rounds_truth') THEN 'A' WHEN lower(origin) IN ('sec_form_d', 'manual', 'academic') THEN 'B' ELSE 'C' END AS own FROM c),
    r AS (SELECT round_id AS id, company_id, sector, country, stage, CASE WHEN round_id % 10 = 0 THEN 0.0::DOUBLE ELSE pre_money END AS pre, CASE WHEN round_id % 2 = 0 THEN amount * 3 END AS cap, amount, CASE round_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' END AS tier, CASE round_id % 7 WHEN 0 THEN NULL ELSE round_id % 7 > 2 END AS gate, CASE round_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' END AS band,
      1 + round_id % 4 AS label, CASE round_id % 5 WHEN 0 THEN 'Seed' WHEN 1 THEN 'Series A' WHEN 2 THEN 'Series C' WHEN 3 THEN 'early' END AS kind, origin, own, round_date FROM rounds JOIN o USING (company_id)), q AS (SELECT *, CASE WHEN pre > 0 THEN pre ELSE cap END AS price, coalesce(pre, 0) = 0 AND cap > 0 AS proxy FROM r),
    a AS (SELECT company_id, max_by(amount / 4, round_date::VARCHAR || lpad(id::VARCHAR, 12, '0')) AS v FROM q WHERE label <= 2 AND id % 3 <> 0 GROUP BY 1), f AS (SELECT company_id, max_by(revenue, filing_date::VARCHAR || lpad(filing_id::VARCHAR, 12, '0')) AS v FROM filings WHERE form_type = 'C-AR' AND revenue > 0 GROUP BY 1),
    x AS (SELECT 'tx:' || id AS key, sector, country, stage, price, CASE WHEN id % 3 <> 0 THEN amount / 4 END AS revenue, amount, CASE WHEN coalesce(gate, false) THEN 'transaction_rounds_truth' ELSE 'transaction_rounds_truth:gate_failed' END AS source, CASE WHEN NOT coalesce(gate, false) OR band IS NULL THEN 'C' WHEN band = 'medium' AND tier = 'A' THEN 'B' ELSE coalesce(tier, 'C') END AS tier FROM q WHERE price > 0
      UNION ALL SELECT 'co:' || id, sector, country, stage, pre, CASE WHEN id % 3 <> 0 THEN amount / 4 END, amount, 'crowdfunding_outcomes:' || coalesce(origin, 'unknown'), CASE WHEN label >= 3 THEN 'C' WHEN label = 2 AND own = 'A' THEN 'B' ELSE own END FROM q WHERE pre > 0 AND label <= 3
      UNION ALL SELECT 'tfw:' || id || CASE WHEN coalesce(proxy, false) THEN ':cap' ELSE ':pre' END, sector, country, stage, price, CASE WHEN id % 3 <> 0 THEN amount / 4 END, amount, 'training_features' || CASE WHEN coalesce(proxy, false) THEN ':valuation_cap_proxy' ELSE '' END, CASE WHEN coalesce(proxy, false) THEN 'C' ELSE 'B' END FROM q WHERE price > 0
      UNION ALL SELECT 'round:' || id, sector, country, CASE kind WHEN 'Seed' THEN 'seed' WHEN 'Series A' THEN 'early_growth' WHEN 'early' THEN 'early_growth' END, price, coalesce(a.v, f.v), amount, 'funding_rounds:' || CASE WHEN id % 8 = 0 THEN 'press' ELSE lower(coalesce(origin, 'unknown')) END || CASE WHEN coalesce(proxy, false) THEN ':valuation_cap_proxy' ELSE '' END, CASE WHEN coalesce(proxy, false) THEN 'C' ELSE own END FROM q LEFT JOIN a USING (company_id) LEFT JOIN f USING (company_id) WHERE price > 0)
    SELECT *, CASE tier WHEN 'A' THEN 1.0::DOUBLE WHEN 'B' THEN 0.7::DOUBLE ELSE 0.35::DOUBLE END AS weight FROM x""",
)
def pricing_sources(t):
    origin = F.element_at(F.array(*map(F.lit, (*_ORIGINS, None))), (F.col("company_id") % 6 + 1).cast("int"))
    k = F.col("id")
    base = t.rounds.join(t.companies.select("company_id", "sector", "country", "stage", origin.alias("company_source")), "company_id").withColumnRenamed("round_id", "id").select(
        "id", "company_id", "sector", "country", "stage", "company_source", "amount", "round_date", F.when(k % 10 == 0, 0.0).otherwise(F.col("pre_money")).alias("pre_money"), F.when(k % 2 == 0, F.col("amount") * 3).alias("cap"), F.when(k % 3 != 0, F.col("amount") / 4).alias("revenue"),
        F.when(k % 4 == 0, "A").when(k % 4 == 1, "B").when(k % 4 == 2, "C").alias("tier"), F.when(k % 7 != 0, k % 7 > 2).alias("gate_pass"), F.when(k % 3 == 0, "high").when(k % 3 == 1, "medium").alias("band"), (1 + k % 4).alias("label_tier"),
        F.when(k % 5 == 0, "Seed").when(k % 5 == 1, "Series A").when(k % 5 == 2, "Series C").when(k % 5 == 3, "early").alias("round_type"), F.when(k % 8 == 0, "press").alias("source"),
    )
    annual = t.filings.where("form_type = 'C-AR'").select("company_id", "revenue", F.col("filing_date").alias("date"), F.col("filing_id").alias("id"))
    revenues = C.latest_revenues(base.withColumn("date", F.col("round_date")), annual)
    return C.pricing_cohort(base, base, base, base.drop("revenue"), revenues)


@query(
    "cv3_confidence",
    """WITH g AS (SELECT sector, country, count(*) AS n, count(pre_money) AS priced, avg(CASE round_id % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.7::DOUBLE ELSE 0.35::DOUBLE END) AS cover FROM (SELECT d.*, deal_id AS round_id FROM deals d) GROUP BY 1, 2),
    c AS (SELECT *, CASE WHEN n >= 200 AND priced >= 400 AND cover >= 0.75 THEN 'high' WHEN n >= 50 AND priced >= 120 AND cover >= 0.55 THEN 'medium' ELSE 'low' END AS source FROM g)
    SELECT sector, country, source, CASE WHEN (CASE source WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) - (cover < 0.69)::INT >= 2 THEN 'high' WHEN (CASE source WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) - (cover < 0.69)::INT = 1 THEN 'medium' ELSE 'low' END AS valuation FROM c""",
)
def confidence(t):
    w = F.when(F.col("deal_id") % 3 == 0, C.TIER_WEIGHT["A"]).when(F.col("deal_id") % 3 == 1, C.TIER_WEIGHT["B"]).otherwise(C.TIER_WEIGHT["C"])
    g = t.deals.groupBy("sector", "country").agg(F.count("*").alias("n"), F.count("pre_money").alias("priced"), F.avg(w).alias("cover"))
    g = g.withColumn("source", C.source_confidence(F.col("n"), F.col("priced"), F.col("cover")))
    return g.select("sector", "country", "source", C.downgraded(F.col("source"), F.col("cover") < 0.69).alias("valuation"))


@query(
    "cv4_scenarios",
    """WITH e AS (SELECT deal_id, CASE WHEN pre_money > 0 THEN pre_money / (amount / 4) END AS entry, CASE WHEN stage = 'seed' THEN 0.35::DOUBLE ELSE 0.55::DOUBLE END - CASE deal_id % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 0.03::DOUBLE ELSE 0.06::DOUBLE END AS k, CASE WHEN deal_id % 2 = 0 THEN 12.0::DOUBLE ELSE 8.0::DOUBLE END * CASE deal_id % 5 WHEN 0 THEN 0.75::DOUBLE WHEN 1 THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END AS x FROM deals)
    SELECT deal_id, round(entry, 6) AS entry_multiple, round(CASE WHEN entry IS NOT NULL THEN greatest(0.2::DOUBLE, k) END, 6) AS retention, round(least(25.0::DOUBLE, greatest(1.0::DOUBLE, x * 0.6) / entry * k), 6) AS bear_moic, round(least(25.0::DOUBLE, greatest(1.5::DOUBLE, x * 1.1) / entry * k), 6) AS base_moic, round(least(25.0::DOUBLE, greatest(3.0::DOUBLE, x * 2.2) / entry * k), 6) AS bull_moic FROM e WHERE entry IS NOT NULL
    UNION ALL SELECT deal_id, NULL, NULL, NULL, NULL, NULL FROM e WHERE entry IS NULL""",
)
def scenarios(t):
    k = F.col("deal_id")
    sure = F.when(k % 3 == 0, "high").when(k % 3 == 1, "medium").otherwise("low")
    signal = F.when(k % 5 == 0, "aggressive").when(k % 5 == 1, "attractive").otherwise("fair")
    s = C.scenario(F.col("pre_money"), F.col("amount") / 4, F.col("stage"), sure, F.when(k % 2 == 0, 12.0), signal)
    return t.deals.select("deal_id", *[F.round(v, 6).alias(n) for n, v in s.items()])


@query("cv5_realised", "SELECT deal_id, coalesce(CASE WHEN deal_id % 9 = 0 THEN 2.5::DOUBLE END, CASE outcome WHEN 'failed' THEN 0.0::DOUBLE WHEN 'trading' THEN 1.0::DOUBLE WHEN 'exited' THEN 3.0::DOUBLE END) AS multiple FROM deals")
def realised(t):
    return t.deals.select("deal_id", C.realised(F.col("outcome"), F.when(F.col("deal_id") % 9 == 0, 2.5)).alias("multiple"))


def rubric_inputs():
    k = F.col("deal_id")
    some = lambda n, v: F.when(k % n != 0, v)
    return {
        "ml": F.col("score"), "text": some(4, (k % 97).cast("double")), "founder": some(4, (k % 101).cast("double")), "problem": some(4, (k % 89).cast("double")), "depth": some(4, (k % 83).cast("double")),
        "revenue": F.when(F.col("has_revenue"), F.col("amount") / 4), "pre_revenue": ~F.col("has_revenue"), "growth": some(3, (k % 30 - 5) / F.lit(10.0)), "over": some(5, (k % 35) / F.lit(10.0)), "target": F.col("amount") * 0.8, "raised": F.col("amount"),
        "signal": F.when(k % 5 == 0, "aggressive").when(k % 5 == 1, "attractive").otherwise("fair"), "instrument": F.when(k % 4 == 0, "convertible_note").when(k % 4 == 1, "safe").otherwise("equity"), "cap": some(2, F.lit(5e6)), "discount": some(6, (k % 40) / F.lit(100.0)), "maturity": some(3, F.lit("2030-01-01")), "interest": some(9, (k % 20) / F.lit(100.0)), "preference": some(5, (k % 3).cast("double")),
        "participation": F.when(k % 6 == 0, "participating").when(k % 6 == 1, "non_participating"), "pro_rata": F.when(k % 7 == 0, True).when(k % 7 == 1, False), "multiple": some(10, k / F.lit(7.0)), "cohort_multiple": some(11, F.lit(6.0)),
        "investors": some(7, k % 400), "days": some(8, k % 120), "debt": F.col("amount") * (k % 10), "assets": F.col("amount") * 10, "cash": F.col("amount") - 50000, "institution": F.col("has_institution"), "sector": F.col("sector"), "pre_money": F.col("pre_money"),
    }


_RUBRIC = """x AS (SELECT deal_id, score AS ml, has_revenue, CASE WHEN deal_id % 4 <> 0 THEN (deal_id % 97)::DOUBLE END AS text_, CASE WHEN deal_id % 4 <> 0 THEN (deal_id % 101)::DOUBLE END AS founder, CASE WHEN deal_id % 4 <> 0 THEN (deal_id % 89 + deal_id % 83)::DOUBLE / 2 END AS md,
      CASE WHEN deal_id % 3 <> 0 THEN (deal_id % 30 - 5) / 10.0::DOUBLE END AS g, CASE WHEN deal_id % 5 <> 0 THEN (deal_id % 35) / 10.0::DOUBLE END AS o, deal_id AS k, amount, has_institution, deal_id % 4 AS inst, CASE WHEN deal_id % 6 <> 0 THEN (deal_id % 40) / 100.0::DOUBLE END AS disc,
      CASE WHEN deal_id % 7 <> 0 THEN deal_id % 400 END AS inv, CASE WHEN deal_id % 8 <> 0 THEN deal_id % 120 END AS days, amount * (deal_id % 10) / (amount * 10) AS dta FROM deals),
    c AS (SELECT *, CASE WHEN text_ IS NULL OR text_ = 0 THEN 35.0::DOUBLE ELSE text_ END AS text_score,
      CASE WHEN NOT has_revenue THEN 30.0::DOUBLE ELSE least(100.0::DOUBLE, 35 + 15 + CASE WHEN g > 1 THEN 20 WHEN g > 0.5 THEN 15 WHEN g > 0.2 THEN 10 WHEN g > 0 THEN 5 WHEN g IS NOT NULL THEN -5 ELSE 0 END + CASE WHEN o > 1 THEN least(15.0::DOUBLE, (o - 1) * 10) ELSE 0.0::DOUBLE END) END AS traction,
      greatest(0.0::DOUBLE, least(100.0::DOUBLE, 35 + 10 + CASE k % 5 WHEN 0 THEN -20 WHEN 1 THEN 20 ELSE 8 END + CASE WHEN inst > 1 THEN 4 ELSE -4 + CASE WHEN k % 2 <> 0 THEN 4 ELSE -6 END + CASE WHEN disc BETWEEN 0.1 AND 0.25 THEN 3 WHEN disc > 0.35 OR disc < 0.05 THEN -2 WHEN disc IS NULL THEN -3 ELSE 0 END + CASE WHEN inst = 0 THEN CASE WHEN k % 3 <> 0 THEN 1 ELSE -2 END ELSE 0 END END
        + CASE WHEN k % 9 <> 0 AND k % 20 > 12 THEN -4 WHEN k % 9 <> 0 AND k % 20 > 8 THEN -2 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 0 WHEN k % 3 = 2 THEN -8 WHEN k % 3 = 1 THEN 2 ELSE 0 END + CASE WHEN k % 6 = 0 THEN -6 ELSE 0 END + CASE k % 7 WHEN 0 THEN 3 WHEN 1 THEN -1 ELSE 0 END
        + CASE WHEN inv > 300 THEN -8 WHEN inv > 150 THEN -4 ELSE 0 END + CASE WHEN days <= 14 THEN 8 WHEN days <= 30 THEN 4 WHEN days > 90 THEN -4 ELSE 0 END))::DOUBLE AS terms,
      least(100.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(35 + (founder - 50) / 50 * 30, 35.0::DOUBLE))) AS team,
      (35 + CASE WHEN dta < 0.3 THEN 15 WHEN dta < 0.5 THEN 10 WHEN dta < 0.8 THEN 5 ELSE -10 END + CASE WHEN amount - 50000 > 100000 THEN 10 WHEN amount - 50000 > 0 THEN 5 ELSE 0 END)::DOUBLE AS financial,
      (35 + CASE WHEN has_institution THEN 15 ELSE 0 END + CASE WHEN o > 2 THEN 10 WHEN o > 1.5 THEN 5 ELSE 0 END)::DOUBLE AS signal, least(100.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(35 + (md - 50) / 50 * 25, 35.0::DOUBLE))) AS market FROM x)"""


@query("sc1_rubric", f"WITH {_RUBRIC} SELECT deal_id, round(text_score, 6) AS text, round(traction, 6) AS traction, terms, round(team, 6) AS team, financial, signal, round(market, 6) AS market FROM c")
def rubric(t):
    return t.deals.select("deal_id", *[F.round(v, 6).alias(k) for k, v in R.rubric(rubric_inputs()).items()])


@query("sc1_overall", f"WITH {_RUBRIC} SELECT deal_id, greatest(0, least(100, floor(ml * 0.6::DOUBLE + (0.20 * text_score + 0.18 * traction + 0.15 * terms + 0.15 * team + 0.12 * financial + 0.10 * signal + 0.10 * market) * 0.4::DOUBLE + 0.5)))::BIGINT AS overall FROM c WHERE deal_id % 4 <> 0 OR true")
def overall(t):
    d = rubric_inputs()
    return t.deals.select("deal_id", R.overall(d["ml"], R.rubric(d)).alias("overall"))


@query(
    "sc1_completeness",
    """WITH n AS (SELECT deal_id, deal_id % 4 <> 0 AS has_text, (has_revenue::INT + 5 + (deal_id % 5 <> 0)::INT + (pre_money IS NOT NULL)::INT + 1 + (deal_id % 7 <> 0)::INT + (deal_id % 8 <> 0)::INT + (deal_id % 10 <> 0)::INT + (deal_id % 11 <> 0)::INT + (sector IS NOT NULL)::INT + (deal_id % 3 <> 0)::INT + (deal_id % 4 <> 0)::INT) / 16 AS c FROM deals)
    SELECT deal_id, round(c, 6) AS completeness, CASE WHEN c > 0.8 AND has_text THEN 8 WHEN c > 0.5 AND has_text THEN 15 WHEN c > 0.5 THEN 20 ELSE 25 END::INTEGER AS margin FROM n""",
)
def completeness(t):
    d = rubric_inputs()
    known = R.completeness(d)
    return t.deals.select("deal_id", F.round(known, 6).alias("completeness"), R.confidence_range(known, d["text"].isNotNull()).alias("margin"))


def gate_inputs():
    k = F.col("deal_id")
    return {
        "completeness": (k % 10) / F.lit(10.0), "ml": F.col("score"), "conflicts": (k % 6 == 0).cast("int"), "sample": F.lit(250), "release_open": k % 8 != 0, "auc": F.lit(0.7), "ece": F.lit(0.05),
        "valuation": F.when(k % 9 == 0, "low").otherwise("medium"), "disqualified": k % 31 == 0, "administration": k % 37 == 0, "sanctioned": k % 41 == 0, "overdue": k % 13 == 0,
    }


_GATES = """h AS (SELECT *, deal_id % 31 = 0 OR deal_id % 37 = 0 OR deal_id % 41 = 0 AS kill, (deal_id % 10) / 10.0 < 0.4 OR deal_id % 6 = 0 OR deal_id % 8 = 0 OR deal_id % 9 = 0
    OR NOT (CASE WHEN score <= 0 OR score >= 100 THEN 0.0 ELSE -((1 - score / 100) * log2(1 - score / 100) + (1 - (1 - score / 100)) * log2(1 - (1 - score / 100))) END < 0.70) AS abstain, deal_id % 13 = 0 AS flagged FROM deals)"""


@query("sc2_gates", f"WITH {_GATES} SELECT deal_id, kill, abstain, NOT (kill OR abstain OR flagged) AS clear FROM h")
def gates(t):
    g = R.gates(gate_inputs())
    return t.deals.withColumn("g", g).select("deal_id", F.exists("g", lambda x: x["action"] == "reject").alias("kill"), F.exists("g", lambda x: x["action"] == "abstain").alias("abstain"), F.forall("g", lambda x: x["passed"]).alias("clear"))


@query("sc3_recommendation", f"WITH {_GATES} SELECT deal_id, CASE WHEN kill THEN 'pass' WHEN abstain THEN 'abstain' WHEN NOT flagged AND score >= 65 THEN 'invest' WHEN NOT flagged AND score >= 50 THEN 'deep_diligence' WHEN score >= 40 THEN 'watch' ELSE 'pass' END AS class FROM h")
def recommendation(t):
    return t.deals.withColumn("g", R.gates(gate_inputs())).select("deal_id", R.classify(F.col("score"), F.col("g")).alias("class"))


@query(
    "sc4_term_audit",
    """WITH p AS (SELECT round_id, pre_money AS a, CASE WHEN round_id % 2 = 0 THEN pre_money * 1.01 WHEN round_id % 5 = 0 THEN amount END AS b FROM rounds), s AS (SELECT *, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN abs(a - b) > 0.01 AND abs(a - b) / greatest(abs(a), abs(b), 1.0) > 0.025 THEN 'conflict' ELSE 'db_and_derived' END WHEN a IS NOT NULL THEN 'db_structured' WHEN b IS NOT NULL THEN 'derived_text' ELSE 'none' END AS pre_money FROM p)
    SELECT round_id, pre_money, ((pre_money = 'conflict')::INT + (pre_money NOT IN ('db_structured', 'db_and_derived'))::INT)::INTEGER AS penalty FROM s""",
)
def term_audit(t):
    k = F.col("round_id")
    s = R.term_sources({"pre_money": (F.col("pre_money"), F.when(k % 2 == 0, F.col("pre_money") * 1.01).when(k % 5 == 0, F.col("amount")))})
    return t.rounds.select("round_id", s["pre_money"].alias("pre_money"), R.term_penalty(s, F.lit("medium")).alias("penalty"))


@query(
    "sc5_readiness",
    """WITH c AS (SELECT deal_id AS k, [CASE WHEN NOT (k % 10) / 10 >= 0.60 THEN 'Data completeness is below 60%.' END, CASE WHEN k % 3 <> 0 THEN 'One or more reliability gates failed.' END, CASE WHEN k % 8 = 0 THEN 'Segment backtest evidence is insufficient.' END,
      CASE WHEN k % 5 = 0 THEN 'Quarterly evidence report is stale or not release-ready.' END, CASE WHEN k % 9 = 0 THEN 'Valuation confidence is low.' END, CASE WHEN k % 200 < 80 THEN 'Stage-country-sector comparable sample is below 80.' END,
      CASE WHEN k % 4 > 1 OR (k % 100) / 100 < 0.30 THEN 'Tier-A pricing evidence share is below 30% or source tier is too weak.' END, CASE WHEN (k % 20) / 20 < 0.85 THEN 'Core term completeness is below 85%.' END,
      CASE WHEN k % 6 = 0 THEN 'Valuation-critical term conflicts were detected across sources.' END, CASE WHEN k % 11 = 0 THEN 'Operational data fetch warnings were encountered.' END] AS r FROM (SELECT deal_id, deal_id AS k FROM deals)),
    n AS (SELECT k, list_filter(r, lambda x: x IS NOT NULL) AS r FROM c) SELECT k AS deal_id, (10 - len(r))::INTEGER AS passed, CASE WHEN len(r) = 0 THEN 'ready' WHEN len(r) <= 4 THEN 'caution' ELSE 'blocked' END AS status, array_to_string(r, ' ') AS reasons FROM n""",
)
def readiness(t):
    k = F.col("deal_id")
    d = {
        "completeness": k % 10 / 10, "failed_gates": k % 3, "segment_ok": k % 8 != 0, "quarter_ok": k % 5 != 0, "valuation": F.when(k % 9 == 0, "low").otherwise("medium"), "peers": k % 200,
        "tier": F.element_at(F.array(*map(F.lit, ("A", "B", "C", "unknown"))), (k % 4 + 1).cast("int")), "tier_a": k % 100 / 100, "core": k % 20 / 20, "conflicts": (k % 6 == 0).cast("int"), "warnings": (k % 11 == 0).cast("int"),
    }
    r = R.readiness(R.readiness_checks(d))
    return t.deals.select("deal_id", r["passed"].alias("passed"), r["status"].alias("status"), F.array_join(r["reasons"], " ").alias("reasons"))


@query("sc8_batch_score", f"WITH {_RUBRIC}, s AS (SELECT deal_id, greatest(0, least(100, floor(ml * 0.6::DOUBLE + (0.20 * text_score + 0.18 * traction + 0.15 * terms + 0.15 * team + 0.12 * financial + 0.10 * signal + 0.10 * market) * 0.4::DOUBLE + 0.5)))::BIGINT AS overall FROM c) SELECT deal_id, overall FROM s ORDER BY overall DESC, deal_id LIMIT 50")
def batch_score(t):
    d = rubric_inputs()
    return t.deals.select("deal_id", R.overall(d["ml"], R.rubric(d)).alias("overall")).orderBy(F.desc("overall"), "deal_id").limit(50)


@query("sc9_checklist", "SELECT deal_id, concat_ws('; ', CASE WHEN pre_money IS NULL THEN 'Confirm valuation' END, CASE WHEN equity IS NULL THEN 'Confirm equity share' END, CASE WHEN NOT has_revenue THEN 'Ask for revenue' END) AS todo FROM deals")
def checklist(t):
    items = F.array_compact(F.array(F.when(F.col("pre_money").isNull(), "Confirm valuation"), F.when(F.col("equity").isNull(), "Confirm equity share"), F.when(~F.col("has_revenue"), "Ask for revenue")))
    return t.deals.select("deal_id", F.array_join(F.slice(items, 1, 8), "; ").alias("todo"))


@query(
    "pl1_sufficiency",
    """WITH c AS (SELECT deal_id, deal_id AS k, 20 AS identity, (1 + has_revenue::INT + (k % 3 <> 0)::INT + (k % 5 <> 0)::INT + (k % 7 <> 0)::INT + (k % 2 = 0)::INT) / 6 AS f, (3 + (pre_money IS NOT NULL)::INT + (equity IS NOT NULL)::INT + (k % 10 >= 6)::INT + (k % 4 = 0)::INT) / 7 AS t,
      ((k % 3 = 0)::INT + (k % 5 = 0)::INT + (k % 7 <> 0)::INT + 1) / 4 AS m, ((k % 4 <> 0)::INT + (k % 6 <> 0)::INT) / 2 AS n FROM (SELECT *, deal_id AS k FROM deals)),
    g AS (SELECT *, round_even(f * 20, 0)::INT AS fi, round_even(t * 20, 0)::INT AS te, round_even(m * 20, 0)::INT AS tm, round_even(n * 20, 0)::INT AS na, CASE WHEN k % 9 <> 0 THEN least(10, round_even((k % 100) / 100 * 10, 0)::INT) ELSE least(10, (k % 13)::INT) END AS bonus FROM c)
    SELECT deal_id, least(100, identity + fi + te + tm + na + bonus)::INTEGER AS score, (1 + (fi >= 10)::INT + (te >= 10)::INT + (tm >= 10)::INT + (na >= 10)::INT)::INTEGER AS groups, fi AS financial, te AS terms, tm AS team, na AS narrative,
    concat_ws(',', CASE WHEN k % 3 <> 0 AND k % 5 <> 0 AND k % 7 = 0 THEN 'team_or_traction' END, CASE WHEN k % 4 = 0 AND k % 6 = 0 THEN 'narrative_or_text_score' END) AS missing FROM g""",
)
def sufficiency(t):
    k = F.col("deal_id")
    some = lambda known: F.when(known, 1)
    d = {
        "company_name": k, "country": F.col("country"), "campaign_date": F.col("deal_date"), "stage": F.col("stage"), "had_revenue": F.col("has_revenue"), "revenue": some(F.col("has_revenue")), "growth": some(k % 3 != 0), "assets": some(k % 5 != 0),
        "debt": some(k % 7 != 0), "burn": some(k % 2 == 0), "target": F.col("amount"), "raised": F.col("amount"), "pre_money": F.col("pre_money"), "equity": F.col("equity"), "instrument": F.lit("safe"), "core": k % 10 / 10, "gate_pass": k % 4 == 0,
        "founders": some(k % 3 == 0), "employees": some(k % 5 == 0), "investors": some(k % 7 != 0), "age_months": k, "text_score": some(k % 4 != 0), "excerpt": some(k % 6 != 0),
    }
    s = R.sufficiency(R.evidence_groups(d), F.when(k % 9 != 0, k % 100 / 100), k % 13)
    return t.deals.select("deal_id", *[s[c].alias(c) for c in ("score", "groups", "financial", "terms", "team", "narrative")], F.array_join(R.missing_required(d), ",").alias("missing"))


@query(
    "pl2_seed_score",
    """WITH x AS (SELECT deal_id, (deal_id % 101)::DOUBLE AS e, has_revenue, has_institution, amount, pre_money, CASE WHEN has_revenue THEN pre_money / (amount / 4) END AS m FROM deals),
    s AS (SELECT deal_id, e, least(100.0::DOUBLE, greatest(0.0::DOUBLE, 35.0 + (e - 50.0) * 0.35 + CASE WHEN has_revenue THEN 16 ELSE -8 END + CASE WHEN has_institution THEN 10 ELSE 0 END + CASE WHEN m > 40 THEN -12 WHEN m > 25 THEN -8 WHEN m < 8 THEN 3 ELSE 0 END + CASE WHEN deal_id % 17 = 0 THEN -12 ELSE 0 END)) AS s FROM x)
    SELECT deal_id, round(s, 6) AS seed, CASE WHEN e < 45 THEN 'abstain' WHEN s >= 72 THEN 'invest' WHEN s >= 58 THEN 'deep_diligence' WHEN s >= 42 THEN 'watch' ELSE 'pass' END AS class FROM s""",
)
def seed_score(t):
    e = (F.col("deal_id") % 101).cast("double")
    none = F.lit(None).cast("double")
    d = {"had_revenue": F.col("has_revenue"), "revenue": F.when(F.col("has_revenue"), F.col("amount") / 4), "valuation": F.col("pre_money"), "growth": none, "over": none, "institution": F.col("has_institution"), "disqualified": F.lit(0), "overdue": F.col("deal_id") % 17 == 0}
    s = R.seed_score(e, d)
    return t.deals.select("deal_id", F.round(s, 6).alias("seed"), R.seed_class(e, F.lit(2), s).alias("class"))


@query(
    "pl3_personas",
    """WITH l AS (SELECT company_id, max({'d': round_date, 'i': round_id, 'a': pre_money}) AS m FROM rounds GROUP BY 1),
    s AS (SELECT deal_id, CASE WHEN coalesce(CASE WHEN equity > 0.05 THEN d.amount ELSE equity END, 0) <> 0 THEN 1 ELSE 0 END + CASE WHEN coalesce(m.a, 0) <> 0 THEN 1 ELSE 0 END + CASE WHEN has_institution AND has_revenue THEN 2 WHEN has_institution THEN -1 ELSE 0 END + CASE WHEN deal_id % 7 <> 0 THEN 1 ELSE 0 END AS s FROM deals d LEFT JOIN l USING (company_id))
    SELECT deal_id, s::INTEGER AS score, CASE WHEN s >= 3 THEN 'deep_diligence' WHEN s >= 1 THEN 'watch' ELSE 'pass' END AS conservative, CASE WHEN s >= 4 THEN 'invest' WHEN s >= 2 THEN 'deep_diligence' WHEN s >= 1 THEN 'watch' ELSE 'pass' END AS balanced, CASE WHEN s >= 4 THEN 'invest' WHEN s >= 2 THEN 'deep_diligence' ELSE 'watch' END AS aggressive,
    CASE WHEN s >= 3 THEN 55 WHEN s >= 1 THEN 45 ELSE 35 END::INTEGER AS sure_conservative, CASE WHEN s >= 4 THEN 70 WHEN s >= 2 THEN 58 WHEN s >= 1 THEN 48 ELSE 38 END::INTEGER AS sure_balanced, CASE WHEN s >= 4 THEN 78 WHEN s >= 2 THEN 64 ELSE 52 END::INTEGER AS sure_aggressive FROM s""",
)
def personas(t):
    """Deals with unknown, zero and known amounts, the latest round of their company, revenue that may be unknown, and stages."""
    last = t.rounds.groupBy("company_id").agg(F.max(F.struct("round_date", "round_id", "pre_money"))["pre_money"].alias("latest"))
    amount = F.when(F.col("equity") > 0.05, F.col("amount")).otherwise(F.col("equity"))
    score = R.persona_score(amount, F.col("latest"), F.when(F.col("has_institution"), F.col("has_revenue")), F.when(F.col("deal_id") % 7 != 0, F.col("stage")).otherwise("series_c"))
    d = t.deals.join(last, "company_id", "left").select("deal_id", score.alias("score"))
    kinds = {k: R.persona(k, F.col("score")) for k in ("conservative", "balanced", "aggressive")}
    return d.select("deal_id", "score", *[v["class"].alias(k) for k, v in kinds.items()], *[v["conviction"].alias(f"sure_{k}") for k, v in kinds.items()])


@query(
    "ops1_alerts",
    """WITH rep AS (SELECT date_trunc('quarter', round_date)::DATE AS q, count(*) % 2 = 0 AS ready FROM rounds GROUP BY 1), last AS (SELECT * FROM rep ORDER BY q DESC LIMIT 1),
    seg AS (SELECT sector || '_' || country AS segment, abs(avg(failed) - 0.2::DOUBLE) AS ece, 0.6::DOUBLE + avg(score) / 1000 AS auc, count(*) % 3 <> 0 AS open FROM deals GROUP BY 1),
    win AS (SELECT sector AS segment, 'y' || year(deal_date) AS label, max(deal_date) AS test_end, 1 + avg(score) / 150 AS quality, avg(failed) * 3.4::DOUBLE AS failure FROM deals GROUP BY 1, 2), lw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY test_end DESC, label DESC) AS r FROM win) WHERE r = 1),
    qa AS (SELECT priority AS field, CASE WHEN round_id % 11 <> 0 THEN round_id % 7 <> 0 END AS ok FROM rounds WHERE round_date >= DATE '1998-08-02' - 84),
    a AS (SELECT 'evidence_missing' AS type, 'critical' AS priority, 'evidence_missing' AS k WHERE NOT EXISTS (SELECT 1 FROM rep) UNION ALL SELECT 'evidence_gate_closed', 'critical', 'evidence_gate_closed:' || q FROM last WHERE NOT ready UNION ALL SELECT 'evidence_stale', 'high', 'evidence_stale:' || q FROM last WHERE q < date_trunc('quarter', DATE '1998-12-31')
      UNION ALL SELECT 'segment_drift', 'high', 'segment_drift:' || segment FROM seg WHERE ece > 0.10 OR auc < 0.65 OR NOT open UNION ALL SELECT 'backtest_regression', 'high', 'backtest_regression:' || segment || ':' || label FROM lw WHERE quality <= 1.3 OR failure >= 0.7
      UNION ALL SELECT 'transaction_qa_drift', 'high', 'transaction_qa_drift:' || field FROM qa WHERE ok IS NOT NULL GROUP BY field HAVING count(*) >= 10 AND avg(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) < 0.85)
    SELECT type, priority, k AS dedupe_key FROM a WHERE k NOT IN (SELECT 'segment_drift:' || sector || '_US' FROM companies WHERE sector <> 'MACHINERY')""",
)
def alerts(t):
    d = t.deals
    reports = t.rounds.groupBy(F.trunc("round_date", "quarter").alias("report_quarter")).agg((F.count("*") % 2 == 0).alias("ready"))
    segments = d.groupBy(F.concat_ws("_", "sector", "country").alias("segment")).agg(F.abs(F.avg("failed") - 0.2).alias("ece"), (0.6 + F.avg("score") / 1000).alias("auc"), (F.count("*") % 3 != 0).alias("open"))
    windows = d.groupBy(F.col("sector").alias("segment"), F.concat(F.lit("y"), F.year("deal_date")).alias("label")).agg(F.max("deal_date").alias("test_end"), (1 + F.avg("score") / 150).alias("quality"), (F.avg("failed") * 3.4).alias("failure"))
    audits = t.rounds.select(F.col("priority").alias("field"), F.when(F.col("round_id") % 11 != 0, F.col("round_id") % 7 != 0).alias("is_match"), F.date_add("round_date", 151).alias("week"))
    active = t.companies.where("sector <> 'MACHINERY'").select(F.concat(F.lit("segment_drift:"), "sector", F.lit("_US")).alias("dedupe_key")).distinct()
    return O.new_alerts(O.system_checks(reports, segments, windows, audits, "1998-12-31"), active)


@query("ops3_delivery", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'sent' WHEN event_type = 'error' THEN 'send_now' WHEN hour(ts) >= 22 OR hour(ts) < 7 THEN 'held' WHEN value > 50 THEN 'queued' ELSE 'waiting' END AS state FROM events")
def delivery(t):
    from granary.functions.parsing import is_quiet

    return t.events.select("event_id", O.delivery(F.col("value") > 50, is_quiet(F.hour("ts"), 22, 7), F.when(F.col("event_type") == "error", "high").otherwise("normal"), F.col("event_id") % 5 == 0).alias("state"))


_EVIDENCE = """seg AS (SELECT country || '_' || CASE stage WHEN 'seed' THEN 'Seed' ELSE 'EarlyGrowth' END AS segment, deal_id, company_id, deal_date, score, failed, amount, pre_money, year(deal_date) AS y FROM deals),
    s AS (SELECT segment, count(*) AS sample, round(0.5 + avg(failed), 6) AS auc, round(avg(failed) / 4, 6) AS ece, segment <> 'UK_Seed' AS gate_open FROM seg GROUP BY 1),
    w AS (SELECT segment, y, round(avg(failed), 6) AS rate, row_number() OVER (PARTITION BY segment ORDER BY y DESC) AS r FROM seg GROUP BY 1, 2), last5 AS (SELECT segment, count(*) AS windows, string_agg(y::VARCHAR, ',' ORDER BY y DESC) AS years FROM w WHERE r <= 5 GROUP BY 1),
    c AS (SELECT segment, floor(score / 10) AS bin, count(*) AS n, abs(avg(failed) - avg(score) / 100) AS err FROM seg GROUP BY 1, 2), cu AS (SELECT segment, round(sum(err * n) / sum(n), 6) AS curve_error FROM c GROUP BY 1),
    v AS (SELECT segment, y, CASE WHEN deal_id % 3 = 0 THEN 'high' ELSE 'low' END AS conf, count(*) AS n, round(avg(abs(pre_money - amount) / amount) / 6, 6) AS mae, round(avg(abs(pre_money - amount) / pre_money) / 2, 6) AS mape FROM seg WHERE pre_money IS NOT NULL GROUP BY 1, 2, 3),
    hi AS (SELECT segment, n >= 30 AND mae <= 1.0 AND mape <= 0.55 AS allowed, n, mae, mape FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY y DESC) AS r FROM v WHERE conf = 'high' AND y <= 1998) WHERE r = 1),
    held AS (SELECT count(DISTINCT company_id) AS n FROM deals WHERE deal_date >= DATE '1998-01-01')"""


@query(
    "ops4_release_readiness",
    f"""WITH {_EVIDENCE}, e AS (SELECT s.*, sample >= 200 AND gate_open AND auc >= 0.65 AND ece <= 0.10 AS evidence_ok, windows, years, curve_error, hi.n AS high_n, mae AS high_mae, mape AS high_mape, coalesce(allowed, false) AS high_allowed FROM s LEFT JOIN last5 USING (segment) LEFT JOIN cu USING (segment) LEFT JOIN hi USING (segment))
    SELECT e.*, held.n AS holdout_entities, bool_and(evidence_ok) OVER () AND bool_and(high_allowed) OVER () AND held.n > 0 AS release_ready FROM e, held""",
)
def release(t):
    """Segments with their sample, windows, calibration curves and valuation errors, and whether all of it allows a release."""
    segment = F.concat_ws("_", "country", F.when(F.col("stage") == "seed", "Seed").otherwise("EarlyGrowth"))
    seg = t.deals.select(segment.alias("segment"), "deal_id", "company_id", "deal_date", "score", "failed", "amount", "pre_money", F.year("deal_date").alias("y"))
    own = seg.groupBy("segment").agg(F.count("*").alias("sample"), F.round(0.5 + F.avg("failed"), 6).alias("auc"), F.round(F.avg("failed") / 4, 6).alias("ece")).withColumn("gate_open", F.col("segment") != "UK_Seed")
    windows = seg.groupBy("segment", F.col("y").alias("test_end")).agg(F.avg("failed").alias("rate"))
    curves = seg.groupBy("segment", F.floor(F.col("score") / 10).alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg("failed") - F.avg("score") / 100).alias("abs_error"))
    priced = seg.where("pre_money is not null")
    off = F.abs(F.col("pre_money") - F.col("amount"))
    values = priced.groupBy("segment", F.col("y").alias("quarter"), F.when(F.col("deal_id") % 3 == 0, "high").otherwise("low").alias("confidence")).agg(F.count("*").alias("n"), F.round(F.avg(off / F.col("amount")) / 6, 6).alias("mae"), F.round(F.avg(off / F.col("pre_money")) / 2, 6).alias("mape"))
    held = t.deals.where("deal_date >= date '1998-01-01'").select("company_id").distinct()
    found = O.evidence_report(own, windows, curves, values.where("quarter <= 1998"), held)
    return found.withColumns({"curve_error": F.round("curve_error", 6), "years": F.array_join("windows", ","), "windows": F.size("windows").cast("long")})


@query("ops5_freeze_drift", "SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'added' WHEN n_nationkey % 3 = 0 THEN 'changed' ELSE 'same' END AS state FROM nation")
def freeze(t):
    saved = t.nation.where("n_nationkey % 5 <> 0").select("n_nationkey", F.when(F.col("n_nationkey") % 3 == 0, "old").otherwise(F.col("n_name")).alias("n_name"))
    return O.frozen(t.nation.select("n_nationkey", "n_name"), saved, "n_nationkey", "n_name")


@query("ops7_candidates", "SELECT company_id, origin FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY o) AS r FROM (SELECT company_id, 0 AS o, 'recent' AS origin FROM rounds WHERE round_date >= DATE '1998-06-01' UNION ALL SELECT company_id, 1, 'fallback' FROM companies WHERE balance > 9000)) WHERE r = 1")
def candidates(t):
    recent = t.rounds.where("round_date >= date '1998-06-01'").select("company_id").distinct().withColumn("origin", F.lit("recent"))
    return C.first_of_sources([recent, t.companies.where("balance > 9000").select("company_id", F.lit("fallback").alias("origin"))], "company_id")


@query("ops9_growth", "SELECT company_id, round((b - a) / nullif(abs(a), 0), 6) AS growth FROM (SELECT company_id, sum(amount) FILTER (year(round_date) = 1996) AS a, sum(amount) FILTER (year(round_date) = 1997) AS b FROM rounds GROUP BY 1)")
def growth(t):
    y = F.year("round_date")
    s = t.rounds.groupBy("company_id").agg(F.sum(F.when(y == 1996, F.col("amount"))).alias("a"), F.sum(F.when(y == 1997, F.col("amount"))).alias("b"))
    return s.select("company_id", F.round(F.try_divide(F.col("b") - F.col("a"), F.abs("a")), 6).alias("growth"))


@query("ops11_activity", "SELECT kind, id, seen FROM (SELECT 'round' AS kind, round_id AS id, round_date AS seen FROM rounds UNION ALL SELECT 'filing', filing_id, filing_date FROM (SELECT DISTINCT filing_id, filing_date FROM filings) UNION ALL SELECT 'fact', fact_id, as_of_date FROM facts) ORDER BY seen DESC, kind, id LIMIT 200")
def activity(t):
    part = lambda df, kind, key, at: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(at).alias("seen"))
    rows = part(t.rounds, "round", "round_id", "round_date").unionByName(part(t.filings.select("filing_id", "filing_date").distinct(), "filing", "filing_id", "filing_date")).unionByName(part(t.facts, "fact", "fact_id", "as_of_date"))
    return rows.orderBy(F.desc("seen"), "kind", "id").limit(200)
