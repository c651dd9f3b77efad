"""Queries of the composite plans: spines, enrichment, inference, pilots, retention and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import aggregates as A
from granary.operators import joins as J
from granary.operators import upserts as U
from granary.operators import windows as V
from granary.plans import backtest as B
from granary.plans import entities as E
from granary.plans import inference as I
from granary.plans import labels as L
from granary.plans import pilot as P
from granary.plans import runs as H
from granary.plans import scoring as R
from granary.plans import spine as N
from granary.queries.analytics import WINDOWS
from granary.queries.base import query
from granary.queries.plans import _GATES, _RUBRIC, _SPLIT, _VALUED, gate_inputs, rubric_inputs, tested, valued_companies

_FIN = "fin AS (SELECT company_id, filing_date AS period_end, max(revenue) AS cash, max(staff) * 100 AS burn FROM filings WHERE form_type = 'C' GROUP BY 1, 2)"


def financials(t):
    return t.filings.where("form_type = 'C'").groupBy("company_id", F.col("filing_date").alias("period_end")).agg(F.max("revenue").alias("cash"), (F.max("staff") * 100).alias("burn"))


@query(
    "tt1_round_facts",
    f"""WITH {_FIN}, r AS (SELECT round_id, company_id % 200 AS company_id, round_date, amount, pre_money FROM rounds), b AS (SELECT r.round_id, max({{'d': period_end, 'c': cash, 'b': burn}}) AS m FROM r JOIN fin f ON f.company_id = r.company_id AND period_end <= round_date GROUP BY 1),
    w AS (SELECT r.round_id, amount, pre_money, b.m.c AS cash, b.m.b AS burn, b.m.c / nullif(b.m.b, 0) AS runway FROM r LEFT JOIN b ON b.round_id = r.round_id)
    SELECT round_id, field, value FROM (UNPIVOT w ON amount, pre_money, cash, burn, runway INTO NAME field VALUE value)""",
)
def round_facts(t):
    rounds = t.rounds.withColumn("company_id", F.col("company_id") % 200)
    return N.round_facts(rounds, financials(t))


#: Sentences of offering texts by the round's number k: when they stand, what they say, and the term as a number or as words in SQL.
_SENTENCES = (
    ("k % 2 = 0", "concat('A valuation cap of $', k % 9 + 1, ' million; ')", "valuation_cap", "(k % 9 + 1) * 1000000.0::DOUBLE", None),
    ("k % 3 = 0", "'with a discount rate of 15%; '", "discount_rate", "0.15::DOUBLE", None),
    ("k % 5 = 0", "'bearing an interest rate of 6%; '", "interest_rate", "0.06::DOUBLE", None),
    ("k % 7 = 0", "concat('at a pre-money valuation of $', k % 40 + 1, ' million; ')", "pre_money", "(k % 40 + 1) * 1000000.0::DOUBLE", None),
    ("k % 11 = 0", "concat('a post-money valuation of $', k % 50 + 2, ' million; ')", "post_money", "(k % 50 + 2) * 1000000.0::DOUBLE", None),
    ("k % 6 = 0", "'a 1x liquidation preference; '", "liquidation_pref", "1.0::DOUBLE", None),
    ("k % 8 = 0", "'maturity date: 2026-05-01; '", "maturity_date", None, "'2026-05-01'"),
    ("k % 10 IN (3, 7)", "CASE WHEN k % 10 = 3 THEN 'non-participating preferred; ' ELSE 'participating preferred; ' END", "participation", None, "CASE WHEN k % 10 = 3 THEN 'non_participating' ELSE 'participating' END"),
    ("k % 4 IN (1, 3)", "CASE WHEN k % 4 = 1 THEN 'pro rata rights apply; ' ELSE 'no pro rata rights; ' END", "pro_rata", None, "CASE WHEN k % 4 = 1 THEN 'true' ELSE 'false' END"),
    ("k % 13 = 0", "'led by Example Ventures; '", "lead_investor", None, "'Example Ventures'"),
)
_OPENING = "Offering statement of the issuer named herein; the securities are offered under the usual exemptions and carry the rights described in the attached agreement and in its exhibits, to which the reader is referred; "
_TEXT = f"concat(CASE WHEN k % 9 = 4 THEN 'Offering statement; ' ELSE '{_OPENING}' END, " + ", ".join(f"CASE WHEN {when} THEN {says} ELSE '' END" for when, says, *_ in _SENTENCES) + ")"
_TERM_ROWS = " UNION ALL ".join(f"SELECT text_id, '{field}' AS field, {number or 'NULL::DOUBLE'} AS number, {said or 'NULL'} AS said FROM long WHERE {when}" for when, _, field, number, said in _SENTENCES)


@query(
    "tt3_narrative_terms",
    f"""WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS text_id, CASE WHEN l_linenumber % 3 <> 0 THEN l_partkey % 700 END AS company_id, CASE WHEN l_linenumber <> 5 THEN '00' || (l_suppkey * 7 + l_linenumber) % 500 END AS cik, l_shipdate::DATE AS filed, l_orderkey AS k, {_TEXT} AS text FROM lineitem),
    long AS (SELECT *, nullif(ltrim(cik, '0'), '') AS number FROM x WHERE length(text) >= 180), r AS (SELECT round_id, company_id, nullif(cik::VARCHAR, '0') AS number, CASE WHEN round_id % 50 <> 7 THEN round_date END AS round_date FROM rounds JOIN companies USING (company_id) WHERE country = 'US'),
    own AS (SELECT round_id, max({{'d': filed, 'i': text_id}}) AS m FROM r JOIN long ON long.company_id = r.company_id AND filed <= coalesce(round_date, DATE '9999-12-31') GROUP BY 1), other AS (SELECT round_id, max({{'d': filed, 'i': text_id}}) AS m FROM r JOIN long ON long.number = r.number AND filed <= coalesce(round_date, DATE '9999-12-31') GROUP BY 1),
    chosen AS (SELECT round_id, coalesce(own.m, other.m) AS m FROM r LEFT JOIN own USING (round_id) LEFT JOIN other USING (round_id)), facts_ AS ({_TERM_ROWS})
    SELECT round_id, field, number, said, text_id, m.d AS as_of, 'B' AS tier FROM chosen JOIN facts_ ON text_id = m.i""",
)
def narrative_terms(t):
    line = F.col("l_linenumber")
    texts = t.lineitem.select(
        (F.col("l_orderkey") * 10 + line).alias("text_id"),
        F.when(line % 3 != 0, F.col("l_partkey") % 700).alias("company_id"),
        F.when(line != 5, F.concat(F.lit("00"), ((F.col("l_suppkey") * 7 + line) % 500).cast("string"))).alias("cik"),
        F.to_date("l_shipdate").alias("filed"),
        F.col("l_orderkey").alias("k"),
    ).withColumn("text", F.expr(_TEXT.replace("'", '"')))
    rounds = t.rounds.join(t.companies.select("company_id", "cik", "country"), "company_id").withColumn("round_date", F.when(F.col("round_id") % 50 != 7, F.col("round_date")))
    return N.narrative_terms(rounds, texts)


@query(
    "lb4_cross_reference",
    """SELECT c.company_id, CASE WHEN f.cik IS NOT NULL THEN 'trading' ELSE 'unknown' END AS outcome, CASE WHEN f.cik IS NOT NULL THEN 2 ELSE 3 END::INTEGER AS tier FROM (SELECT company_id, cik, min(round_date) AS d FROM companies JOIN rounds USING (company_id) GROUP BY 1, 2) c
    LEFT JOIN (SELECT DISTINCT cik FROM filings WHERE form_type = 'C-TR') f ON f.cik = c.cik WHERE c.company_id NOT IN (SELECT company_id FROM companies WHERE outcome = 'exited') AND (f.cik IS NOT NULL OR d < DATE '1998-06-01')""",
)
def cross_reference(t):
    first = t.companies.join(t.rounds, "company_id").groupBy("company_id", "cik").agg(F.min("round_date").alias("campaign_date"))
    return N.cross_referenced(first, t.filings.where("form_type = 'C-TR'"), t.companies.where("outcome = 'exited'").select("company_id"), "2001-06-01")


_STATUS = ("active", "Dissolved", "liquidation", "open", None)


@query(
    "lb3_rebuild",
    """WITH c AS (SELECT company_id, CASE company_id % 3 WHEN 0 THEN 'companies_house' WHEN 1 THEN 'sec_dera_cf' ELSE 'academic' END AS source, CASE company_id % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'dissolved' WHEN 2 THEN 'liquidation' WHEN 3 THEN 'open' ELSE 'unknown' END AS status,
        outcome, (1 + company_id % 4)::INTEGER AS tier FROM companies),
    n AS (SELECT *, CASE WHEN source <> 'companies_house' THEN outcome WHEN status IN ('dissolved', 'liquidation') THEN 'failed' WHEN status = 'active' THEN 'trading' ELSE 'unknown' END AS new FROM c)
    SELECT company_id, new AS outcome, CASE WHEN source <> 'companies_house' THEN 'old' ELSE status END AS detail,
        CASE WHEN new = 'unknown' THEN 3 WHEN source = 'companies_house' AND new IN ('failed', 'trading') THEN 1 WHEN source = 'sec_dera_cf' AND new = 'failed' THEN 1 WHEN source = 'sec_dera_cf' AND new = 'trading' AND tier > 2 THEN 2 ELSE tier END::INTEGER AS tier FROM n""",
)
def rebuild(t):
    k = F.col("company_id")
    source = F.when(k % 3 == 0, "companies_house").when(k % 3 == 1, "sec_dera_cf").otherwise("academic")
    firms = t.companies.select("company_id", source.alias("source"), F.element_at(F.array(*map(F.lit, _STATUS)), (k % 5 + 1).cast("int")).alias("status"))
    return L.rebuilt(t.companies.select("company_id", "outcome", F.lit("old").alias("detail"), (k % 4 + 1).cast("int").alias("tier")), firms)


@query("er4_bulk_create", "SELECT id, country FROM (SELECT company_id % 70 AS id, country, company_id, row_number() OVER (PARTITION BY company_id % 70 ORDER BY company_id) AS r FROM companies) WHERE r = 1 AND id >= 20 UNION ALL SELECT i AS id, 'known' FROM range(20) t(i)")
def bulk_create(t):
    known = t.spark.range(20).withColumn("country", F.lit("known"))
    return N.created(known, t.companies.select((F.col("company_id") % 70).alias("id"), "country", "company_id"), ["id"], "company_id")


@query("er8_matched_pairs", "SELECT a.company_id, CASE WHEN b.company_id IS NULL OR c.company_id IS NULL THEN 'missing' WHEN b.cik = c.cik THEN 'match' ELSE 'differ' END AS verdict FROM (SELECT company_id FROM companies) a LEFT JOIN companies b ON b.company_id = a.company_id LEFT JOIN companies c ON c.company_id = a.company_id + 500")
def matched_pairs(t):
    pairs = t.companies.select("company_id", (F.col("company_id") + 500).alias("other"))
    left, right = t.companies.select("company_id", F.col("cik").alias("a")), t.companies.select(F.col("company_id").alias("other"), F.col("cik").alias("b"))
    both = pairs.join(left, "company_id", "left").join(right, "other", "left")
    return both.select("company_id", F.when(F.col("a").isNull() | F.col("b").isNull(), "missing").when(F.col("a") == F.col("b"), "match").otherwise("differ").alias("verdict"))


_ADVISERS = """refs AS (SELECT c_custkey AS ref_id, CASE WHEN c_custkey % 3 = 0 THEN 'The ' ELSE '' END || upper(c_mktsegment) || ' ' || n_name || ' ' || right(c_name, 2) || CASE WHEN c_custkey % 2 = 0 THEN ' Capital, L.P.' ELSE ' Ventures LLC' END AS legal,
    CASE WHEN c_acctbal > 9000 THEN 'A' WHEN c_acctbal > 4000 THEN 'B' ELSE 'C' END AS tier, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS assets FROM customer JOIN nation ON c_nationkey = n_nationkey),
    leads AS (SELECT o_orderkey AS round_id, CASE o_orderkey % 5 WHEN 0 THEN upper(c_mktsegment) || ' ' || n_name || ' ' || right(c_name, 2) || ' Partners' WHEN 1 THEN substr(c_mktsegment, 3, 4) || ' ' WHEN 2 THEN substr(c_mktsegment, 4) || ' ' || n_name WHEN 3 THEN 'Capital Partners' ELSE o_orderpriority END AS lead FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey)"""
_INVESTOR = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), '\b(the|inc|llc|ltd|limited|plc|corp|corporation|partners|capital|ventures)\b', ' ', 'g'), '\s+', ' ', 'g'))"


@query(
    "jn11_investor_match",
    f"""WITH {_ADVISERS}, l AS (SELECT round_id, {_INVESTOR.format("lead")} AS n FROM leads), r AS (SELECT *, {_INVESTOR.format("legal")} AS rn FROM refs), q AS (SELECT DISTINCT n FROM l WHERE n <> ''),
    e AS (SELECT n, min(ref_id) AS ref_id FROM q JOIN r ON rn = n GROUP BY 1), c AS (SELECT n, ref_id, row_number() OVER (PARTITION BY n ORDER BY tier, assets DESC NULLS LAST, ref_id) AS k FROM q JOIN r ON contains(rn, n) WHERE n NOT IN (SELECT n FROM e)),
    b AS (SELECT n, ref_id, 'exact' AS how FROM e UNION ALL SELECT n, ref_id, 'contains' FROM c WHERE k = 1)
    SELECT round_id, b.ref_id, how, CASE tier WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.75 WHEN 'C' THEN 0.45 END::DOUBLE AS quality FROM l LEFT JOIN b ON b.n = l.n LEFT JOIN refs ON refs.ref_id = b.ref_id""",
)
def investor_match(t):
    """Lead investors of rounds and their references: the same normalised name, else of the names that contain it the best tier,
    then the largest assets."""
    place = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    k, own = F.col("c_custkey"), F.concat_ws(" ", F.upper("c_mktsegment"), "n_name", F.right("c_name", F.lit(2)))
    legal = F.concat(F.when(k % 3 == 0, "The ").otherwise(""), own, F.when(k % 2 == 0, " Capital, L.P.").otherwise(" Ventures LLC"))
    tier = F.when(F.col("c_acctbal") > 9000, "A").when(F.col("c_acctbal") > 4000, "B").otherwise("C")
    refs = place.select(k.alias("ref_id"), legal.alias("legal"), tier.alias("tier"), F.when(k % 5 != 0, F.col("c_acctbal")).alias("assets"))
    o = F.col("o_orderkey") % 5
    lead = F.when(o == 0, F.concat(own, F.lit(" Partners"))).when(o == 1, F.concat(F.substring("c_mktsegment", 3, 4), F.lit(" "))).when(o == 2, F.concat_ws(" ", F.substring("c_mktsegment", 4, 99), "n_name")).when(o == 3, "Capital Partners").otherwise(F.col("o_orderpriority"))
    leads = t.orders.join(place, F.col("o_custkey") == k).select(F.col("o_orderkey").alias("round_id"), lead.alias("lead"))
    return E.investor_references(leads, refs, "round_id", "lead", "legal").select("round_id", "ref_id", "how", "quality")


@query(
    "jn13_item_enrichment",
    """WITH i AS (SELECT company_id, sector, cik, outcome, DATE '1995-06-01' + (company_id % 900)::INTEGER AS created FROM companies),
    fund AS (SELECT i.company_id, max({'d': round_date, 'i': round_id, 'a': amount}) AS m, sum(amount) FILTER (round_date < created) AS total FROM i JOIN rounds r ON r.company_id = i.company_id AND round_date <= created GROUP BY 1),
    ar AS (SELECT i.company_id, max({'d': filing_date, 'i': filing_id, 'v': revenue}) AS m FROM i JOIN filings f ON f.company_id = i.company_id AND form_type = 'C-AR' AND filing_date <= created GROUP BY 1), up AS (SELECT i.company_id, max(filing_date) AS d FROM i JOIN filings f ON f.company_id = i.company_id AND form_type = 'C-U' AND filing_date < created GROUP BY 1),
    nf AS (SELECT i.company_id, count(*)::DOUBLE AS n FROM i JOIN filings f ON f.company_id = i.company_id AND filing_date < created GROUP BY 1), br AS (SELECT cik, min(company_id) AS bridge FROM companies GROUP BY 1),
    ft AS (SELECT entity_id, max({'d': as_of_date, 'i': fact_id, 'v': value}) FILTER (feature_name = 'purchase') AS p, max({'d': as_of_date, 'i': fact_id, 'v': value}) FILTER (feature_name = 'error') AS e FROM facts GROUP BY 1),
    ev AS (SELECT company_id, max({'d': deal_date, 'i': deal_id, 's': score}) AS m FROM deals GROUP BY 1), mo AS (SELECT i.company_id, sum(failed)::DOUBLE AS n FROM i JOIN deals d ON d.sector = i.sector AND d.deal_date < created GROUP BY 1)
    SELECT i.company_id, fund.m.i AS last_round, fund.m.a AS last_amount, round(fund.total, 2) AS total_before, ar.m.d AS annual_date, ar.m.v AS annual_revenue, up.d AS update_date, nf.n AS filings_before, br.bridge, ft.p.v AS last_purchase, ft.e.v AS last_error, coalesce(own.m.i, other.m.i) AS evaluation, coalesce(own.m.s, other.m.s) AS score, mo.n AS sector_failures
    FROM i LEFT JOIN fund USING (company_id) LEFT JOIN ar USING (company_id) LEFT JOIN up USING (company_id) LEFT JOIN nf USING (company_id) LEFT JOIN br USING (cik) LEFT JOIN ft ON ft.entity_id = i.company_id LEFT JOIN ev own ON own.company_id = i.company_id LEFT JOIN ev other ON other.company_id = br.bridge LEFT JOIN mo ON mo.company_id = i.company_id""",
)
def enrichment(t):
    """Items with the latest round, annual report and update up to their date, sums before it, the first company of the same
    number, the latest facts by name, an evaluation of their own or of that company, and failures in the sector before."""
    items = t.companies.select("company_id", "sector", "cik", F.date_add(F.lit("1995-06-01").cast("date"), (F.col("company_id") % 900).cast("int")).alias("created"))
    rounds, filings = t.rounds.select("company_id", "round_date", F.col("round_id").alias("last_round"), F.col("amount").alias("last_amount")), t.filings
    dated, key = items.select("company_id", "created"), "company_id"
    annual = filings.where("form_type = 'C-AR'").select("company_id", F.col("filing_date").alias("annual_date"), "filing_id", F.col("revenue").alias("annual_revenue"))
    updates = filings.where("form_type = 'C-U'").select("company_id", F.col("filing_date").alias("update_date"), "filing_id")
    deals = t.deals.select("sector", "deal_date", F.col("failed").cast("double").alias("failed"))
    steps = [  # each starts from the items alone, so no step is computed again for the next
        J.asof(dated, rounds, key, "created", "round_date", ["last_round", "last_amount"], "last_round", key).drop("round_date"),
        J.prior_sum(dated, t.rounds, key, key, "created", "round_date", "amount", "total_before"),
        J.asof(dated, annual, key, "created", "annual_date", ["annual_revenue"], "filing_id", key),
        J.asof(dated, updates, key, "created", "update_date", [], "filing_id", key, strict=True),
        J.prior_sum(dated, filings.withColumn("one", F.lit(1.0)), key, key, "created", "filing_date", "one", "filings_before"),
        J.prior_sum(items.select("company_id", "created", "sector"), deals, "sector", key, "created", "deal_date", "failed", "sector_failures").drop("sector"),
    ]
    newest = lambda kind: F.max(F.when(F.col("feature_name") == kind, F.struct("as_of_date", "fact_id", "value")))["value"]
    steps.append(t.facts.groupBy(F.col("entity_id").alias("company_id")).agg(newest("purchase").alias("last_purchase"), newest("error").alias("last_error")))
    last = t.deals.groupBy("company_id").agg(F.max(F.struct("deal_date", "deal_id", "score")).alias("m"))
    steps.append(last.select("company_id", F.col("m.deal_date").alias("own_date"), F.col("m.deal_id").alias("own_deal"), F.col("m.score").alias("own_score"), F.lit(True).alias("own_known")))
    done = items.join(J.side_by_side([s.drop("created") for s in steps], key), key)
    done = done.join(t.companies.groupBy("cik").agg(F.min("company_id").alias("bridge")), "cik", "left")
    done = done.join(last.select(F.col("company_id").alias("bridge"), F.col("m").alias("other")), "bridge", "left")
    own = F.struct(F.col("own_date").alias("deal_date"), F.col("own_deal").alias("deal_id"), F.col("own_score").alias("score"))
    best = F.coalesce(F.when(F.col("own_known"), own), "other")
    shown = ["last_round", "last_amount", F.round("total_before", 2).alias("total_before"), "annual_date", "annual_revenue", "update_date", "filings_before", "bridge", "last_purchase", "last_error", best["deal_id"].alias("evaluation"), best["score"].alias("score"), "sector_failures"]
    return done.select("company_id", *shown)


@query("fs6_feature_dates", "SELECT c.company_id, coalesce(min(r.round_date) FILTER (r.status = 'F'), min(r.round_date), DATE '2000-01-01') AS as_of_date FROM companies c LEFT JOIN rounds r ON r.company_id = c.company_id GROUP BY 1")
def feature_dates(t):
    d = t.rounds.groupBy("company_id").agg(F.min(F.when(F.col("status") == "F", F.col("round_date"))).alias("campaign"), F.min("round_date").alias("first"))
    return t.companies.select("company_id").join(d, "company_id", "left").select("company_id", F.coalesce("campaign", "first", F.lit("2000-01-01").cast("date")).alias("as_of_date"))


@query(
    "bt1_feature_load",
    """WITH k AS (SELECT d.deal_id, d.deal_date, d.amount, x.failed FROM deals d LEFT JOIN (SELECT deal_id, failed FROM deals WHERE outcome <> 'unknown') x ON x.deal_id = d.deal_id WHERE d.deal_date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'),
    f AS (SELECT k.deal_id, max({'d': filing_date, 'i': filing_id, 'v': revenue}) AS m FROM k JOIN filings f ON f.round_id = k.deal_id AND filing_date <= deal_date GROUP BY 1) SELECT k.deal_id, k.failed, k.amount, f.m.v AS revenue FROM k LEFT JOIN f ON f.deal_id = k.deal_id""",
)
def feature_load(t):
    known = t.deals.where("outcome <> 'unknown'").select("deal_id", "failed")
    rows = t.deals.where("deal_date between date '1996-01-01' and date '1997-12-31'").select("deal_id", "deal_date", "amount").join(known, "deal_id", "left").withColumn("key", F.col("deal_id"))
    f = t.filings.select(F.col("round_id").alias("key"), "filing_date", "filing_id", "revenue")
    return J.asof(rows, f, "key", "deal_date", "filing_date", ["revenue"], "filing_id", "deal_id").select("deal_id", "failed", "amount", "revenue")


@query(
    "bt3_family",
    """WITH d AS (SELECT deal_id, deal_date, country, stage, CASE WHEN deal_date <= DATE '1997-12-31' THEN 'train' ELSE 'test' END AS part FROM deals), f AS (SELECT c.country, s.stage FROM (VALUES ('UK'), ('FR')) c(country), (VALUES ('seed'), ('early_growth')) s(stage)),
    n AS (SELECT f.country AS fc, f.stage AS fs, count(*) FILTER (part = 'train') >= 120 AND count(*) FILTER (part = 'test') >= 30 AS enough FROM f LEFT JOIN d ON d.country = f.country AND d.stage = f.stage GROUP BY 1, 2)
    SELECT fc || '_' || fs AS family, part, NOT enough AS pooled, count(*) AS n, min(deal_id) AS first_deal FROM n JOIN d ON NOT enough OR (d.country = fc AND d.stage = fs) GROUP BY 1, 2, 3""",
)
def family(t):
    """Families with rows enough to train and test on, and two without any, which take all rows."""
    cut, out = F.lit("1997-12-31").cast("date"), None
    for country in ("UK", "FR"):
        for stage in ("seed", "early_growth"):
            parts = N.family(t.deals.where(F.col("deal_date") <= cut), t.deals.where(F.col("deal_date") > cut), country, stage)
            for part, rows in zip(("train", "test"), parts[:2], strict=True):
                one = rows.groupBy(F.lit(f"{country}_{stage}").alias("family"), F.lit(part).alias("part"), F.lit(parts[2]).alias("pooled")).agg(F.count("*").alias("n"), F.min("deal_id").alias("first_deal"))
                out = one if out is None else out.unionByName(one)
    return out


@query(
    "bt10_portfolio_sectors",
    f"WITH {_SPLIT}, g AS (SELECT *, row_number() OVER (PARTITION BY w, sector ORDER BY score DESC, deal_id) AS g FROM split), p AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY score DESC, deal_id) AS pick FROM g WHERE g <= 3) SELECT w AS \"window\", sector, count(*) AS n, sum(failed)::BIGINT AS failed FROM p WHERE pick <= 12 GROUP BY 1, 2",
)
def portfolio_sectors(t):
    return V.capped(tested(t), "sector", 3, 12, [F.desc("score"), F.col("deal_id")], ["window"]).groupBy("window", "sector").agg(F.count("*").alias("n"), F.sum("failed").alias("failed"))


@query("bt13_quarantine", "SELECT entity_id, holdout FROM (SELECT company_id AS entity_id, 'w2' AS holdout FROM deals WHERE deal_date BETWEEN DATE '1997-07-01' AND DATE '1998-06-30' UNION SELECT company_id, 'w1' FROM companies WHERE company_id % 10 = 0)")
def quarantine(t):
    held = t.companies.where("company_id % 10 = 0").select(F.col("company_id").alias("entity_id"), F.lit("w1").alias("holdout"))
    new = t.deals.where(F.col("deal_date").between(*[F.lit(d).cast("date") for d in WINDOWS[3][2:]])).select(F.col("company_id").alias("entity_id"), F.lit("w2").alias("holdout")).distinct()
    return U.insert_absent(held, new, ["entity_id", "holdout"])


@query(
    "bt16_open_signals",
    f"""WITH l AS (SELECT r.round_id, max(f.filing_date) AS d FROM rounds r JOIN filings f ON f.round_id = r.round_id AND f.filing_date <= r.round_date GROUP BY 1), x AS (SELECT r.round_id, date_diff('day', d, r.round_date) AS days FROM rounds r LEFT JOIN l ON l.round_id = r.round_id)
    SELECT round_id, 'filing_recency_days' AS signal, days::DOUBLE AS value, CASE WHEN days IS NULL THEN 0.0::DOUBLE WHEN days <= 365 THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM x
    UNION ALL SELECT round_id, s, NULL, 0.0::DOUBLE FROM rounds, (VALUES {", ".join(f"('{s}')" for s in B.NOT_YET)}) v(s)""",
)
def open_signals(t):
    """All eight signals of each round: days since the last filing, and those that nothing measures yet."""
    left = t.rounds.select("round_id", "round_date").withColumn("key", F.col("round_id"))
    last = J.asof(left, t.filings.select(F.col("round_id").alias("key"), "filing_date", "filing_id"), "key", "round_date", "filing_date", [], "filing_id", "round_id", hot=False)
    return B.signals(last, "round_id", "round_date", "filing_date")


_RUNS = """g AS (SELECT sector, country, year(deal_date) AS y, count(*) AS n, avg(score) / 75 AS auc, avg(failed) / 3 AS ece, round(avg(failed), 6) AS rate FROM deals GROUP BY 1, 2, 3),
    runs AS (SELECT country || '_' || sector AS family, y::BIGINT AS y, round(auc, 6) AS survival_auc, round(ece, 6) AS calibration_ece, auc >= 0.65 AND ece < 0.08 AS all_passed, make_timestamp(2000 + y, 1 + (n % 12)::BIGINT, 1, 0, 0, 0.0::DOUBLE) AS run_date FROM g)"""


def logged_runs(t):
    """A run for each family (country and sector) and test year, in the shape of the run log."""
    g = t.deals.groupBy("sector", "country", F.year("deal_date").alias("y")).agg(F.count("*").alias("n"), (F.avg("score") / 75).alias("auc"), (F.avg("failed") / 3).alias("ece"))
    metrics = F.create_map(F.lit("survival_auc"), F.round("auc", 6), F.lit("calibration_ece"), F.round("ece", 6))
    verdicts = F.create_map(F.lit("survival_auc"), F.col("auc") >= 0.65, F.lit("calibration_ece"), F.col("ece") < 0.08)
    made = g.select(
        F.concat_ws("_", "country", "sector").alias("model_family"), F.lit("2001-06-01").cast("date").alias("data_snapshot_date"), F.lit("all before").alias("train_window"), F.col("y").cast("string").alias("test_window"), F.array(F.lit("score")).alias("features_active"), F.array().cast("array<string>").alias("alt_data_signals"),
        metrics.alias("metrics"), verdicts.alias("pass_fail"), ((F.col("auc") >= 0.65) & (F.col("ece") < 0.08)).alias("all_passed"), F.make_timestamp(F.col("y") + 2000, F.col("n") % 12 + 1, F.lit(1), F.lit(0), F.lit(0), F.lit(0.0)).alias("run_date"),
    )
    return made.withColumn("run_id", H.run_key())


@query("bt12_latest_runs", f"WITH {_RUNS} SELECT family, y, survival_auc, calibration_ece, all_passed, rank FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY run_date DESC)::INTEGER AS rank FROM runs) WHERE rank <= 3")
def latest_runs(t):
    m = F.col("metrics")
    return H.latest(logged_runs(t), ["model_family"], 3).select(F.col("model_family").alias("family"), F.col("test_window").cast("long").alias("y"), m["survival_auc"].alias("survival_auc"), m["calibration_ece"].alias("calibration_ece"), "all_passed", "rank")


@query("bt12_passing_runs", f"WITH {_RUNS} SELECT family, y, rank FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY run_date DESC)::INTEGER AS rank FROM runs WHERE all_passed) WHERE rank <= 1")
def passing_runs(t):
    return H.latest(logged_runs(t), ["model_family"], 1, passing=True).select(F.col("model_family").alias("family"), F.col("test_window").cast("long").alias("y"), "rank")


def evidence(t):
    """All windows: AUC, calibration error, portfolio against a random one, and the gates, in one table."""
    rows = tested(t).withColumns({"p": 1 - F.col("score") / 100, "random": B.seeded(F.col("deal_id"), "42")})
    by = ["window"]
    m = A.auc(rows, "failed", "p", by).select("window", F.col("auc").alias("survival_auc"))
    m = m.join(A.calibration_error(rows, "failed", "p", 10, by).withColumnRenamed("ece", "calibration_ece"), by)
    own, luck = (B.portfolios(rows, by, c, 0.0).select("window", F.col("quality").alias(f"q_{c}"), F.col("failure_rate").alias(f"f_{c}")) for c in ("score", "random"))
    m = m.join(own, by).join(luck, by)
    m = m.withColumns({"quality_vs_random": F.try_divide("q_score", "q_random"), "failure_vs_random": F.try_divide("f_score", "f_random")})
    return B.gated(m, by)


@query("bt14_backtest_report", None)
def backtest_report(t):
    return evidence(t)


def backtest_loop(t, path: str, family: str = "pooled", snapshot: str = "2001-06-01") -> int:
    """The whole loop: windows are measured and gated, and each window's run is put into the log at path, unless it is there; the
    number of runs that are new."""
    return H.record(H.from_gates(evidence(t), "window", family, ["score"], snapshot), path)


_MODEL = {
    "inputs": ["pre_money", "equity", "score"], "learning_rate": 0.5, "baseline": -0.5, "calibration": {"x": [0.2, 0.5, 0.8], "y": [0.1, 0.5, 0.95]},
    "trees": [
        [{"is_leaf": False, "feature_idx": 0, "threshold": 500000.0, "left": 1, "right": 2, "missing_go_to_left": True}, {"is_leaf": True, "value": 1.0}, {"is_leaf": False, "feature_idx": 1, "threshold": 0.2, "left": 3, "right": 4, "missing_go_to_left": False}, {"is_leaf": True, "value": -2.0}, {"is_leaf": True, "value": 0.25}],
        [{"is_leaf": False, "feature_idx": 2, "threshold": 50.0, "left": 1, "right": 2, "missing_go_to_left": False}, {"is_leaf": True, "value": 2.0}, {"is_leaf": True, "value": -1.0}],
    ],
}


@query(
    "sc6_tree_inference",
    """WITH m AS (SELECT deal_id, 1 / (1 + exp(-(-0.5 + 0.5 * (CASE WHEN pre_money IS NULL OR pre_money <= 500000 THEN 1.0 WHEN equity <= 0.2 THEN -2.0 ELSE 0.25 END) + 0.5 * (CASE WHEN score <= 50 THEN 2.0 ELSE -1.0 END)))) AS raw FROM deals),
    c AS (SELECT deal_id, CASE WHEN raw <= 0.2 THEN 0.1 WHEN raw <= 0.5 THEN 0.1 + (raw - 0.2) / 0.3 * 0.4 WHEN raw <= 0.8 THEN 0.5 + (raw - 0.5) / 0.3 * 0.45 ELSE 0.95 END AS p FROM m) SELECT deal_id, round(p, 6)::DOUBLE AS p_fail, floor((1 - p) * 100 + 0.5)::BIGINT AS score FROM c""",
)
def tree_inference(t):
    p = I.predicted(_MODEL, {c: F.col(c) for c in _MODEL["inputs"]})
    return t.deals.select("deal_id", F.round(p["p_fail"], 6).alias("p_fail"), p["score"].alias("score"))


@query(
    "sc7_quick_score",
    f"""WITH {_VALUED}, {_RUBRIC.replace("x AS (", "rx AS (", 1).replace("FROM x", "FROM rx")}, rated AS (SELECT deal_id, greatest(0, least(100, floor(ml * 0.6::DOUBLE + (0.20 * text_score + 0.18 * traction + 0.15 * terms + 0.15 * team + 0.12 * financial + 0.10 * signal + 0.10 * market) * 0.4::DOUBLE + 0.5)))::BIGINT AS base FROM c), {_GATES},
    w AS (SELECT deal_id, company_id, pre_money AS a, CASE WHEN deal_id % 2 = 0 THEN pre_money * 1.01 WHEN deal_id % 5 = 0 THEN amount END AS b FROM deals), te AS (SELECT deal_id, company_id, (coalesce(abs(a - b) > 0.01 AND abs(a - b) / greatest(abs(a), abs(b), 1.0) > 0.025, false))::INT + (a IS NULL OR coalesce(abs(a - b) > 0.01 AND abs(a - b) / greatest(abs(a), abs(b), 1.0) > 0.025, false))::INT AS t FROM w),
    q AS (SELECT rated.deal_id, greatest(0, base - least(16, 4 * (coalesce(penalty, 0) + t)))::BIGINT AS overall, coalesce(penalty, 0) + t AS penalty, coalesce(valuation, 'low') AS valuation, kill, abstain, flagged FROM rated JOIN h ON h.deal_id = rated.deal_id JOIN te ON te.deal_id = rated.deal_id LEFT JOIN valued ON valued.company_id = te.company_id)
    SELECT deal_id, overall, penalty::INTEGER AS penalty, valuation, CASE WHEN kill THEN 'pass' WHEN abstain THEN 'deep_diligence' WHEN NOT flagged AND overall >= 65 THEN 'invest' WHEN NOT flagged AND overall >= 50 THEN 'deep_diligence' WHEN overall >= 40 THEN 'watch' ELSE 'pass' END AS class,
        NOT kill AND abstain AS rerouted FROM q""",
)
def quick_score(t):
    """The rubric's score less the points of weak comparables and of terms that disagree; an abstention is sent to deep diligence with a warning."""
    d, g, k = rubric_inputs(), gate_inputs(), F.col("deal_id")
    terms = R.term_sources({"pre_money": (F.col("pre_money"), F.when(k % 2 == 0, F.col("pre_money") * 1.01).when(k % 5 == 0, F.col("amount")))})
    rows = t.deals.join(valued_companies(t).withColumnRenamed("penalty", "_own"), "company_id", "left")
    penalty = F.coalesce("_own", F.lit(0)) + R.term_penalty(terms, F.lit("medium"))
    scored = rows.select("deal_id", R.penalised(R.overall(d["ml"], R.rubric(d)), penalty).alias("overall"), penalty.cast("int").alias("penalty"), F.coalesce("valuation", F.lit("low")).alias("valuation"), R.gates(g).alias("g"))
    kind = R.classify(F.col("overall"), F.col("g"))
    return scored.select("deal_id", "overall", "penalty", "valuation", F.when(kind == "abstain", "deep_diligence").otherwise(kind).alias("class"), (kind == "abstain").alias("rerouted"))


_DECISIONS = "d AS (SELECT deal_id AS item, a::INTEGER AS agent, r::INTEGER AS run, deal_id * 10 + a AS ord, CASE (deal_id * 3 + a * (deal_id % 3) + (deal_id % 11 = r)::INT) % 4 WHEN 0 THEN 'invest' WHEN 1 THEN 'watch' WHEN 2 THEN 'pass' ELSE 'abstain' END AS class, (deal_id + a) % 6 = 0 AS fallback, CASE WHEN deal_id % 3 = 0 THEN 'watch' END AS model_class FROM deals, range(1, 4) x(a), range(1, 4) y(r))"


def decisions(t):
    each = lambda n: F.explode(F.array(*map(F.lit, range(1, 4)))).alias(n)
    k = F.col("item")
    base = t.deals.select(F.col("deal_id").alias("item"), each("agent")).select("*", each("run"))
    h = (k * 3 + F.col("agent") * (k % 3) + (k % 11 == F.col("run")).cast("int")) % 4
    return base.select("item", "agent", "run", (k * 10 + F.col("agent")).alias("ord"), F.when(h == 0, "invest").when(h == 1, "watch").when(h == 2, "pass").otherwise("abstain").alias("class"), ((k + F.col("agent")) % 6 == 0).alias("fallback"), F.when(k % 3 == 0, "watch").alias("model_class"))


@query(
    "pl4_run_summary",
    f"""WITH {_DECISIONS}, i AS (SELECT run, item, count(DISTINCT class) AS c, count(model_class) AS m, count(*) AS n FROM d GROUP BY 1, 2), a AS (SELECT run, count(*) AS items, sum(n)::BIGINT AS decisions, round(avg((c > 1)::INT), 6) AS disagreement_rate, round(avg((m > 0)::INT), 6) AS model_coverage FROM i GROUP BY 1),
    b AS (SELECT run, round(avg(fallback::INT), 6) AS fallback_rate, round(avg((class = 'abstain')::INT), 6) AS abstain_rate, count(DISTINCT class)::DOUBLE AS classes FROM d GROUP BY 1) SELECT a.*, b.fallback_rate, b.abstain_rate, b.classes FROM a JOIN b ON a.run = b.run""",
)
def run_summary(t):
    s = P.summary(decisions(t), ["run"])
    return s.select("run", "items", "decisions", *[F.round(c, 6).alias(c) for c in ("disagreement_rate", "model_coverage", "fallback_rate", "abstain_rate")], "classes")


@query(
    "pl5_stability_gates",
    f"""WITH {_DECISIONS}, o AS (SELECT * FROM d WHERE NOT fallback), c AS (SELECT run, item, class, count(*) AS n, min(ord) AS f FROM o GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY run, item ORDER BY n DESC, f) AS r, sum(n) OVER (PARTITION BY run, item) AS total FROM c), v AS (SELECT run, item, class, (n < total)::INT AS odd FROM r WHERE r = 1),
    g AS (SELECT 'fallback_rate' AS gate, (SELECT avg(fallback::INT) FROM d) AS value, '<=' AS op, 0.25 AS t UNION ALL SELECT 'majority_agreement', (SELECT avg((a.class = b.class)::INT) FROM v a JOIN v b ON a.item = b.item AND a.run < b.run), '>=', 0.75
    UNION ALL SELECT 'least_pairwise', (SELECT min(s) FROM (SELECT avg((a.class = b.class)::INT) AS s FROM o a JOIN o b ON a.item = b.item AND a.agent = b.agent AND a.run < b.run GROUP BY a.run, b.run)), '>=', 0.80 UNION ALL SELECT 'disagreement_sd', (SELECT stddev_samp(x) FROM (SELECT avg(odd) AS x FROM v GROUP BY run)), '<=', 0.10
    UNION ALL SELECT 'model_coverage', (SELECT avg((m > 0)::INT) FROM (SELECT count(model_class) AS m FROM d GROUP BY item)), '>=', 0.30 UNION ALL SELECT 'classes', (SELECT count(DISTINCT class) FROM d), '>=', 3) SELECT gate, round(value, 6) AS value, CASE op WHEN '<=' THEN value <= t ELSE value >= t END AS passed FROM g""",
)
def stability_gates(t):
    return P.stability(decisions(t)).withColumn("value", F.round("value", 6))


@query("wn9_diverse_selection", None)
def diverse(t):
    kind = F.when(F.col("score") >= 65, "invest").when(F.col("score") >= 40, "watch").otherwise("pass")
    return P.diverse(t.deals.select(F.col("deal_id").alias("id"), kind.alias("class"), "sector", "country", F.col("score").alias("evidence")), 15)


@query("ops2_due_reminders", "SELECT event_id, 'reminder:' || event_id AS dedupe_key FROM events WHERE event_type = 'signup' AND value > 20 AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 60)")
def due_reminders(t):
    done = t.events.where("event_type = 'purchase' and value > 60").select("user_id")
    due = t.events.where("event_type = 'signup' and value > 20").join(done, "user_id", "left_anti")
    return due.select("event_id", F.concat(F.lit("reminder:"), "event_id").alias("dedupe_key"))


@query("ops6_retention", "SELECT conv_id, turn, CASE WHEN conv_id % 4 <> 0 THEN text END AS text, CASE WHEN conv_id % 4 = 0 AND text IS NOT NULL THEN concat_ws(' ', role, '[retention purge applied]') ELSE role END AS role FROM conversations")
def retention(t):
    old = (F.col("conv_id") % 4 == 0) & F.col("text").isNotNull()
    return U.redact(t.conversations, ["text"], "role", "[retention purge applied]", old)


@query("ops8_backfills", "SELECT deal_id, CASE WHEN deal_id % 2 = 0 THEN 1.5::DOUBLE WHEN deal_id % 7 <> 0 AND amount > 0 THEN round(amount / (amount * 0.3), 4) END AS over, CASE WHEN deal_id % 3 = 0 THEN 7 WHEN deal_id % 4 <> 0 THEN 24 END::INTEGER AS age_months, CASE WHEN deal_id % 5 = 0 THEN 100.0::DOUBLE WHEN balance < 0 THEN round(abs(balance * 1.0007::DOUBLE) / 12, 2) END AS burn, CASE WHEN deal_id % 9 = 0 AND company_id % 10 = 0 THEN NULL ELSE sector END AS sector FROM deals JOIN (SELECT company_id AS cid, balance FROM companies) ON cid = company_id")
def backfills(t):
    k, c = F.col("deal_id"), F.col("company_id")
    rows = t.deals.join(t.companies.select("company_id", (F.col("balance") * 1.0007).alias("net_income"), F.when(c % 10 != 0, F.col("sector")).alias("company_sector")), "company_id").select(
        "deal_id", "amount", F.when(k % 7 != 0, F.col("amount") * 0.3).otherwise(0.0).alias("target"), "deal_date", F.add_months("deal_date", F.when(k % 4 != 0, -24).otherwise(6)).alias("founded"), "net_income", "company_sector",
        F.when(k % 2 == 0, 1.5).alias("over"), F.when(k % 3 == 0, 7).alias("age_months"), F.when(k % 5 == 0, 100.0).alias("burn"), F.when(k % 9 != 0, F.col("sector")).alias("sector"),
    )
    return N.backfilled(rows).select("deal_id", "over", "age_months", "burn", "sector")


@query("ops10_weekly_qa", "WITH s AS (SELECT * FROM (SELECT round_id, pre_money, equity FROM rounds ORDER BY md5('week' || round_id::VARCHAR), round_id LIMIT 200)), f AS (SELECT 'pre_money' AS field, (pre_money IS NOT NULL) AS found, round_id % 11 <> 0 AS truth FROM s UNION ALL SELECT 'equity', equity IS NOT NULL, round_id % 13 <> 0 FROM s), c AS (SELECT field, count(*) FILTER (found AND truth) AS tp, count(*) FILTER (found AND NOT truth) AS fp, count(*) FILTER (NOT found AND truth) AS fn FROM f GROUP BY 1) SELECT field, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM c")
def weekly_qa(t):
    s = V.hashed_sample(t.rounds.select("round_id", "pre_money", "equity"), "round_id", "week", 200)
    checks = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).isNotNull().alias("found"), (F.col("round_id") % m != 0).alias("truth")) for c, m in (("pre_money", 11), ("equity", 13))])).alias("c")
    f, y = F.col("found"), F.col("truth")
    sums = s.select(checks).select("c.*").groupBy("field").agg(F.count_if(f & y).alias("tp"), F.count_if(f & ~y).alias("fp"), F.count_if(~f & y).alias("fn"))
    pr = A.precision_recall(F.col("tp"), F.col("fp"), F.col("fn"))
    return sums.select("field", F.round(pr["precision"], 6).alias("precision"), F.round(pr["recall"], 6).alias("recall"))


@query("rls_visible_rows", "SELECT round_id, owner FROM (SELECT round_id, 'u' || (round_id % 3) AS owner FROM rounds) WHERE owner = 'u1'")
def visible_rows(t):
    roles = t.spark.createDataFrame([("u0", "admin"), ("u1", "viewer")], "email string, role string")
    return N.visible(t.rounds.select("round_id", F.concat(F.lit("u"), (F.col("round_id") % 3).cast("string")).alias("owner")), roles, "u1")
