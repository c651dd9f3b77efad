"""Queries of operators/upserts.py and operators/joins.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import containment as N
from granary.operators import joins as J
from granary.operators import upserts as U
from granary.operators import windows as V
from granary.queries.base import query


def old_and_new(t):
    old = t.companies.where("company_id % 3 <> 0").select("company_id", "name", "balance", "stage")
    new = t.companies.where("company_id % 2 = 0").select("company_id", F.when(F.col("company_id") % 4 == 0, F.upper("name")).alias("name"), (F.col("balance") + 1).alias("balance"), F.lit("seed").alias("stage"))
    return old, new


_OLD_NEW = """old AS (SELECT company_id, name, balance, stage FROM companies WHERE company_id % 3 <> 0),
    new AS (SELECT company_id, CASE WHEN company_id % 4 = 0 THEN upper(name) END AS name, balance + 1 AS balance, 'seed' AS stage FROM companies WHERE company_id % 2 = 0)"""


@query("snk1_upsert", f"WITH {_OLD_NEW} SELECT * FROM new UNION ALL SELECT * FROM old WHERE company_id NOT IN (SELECT company_id FROM new)")
def upsert(t):
    return U.upsert(*old_and_new(t), ["company_id"])


@query(
    "snk2_merge",
    f"WITH {_OLD_NEW} SELECT coalesce(n.company_id, o.company_id) AS company_id, coalesce(n.name, o.name) AS name, greatest(o.balance, n.balance) AS balance, least(o.stage, n.stage) AS stage FROM old o FULL OUTER JOIN new n ON o.company_id = n.company_id",
)
def merge(t):
    return U.merge(*old_and_new(t), ["company_id"], {"name": "fill", "balance": "greatest", "stage": "least"})


@query("snk3_json_merge", "SELECT event_id, 'new' AS k, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'kept' END AS shared, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 2 END::INTEGER AS size FROM events")
def json_merge(t):
    text = lambda *xs: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    old = text("k", F.lit("old"), "shared", F.lit("kept"))
    new = F.when(F.col("event_id") % 2 == 0, text("k", F.lit("new"), "shared", F.col("event_type"))).otherwise(text("k", F.lit("new")))
    m = F.col("m")
    return t.events.select("event_id", U.merged_maps(old, new).alias("m")).select("event_id", m["k"].alias("k"), m["shared"].alias("shared"), F.size("m").alias("size"))


@query("snk4_insert_absent", f"WITH {_OLD_NEW} SELECT * FROM old UNION ALL SELECT * FROM new WHERE company_id NOT IN (SELECT company_id FROM old)")
def insert_absent(t):
    return U.insert_absent(*old_and_new(t), ["company_id"])


@query("snk5_update_from", "SELECT c.company_id, c.sector, CASE WHEN c.outcome = 'unknown' AND f.company_id IS NOT NULL THEN 'trading' ELSE c.outcome END AS outcome FROM companies c LEFT JOIN (SELECT DISTINCT company_id FROM filings WHERE form_type = 'C-AR') f ON c.company_id = f.company_id")
def update_from(t):
    active = t.filings.where("form_type = 'C-AR'").select("company_id").distinct()
    return U.update_from(t.companies.select("company_id", "sector", "outcome"), active, ["company_id"], {"outcome": F.lit("trading")}, F.col("outcome") == "unknown")


@query("snk6_delete", "SELECT fact_id, entity_id FROM facts WHERE NOT EXISTS (SELECT 1 FROM companies c WHERE c.company_id = entity_id AND c.outcome = 'failed')")
def delete(t):
    return t.facts.join(t.companies.where("outcome = 'failed'").select(F.col("company_id").alias("entity_id")), "entity_id", "left_anti").select("fact_id", "entity_id")


@query("snk7_redact", "SELECT round_id, CASE WHEN round_date >= DATE '1996-01-01' THEN security END AS security, CASE WHEN round_date < DATE '1996-01-01' THEN priority || ' [redacted]' ELSE priority END AS priority FROM rounds")
def redact(t):
    return U.redact(t.rounds.select("round_id", "security", "priority", "round_date"), ["security"], "priority", "[redacted]", F.col("round_date") < F.lit("1996-01-01").cast("date")).drop("round_date")


@query("snk8_keep_last", "SELECT company_id, filing_id, form_type FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY filing_date DESC, filing_id DESC) AS r FROM filings) WHERE r = 1")
def keep_last(t):
    return U.keep_last(t.filings, ["company_id"], F.desc("filing_date"), F.desc("filing_id")).select("company_id", "filing_id", "form_type")


@query("snk11_audit_export", "SELECT event_id, event_type, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 250")
def audit_export(t):
    return t.events.select("event_id", "event_type", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(min(max(250, 1), 5000))


@query("snk12_ledger", "SELECT p_type AS name, sha256(string_agg(p_name, ',' ORDER BY p_partkey)) AS checksum FROM part GROUP BY 1")
def ledger(t):
    rows = F.array_sort(F.collect_list(F.struct("p_partkey", "p_name")))
    return t.part.groupBy(F.col("p_type").alias("name")).agg(F.sha2(F.array_join(F.transform(rows, lambda x: x["p_name"]), ","), 256).alias("checksum"))


@query("jn1_linked", "SELECT r.round_id, c.sector, c.country FROM rounds r JOIN companies c ON r.company_id = c.company_id")
def linked(t):
    return t.rounds.join(t.companies, "company_id").select("round_id", "sector", "country")


@query("jn2_unlinked", "SELECT company_id FROM companies c WHERE NOT EXISTS (SELECT 1 FROM rounds r WHERE r.company_id = c.company_id AND r.status = 'F' AND r.amount > 250000)")
def unlinked(t):
    return t.companies.join(t.rounds.where("status = 'F' and amount > 250000"), "company_id", "left_anti").select("company_id")


@query("jn3_time_aligned", "SELECT r.round_id, max(f.value) AS value FROM rounds r LEFT JOIN facts f ON f.entity_id = r.company_id AND f.as_of_date = r.round_date AND f.tier <= 2 GROUP BY 1")
def aligned(t):
    facts = t.facts.where("tier <= 2").select(F.col("entity_id").alias("company_id"), F.col("as_of_date").alias("round_date"), "value")
    return t.rounds.join(facts, ["company_id", "round_date"], "left").groupBy("round_id").agg(F.max("value").alias("value"))


@query(
    "jn4_asof",
    """SELECT r.round_id, x.m.d AS filing_date, x.m.i AS filing_id, x.m.v AS revenue FROM rounds r LEFT JOIN
    (SELECT r.round_id, max({'d': f.filing_date, 'i': f.filing_id, 'v': f.revenue}) AS m FROM rounds r JOIN filings f ON f.round_id = r.round_id AND f.filing_date <= r.round_date GROUP BY 1) x ON x.round_id = r.round_id""",
)
def asof(t):
    filings = t.filings.select("round_id", "filing_date", "filing_id", "revenue")
    left = t.rounds.select("round_id", "round_date").withColumn("key", F.col("round_id"))
    return J.asof(left, filings.withColumnRenamed("round_id", "key"), "key", "round_date", "filing_date", ["filing_id", "revenue"], "filing_id", "round_id", hot=False).select("round_id", "filing_date", "filing_id", "revenue")


@query("jn5_latest", "SELECT c.company_id, f.filing_id, f.filing_date FROM companies c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY filing_date DESC, filing_id) AS r FROM filings) f ON f.company_id = c.company_id AND f.r = 1")
def latest(t):
    last = J.latest(t.filings, "company_id", [F.desc("filing_date"), F.col("filing_id")], ["filing_id", "filing_date"])
    return t.companies.select("company_id").join(last, "company_id", "left")


@query("jn6_prior_sum", "SELECT r.round_id, round(sum(p.amount), 2) AS prior FROM rounds r LEFT JOIN rounds p ON p.company_id = r.company_id AND p.round_date < r.round_date GROUP BY 1")
def prior_sum(t):
    r = t.rounds.select("round_id", "company_id", "round_date")
    return J.prior_sum(r, t.rounds.select("company_id", "round_date", "amount"), "company_id", "round_id", "round_date", "round_date", "amount", "prior").select("round_id", F.round("prior", 2).alias("prior"))


@query(
    "jn7_progress_evidence",
    """SELECT r.round_id, EXISTS (SELECT 1 FROM filings f WHERE f.company_id = r.company_id % 200 AND f.filing_date > r.round_date + INTERVAL 6 MONTH AND f.filing_date <= least(r.round_date + INTERVAL 24 MONTH, TIMESTAMP '1998-06-01')) AS progressed FROM rounds r WHERE r.round_date <= DATE '1996-12-01'""",
)
def evidence(t):
    rounds = t.rounds.where("round_date <= date '1996-12-01'").select("round_id", (F.col("company_id") % 200).alias("company_id"), "round_date")
    d = rounds["round_date"]
    return J.within(rounds, t.filings, "company_id", F.add_months(d, 6), F.least(F.add_months(d, 24), F.lit("1998-06-01").cast("date")), "filing_date", "progressed", "round_id").select("round_id", "progressed")


@query(
    "jn8_prior_year",
    """WITH y AS (SELECT company_id, year(round_date)::INTEGER AS y, sum(amount) AS total FROM rounds GROUP BY 1, 2) SELECT a.company_id, a.y, round((a.total - b.total) / abs(b.total), 6) AS growth FROM y a JOIN y b ON a.company_id = b.company_id AND a.y = b.y + 1""",
)
def prior_year(t):
    y = t.rounds.groupBy("company_id", F.year("round_date").alias("y")).agg(F.sum("amount").alias("total"))
    before = y.select("company_id", (F.col("y") + 1).alias("y"), F.col("total").alias("before"))
    return y.join(before, ["company_id", "y"]).select("company_id", "y", F.round(F.try_divide(F.col("total") - F.col("before"), F.abs("before")), 6).alias("growth"))


@query(
    "jn9_preferred_match",
    """WITH m AS (SELECT s_suppkey, 0 AS pref, c_custkey AS company_id FROM supplier JOIN customer ON c_custkey = s_suppkey AND c_custkey % 3 = 0
    UNION ALL SELECT s_suppkey, 1, c_custkey FROM supplier JOIN customer ON lower(right(c_name, 5)) = lower(right(s_name, 5)) AND c_custkey % 2 = 0
    UNION ALL SELECT s_suppkey, 2, c_custkey FROM supplier JOIN customer ON c_nationkey = s_nationkey AND c_mktsegment = 'BUILDING'),
    b AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY pref, company_id) AS r FROM m) SELECT s.s_suppkey, b.company_id, b.pref::INTEGER AS pref FROM supplier s LEFT JOIN b ON b.s_suppkey = s.s_suppkey AND r = 1""",
)
def preferred(t):
    s, c = t.supplier, t.customer.withColumn("company_id", F.col("c_custkey"))
    one, two, three = c.where("c_custkey % 3 = 0"), c.where("c_custkey % 2 = 0"), c.where("c_mktsegment = 'BUILDING'")
    ways = [(one, F.col("s_suppkey"), F.col("c_custkey")), (two, F.lower(F.right("s_name", F.lit(5))), F.lower(F.right("c_name", F.lit(5)))), (three, F.col("s_nationkey"), F.col("c_nationkey"))]
    return J.preferred(s, "s_suppkey", ways, ["company_id"], ["company_id"]).select("s_suppkey", "company_id", "pref")


@query(
    "jn10_name_match",
    """WITH l AS (SELECT p_partkey AS id, lower(trim(CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN split_part(p_name, ' ', 1) WHEN 2 THEN substr(p_name, 3, 5) ELSE p_brand END)) AS n FROM part), r AS (SELECT p_partkey AS rid, lower(trim(p_name)) AS rn FROM part WHERE p_size > 3),
    e AS (SELECT id, min(rid) AS rid, 'exact' AS how FROM l JOIN r ON n = rn GROUP BY 1), c AS (SELECT id, min(rid) AS rid, 'contains' AS how FROM l JOIN r ON n <> '' AND contains(rn, n) WHERE id NOT IN (SELECT id FROM e) GROUP BY 1)
    SELECT l.id, x.rid, x.how FROM l LEFT JOIN (SELECT * FROM e UNION ALL SELECT * FROM c) x ON x.id = l.id""",
)
def name_match(t):
    """Whole names, first words, pieces across words ("all ri" in "small ring") and names that are nowhere."""
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.col("p_name")).when(k == 1, F.split("p_name", " ")[0]).when(k == 2, F.substring("p_name", 3, 5)).otherwise(F.col("p_brand"))
    left = t.part.select(F.col("p_partkey").alias("id"), name.alias("name"))
    right = t.part.where("p_size > 3").select(F.col("p_partkey").alias("rid"), F.col("p_name").alias("full"))
    clean = lambda c: F.lower(F.trim(c))
    return N.by_name(left, right, "id", clean(F.col("name")), clean(F.col("full")), ["rid"], [F.col("rid")], [F.col("rid")]).select("id", "rid", "how")


@query(
    "jn12_cross_reference",
    """WITH a AS (SELECT cik, min(company_id) AS first_company FROM companies GROUP BY 1), b AS (SELECT cik, min(filing_date) AS first_filing FROM filings GROUP BY 1), k AS (SELECT cik FROM a UNION SELECT cik FROM b)
    SELECT k.cik::BIGINT AS cik, a.first_company, b.first_filing, CASE WHEN a.cik IS NULL THEN 'filings' WHEN b.cik IS NULL THEN 'companies' ELSE 'both' END AS found_in FROM k LEFT JOIN a ON a.cik = k.cik LEFT JOIN b ON b.cik = k.cik""",
)
def cross_reference(t):
    a, b = t.companies.groupBy("cik").agg(F.min("company_id").alias("first_company")), t.filings.groupBy("cik").agg(F.min("filing_date").alias("first_filing"))
    found = F.when(F.col("first_company").isNull(), "filings").when(F.col("first_filing").isNull(), "companies").otherwise("both")
    return a.join(b, "cik", "full_outer").select("cik", "first_company", "first_filing", found.alias("found_in"))


@query("jn14_holdout", "SELECT deal_id, CASE WHEN EXISTS (SELECT 1 FROM facts f WHERE f.entity_id = company_id AND f.feature_name = 'error') THEN 'holdout' ELSE 'train' END AS part FROM deals")
def holdout(t):
    held = t.facts.where("feature_name = 'error'").select(F.col("entity_id").alias("company_id"))
    d = t.deals.select("deal_id", "company_id")
    semi, anti = d.join(held, "company_id", "left_semi"), d.join(held, "company_id", "left_anti")
    return semi.select("deal_id", F.lit("holdout").alias("part")).unionByName(anti.select("deal_id", F.lit("train").alias("part")))


@query(
    "jn15_sector_momentum",
    """WITH days AS (SELECT sector, deal_date, count(*) AS n, sum(CASE WHEN failed = 0 THEN 1 ELSE 0 END) AS ok FROM deals GROUP BY 1, 2)
    SELECT a.sector, a.deal_date, coalesce(round(sum(b.ok) / sum(b.n), 6), 0.5::DOUBLE) AS momentum FROM days a LEFT JOIN days b ON b.sector = a.sector AND b.deal_date < a.deal_date AND b.deal_date >= a.deal_date - 730 GROUP BY 1, 2""",
)
def momentum(t):
    days = t.deals.groupBy("sector", "deal_date").agg(F.count("*").alias("n"), F.count_if(F.col("failed") == 0).alias("ok")).withColumn("day", F.datediff("deal_date", F.lit("1970-01-01")))
    w = V.W.partitionBy("sector").orderBy("day").rangeBetween(-730, -1)
    return days.select("sector", "deal_date", F.coalesce(F.round(F.sum("ok").over(w) / F.sum("n").over(w), 6), F.lit(0.5)).alias("momentum"))


@query("jn16_portfolio_sectors", "SELECT sector, round(sum(amount), 2) AS capital, count(*) AS n FROM deals WHERE lower(sector) IN ('building', 'machinery') GROUP BY 1")
def portfolio_sectors(t):
    own = t.spark.createDataFrame([("building",), ("machinery",)], "s string")
    d = t.deals
    return d.join(own, F.lower(d["sector"]) == own["s"], "left_semi").groupBy("sector").agg(F.round(F.sum("amount"), 2).alias("capital"), F.count("*").alias("n"))


@query("jn17_watchlist", "SELECT company_id, s_suppkey IS NOT NULL AS listed FROM companies LEFT JOIN supplier ON trim(regexp_replace(lower(replace(s_name, 'Supplier', 'Customer')), '[^a-z0-9]+', ' ', 'g')) = trim(regexp_replace(lower(regexp_replace(name, ' Ltd\\.| PLC|, LLC', '')), '[^a-z0-9]+', ' ', 'g'))")
def watchlist(t):
    from granary.functions.parsing import watchlist_name

    listed = t.supplier.select(watchlist_name(F.replace("s_name", F.lit("Supplier"), F.lit("Customer"))).alias("w")).distinct().withColumn("hit", F.lit(True))
    own = t.companies.withColumn("w", watchlist_name(F.regexp_replace("name", r" Ltd\.| PLC|, LLC", "")))
    return own.join(listed, "w", "left").select("company_id", F.col("hit").isNotNull().alias("listed"))


@query("jn20_two_keys", "SELECT a.sector, a.country, a.n, b.failed FROM (SELECT sector, country, count(*) AS n FROM companies GROUP BY 1, 2) a JOIN (SELECT sector, country, sum(failed)::BIGINT AS failed FROM deals GROUP BY 1, 2) b ON a.sector = b.sector AND a.country = b.country")
def two_keys(t):
    return t.companies.groupBy("sector", "country").agg(F.count("*").alias("n")).join(t.deals.groupBy("sector", "country").agg(F.sum("failed").alias("failed")), ["sector", "country"])
