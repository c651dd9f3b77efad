"""Queries of operators/aggregates.py, operators/windows.py and operators/graph.py."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.operators import aggregates as A
from granary.operators import windows as V
from granary.operators.graph import components
from granary.queries.base import query

_KINDS = ("click", "error", "purchase", "signup", "view")


@query("ag1_pivot", "SELECT entity_id, as_of_date, " + ", ".join(f"max(CASE WHEN feature_name = '{k}' THEN value END) AS {k}" for k in _KINDS) + ", max(tier) AS worst_tier FROM facts WHERE tier <= 2 GROUP BY 1, 2")
def pivot(t):
    kept = t.facts.where("tier <= 2")
    wide = kept.groupBy("entity_id", "as_of_date").agg(*[F.max(F.when(F.col("feature_name") == k, F.col("value"))).alias(k) for k in _KINDS], F.max("tier").alias("worst_tier"))
    return wide


@query(
    "ag2_latest_matrix",
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY entity_id, feature_name ORDER BY as_of_date DESC, fact_id DESC) AS n FROM facts WHERE tier <= 2 AND as_of_date <= DATE '2024-06-30') SELECT entity_id, " + ", ".join(f"max(CASE WHEN feature_name = '{k}' THEN value END) AS {k}" for k in _KINDS) + " FROM r WHERE n = 1 GROUP BY 1",
)
def latest_matrix(t):
    last = V.first_by(t.facts.where("tier <= 2 and as_of_date <= date '2024-06-30'"), ["entity_id", "feature_name"], F.desc("as_of_date"), F.desc("fact_id"))
    return A.pivot_facts(last, ["entity_id"], "feature_name", {k: F.col("value") for k in _KINDS})


@query("ag3_holdout_summary", "SELECT outcome AS holdout, count(*) AS n, min(deal_date) AS first_date FROM deals GROUP BY 1")
def holdout_summary(t):
    return t.deals.groupBy(F.col("outcome").alias("holdout")).agg(F.count("*").alias("n"), F.min("deal_date").alias("first_date"))


@query("ag4_sustained", "SELECT cik FROM filings GROUP BY cik HAVING max(filing_date) - min(filing_date) > 730")
def sustained(t):
    return t.filings.groupBy("cik").agg(F.datediff(F.max("filing_date"), F.min("filing_date")).alias("span")).where("span > 730").select("cik")


@query("ag5_low_match", "SELECT entity_id, count(*) AS n, round(avg(CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS rate FROM facts GROUP BY 1 HAVING count(*) >= 10 AND avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) < 0.85")
def low_match(t):
    rate = F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0))
    return t.facts.groupBy("entity_id").agg(F.count("*").alias("n"), F.round(rate, 6).alias("rate")).where("n >= 10 and rate < 0.85")


@query("ag6_coverage", "SELECT count(*) AS n, count(pre_money) AS pre_money, count(equity) AS equity, count(*) FILTER (WHERE amount > 100000) AS large FROM rounds")
def coverage(t):
    return t.rounds.agg(F.count("*").alias("n"), F.count("pre_money").alias("pre_money"), F.count("equity").alias("equity"), F.count_if(F.col("amount") > 100000).alias("large"))


@query("ag7_median", "SELECT security, count(equity) AS n, round(avg(equity), 3) AS mean, quantile_cont(equity, 0.5) AS median FROM rounds GROUP BY 1")
def median(t):
    return t.rounds.groupBy("security").agg(F.count("equity").alias("n"), F.round(F.avg("equity"), 3).alias("mean"), F.percentile("equity", 0.5).alias("median"))


@query("ag8_min_by_four", "SELECT c.company_id, r.security, r.status, c.country, min(r.amount) AS least FROM companies c LEFT JOIN rounds r ON r.company_id = c.company_id GROUP BY 1, 2, 3, 4")
def min_by_four(t):
    return t.companies.join(t.rounds, "company_id", "left").groupBy("company_id", "security", "status", "country").agg(F.min("amount").alias("least"))


@query("ag9_distribution", "SELECT sector, outcome, count(*) AS n FROM companies GROUP BY 1, 2")
def distribution(t):
    return t.companies.groupBy("sector", "outcome").agg(F.count("*").alias("n"))


@query(
    "ag10_cohort_stats",
    """SELECT sector, country, count(*) AS n, round(avg(failed), 6) AS failure_rate, round(avg(CASE WHEN outcome = 'exited' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS exit_rate, quantile_cont(CASE WHEN pre_money > 0 THEN pre_money END, 0.5) AS median_pre_money,
    round(100 * avg(CASE WHEN has_revenue THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS pct_revenue FROM deals GROUP BY 1, 2""",
)
def cohort_stats(t):
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return t.deals.groupBy("sector", "country").agg(F.count("*").alias("n"), F.round(F.avg("failed"), 6).alias("failure_rate"), F.round(share(F.col("outcome") == "exited"), 6).alias("exit_rate"), F.percentile(F.when(F.col("pre_money") > 0, F.col("pre_money")), 0.5).alias("median_pre_money"), F.round(100 * share(F.col("has_revenue")), 4).alias("pct_revenue"))


@query(
    "ag11_error_cohorts",
    """WITH e AS (SELECT year(deal_date)::VARCHAR || '-Q' || quarter(deal_date)::VARCHAR AS quarter, country || '_' || stage AS segment, CASE WHEN deal_id % 3 = 0 THEN 'high' ELSE 'low' END AS confidence, amount, pre_money FROM deals),
    g AS (SELECT quarter, segment, confidence, count(*) AS n, count(pre_money) AS known, round(sum(abs(pre_money - amount)), 2) / count(pre_money) AS mae, round(avg(abs(pre_money - amount) / CASE WHEN abs(amount) > 1e-6 THEN abs(amount) ELSE 1 END), 6) AS mape FROM e GROUP BY 1, 2, 3),
    w AS (SELECT *, round(known / sum(n) OVER (PARTITION BY quarter, segment), 6) AS coverage, dense_rank() OVER (ORDER BY quarter DESC) AS q FROM g) SELECT quarter, segment, confidence, n, mae, mape, coverage FROM w WHERE q <= 8""",
)
def error_cohorts(t):
    from granary.functions.parsing import quarter_label

    e = t.deals.select(quarter_label(F.col("deal_date")).alias("quarter"), F.concat_ws("_", "country", "stage").alias("segment"), F.when(F.col("deal_id") % 3 == 0, "high").otherwise("low").alias("confidence"), "amount", "pre_money")
    gap = F.abs(F.col("pre_money") - F.col("amount"))
    base = F.when(F.abs("amount") > 1e-6, F.abs("amount")).otherwise(1.0)
    g = e.groupBy("quarter", "segment", "confidence").agg(F.count("*").alias("n"), F.count("pre_money").alias("known"), (F.round(F.sum(gap), 2) / F.count(gap)).alias("mae"), F.round(F.avg(gap / base), 6).alias("mape"))
    recent = g.select("quarter").distinct().orderBy(F.desc("quarter")).limit(8)
    share = F.round(F.col("known") / F.sum("n").over(W.partitionBy("quarter", "segment")), 6)
    return g.withColumn("coverage", share).join(recent, "quarter", "left_semi").drop("known")


@query("ag12_calibration_error", "WITH b AS (SELECT sector, least(floor(score / 100 * 10), 9) AS bin, count(*) AS k, abs(avg(score / 100) - avg(failed)) AS gap FROM deals GROUP BY 1, 2) SELECT sector, round(sum(k * gap) / sum(k), 6) AS ece FROM b GROUP BY 1")
def ece(t):
    return A.calibration_error(t.deals.withColumn("p", F.col("score") / 100), "failed", "p", 10, ["sector"]).select("sector", F.round("ece", 6).alias("ece"))


@query("ag13_calibration_bins", "SELECT i::INTEGER AS bin, coalesce(n, 0) AS n, mean_p, mean_y FROM range(10) t(i) LEFT JOIN (SELECT least(floor(score / 100 * 10), 9)::INTEGER AS b, count(*) AS n, round(avg(score / 100), 6) AS mean_p, round(avg(failed), 6) AS mean_y FROM deals WHERE score < 70 GROUP BY 1) ON b = i")
def calibration(t):
    c = A.calibration(t.deals.where("score < 70").withColumn("p", F.col("score") / 100), "failed", "p")
    return c.select("bin", "n", F.round("mean_p", 6).alias("mean_p"), F.round("mean_y", 6).alias("mean_y"))


@query(
    "ag14_auc",
    """WITH r AS (SELECT sector, failed, rank() OVER (PARTITION BY sector ORDER BY score) + (count(*) OVER (PARTITION BY sector, score) - 1) / 2.0::DOUBLE AS r FROM deals),
    s AS (SELECT sector, count(*) AS n, sum(failed) AS p, sum(r) FILTER (failed = 1) AS t FROM r GROUP BY 1) SELECT sector, n, round((t - p * (p + 1) / 2) / (p * (n - p)), 6) AS auc FROM s""",
)
def auc(t):
    return A.auc(t.deals, "failed", "score", ["sector"]).select("sector", "n", F.round("auc", 6).alias("auc"))


#: Cuts by which the area is reported, beside all rows.
_CUTS = ("country", "stage", "sector", "outcome_known", "has_revenue", "has_institution", "eis_eligible", "year")


@query(
    "ag14_auc_by_cuts",
    """WITH d AS (SELECT failed, score, country, stage, sector, (outcome <> 'unknown')::VARCHAR AS outcome_known, has_revenue::VARCHAR AS has_revenue, has_institution::VARCHAR AS has_institution, eis_eligible::VARCHAR AS eis_eligible, year(deal_date)::VARCHAR AS year FROM deals),
    u AS (SELECT 'all' AS cut, 'all' AS value, failed, score FROM d UNION ALL SELECT cut, value, failed, score FROM (UNPIVOT d ON country, stage, sector, outcome_known, has_revenue, has_institution, eis_eligible, year INTO NAME cut VALUE value)),
    r AS (SELECT cut, value, failed, rank() OVER (PARTITION BY cut, value ORDER BY score) + (count(*) OVER (PARTITION BY cut, value, score) - 1) / 2.0::DOUBLE AS r FROM u),
    s AS (SELECT cut, value, count(*) AS n, sum(failed) AS p, coalesce(sum(r) FILTER (failed = 1), 0) AS t FROM r GROUP BY 1, 2) SELECT cut, value, n, CASE WHEN n >= 10 AND p > 0 AND p < n THEN round((t - p * (p + 1) / 2) / (p * (n - p)), 6) ELSE 0.0::DOUBLE END AS auc FROM s""",
)
def auc_by_cuts(t):
    d = t.deals.withColumn("outcome_known", F.col("outcome") != "unknown").withColumn("year", F.year("deal_date"))
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("cut"), F.col(c).cast("string").alias("value")) for c in _CUTS])).alias("c")
    each = A.auc(d.select("failed", "score", parts).select("failed", "score", "c.*").where("value is not null"), "failed", "score", ["cut", "value"])
    whole = A.auc(d, "failed", "score").select(F.lit("all").alias("cut"), F.lit("all").alias("value"), "n", "auc")
    return whole.unionByName(each).withColumn("auc", F.round("auc", 6))


@query(
    "ag15_precision_recall",
    """WITH c AS (SELECT sector, count(*) FILTER (score < 50 AND failed = 1) AS tp, count(*) FILTER (score < 50 AND failed = 0) AS fp, count(*) FILTER (score >= 50 AND failed = 1) AS fn FROM deals GROUP BY 1)
    SELECT sector, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM c""",
)
def precision_recall(t):
    low, bad = F.col("score") < 50, F.col("failed") == 1
    c = t.deals.groupBy("sector").agg(F.count_if(low & bad).alias("tp"), F.count_if(low & ~bad).alias("fp"), F.count_if(~low & bad).alias("fn"))
    return c.select("sector", *[F.round(v, 6).alias(k) for k, v in A.precision_recall(F.col("tp"), F.col("fp"), F.col("fn")).items()])


@query("ag16_weighted_error", "SELECT round(sum(abs(s / n - f) * n) / sum(n), 6) AS error FROM (SELECT sector, count(*) AS n, sum(score / 100) AS s, avg(failed) AS f FROM deals GROUP BY 1)")
def weighted_error(t):
    g = t.deals.groupBy("sector").agg(F.count("*").alias("n"), F.avg(F.col("score") / 100).alias("p"), F.avg("failed").alias("y"))
    return g.agg(F.round(F.sum(F.abs(F.col("p") - F.col("y")) * F.col("n")) / F.sum("n"), 6).alias("error"))


@query("ag19_uncertainty", "WITH top AS (SELECT sector FROM deals ORDER BY score DESC, deal_id LIMIT 50) SELECT (SELECT round(avg(CASE WHEN score BETWEEN 40 AND 60 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) FROM deals) AS uncertain, (SELECT max(n) / sum(n) FROM (SELECT count(*) AS n FROM top GROUP BY sector)) AS top_sector_share")
def uncertainty(t):
    top = t.deals.orderBy(F.desc("score"), "deal_id").limit(50).groupBy("sector").agg(F.count("*").alias("n")).agg((F.max("n") / F.sum("n")).alias("top_sector_share"))
    return t.deals.agg(F.round(F.avg(F.when(F.col("score").between(40, 60), 1.0).otherwise(0.0)), 6).alias("uncertain")).join(F.broadcast(top))


@query("ag20_majority", "WITH c AS (SELECT entity_id, feature_name, count(*) AS n, min(fact_id) AS f FROM facts GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, f) AS r, sum(n) OVER (PARTITION BY entity_id) AS total FROM c) SELECT entity_id, feature_name AS majority, round(1 - n / total, 6) AS disagreement FROM r WHERE r = 1")
def majority(t):
    return A.majority(t.facts, ["entity_id"], "feature_name", "fact_id").select("entity_id", "majority", F.round("disagreement", 6).alias("disagreement"))


_RUNS = "runs AS (SELECT deal_id, i::INTEGER AS run, CASE WHEN (deal_id * 31 + i * 17) % 11 < 5 THEN 'invest' WHEN (deal_id * 31 + i * 17) % 11 < 8 THEN 'watch' ELSE 'pass' END AS class, ((deal_id * 31 + i * 17) % 101)::DOUBLE AS conviction FROM deals, range(1, 5) t(i))"


def runs(t):
    h = F.col("deal_id") * 31 + F.col("run") * 17
    return t.deals.select("deal_id", F.explode(F.array(*map(F.lit, range(1, 5)))).alias("run")).withColumn("class", F.when(h % 11 < 5, "invest").when(h % 11 < 8, "watch").otherwise("pass")).withColumn("conviction", (h % 101).cast("double"))


@query("ag21_run_agreement", f"WITH {_RUNS} SELECT a.run AS run_a, b.run AS run_b, count(*) AS n, round(avg(CASE WHEN a.class = b.class THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS agreement FROM runs a JOIN runs b ON a.deal_id = b.deal_id AND a.run < b.run GROUP BY 1, 2")
def agreement(t):
    return A.pairwise_agreement(runs(t), ["deal_id"], "run", "class").withColumn("agreement", F.round("agreement", 6))


@query("ag22_conviction", f"WITH {_RUNS} SELECT run, round(avg(conviction), 6) AS mean, quantile_cont(conviction, 0.5) AS median, round(stddev_samp(conviction), 6) AS sd FROM runs GROUP BY 1")
def conviction(t):
    return runs(t).groupBy("run").agg(F.round(F.avg("conviction"), 6).alias("mean"), F.percentile("conviction", 0.5).alias("median"), F.round(F.stddev_samp("conviction"), 6).alias("sd"))


@query("ag23_class_drift", f"WITH {_RUNS}, c AS (SELECT run, count(*) FILTER (class = 'invest') AS i, count(*) FILTER (class = 'watch') AS w, count(*) FILTER (class = 'pass') AS p FROM runs GROUP BY 1) SELECT a.run AS run_a, b.run AS run_b, (abs(a.i - b.i) + abs(a.w - b.w) + abs(a.p - b.p))::BIGINT AS drift FROM c a JOIN c b ON a.run < b.run")
def drift(t):
    return A.drift(runs(t), "run", "class", ["invest", "watch", "pass"])


@query("ag24_missing_fields", "SELECT field, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN pre_money IS NULL THEN 'pre_money' END, CASE WHEN equity IS NULL THEN 'equity' END, CASE WHEN NOT has_revenue THEN 'revenue' END], lambda x: x IS NOT NULL)) AS field FROM deals) GROUP BY 1 ORDER BY n DESC LIMIT 8")
def missing_fields(t):
    c = F.col
    found = F.array_compact(F.array(F.when(c("pre_money").isNull(), "pre_money"), F.when(c("equity").isNull(), "equity"), F.when(~c("has_revenue"), "revenue")))
    return t.deals.select(F.explode(found).alias("field")).groupBy("field").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(8)


@query("ag25_usage", "WITH u AS (SELECT user_id, event_type, date_trunc('month', ts)::DATE AS m, count(*) AS used FROM events GROUP BY 1, 2, 3), l AS (SELECT * FROM (VALUES ('click', 3), ('view', 5)) x(event_type, most)) SELECT user_id, u.event_type, m AS month, used, used > most AS over FROM u JOIN l ON l.event_type = u.event_type")
def usage(t):
    limits = t.spark.createDataFrame([("click", 3), ("view", 5)], "event_type string, most int")
    used = t.events.groupBy("user_id", "event_type", F.trunc("ts", "month").alias("month")).agg(F.count("*").alias("used"))
    return used.join(F.broadcast(limits), "event_type").select("user_id", "event_type", "month", "used", (F.col("used") > F.col("most")).alias("over"))


@query("ag26_evidence_score", "SELECT round_id, ((pre_money IS NOT NULL)::INT + (equity IS NOT NULL)::INT + (security <> 'Debt')::INT)::INTEGER AS sources, round(((pre_money IS NOT NULL)::INT + (equity IS NOT NULL)::INT + (security <> 'Debt')::INT) / 3, 6) AS ratio FROM rounds")
def evidence_score(t):
    n = F.col("pre_money").isNotNull().cast("int") + F.col("equity").isNotNull().cast("int") + (F.col("security") != "Debt").cast("int")
    return t.rounds.select("round_id", n.alias("sources"), F.round(n / 3, 6).alias("ratio"))


@query("ag27_model_health", "SELECT round(sum(abs(pre_money - amount)), 2) / count(pre_money) AS mae, count(*) AS n FROM (SELECT * FROM rounds ORDER BY round_date DESC, round_id DESC LIMIT 1000)")
def model_health(t):
    last = t.rounds.orderBy(F.desc("round_date"), F.desc("round_id")).limit(1000)
    return last.agg((F.round(F.sum(F.abs(F.col("pre_money") - F.col("amount"))), 2) / F.count("pre_money")).alias("mae"), F.count("*").alias("n"))


@query("ag28_distinct_on", "SELECT DISTINCT ON (company_id) company_id, round_id, amount FROM rounds ORDER BY company_id, round_date DESC NULLS LAST, round_id")
def distinct_on(t):
    return V.first_by(t.rounds, ["company_id"], F.desc_nulls_last("round_date"), "round_id").select("company_id", "round_id", "amount")


@query("ag29_rollup_cube", "SELECT sector, country, grouping_id(sector, country)::INTEGER AS level, count(*) AS n FROM companies GROUP BY CUBE (sector, country)")
def cube(t):
    return t.companies.cube("sector", "country").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"))


@query("ag30_approximate", None)
def approximate(t):
    return t.facts.groupBy("feature_name").agg(F.approx_count_distinct("entity_id", 0.02).alias("entities"), F.percentile_approx("value", 0.5, 1000).alias("median"))


@query("wn3_capped_selection", "WITH g AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY score DESC, deal_id) AS g FROM deals), p AS (SELECT *, row_number() OVER (ORDER BY score DESC, deal_id) AS pick FROM g WHERE g <= 10) SELECT deal_id, sector, score, pick::INTEGER AS pick FROM p WHERE pick <= 30")
def capped(t):
    return V.capped(t.deals, "sector", 10, 30, [F.desc("score"), F.col("deal_id")]).select("deal_id", "sector", "score", "pick")


#: Expanding windows: label, end of training, begin and end of test.
WINDOWS = [("w1", "1994-06-30", "1994-07-01", "1995-06-30"), ("w2", "1995-06-30", "1995-07-01", "1996-06-30"), ("w3", "1996-06-30", "1996-07-01", "1997-06-30"), ("w4", "1997-06-30", "1997-07-01", "1998-06-30"), ("w5", "1998-06-30", "1998-07-01", "1999-12-31")]
_WINDOWS = "windows(w, a, b, c) AS (VALUES " + ", ".join(f"('{w}', DATE '{a}', DATE '{b}', DATE '{c}')" for w, a, b, c in WINDOWS) + ")"


@query("wn5_walk_forward", f"WITH {_WINDOWS} SELECT w AS \"window\", CASE WHEN deal_date <= a THEN 'train' ELSE 'test' END AS split, count(*) AS n, min(deal_date) AS first_date, max(deal_date) AS last_date FROM deals, windows WHERE deal_date <= a OR deal_date BETWEEN b AND c GROUP BY 1, 2")
def walk_forward(t):
    return V.walk_forward(t.deals, "deal_date", WINDOWS).groupBy("window", "split").agg(F.count("*").alias("n"), F.min("deal_date").alias("first_date"), F.max("deal_date").alias("last_date"))


@query(
    "wn6_nearest_deals",
    """WITH d AS (SELECT sector, deal_id, CASE WHEN pre_money IS NULL AND equity IS NULL THEN 999.0::DOUBLE ELSE (coalesce(abs(pre_money - 500000.0::DOUBLE) / 500000.0::DOUBLE, 0.0::DOUBLE) + coalesce(abs(equity - 0.1::DOUBLE) / 0.1::DOUBLE, 0.0::DOUBLE)) / ((pre_money IS NOT NULL)::INT + (equity IS NOT NULL)::INT) END AS distance FROM deals),
    r AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY distance, deal_id)::INTEGER AS rank FROM d) SELECT sector, rank, deal_id, round(distance, 6) AS distance FROM r WHERE rank <= 5""",
)
def nearest(t):
    d = t.deals.withColumn("to_value", F.lit(500000.0)).withColumn("to_equity", F.lit(0.1))
    return V.nearest(d, ["sector"], [("pre_money", "to_value", 500000.0), ("equity", "to_equity", 0.1)], 5, "deal_id").select("sector", "rank", "deal_id", F.round("distance", 6).alias("distance"))


@query("wn7_percentile", "SELECT sector, CASE WHEN count(pre_money) >= 20 THEN floor(100 * count(*) FILTER (pre_money <= 600000) / count(pre_money) + 0.5)::BIGINT END AS percentile FROM deals GROUP BY 1")
def percentile(t):
    return V.percentile_of(t.deals.withColumn("at", F.lit(600000.0)), ["sector"], "pre_money", "at")


@query("wn8_hashed_sample", "SELECT round_id FROM rounds ORDER BY md5('qa' || round_id::VARCHAR), round_id LIMIT 40")
def sample(t):
    return V.hashed_sample(t.rounds.select("round_id"), "round_id", "qa", 40)


@query("wn10_latest_list", "SELECT round_id, round_date, pre_money FROM rounds ORDER BY pre_money DESC NULLS LAST, round_id LIMIT 25")
def latest_list(t):
    return t.rounds.select("round_id", "round_date", "pre_money").orderBy(F.desc_nulls_last("pre_money"), "round_id").limit(25)


@query("wn11_rolling", "SELECT sector, deal_date, n FROM (SELECT sector, deal_date, count(*) AS n, row_number() OVER (PARTITION BY sector ORDER BY deal_date DESC) AS r FROM deals GROUP BY 1, 2) WHERE r <= 5")
def rolling(t):
    return V.first_by(t.deals.groupBy("sector", "deal_date").agg(F.count("*").alias("n")).withColumn("_k", F.row_number().over(W.partitionBy("sector").orderBy(F.desc("deal_date")))), ["sector", "_k"], "deal_date").where("_k <= 5").drop("_k")


@query(
    "wn12_frames",
    """SELECT round_id, lag(amount) OVER w AS previous, lead(round_date, 2) OVER w AS after_next, ntile(4) OVER w AS quarter, first_value(amount) OVER w AS first_amount, dense_rank() OVER (PARTITION BY company_id ORDER BY round_date) AS nth_day,
    round(avg(amount) OVER (PARTITION BY company_id ORDER BY round_date, round_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS mean_of_three, count(*) OVER (PARTITION BY company_id ORDER BY round_date RANGE BETWEEN INTERVAL 180 DAY PRECEDING AND CURRENT ROW) AS in_half_a_year
    FROM rounds WINDOW w AS (PARTITION BY company_id ORDER BY round_date, round_id)""",
)
def frames(t):
    w, days = W.partitionBy("company_id").orderBy("round_date", "round_id"), W.partitionBy("company_id").orderBy("_day")
    return t.rounds.withColumn("_day", F.unix_date("round_date")).select(
        "round_id", F.lag("amount").over(w).alias("previous"), F.lead("round_date", 2).over(w).alias("after_next"), F.ntile(4).over(w).alias("quarter"), F.first("amount").over(w).alias("first_amount"), F.dense_rank().over(days).alias("nth_day"),
        F.round(F.avg("amount").over(w.rowsBetween(-2, 0)), 4).alias("mean_of_three"), F.count("*").over(days.rangeBetween(-180, 0)).alias("in_half_a_year"),
    )


@query("jn21_all_kinds", "SELECT r_regionkey, n_nationkey, n_name, r_name FROM region FULL JOIN (SELECT * FROM nation WHERE n_regionkey <> 1) n ON r_regionkey = n_regionkey AND n_nationkey % 2 = 0 UNION ALL SELECT a.r_regionkey, b.r_regionkey, NULL, a.r_name FROM region a CROSS JOIN region b WHERE a.r_name < b.r_name UNION ALL SELECT r_regionkey, n_nationkey, n_name, r_name FROM nation RIGHT JOIN region ON r_regionkey = n_regionkey AND n_nationkey > 15")
def all_kinds(t):
    """Full, cross (of two tables of five rows) and right joins."""
    region, cols = t.region, ["r_regionkey", "n_nationkey", "n_name", "r_name"]
    same = F.col("r_regionkey") == F.col("n_regionkey")
    full = region.join(t.nation.where("n_regionkey <> 1"), same & (F.col("n_nationkey") % 2 == 0), "full").select(*cols)
    other = region.select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("other"))
    cross = region.crossJoin(F.broadcast(other)).where("r_name < other").select("r_regionkey", "n_nationkey", F.lit(None).cast("string").alias("n_name"), "r_name")
    return full.unionByName(cross).unionByName(t.nation.join(region, same & (F.col("n_nationkey") > 15), "right").select(*cols))


@query(
    "set_operations",
    "SELECT company_id, 'both' AS part FROM (SELECT company_id FROM companies WHERE stage = 'seed' INTERSECT SELECT company_id FROM rounds WHERE status = 'F') UNION ALL SELECT company_id, 'only' FROM (SELECT company_id FROM companies WHERE stage = 'seed' EXCEPT SELECT company_id FROM rounds WHERE status = 'F')",
)
def set_operations(t):
    seed, done = t.companies.where("stage = 'seed'").select("company_id"), t.rounds.where("status = 'F'").select("company_id")
    return seed.intersect(done).withColumn("part", F.lit("both")).unionByName(seed.subtract(done).withColumn("part", F.lit("only")))


@query(
    "er5_components",
    """WITH RECURSIVE links AS (SELECT s_suppkey AS a, s_suppkey + 7 AS b FROM supplier WHERE s_suppkey % 3 <> 0), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach(id, other) AS (SELECT a, a FROM both_ways UNION SELECT r.id, l.b FROM reach r JOIN both_ways l ON l.a = r.other) SELECT id, min(other) AS root FROM reach GROUP BY 1""",
)
def clusters(t):
    return components(t.supplier.where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 7).alias("b")), "a", "b")
