"""Registration of queries, and the deal-domain tables that they derive from the driver's tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The domain tables in SQL, each over the driver's tables or those above it.
VIEWS = {
    "companies": """SELECT c_custkey AS company_id, c_name || CASE c_custkey % 4 WHEN 0 THEN ' Ltd.' WHEN 1 THEN ', LLC' WHEN 2 THEN ' PLC' ELSE '' END AS name,
        CASE WHEN n_regionkey IN (2, 3) THEN 'UK' ELSE 'US' END AS country, c_mktsegment AS sector, c_custkey % 500 AS cik,
        CASE WHEN c_acctbal >= 5000 THEN 'early_growth' ELSE 'seed' END AS stage, c_acctbal AS balance,
        CASE c_custkey % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'exited' WHEN 2 THEN 'unknown' ELSE 'trading' END AS outcome FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "rounds": """SELECT o_orderkey AS round_id, o_custkey AS company_id, o_orderdate::DATE AS round_date, o_totalprice AS amount, o_orderpriority AS priority, o_orderstatus AS status,
        CASE o_orderkey % 4 WHEN 0 THEN 'Convertible Note' WHEN 1 THEN 'SAFE' WHEN 2 THEN 'Debt' ELSE 'Common Stock' END AS security,
        CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice * (1 + o_orderkey % 9) END AS pre_money, CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 40) / 100.0::DOUBLE END AS equity FROM orders""",
    "filings": """SELECT l_orderkey * 10 + l_linenumber AS filing_id, l_orderkey AS round_id, l_suppkey % 500 AS cik, l_partkey % 200 AS company_id, l_shipdate::DATE AS filing_date, l_extendedprice AS revenue, l_quantity AS staff,
        CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN 'C-TR' WHEN l_returnflag = 'A' THEN 'C-AR' WHEN l_returnflag = 'N' THEN 'C' ELSE 'C-U' END AS form_type FROM lineitem""",
    "facts": """SELECT event_id AS fact_id, user_id AS entity_id, ts::DATE AS as_of_date, event_type AS feature_name, value, 1 + event_id % 3 AS tier,
        CASE event_id % 4 WHEN 0 THEN 'sec_form_d' WHEN 1 THEN 'manual' WHEN 2 THEN 'web_scrape' ELSE 'academic' END AS source FROM events""",
    "deals": """SELECT r.round_id AS deal_id, r.company_id, c.sector, c.country, c.stage, c.outcome, r.round_date AS deal_date, r.amount, r.pre_money, r.equity,
        ((r.round_id * 7919) % 1000) / 10.0::DOUBLE AS score, CASE WHEN c.outcome = 'failed' THEN 1 ELSE 0 END AS failed, r.round_id % 3 <> 0 AS has_revenue, r.round_id % 4 <> 0 AS has_institution,
        r.round_id % 5 <> 0 AS eis_eligible FROM rounds r JOIN companies c ON r.company_id = c.company_id""",
}
_USES = {k: [v for v in VIEWS if re.search(rf"\b(?:FROM|JOIN) {v}\b", sql)] for k, sql in VIEWS.items()}


class Tables:
    """The driver's tables and the domain tables as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def companies(self) -> DataFrame:
        k = F.col("c_custkey") % 4
        own = F.col("c_custkey") % 5
        suffix = F.when(k == 0, " Ltd.").when(k == 1, ", LLC").when(k == 2, " PLC").otherwise("")
        return self.customer.join(self.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_custkey").alias("company_id"), F.concat("c_name", suffix).alias("name"), F.when(F.col("n_regionkey").isin(2, 3), "UK").otherwise("US").alias("country"), F.col("c_mktsegment").alias("sector"),
            (F.col("c_custkey") % 500).alias("cik"), F.when(F.col("c_acctbal") >= 5000, "early_growth").otherwise("seed").alias("stage"), F.col("c_acctbal").alias("balance"),
            F.when(own == 0, "failed").when(own == 1, "exited").when(own == 2, "unknown").otherwise("trading").alias("outcome"),
        )

    @cached_property
    def rounds(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.orders.select(
            k.alias("round_id"), F.col("o_custkey").alias("company_id"), F.to_date("o_orderdate").alias("round_date"), F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"),
            F.when(k % 4 == 0, "Convertible Note").when(k % 4 == 1, "SAFE").when(k % 4 == 2, "Debt").otherwise("Common Stock").alias("security"),
            F.when(k % 7 != 0, F.col("o_totalprice") * (1 + k % 9)).alias("pre_money"), F.when(k % 3 != 0, (k % 40) / F.lit(100.0)).alias("equity"),
        )

    @cached_property
    def filings(self) -> DataFrame:
        flag = F.col("l_returnflag")
        return self.lineitem.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("filing_id"), F.col("l_orderkey").alias("round_id"), (F.col("l_suppkey") % 500).alias("cik"), (F.col("l_partkey") % 200).alias("company_id"), F.to_date("l_shipdate").alias("filing_date"),
            F.col("l_extendedprice").alias("revenue"), F.col("l_quantity").alias("staff"), F.when((flag == "R") & (F.col("l_linenumber") == 7), "C-TR").when(flag == "A", "C-AR").when(flag == "N", "C").otherwise("C-U").alias("form_type"),
        )

    @cached_property
    def facts(self) -> DataFrame:
        k = F.col("event_id")
        return self.events.select(
            k.alias("fact_id"), F.col("user_id").alias("entity_id"), F.to_date("ts").alias("as_of_date"), F.col("event_type").alias("feature_name"), "value", (1 + k % 3).alias("tier"),
            F.when(k % 4 == 0, "sec_form_d").when(k % 4 == 1, "manual").when(k % 4 == 2, "web_scrape").otherwise("academic").alias("source"),
        )

    @cached_property
    def deals(self) -> DataFrame:
        k = F.col("round_id")
        return self.rounds.join(self.companies, "company_id").select(
            k.alias("deal_id"), "company_id", "sector", "country", "stage", "outcome", F.col("round_date").alias("deal_date"), "amount", "pre_money", "equity", ((k * 7919) % 1000 / F.lit(10.0)).alias("score"),
            F.when(F.col("outcome") == "failed", 1).otherwise(0).alias("failed"), (k % 3 != 0).alias("has_revenue"), (k % 4 != 0).alias("has_institution"), (k % 5 != 0).alias("eis_eligible"),
        )


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly to four tasks a core, whatever row groups their files have."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def query(name: str, sql: str | None = None):
    """Registers a function of Tables under a name, with the SQL for the same rows."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            used: list[str] = []

            def need(text: str) -> None:
                for v in VIEWS:
                    if v not in used and re.search(rf"\b{v}\b", text):
                        need(VIEWS[v])
                        used.append(v)

            need(sql)
            body = sql.strip()
            views = ", ".join(f"{v} AS ({VIEWS[v]})" for v in used)
            if views and body.upper().startswith("WITH RECURSIVE "):
                body = f"WITH RECURSIVE {views}, {body[15:]}"
            elif views and body.upper().startswith("WITH "):
                body = f"WITH {views}, {body[5:]}"
            elif views:
                body = f"WITH {views} {body}"
            SQL[name] = body
        return f

    return register
