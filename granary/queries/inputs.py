"""Queries of sources/files.py over lines made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.queries.base import query, spread
from granary.sources import landed as D
from granary.sources import files as S


@query("src5_form_index", "SELECT form_type, 'Firm ' || company_id AS company, cik::VARCHAR AS cik, strftime(filing_date, '%Y-%m-%d') AS date_filed, 'edgar/' || filing_id || '.txt' AS filename FROM filings WHERE form_type IN ('C', 'C-U', 'C-AR', 'C-TR')")
def form_index(t):
    line = F.concat(F.rpad("form_type", 12, " "), F.rpad(F.concat(F.lit("Firm "), "company_id"), 40, " "), F.rpad(F.col("cik").cast("string"), 12, " "), F.date_format("filing_date", "yyyy-MM-dd"), F.lit("  edgar/"), "filing_id", F.lit(".txt   "))
    head = t.spark.createDataFrame([("Form Type   Company Name   CIK   Date Filed  File Name",), ("-" * 80,), ("",)], "value string")
    filings = spread(t.filings.select("form_type", "company_id", "cik", "filing_date", "filing_id"))
    return S.index_lines(head.unionByName(filings.select(line.alias("value"))))


@query("src10_submission_parts", "SELECT round_id, i::INTEGER AS i, CASE i WHEN 0 THEN 'C' ELSE 'EX-99' END AS type, CASE i WHEN 0 THEN 'amount ' || floor(amount)::BIGINT ELSE 'note' END AS body FROM rounds, range(2) r(i)")
def parts(t):
    doc = lambda kind, body: F.concat(F.lit(f"<DOCUMENT>\n<TYPE>{kind}\n<SEQUENCE>1\n<FILENAME>a.txt\n<TEXT>\n"), body, F.lit("\n</TEXT>\n</DOCUMENT>\n"))
    text = F.concat(F.lit("<SEC-HEADER>x</SEC-HEADER>\n"), doc("C", F.concat(F.lit("amount "), F.floor("amount").cast("string"))), doc("EX-99", F.lit("note")))
    return t.rounds.select("round_id", F.posexplode(S.submission_parts(text)).alias("i", "p")).select("round_id", "i", F.trim("p.type").alias("type"), F.regexp_replace("p.body", r"^\s+|\s+$", "").alias("body"))


@query("src11_xml_fields", "SELECT company_id, name AS issuer, CASE WHEN balance > 0 THEN floor(balance)::BIGINT::VARCHAR END AS cash FROM companies")
def xml(t):
    cash = F.when(F.col("balance") > 0, F.concat(F.lit("<n1:cash>"), F.floor("balance").cast("string"), F.lit("</n1:cash>"))).otherwise("")
    doc = F.concat(F.lit('<n1:form xmlns:n1="urn:x"><n1:issuer><n1:name>'), "name", F.lit("</n1:name></n1:issuer>"), cash, F.lit("</n1:form>"))
    fields = S.xml_fields(doc, ["form/issuer/name/text()", "form/cash/text()"])
    # a small file can hold many rows, so rows are dealt to all cores before they are parsed; explode keeps the array from being made for each field
    read = spread(t.companies.select("company_id", "name", "balance")).select("company_id", F.explode(F.array(fields)).alias("_f"))
    return read.select("company_id", F.col("_f")[0].alias("issuer"), F.col("_f")[1].alias("cash"))


@query("src13_quoted_csv", "SELECT company_id, 'Say \"' || name || '\", Inc' AS listed, country FROM companies")
def quoted(t):
    line = F.concat(F.lit('"Say ""'), "name", F.lit('"", Inc",'), "country")
    return t.companies.select("company_id", S.quoted_fields(line, ["listed", "place"]).alias("c")).select("company_id", "c.listed", F.col("c.place").alias("country"))


@query("src8_latest_link", "SELECT p_brand, max(DATE '2020-01-01' + (p_partkey % 900)::INTEGER) AS day FROM part WHERE p_partkey % 5 <> 0 GROUP BY 1")
def latest_link(t):
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("p_partkey") % 900).cast("int"))
    name = F.when(F.col("p_partkey") % 5 == 0, "https://x/ia-latest.zip").when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("https://x/ia"), F.date_format(day, "MMddyy"), F.lit(".zip"))).otherwise(F.concat(F.lit("https://x/adv-"), F.date_format(day, "yyyyMMdd"), F.lit(".zip")))
    return S.latest_link(t.part.select("p_brand", name.alias("url")), "url", ["p_brand"]).select("p_brand", "day")


@query("src14_uploads", "SELECT conv_id, turn, substr(text, 1, 8000) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE strlen(text) <= 2000000) WHERE r <= 3")
def uploads(t):
    files = t.conversations.select("conv_id", "turn", "text", F.octet_length("text").alias("bytes"))
    return S.accepted_uploads(files, "conv_id", "turn", "bytes", "text").select("conv_id", "turn", "text")


@query(
    "tt4_allotments",
    """WITH x AS (SELECT o_orderkey AS k, o_custkey AS c, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate::DATE END AS d, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey % 40 + 1) / 4.0::DOUBLE END AS price, CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 900 + 1) * 10.0::DOUBLE END AS shares FROM orders WHERE o_orderstatus <> 'P'),
    a AS (SELECT c AS company_id, d AS round_date, CASE WHEN shares IS NULL THEN price ELSE price * shares END AS amount, 'T' || lpad(k::VARCHAR, 9, '0') AS record_id FROM x WHERE c % 2 = 0),
    r AS (SELECT *, company_id || ':' || coalesce(strftime(round_date, '%Y-%m-%d'), 'unknown') || ':uk_share_allotment:equity:' || coalesce(printf('%.2f', amount), 'unknown') AS round_key FROM a)
    SELECT round_key, max(company_id) AS company_id, max(round_date) AS round_date, max(amount) AS amount, max(record_id) AS record_id, 'A' AS tier FROM r GROUP BY 1""",
)
def allotment_rounds(t):
    """Filing histories written as nested JSON, one for each company, and read again; half of the companies are known."""
    k = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    price = F.when(k % 5 != 0, text((k % 40 + 1) / F.lit(4.0)))
    shares = F.when(k % 3 != 0, F.concat(text((k % 900 + 1) * 10), F.lit(".0")))
    values = F.map_from_arrays(F.array(*map(F.lit, ("nominal_value_per_share", "amount", "number_allotted", "total_number_of_shares_allotted"))), F.array(F.when(k % 2 == 0, price), price, F.when(k % 4 < 2, shares), shares))
    item = F.struct(
        F.when(F.col("o_orderstatus") == "P", "CS01").when(k % 7 == 0, "sh01").otherwise("SH01").alias("type"), F.when(k % 11 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"), F.lit(None).cast("string").alias("action_date"),
        F.when(k % 2 == 0, F.concat(F.lit("T"), F.lpad(text(k), 9, "0"))).alias("transaction_id"), F.concat(F.lit("T"), F.lpad(text(k), 9, "0")).alias("barcode"), values.alias("description_values"),
    )
    said = t.orders.groupBy(text(F.col("o_custkey")).alias("company_number")).agg(F.to_json(F.struct(F.collect_list(item).alias("items"))).alias("j"))
    history = said.select("company_number", F.from_json("j", D.HISTORY.split(", ", 1)[1]).alias("h")).select("company_number", "h.items")
    own = t.customer.where("c_custkey % 2 = 0").select(text(F.col("c_custkey")).alias("company_number"), F.col("c_custkey").alias("company_id"), F.lit(None).cast("string").alias("country"), F.col("c_mktsegment").alias("sector"))
    return D.allotments(history, own).select("round_key", "company_id", "round_date", "amount", "record_id", "tier")
