"""Landed JSON of registries: filing histories with share allotments, and lists of filings as parallel arrays, flattened to rounds and facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.parsing import date_of, filing_terms, number, round_key

#: What is read of a company's filing history, and of a filer's submissions; anything else in the files is left aside.
HISTORY = "company_number string, items array<struct<type:string,date:string,action_date:string,transaction_id:string,barcode:string,links:struct<self:string>,description_values:map<string,string>>>"
SUBMISSIONS = "cik string, filings struct<recent:struct<form:array<string>,accessionNumber:array<string>,primaryDocument:array<string>,filingDate:array<string>>>"
#: The form of an allotment, what it is as a round, and where its price and its number of shares stand, first ones first.
ALLOTMENT, ROUND_TYPE, INSTRUMENT = "SH01", "uk_share_allotment", "equity"
PRICES = ("nominal_value_per_share", "aggregate_nominal_value", "amount")
SHARES = ("number_allotted", "total_number_of_shares_allotted")
#: Forms that late-stage terms are read from.
LATE_FORMS = ("8-K", "S-1", "424B1", "424B2", "424B3", "424B4", "D")


def histories(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY).json(path)


def submissions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUBMISSIONS).json(path)


def _first_of(values: Column, names: tuple[str, ...]) -> Column:
    return number(F.coalesce(*[F.nullif(F.trim(F.try_element_at(values, F.lit(n))), F.lit("")) for n in names]))


def allotments(history: DataFrame, companies: DataFrame) -> DataFrame:
    """Rounds of share allotments: company_id, country, sector, round_date, amount (shares times price, the price alone without shares),
    record_id, url, round_key, tier. companies (company_number, company_id, country, sector) says whose they are; others have
    none. Of allotments with one key, the last record's stays."""
    items = history.select("company_number", F.explode("items").alias("f")).where(F.upper("f.type") == ALLOTMENT)
    values = F.col("f.description_values")
    price, shares = _first_of(values, PRICES), _first_of(values, SHARES)
    filed = date_of(F.coalesce(F.nullif(F.col("f.date"), F.lit("")), F.col("f.action_date")))
    record = F.coalesce(F.nullif(F.col("f.transaction_id"), F.lit("")), F.col("f.barcode"))
    rows = items.select("company_number", filed.alias("round_date"), F.when(price.isNotNull() & shares.isNotNull(), price * shares).otherwise(price).alias("amount"), record.alias("record_id"), F.col("f.links.self").alias("url"))
    own = rows.join(companies.select("company_number", "company_id", F.coalesce("country", F.lit("UK")).alias("country"), "sector"), "company_number")
    key = round_key(F.col("company_id"), F.col("round_date"), F.lit(ROUND_TYPE), F.lit(INSTRUMENT), F.col("amount"))
    fields = ["company_id", "country", "sector", "round_date", "amount", "record_id", "url"]
    last = own.withColumn("round_key", key).groupBy("round_key").agg(F.max_by(F.struct(*fields), F.coalesce("record_id", F.lit(""))).alias("_r"))
    return last.select("round_key", "_r.*", F.lit("A").alias("tier"))


def allotment_facts(rounds: DataFrame) -> DataFrame:
    """(round_key, field, said, record_id, as_of, tier) of what an allotment says; nulls say nothing."""
    said = {"round_type": F.lit(ROUND_TYPE), "instrument_type": F.lit(INSTRUMENT), "round_date": F.col("round_date").cast("string"), "amount_raised": F.format_string("%.2f", "amount")}
    said["amount_raised"] = F.when(F.col("amount").isNotNull(), said["amount_raised"])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), v.alias("said")) for k, v in said.items()])).alias("_f")
    return rounds.select("round_key", pairs, "record_id", F.col("round_date").alias("as_of"), "tier").select("round_key", "_f.*", "record_id", "as_of", "tier").where("said is not null")


def late_filings(submitted: DataFrame) -> DataFrame:
    """(cik, form, accession, document, filed) of each filer's first listed filing of a late form, of those with a document."""
    recent = F.col("filings.recent")
    rows = F.arrays_zip(recent["form"].alias("form"), recent["accessionNumber"].alias("accession"), recent["primaryDocument"].alias("document"), recent["filingDate"].alias("filed"))
    first = F.try_element_at(F.filter(rows, lambda x: x["form"].isin(*LATE_FORMS)), F.lit(1))
    found = submitted.select(F.ltrim("cik", F.lit("0")).alias("cik"), first.alias("_f")).where("_f is not null")
    out = found.select("cik", "_f.form", F.replace("_f.accession", F.lit("-"), F.lit("")).alias("accession"), "_f.document", date_of(F.col("_f.filed")).alias("filed"))
    return out.where("coalesce(cik, '') <> '' and coalesce(accession, '') <> '' and coalesce(document, '') <> ''")


def late_terms(rounds: DataFrame, filings: DataFrame, documents: DataFrame, least: float = 5e6) -> DataFrame:
    """(round_id, field, said, record_id, as_of, tier) of the terms in the filing of each American round in early growth or of `least` or more.
    rounds have cik, country, stage and amount; documents (accession, text) hold the landed texts, of which each is read once."""
    found = filing_terms(F.col("text"))
    terms = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), v.cast("string").alias("said")) for k, v in found.items()])).alias("_t")
    facts = filings.join(documents.select("accession", "text"), "accession").select("cik", "accession", "filed", terms).select("cik", "accession", "filed", "_t.*").where("said is not null")
    late = rounds.where((F.col("country") == "US") & ((F.col("stage") == "early_growth") | (F.col("amount") >= least)))
    own = late.select("round_id", F.ltrim(F.col("cik").cast("string"), F.lit("0")).alias("cik"))
    return own.join(facts, "cik").select("round_id", "field", "said", F.concat_ws(":", F.lpad("cik", 10, "0"), "accession").alias("record_id"), F.col("filed").alias("as_of"), F.lit("B").alias("tier"))
