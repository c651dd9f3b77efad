"""Readers of filing-style files. All give strings with tidy column names; parsing to types is granary.functions'."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Forms kept from a filing index.
FORMS = ("C", "C-U", "C/A", "C-U/A", "C-AR", "C-AR/A", "C-TR")


def tidy(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def zipped_tsv(spark: SparkSession, path: str, member: str) -> DataFrame:
    """(file, line, cells) of the members whose names end in `member` (any case) of zip files, as zipped_lines() reads them."""
    from granary.sources.archives import zipped_lines

    return zipped_lines(spark, path, member).select("file", "line", "cells")


def cells(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.select("file", "line", *[F.coalesce(F.try_element_at("cells", F.lit(n)), F.lit("")).alias(tidy(n)) for n in names])


def joined_filings(main: DataFrame, others: list[DataFrame], key: str, order: str = "line") -> DataFrame:
    """main with the columns of others joined by key: of rows that repeat a key the last counts, of columns that several
    have the last table's value unless it is empty."""
    out = main
    for other in others:
        last = other.groupBy(key).agg(F.max_by(F.struct(*[c for c in other.columns if c not in (key, order, "file")]), order).alias("_o"))
        fields = last.schema["_o"].dataType.names
        both = out.join(last, key, "left")
        new = [F.coalesce(F.nullif(F.col(f"_o.{c}"), F.lit("")), F.col(c)).alias(c) if c in out.columns else F.col(f"_o.{c}").alias(c) for c in fields]
        out = both.select(*[c for c in out.columns if c not in fields], *new)
    return out


#: What an issuer's row takes from its submission if it has no such column, and from its offering in any case.
IF_LACKING = ("filing_date", "submissiontype", "sic_code")
FROM_OFFERING = ("totalofferingamount", "totalamountsold", "totalremaining", "sale_date", "federalexemptions_items_list", "industrygrouptype")


def notice_filings(issuers: DataFrame, submissions: DataFrame, offerings: DataFrame, key: str = "accessionnumber", order: str = "line") -> DataFrame:
    """Issuers with the columns of their submission and offering, of each the last row of an accession number. A submission's
    columns fill only columns that issuers lack; an offering's replace those of issuers, empty ones too. Issuers without a number drop out."""
    out = issuers.where(F.col(key) != "")
    for other, names, always in ((submissions, IF_LACKING, False), (offerings, FROM_OFFERING, True)):
        names = [c for c in names if c in other.columns and (always or c not in out.columns)]
        if not names:
            continue
        last = other.where(F.col(key) != "").groupBy(key).agg(F.max_by(F.struct(*names), order).alias("_o"))
        pick = lambda c: F.when(F.col("_o").isNotNull(), F.col(f"_o.{c}")).otherwise(F.col(c) if c in issuers.columns else F.lit(None)).alias(c)
        kept = [c for c in out.columns if c not in names]
        out = out.join(last, key, "left").select(*kept, *[pick(c) for c in names])
    return out


def index_lines(lines: DataFrame, column: str = "value", forms: tuple[str, ...] = FORMS) -> DataFrame:
    """Entries of a form index: the form first, then the name and, from the right, id, date and file."""
    pattern = r"^(\S+(?: \S+)?)\s{2,}(.*\S)\s{2,}(\d+)\s+(\d{4}-?\d{2}-?\d{2})\s+(\S+)\s*$"
    # no part can hold a line break; the generator keeps the match from being repeated for each column
    parts = F.split(F.regexp_replace(column, pattern, "$1\n$2\n$3\n$4\n$5"), "\n")
    found = lines.select(F.explode(F.array(F.when(F.col(column).rlike(pattern), parts))).alias("_p")).where("_p is not null")
    rows = found.select(*[F.col("_p")[i].alias(c) for i, c in enumerate(("form_type", "company", "cik", "date_filed", "filename"))])
    return rows.where(F.col("form_type").isin(*forms))


def csv_by_synonyms(spark: SparkSession, path: str, synonyms: dict[str, tuple[str, ...]], sep: str = ",") -> DataFrame:
    """Columns by their first synonym present; missing ones are null. All are strings."""
    raw = spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', inferSchema=False)
    have: dict[str, str] = {}
    for c in raw.columns:
        have.setdefault(tidy(c), c)  # of columns with one tidy name the first stays
    pick = lambda names: next((F.col(f"`{have[n]}`") for n in names if n in have), F.lit(None).cast("string"))
    return raw.select(*[pick(names).alias(k) for k, names in synonyms.items()])


#: The columns of four published datasets (tidy names) and the names that they get here.
DATASETS = {
    "walthoff_borm": {
        "company_name": "name",
        "company": "name",
        "platform": "platform",
        "campaign_date": "campaign_date",
        "campaign_year": "campaign_year",
        "amount_raised": "amount_raised",
        "target": "funding_target",
        "funding_target": "funding_target",
        "equity_offered": "equity_offered",
        "equity_offered_pct": "equity_offered",
        "pre_money_valuation": "pre_money_valuation",
        "valuation": "pre_money_valuation",
        "investor_count": "investor_count",
        "investors": "investor_count",
        "outcome": "outcome",
        "status": "outcome",
        "outcome_date": "outcome_date",
        "sector": "sector",
        "industry": "sector",
        "country": "country",
        "age_months": "company_age_at_raise_months",
        "company_age": "company_age_at_raise_months",
        "had_revenue": "had_revenue",
        "has_revenue": "had_revenue",
        "revenue_at_raise": "revenue_at_raise",
        "eis_eligible": "eis_seis_eligible",
        "seis_eligible": "eis_seis_eligible",
        "founder_count": "founder_count",
        "founders": "founder_count",
        "prior_exits": "founder_prior_exits",
        "founder_prior_exits": "founder_prior_exits",
        "accelerator": "accelerator_alumni",
        "accelerator_alumni": "accelerator_alumni",
        "overfunding_ratio": "overfunding_ratio",
    },
    "signori_vismara": {
        "company_name": "name",
        "firm_name": "name",
        "platform": "platform",
        "campaign_date": "campaign_date",
        "year": "campaign_year",
        "amount_raised": "amount_raised",
        "raised_eur": "amount_raised",
        "target_eur": "funding_target",
        "funding_target": "funding_target",
        "equity_pct": "equity_offered",
        "pre_money_eur": "pre_money_valuation",
        "investors": "investor_count",
        "n_investors": "investor_count",
        "outcome": "outcome",
        "status": "outcome",
        "sector": "sector",
        "country": "country",
        "age_at_campaign": "company_age_at_raise_months",
        "revenue_at_raise": "revenue_at_raise",
        "has_revenue": "had_revenue",
    },
    "kleinert": {
        "company_name": "name",
        "startup_name": "name",
        "platform": "platform",
        "campaign_date": "campaign_date",
        "year": "campaign_year",
        "amount_raised": "amount_raised",
        "raised_eur": "amount_raised",
        "funding_goal": "funding_target",
        "target_eur": "funding_target",
        "equity_pct": "equity_offered",
        "valuation_eur": "pre_money_valuation",
        "investors": "investor_count",
        "outcome": "outcome",
        "failure": "failure_flag",
        "sector": "sector",
        "industry": "sector",
        "country": "country",
        "age_months": "company_age_at_raise_months",
        "team_size": "founder_count",
        "experience_years": "founder_domain_experience_years",
    },
    "kingscrowd": {
        "company_name": "name",
        "company": "name",
        "platform": "platform",
        "campaign_date": "campaign_date",
        "date": "campaign_date",
        "amount_raised": "amount_raised",
        "total_raised": "amount_raised",
        "funding_target": "funding_target",
        "goal": "funding_target",
        "valuation": "pre_money_valuation",
        "pre_money_valuation": "pre_money_valuation",
        "investor_count": "investor_count",
        "investors": "investor_count",
        "outcome": "outcome",
        "rating": "kingscrowd_rating",
        "sector": "sector",
        "category": "sector",
        "country": "country",
        "revenue": "revenue_at_raise",
        "has_revenue": "had_revenue",
        "revenue_model": "revenue_model",
    },
}


def dataset(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The columns of a published dataset's CSV under the names used here, as strings; of columns that get one name the first
    in the file stays, others keep their tidy names, names that the file lacks are null."""
    known = DATASETS[name]
    raw = spark.read.csv(path, header=True, quote='"', escape='"', inferSchema=False)
    found: dict[str, str] = {}
    for c in raw.columns:
        found.setdefault(known.get(tidy(c), tidy(c)), c)
    lacking = [c for c in dict.fromkeys(known.values()) if c not in found]
    return raw.select(*[F.col(f"`{c}`").alias(k) for k, c in found.items()], *[F.lit(None).cast("string").alias(c) for c in lacking])


def delimiter(spark: SparkSession, path: str) -> str:
    """Tab or comma, whichever the file's beginning has more of."""
    head = "\n".join(r.value for r in spark.read.text(path).limit(20).collect())[:2048]
    return "\t" if head.count("\t") > head.count(",") else ","


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def submission_parts(text: Column) -> Column:
    """An array of (type, filename, body) of the documents in a submission."""
    get = lambda p, i: F.regexp_extract_all(text, F.lit(p), F.lit(i))
    whole = r"(?s)<DOCUMENT>\s*<TYPE>([^\n<]*).*?(?:<FILENAME>([^\n<]*))?[^<]*(?:<DESCRIPTION>[^\n<]*\s*)?<TEXT>(.*?)</TEXT>"
    return F.arrays_zip(get(whole, 1).alias("type"), get(whole, 2).alias("filename"), get(whole, 3).alias("body"))


def xml_fields(xml: Column, paths: list[str]) -> Column:
    """The texts at paths of element names, whatever their namespaces, as an array that is null where there is none: the XML is parsed
    once. No XML text can hold the separator U+0001."""
    bare = F.regexp_replace(F.regexp_replace(xml, r"<(/?)[A-Za-z0-9_]+:", "<$1"), r"\sxmlns(:\w+)?=\"[^\"]*\"", "")
    every = F.xpath_string(bare, F.lit("concat(" + ", '\x01', ".join(["''", *paths]) + ")"))
    return F.transform(F.slice(F.split(every, "\x01"), 2, len(paths)), lambda v: F.nullif(v, F.lit("")))


def xml_field(xml: Column, path: str) -> Column:
    """The text at one path, as xml_fields."""
    return xml_fields(xml, [path])[0]


def quoted_fields(line: Column, names: list[str]) -> Column:
    """A line of comma-separated values, quotes doubled inside quotes, as a struct."""
    return F.from_csv(line, ", ".join(f"{n} string" for n in names), {"quote": '"', "escape": '"'})


def sheets(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, row, cells) of the worksheets of XLSX files, read from their XML without further libraries."""
    import xml.etree.ElementTree as ET

    def rows(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
        for batch in files:
            made = []
            for where, raw in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    shared = []
                    if "xl/sharedStrings.xml" in z.namelist():
                        shared = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{ns}si")]
                    for name in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)):
                        for i, row in enumerate(ET.fromstring(z.read(name)).iter(f"{ns}row")):
                            values = []
                            for c in row.iter(f"{ns}c"):
                                v = c.find(f"{ns}v")
                                text = "".join(t.text or "" for t in c.iter(f"{ns}t")) if v is None else v.text or ""
                                values.append(shared[int(text)] if c.get("t") == "s" else text)
                            made.append((where, name.rsplit("/", 1)[1][:-4], i, values))
            yield pd.DataFrame(made, columns=["file", "sheet", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "file string, sheet string, row int, cells array<string>")


def company_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Registry profiles from JSON files: number, name, status, created, overdue accounts and active officers."""
    schema = "company_number string, company_name string, company_status string, date_of_creation string, accounts struct<overdue:boolean>, officers array<struct<name:string,resigned_on:string>>"
    raw = spark.read.schema(schema).json(path)
    active = F.filter("officers", lambda o: o["resigned_on"].isNull())
    return raw.select("company_number", "company_name", F.lower("company_status").alias("status"), F.try_to_date("date_of_creation", "yyyy-MM-dd").alias("created"), F.coalesce("accounts.overdue", F.lit(False)).alias("overdue"), F.coalesce(F.size(active), F.lit(0)).alias("officers"))


def quarter_archive(year: int, quarter: int) -> str:
    """The name of a quarter's archive; refuses quarters that no archive covers."""
    #: Years that archives cover.
    if not 2017 <= year <= 2030 or quarter not in (1, 2, 3, 4):
        raise ValueError(f"no archive for {year} Q{quarter}")
    return f"{year}q{quarter}.zip"


def latest_link(links: DataFrame, url: str, by: list[str]) -> DataFrame:
    """Of each group the link whose name has the latest date (MMDDYY or YYYYMMDD); links without a date are left out."""
    short, long = F.regexp_extract(url, r"(\d{2})(\d{2})(\d{2})(?!\d)", 0), F.regexp_extract(url, r"(20\d{2})(\d{2})(\d{2})(?!\d)", 0)
    day = F.coalesce(F.try_to_date(F.nullif(long, F.lit("")), "yyyyMMdd"), F.try_to_date(F.nullif(short, F.lit("")), "MMddyy"))
    return links.withColumn("day", day).where("day is not null").groupBy(*by).agg(F.max(F.struct("day", url)).alias("_l")).select(*by, F.col("_l.day").alias("day"), F.col(f"_l.{url}").alias(url))


#: Documents of an upload, bytes of each, and characters of text kept from each.
UPLOAD_FILES, UPLOAD_BYTES, UPLOAD_CHARS = 3, 2_000_000, 8000


def accepted_uploads(files: DataFrame, upload: str, order: str, size: str, text: str) -> DataFrame:
    """The first files of each upload that are small enough, with the beginning of their texts."""
    from granary.operators.windows import W

    fit = files.where(F.col(size) <= UPLOAD_BYTES).withColumn("_r", F.row_number().over(W.partitionBy(upload).orderBy(order)))
    return fit.where(F.col("_r") <= UPLOAD_FILES).withColumn(text, F.substring(text, 1, UPLOAD_CHARS)).drop("_r")


def official_signals(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON of official sources as long rows (company_id, signal, observed, value)."""
    raw = spark.read.schema("company_id long, observed string, grants double, patents double, tenders double").json(path)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("signal"), F.col(c).alias("value")) for c in ("grants", "patents", "tenders")])).alias("_s")
    return raw.select("company_id", F.try_to_date("observed", "yyyy-MM-dd").alias("observed"), pairs).select("company_id", "observed", "_s.*").where("value is not null and observed is not null")
