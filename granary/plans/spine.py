"""Round spines, enrichment and backfills: the tables that the analytics start from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.parsing import terms
from granary.operators.graph import checkpoints
from granary.operators.joins import asof
from granary.operators.upserts import insert_absent


def fact_rows(wide: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Long rows (keys, field, value) of the columns that have a value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value")) for c in fields])).alias("_f")
    return wide.select(*keys, pairs).select(*keys, "_f.*").where("value is not null")


def round_facts(rounds: DataFrame, financials: DataFrame) -> DataFrame:
    """Facts of each round with the latest financials up to its date and the runway, cash over monthly burn."""
    left = rounds.select("round_id", "company_id", "round_date", "amount", "pre_money")
    wide = asof(left, financials, "company_id", "round_date", "period_end", ["cash", "burn"], "period_end", "round_id")
    wide = wide.withColumn("runway", F.try_divide("cash", F.nullif("burn", F.lit(0.0))))
    return fact_rows(wide, ["round_id"], ["amount", "pre_money", "cash", "burn", "runway"])


#: Characters that a text has at least to be read for terms.
SHORTEST = 180


def number_of(cik):
    return F.nullif(F.regexp_replace(cik.cast("string"), "^0+", ""), F.lit(""))


def term_facts(texts: DataFrame, text_id: str, text: str) -> DataFrame:
    """(text_id, field, number, said): every term that a text names, numbers apart from words."""
    rows = []
    for field, c in terms(F.col(text)).items():
        words = field in ("maturity_date", "participation", "lead_investor", "pro_rata")
        number, said = (F.lit(None).cast("double"), c.cast("string")) if words else (c.cast("double"), F.lit(None).cast("string"))
        rows.append(F.struct(F.lit(field).alias("field"), number.alias("number"), said.alias("said")))
    found = texts.select(text_id, F.explode(F.array(*rows)).alias("_f")).select(text_id, "_f.*")
    return found.where("number is not null or coalesce(said, '') <> ''")


def narrative_terms(rounds: DataFrame, texts: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(round_id, field, number, said, text_id, as_of, tier) of the terms in one text for each American round: the latest up to its date
    of the company itself, and only where there is none the latest of the same number. A round without a date takes the last of all. Both
    looks are as-of reads of two time lines; texts move by id alone, and only those that a round takes are read for terms, each once."""
    long = texts.where(F.length("text") >= shortest)
    at = F.coalesce("round_date", F.lit("9999-12-31").cast("date")).alias("_at")
    left = rounds.where("country = 'US'").select("round_id", "company_id", number_of(F.col("cik")).alias("number"), "round_date", at)
    dated = long.select("company_id", number_of(F.col("cik")).alias("number"), F.col("filed").alias("_filed"), F.col("text_id").alias("_text"))

    def latest(on: str, name: str) -> DataFrame:
        best = asof(left, dated.select(on, "_filed", "_text"), on, "_at", "_filed", ["_text"], "_text", "round_id")
        return best.select("round_id", "round_date", F.when(F.col("_text").isNotNull(), F.struct(F.col("_filed").alias("filed"), F.col("_text").alias("text_id"))).alias(name))

    both = latest("company_id", "_own").join(latest("number", "_other").drop("round_date"), "round_id")
    chosen = both.select("round_id", "round_date", F.coalesce("_own", "_other").alias("_t")).where("_t is not null").select("round_id", "round_date", "_t.*")
    checkpoints(rounds.sparkSession)
    chosen = chosen.checkpoint()
    facts = term_facts(long.join(chosen.select("text_id").distinct(), "text_id", "left_semi"), "text_id", "text")
    return chosen.join(facts, "text_id").select("round_id", "field", "number", "said", "text_id", F.coalesce("filed", "round_date").alias("as_of"), F.lit("B").alias("tier"))


def cross_referenced(main: DataFrame, other: DataFrame, known: DataFrame, today: str) -> DataFrame:
    """Outcomes of companies that have none yet: trading where the other source has their number too, unknown where their
    campaign is more than three years old, else nothing."""
    seen = other.select("cik").distinct().withColumn("_seen", F.lit(True))
    old = F.col("campaign_date") < F.add_months(F.lit(today).cast("date"), -36)
    open_ = main.join(known, "company_id", "left_anti").join(seen, "cik", "left").where(F.col("_seen").isNotNull() | old)
    return open_.select("company_id", F.when(F.col("_seen"), "trading").otherwise("unknown").alias("outcome"), F.when(F.col("_seen"), 2).otherwise(3).alias("tier"))


def created(entities: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Entities after adding the first of the rows of each key that is not there yet."""
    from granary.operators.windows import first_by

    return insert_absent(entities, first_by(rows, keys, order).select(*entities.columns), keys)


def backfilled(deals: DataFrame) -> DataFrame:
    """Missing ratio (four places), age in full months, sector (the company's) and monthly burn of a loss (two places) from the columns
    they follow from; what is known stays."""
    ratio = F.when(F.col("target") > 0, F.round(F.col("amount") / F.col("target"), 4))
    age = F.when(F.col("deal_date") >= F.col("founded"), F.floor(F.months_between("deal_date", "founded")).cast("int"))
    burn = F.when(F.col("net_income") < 0, F.round(F.abs("net_income") / 12, 2))
    own = {"over": F.coalesce("over", ratio), "age_months": F.coalesce("age_months", age), "burn": F.coalesce("burn", burn)}
    return deals.withColumns(own | ({"sector": F.coalesce("sector", "company_sector")} if "company_sector" in deals.columns else {}))


#: Rows of a family at least, to train and to test on.
LEAST_TRAIN, LEAST_TEST = 120, 30


def family(train: DataFrame, test: DataFrame, country: str, stage: str, least_train: int = LEAST_TRAIN, least_test: int = LEAST_TEST) -> tuple[DataFrame, DataFrame, bool]:
    """Rows of a country and stage to train and to test on; where either are too few both are all rows, and the third is True."""
    own = (F.upper("country") == country) & (F.lower("stage") == stage)
    few = train.where(own).limit(least_train).count() < least_train or test.where(own).limit(least_test).count() < least_test
    return (train, test, True) if few else (train.where(own), test.where(own), False)


def visible(rows: DataFrame, roles: DataFrame, user: str, owner: str = "owner") -> DataFrame:
    """Rows that a user may see: all with a reading role, else their own."""
    may = roles.where((F.col("email") == user) & F.col("role").isin("admin", "reviewer")).select(F.lit(True).alias("_all")).limit(1)
    return rows.join(F.broadcast(may), how="left").where(F.col("_all").isNotNull() | (F.col(owner) == user)).drop("_all")
