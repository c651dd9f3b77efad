"""Walk-forward backtests: baselines, portfolios, metrics and the models themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.graph import checkpoints

from granary.operators.windows import capped

#: Metric, comparison, threshold, whether it must pass.
GATES = (
    ("survival_auc", ">=", 0.65, True),
    ("calibration_ece", "<", 0.08, True),
    ("quality_vs_random", ">", 1.3, True),
    ("failure_vs_random", "<", 0.7, True),
    ("text_auc", ">=", 0.60, True),
    ("progress_auc", ">=", 0.58, False),
    ("uncertainty_rate", "<=", 0.40, False),
    ("sector_share", "<=", 0.50, False),
)


def seeded(key: Column, seed: str) -> Column:
    """A number from 0 to 100 drawn by hash."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0) * 100


def heuristic(revenue: Column, institution: Column, eis: Column) -> Column:
    return F.when(revenue & institution & eis, 100.0).otherwise(0.0)


def quality(outcome: Column, growth: Column) -> Column:
    return F.when(outcome == "failed", 0.0).when(growth.isNull(), 1.0).when(growth < -0.1, 0.5).when(growth <= 0.1, 1.0).otherwise(1.0 + F.least(growth, F.lit(2.0)))


def portfolios(deals: DataFrame, by: list[str], score: str, least: float, per_sector: int = 4, total: int = 20) -> DataFrame:
    """Selected deals of each window and their failure rate, quality and abstention, all windows at once."""
    able = deals.where(F.col(score) >= least)
    picked = capped(able, "sector", per_sector, total, [F.desc(score), F.col("deal_id")], by)
    sums = picked.groupBy(*by).agg(F.count("*").alias("n"), F.avg("failed").alias("failure_rate"), F.avg(quality(F.col("outcome"), F.col("growth"))).alias("quality"), F.sum("amount").alias("invested"))
    every = deals.groupBy(*by).agg(F.avg(F.when(F.col(score) < least, 1.0).otherwise(0.0)).alias("abstention"))
    return every.join(sums, by, "left")


def passed(value: Column, comparison: str, threshold: float) -> Column:
    """A missing or NaN value never passes."""
    v = F.nanvl(value, F.lit(None).cast("double"))
    ok = {">=": v >= threshold, ">": v > threshold, "<": v < threshold, "<=": v <= threshold}[comparison]
    return F.coalesce(ok, F.lit(False))


def gated(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Long rows (by, metric, value, passed, must_pass) of a wide metrics table."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), passed(F.col(m), op, t).alias("passed"), F.lit(must).alias("must_pass")) for m, op, t, must in GATES if m in metrics.columns])
    return metrics.select(*by, F.explode(rows).alias("_m")).select(*by, "_m.*")


#: Signals without a source so far.
NOT_YET = ("wayback_active", "job_posting_volume", "app_store_rating", "social_followers", "patent_count", "news_sentiment", "regulatory_flags")


def signals(rows: DataFrame, key: str, date: str, last_filing: str) -> DataFrame:
    """(key, signal, value, confidence) of each row: days since its last filing, and the open signals without a value."""
    days = F.datediff(date, last_filing).cast("double")
    sure = F.when(days.isNull(), 0.0).when(days <= 365, 0.9).otherwise(0.5)
    one = lambda name, value, c: F.struct(F.lit(name).alias("signal"), value.alias("value"), c.alias("confidence"))
    told = F.array(one("filing_recency_days", days, sure), *[one(n, F.lit(None).cast("double"), F.lit(0.0)) for n in NOT_YET])
    return rows.select(key, F.explode(told).alias("_s")).select(key, "_s.*")


def matrix(deals: DataFrame, numeric: list[str], categorical: list[str], kept: tuple[str, ...] = ()) -> DataFrame:
    """Model inputs: a missing number is 0 if the row has any other, else null; categories are hashed to 100000. Other columns are kept by name."""
    some = F.lit(False)
    for c in numeric:
        some = some | F.col(c).isNotNull()
    return deals.select("deal_id", "failed", *[F.when(some, F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in numeric], *[F.pmod(F.crc32(F.coalesce(F.col(c), F.lit("")).cast("binary")), F.lit(100000)).cast("double").alias(c) for c in categorical], *kept)


#: Rows from which on probabilities are calibrated, and by an isotonic fit instead of a sigmoid.
LEAST_CALIBRATED, LEAST_ISOTONIC = 120, 500
FOLDS = 3


def _fitted(kind: str, rows: DataFrame, label: str):
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier

    common = {"labelCol": label, "featuresCol": "_x", "weightCol": "_w", "maxDepth": 5, "seed": 42}
    maker = GBTClassifier(maxIter=10, stepSize=0.1, **common) if kind == "boosted" else RandomForestClassifier(numTrees=30, subsamplingRate=0.9, **common)
    return maker.fit(rows)


def _with_chance(model, rows: DataFrame, name: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows).withColumn(name, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def _calibrator(held: DataFrame, label: str, isotonic: bool):
    """A function that replaces column _p by calibrated chances, fitted on rows with _p and the label."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    if isotonic:
        fitted = IsotonicRegression(featuresCol="_p", labelCol=label, weightCol="_one").fit(held.withColumn("_one", F.lit(1.0)).withColumn(label, F.col(label).cast("double")))
        return lambda df: fitted.transform(df).drop("_p").withColumnRenamed("prediction", "_p")
    odds = lambda df: VectorAssembler(inputCols=["_o"], outputCol="_v").transform(df.withColumn("_o", F.log(F.greatest(F.col("_p"), F.lit(1e-6)) / F.greatest(1 - F.col("_p"), F.lit(1e-6)))))
    fitted = LogisticRegression(labelCol=label, featuresCol="_v").fit(odds(held))
    return lambda df: _with_chance(fitted, odds(df).drop("_p"), "_p").drop("_o", "_v")


def trained(train: DataFrame, test: DataFrame, inputs: list[str], key: str, label: str = "failed", calibrate: bool = True) -> tuple[DataFrame, str, dict[str, float]]:
    """Boosted trees, a forest as challenger and the mean of both, the one with the largest AUC on the test rows: these
    with p_failed and score, its name, and all AUCs. With enough rows each model is fitted without one fold of hashed
    keys after the other, calibrated on that fold, and the folds' chances are averaged."""
    from pyspark.ml.feature import VectorAssembler

    from granary.operators.aggregates import auc

    # models pass over their rows dozens of times, so what these are made from is computed once
    checkpoints(train.sparkSession)
    train, test = train.checkpoint(), test.checkpoint()
    n, positive = train.agg(F.count("*"), F.sum(F.col(label).cast("long"))).first()
    positive, negative = max(positive or 0, 1), max(n - (positive or 0), 1)
    vectors = VectorAssembler(inputCols=inputs, outputCol="_x", handleInvalid="keep")
    weight = F.when(F.col(label) == 1, min(negative / positive, 10.0)).otherwise(min(positive / negative, 10.0))
    fold = F.pmod(F.xxhash64(F.lit("fold"), key), F.lit(FOLDS))
    known = vectors.transform(train.select(key, label, *inputs).fillna(0.0, inputs)).withColumn("_w", weight).withColumn("_fold", fold)
    scored = vectors.transform(test.fillna(0.0, inputs))
    for kind in ("boosted", "forest"):
        if not calibrate or n < LEAST_CALIBRATED:
            scored = _with_chance(_fitted(kind, known, label), scored, f"_{kind}")
            continue
        for i in range(FOLDS):
            model = _fitted(kind, known.where(F.col("_fold") != i).withColumn("_w", F.lit(1.0)), label)
            held = _with_chance(model, known.where(F.col("_fold") == i), "_p")
            to_chance = _calibrator(held, label, n >= LEAST_ISOTONIC)
            scored = to_chance(_with_chance(model, scored, "_p")).withColumnRenamed("_p", f"_{kind}{i}")
        parts = [f"_{kind}{i}" for i in range(FOLDS)]
        scored = scored.withColumn(f"_{kind}", sum((F.col(c) for c in parts), F.lit(0.0)) / FOLDS).drop(*parts)
    scored = scored.withColumn("_ensemble", (F.col("_boosted") + F.col("_forest")) / 2).drop("_x").checkpoint()
    names = ["boosted", "forest", "ensemble"]
    classes = test.agg(F.count_distinct(label)).first()[0]
    areas = {name: auc(scored, label, f"_{name}", least=1).first().auc if classes > 1 else 0.5 for name in names}
    best = max(names, key=lambda name: areas[name])  # of equal ones the first
    return scored.withColumn("p_failed", F.col(f"_{best}")).withColumn("score", (1 - F.col("p_failed")) * 100).drop(*[f"_{x}" for x in names]), best, areas


def progress_model(train: DataFrame, test: DataFrame, inputs: list[str], key: str, label: str, least_train: int = 30, least_test: int = 10) -> DataFrame | None:
    """trained() for progress labels; None with too few rows or one class."""
    counts = train.agg(F.count(label).alias("n"), F.min(label).alias("a"), F.max(label).alias("b")).first()
    if counts.n < least_train or counts.a == counts.b or test.limit(least_test).count() < least_test:
        return None
    return trained(train, test, inputs, key, label)[0]


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their rank from 0 by an order that has no ties, sorted by ranges: each partition counts its own rows and begins after those
    of the partitions before it. One number for each partition comes to the driver."""
    checkpoints(rows.sparkSession)
    place = F.monotonically_increasing_id()  # partition and place in it, in 33 bits
    held = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.shiftright(place, 33), "_at": place.bitwiseAND(F.lit((1 << 33) - 1))}).checkpoint()
    starts, before = [], 0
    for r in held.groupBy("_part").agg(F.max("_at").alias("most")).orderBy("_part").collect():
        starts.append((r["_part"], before))
        before += r.most + 1
    begins = rows.sparkSession.createDataFrame(starts, "_part long, _from long")
    return held.join(F.broadcast(begins), "_part").withColumn(name, F.col("_at") + F.col("_from")).drop("_part", "_at", "_from")


def permuted(rows: DataFrame, column: str, key: str, seed: int) -> DataFrame:
    """rows with the values of one column dealt out anew: two hashed orders of the rows, joined by rank."""
    order = lambda salt: [F.xxhash64(F.lit(salt), key), F.col(key)]
    values = ranked(rows.select(key, column), order(seed), "_rank").select("_rank", F.col(column).alias("_value"))
    mixed = ranked(rows, order(-seed - 1), "_rank").join(values, "_rank")
    return mixed.withColumn(column, F.col("_value")).select(*rows.columns)


def permutation_importance(score, rows: DataFrame, inputs: list[str], key: str, repeats: int = 5, seed: int = 42) -> dict[str, float]:
    """How much score(rows), a number, falls on average when one input is permuted."""
    base = score(rows)
    return {c: sum(base - score(permuted(rows, c, key, seed + i)) for i in range(repeats)) / repeats for c in inputs}
