"""Summaries and quality gates of repeated analyst runs, and the choice of diverse items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.operators.aggregates import majority, pairwise_agreement

#: Gates of a set of runs.
STABILITY = (("fallback_rate", "<=", 0.25), ("majority_agreement", ">=", 0.75), ("least_pairwise", ">=", 0.80), ("disagreement_sd", "<=", 0.10), ("model_coverage", ">=", 0.30), ("classes", ">=", 3.0))
#: Bonus of an unseen class, sector and country.
BONUS = {"class": 3, "sector": 2, "country": 1}


def summary(decisions: DataFrame, by: list[str]) -> DataFrame:
    """Items, decisions, shares of disagreement, fallback and abstention, classes and model coverage of each run over
    rows (by, item, class, fallback, model_class)."""
    items = decisions.groupBy(*by, "item").agg(F.count_distinct("class").alias("_classes"), F.count("model_class").alias("_model"), F.count("*").alias("_n"))
    per_item = items.groupBy(*by).agg(F.count("*").alias("items"), F.sum("_n").alias("decisions"), F.avg((F.col("_classes") > 1).cast("double")).alias("disagreement_rate"), F.avg((F.col("_model") > 0).cast("double")).alias("model_coverage"))
    rates = decisions.groupBy(*by).agg(F.avg(F.col("fallback").cast("double")).alias("fallback_rate"), F.avg((F.col("class") == "abstain").cast("double")).alias("abstain_rate"), F.count_distinct("class").cast("double").alias("classes"))
    return per_item.join(rates, by)


def stability(decisions: DataFrame) -> DataFrame:
    """Long rows (gate, value, passed) over all runs; agreement counts decisions that are no fallback alone."""
    own = decisions.where(~F.col("fallback"))
    votes = majority(own, ["run", "item"], "class", "ord")
    a, b = votes.select("item", F.col("run").alias("ra"), F.col("majority").alias("ma")), votes.select("item", F.col("run").alias("rb"), F.col("majority").alias("mb"))
    same = a.join(b, "item").where("ra < rb").agg(F.avg((F.col("ma") == F.col("mb")).cast("double")).alias("majority_agreement"))
    pairs = pairwise_agreement(own, ["item", "agent"], "run", "class").agg(F.min("agreement").alias("least_pairwise"))
    by_run = votes.groupBy("run").agg(F.avg((F.col("disagreement") > 0).cast("double")).alias("d")).agg(F.coalesce(F.stddev_samp("d"), F.lit(0.0)).alias("disagreement_sd"))
    rates = decisions.agg(F.avg(F.col("fallback").cast("double")).alias("fallback_rate"), F.count_distinct("class").cast("double").alias("classes"))
    cover = decisions.groupBy("item").agg(F.count("model_class").alias("m")).agg(F.avg((F.col("m") > 0).cast("double")).alias("model_coverage"))
    wide = same
    for one_row in (pairs, by_run, rates, cover):
        wide = wide.join(F.broadcast(one_row))  # each has one row
    ok = {"<=": lambda v, t: v <= t, ">=": lambda v, t: v >= t}
    rows = F.array(*[F.struct(F.lit(g).alias("gate"), F.col(g).alias("value"), F.coalesce(ok[op](F.col(g), t), F.lit(False)).alias("passed")) for g, op, t in STABILITY])
    return wide.select(F.explode(rows).alias("_g")).select("_g.*")


def diverse(items: DataFrame, n: int) -> DataFrame:
    """n of rows (id, class, sector, country, evidence): the best of each class first, then one by one the item with the
    best evidence plus bonus for what is not yet chosen. Choosing is sequential, so the driver does it, over all items
    that can be chosen: of items with the same class, sector and country, which have the same bonus, the n best, if their
    evidence with every bonus reaches the n-th best evidence, since one of the n best items is always left."""
    from granary.operators.windows import first_by

    cols = ["id", "class", "sector", "country", "evidence"]
    order, rows = [F.desc("evidence"), F.col("id")], items.select(*cols)
    first = first_by(rows, ["class"], *order).orderBy(*order).limit(n).collect()
    best = [r.evidence for r in rows.orderBy(*order).limit(n).collect()]
    least = best[-1] - sum(BONUS.values()) if len(best) == n else float("-inf")
    alike = W.partitionBy("class", "sector", "country").orderBy(*order)
    able = rows.where(F.col("evidence") >= least).withColumn("_r", F.row_number().over(alike)).where(F.col("_r") <= n)
    pool, chosen = {r.id: r for r in able.collect()}, list(first)
    seen = {k: {r[k] for r in chosen} - {None} for k in BONUS}
    for r in chosen:
        pool.pop(r.id, None)
    while pool and len(chosen) < n:
        bonus = lambda r: sum(v for k, v in BONUS.items() if r[k] is not None and r[k] not in seen[k])
        r = min(pool.values(), key=lambda r: (-(r.evidence + bonus(r)), r.id))
        pool.pop(r.id)
        chosen.append(r)
        for k in BONUS:
            seen[k].add(r[k])
    return items.sparkSession.createDataFrame([(r.id, i) for i, r in enumerate(chosen, 1)], "id long, pick int")
