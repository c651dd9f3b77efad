"""Alerts, reminders, retention, reports, freezes and samples for running the analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def new_alerts(rules: list[tuple[DataFrame, str, str, Column]], active: DataFrame) -> DataFrame:
    """Rows (type, priority, dedupe_key) of all rules whose key is not yet active; each key once."""
    found = None
    for rows, kind, priority, key in rules:
        part = rows.select(F.lit(kind).alias("type"), F.lit(priority).alias("priority"), F.concat_ws(":", F.lit(kind), key.cast("string")).alias("dedupe_key"))
        found = part if found is None else found.unionByName(part)
    return found.dropDuplicates(["dedupe_key"]).join(active.select("dedupe_key"), "dedupe_key", "left_anti").select("type", "priority", "dedupe_key")


def system_checks(reports: DataFrame, segments: DataFrame, windows: DataFrame, audits: DataFrame, today: str) -> list[tuple[DataFrame, str, str, Column]]:
    """Rules for new_alerts() over evidence reports (report_quarter, ready), segments (segment, ece, auc, open), backtest
    windows (segment, label, test_end, quality, failure) and audits (field, is_match, week)."""
    now = F.lit(today).cast("date")
    last = reports.orderBy(F.desc("report_quarter")).limit(1)
    nothing = reports.sparkSession.range(1).join(last.select(F.lit(0).alias("id")), "id", "left_anti")
    order = W.partitionBy("segment").orderBy(F.desc("test_end"), F.desc("label"))
    newest = windows.withColumn("_r", F.row_number().over(order)).where("_r = 1")
    recent = audits.where(F.col("is_match").isNotNull() & (F.col("week") >= F.date_sub(now, 84)))
    rates = recent.groupBy("field").agg(F.count("*").alias("n"), F.avg(F.col("is_match").cast("double")).alias("rate"))
    return [
        (nothing, "evidence_missing", "critical", F.lit(None)),
        (last.where(~F.coalesce("ready", F.lit(False))), "evidence_gate_closed", "critical", F.col("report_quarter")),
        (last.where(F.col("report_quarter") < F.trunc(now, "quarter")), "evidence_stale", "high", F.col("report_quarter")),
        (segments.where((F.col("ece") > 0.10) | (F.col("auc") < 0.65) | ~F.col("open")), "segment_drift", "high", F.col("segment")),
        (newest.where((F.col("quality") <= 1.3) | (F.col("failure") >= 0.7)), "backtest_regression", "high", F.concat_ws(":", "segment", "label")),
        (rates.where((F.col("n") >= 10) & (F.col("rate") < 0.85)), "transaction_qa_drift", "high", F.col("field")),
    ]


def delivery(due: Column, quiet: Column, priority: Column, sent: Column) -> Column:
    return F.when(sent, "sent").when(priority == "high", "send_now").when(quiet, "held").when(due, "queued").otherwise("waiting")


def frozen(current: DataFrame, saved: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose value's hash differs from the saved one, is new or is gone."""
    a = current.select(key, F.sha2(F.col(value).cast("string"), 256).alias("_now"))
    b = saved.select(key, F.sha2(F.col(value).cast("string"), 256).alias("_then"))
    state = F.when(F.col("_then").isNull(), "added").when(F.col("_now").isNull(), "removed").when(F.col("_now") != F.col("_then"), "changed").otherwise("same")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def deltas(runs: DataFrame, run: str, metrics: str, old: int, new: int) -> DataFrame:
    """Metrics of two runs by name and their differences; metrics of one run alone have none."""
    flat = runs.where(F.col(run).isin(old, new)).select(run, F.explode(metrics).alias("metric", "value"))
    both = flat.groupBy("metric").agg(F.max(F.when(F.col(run) == old, F.col("value"))).alias("before"), F.max(F.when(F.col(run) == new, F.col("value"))).alias("after"))
    return both.withColumn("delta", F.col("after") - F.col("before"))


#: What a segment's evidence needs (sample, AUC, calibration error), and valuations of high confidence (sample, mean and relative error).
EVIDENCE, VALUATION = (200, 0.65, 0.10), (30, 1.0, 0.55)


def evidence_report(segments: DataFrame, windows: DataFrame, curves: DataFrame, valuations: DataFrame, holdout: DataFrame, last: int = 5) -> DataFrame:
    """A quarter's evidence by segment: sample, auc, ece, gate_open, its `last` windows by test_end, the calibration curves' error weighted by
    n, the latest valuations of high confidence, evidence_ok, and, the same in all rows, the locked entities and whether a release is ready:
    all segments' evidence and valuations hold and some entities are locked. Segments are few; all else is grouped before it is joined."""
    newest = F.array_sort(F.collect_list("test_end"), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0))
    shown = windows.groupBy("segment").agg(F.slice(newest, 1, last).alias("windows"))
    known = curves.where(F.col("abs_error").isNotNull() & (F.col("n") > 0))
    error = known.groupBy("segment").agg((F.sum(F.col("abs_error") * F.col("n")) / F.sum("n")).alias("curve_error"))
    high = valuations.where("confidence = 'high'").groupBy("segment").agg(F.max_by(F.struct("n", "mae", "mape"), "quarter").alias("_v"))
    n, mae, mape = VALUATION
    allowed = F.coalesce((F.col("_v.n") >= n) & (F.col("_v.mae") <= mae) & (F.col("_v.mape") <= mape), F.lit(False))
    sample, area, gap = EVIDENCE
    ok = F.coalesce((F.col("sample") >= sample) & F.col("gate_open") & (F.col("auc") >= area) & (F.col("ece") <= gap), F.lit(False))
    own = segments.join(shown, "segment", "left").join(error, "segment", "left").join(high, "segment", "left")
    own = own.select(*segments.columns, ok.alias("evidence_ok"), "windows", "curve_error", F.col("_v.n").alias("high_n"), F.col("_v.mae").alias("high_mae"), F.col("_v.mape").alias("high_mape"), allowed.alias("high_allowed"))
    locked = holdout.agg(F.count("*").alias("holdout_entities"))
    ready = own.agg(F.bool_and("evidence_ok").alias("_e"), F.bool_and("high_allowed").alias("_h"))
    whole = ready.crossJoin(locked).select("holdout_entities", (F.coalesce(F.col("_e") & F.col("_h"), F.lit(False)) & (F.col("holdout_entities") > 0)).alias("release_ready"))  # one row
    return own.crossJoin(F.broadcast(whole))
