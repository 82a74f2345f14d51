"""Experiment-run analytics: nested run records -> flat table -> parameter trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.operators.aggregates import heuristic_recurring


def heuristic_grid_runs(cand: DataFrame, tolerances: list[float], cv_thresholds: list[float],
                        dom_thresholds: list[float]) -> DataFrame:
    """Evaluate the fixed rule for every parameter setting in one plan; one JSON run
    record {params: {...}, metrics: {precision, recall, f1, accepted}} per setting."""
    spark = cand.sparkSession
    grid = spark.createDataFrame([(float(a), float(b), float(c)) for a in tolerances for b in cv_thresholds
                                  for c in dom_thresholds], "interval_tolerance double, amount_cv_threshold double, dom_std_threshold double")
    r = lambda x: F.round(F.col(x), 9)
    x = cand.crossJoin(F.broadcast(grid))  # grid: a few settings
    periodic = r("interval_std") < F.col("interval_tolerance")
    stable = r("amount_cv") < F.col("amount_cv_threshold")
    rule = F.when(F.col("count") < 3, periodic & stable).otherwise(
        (periodic | (r("dom_std") < F.col("dom_std_threshold")) | (r("dow_std") < 1.0)) & stable)
    x = x.withColumn("_acc", rule)
    keys = ["interval_tolerance", "amount_cv_threshold", "dom_std_threshold"]
    m = x.groupBy(*keys).agg(
        F.count_if(F.col("_acc") & F.col("label")).alias("tp"), F.count_if(F.col("_acc") & ~F.col("label")).alias("fp"),
        F.count_if(~F.col("_acc") & F.col("label")).alias("fn"), F.count_if("_acc").alias("accepted"))
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    rc = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    m = m.withColumns({"precision": p, "recall": rc})
    m = m.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                  2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))
    rec = F.to_json(F.struct(F.struct(*keys).alias("params"),
                             F.struct("precision", "recall", "f1", "accepted").alias("metrics")))
    return m.select(F.concat_ws("_", *keys).alias("run_id"), rec.alias("record"))


RUN_SCHEMA = T.StructType([
    T.StructField("params", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
])


def run_flatten(runs: DataFrame, record: str = "record", reset_inactive: dict | None = None) -> DataFrame:
    """Nested JSON run records -> one column per parameter and metric (missing -> 0).

    Keys are collected from the records (a handful of names), then selected as columns.
    reset_inactive: {switch_param: [params set to 0 when the switch is 0/false]}.
    """
    parsed = runs.withColumn("_r", F.from_json(F.col(record), RUN_SCHEMA))
    pkeys = sorted(k for (k,) in parsed.select(F.explode(F.map_keys("_r.params"))).distinct().collect())
    mkeys = sorted(k for (k,) in parsed.select(F.explode(F.map_keys("_r.metrics"))).distinct().collect())
    cols = [F.coalesce(F.col("_r.params")[k], F.lit(0.0)).alias(k) for k in pkeys]
    cols += [F.coalesce(F.col("_r.metrics")[k], F.lit(0.0)).alias(k) for k in mkeys]
    flat = parsed.select(*[c for c in runs.columns if c != record], *cols)
    for switch, deps in (reset_inactive or {}).items():
        if switch in flat.columns:
            for d in deps:
                if d in flat.columns:
                    flat = flat.withColumn(d, F.when(F.col(switch) == 0, F.lit(0.0)).otherwise(F.col(d)))
    return flat


def run_trends(flat: DataFrame, params: list[str], metric: str = "f1", fail_below: float = 0.3) -> DataFrame:
    """Per varying parameter and value: runs, failures (metric < fail_below), failure rate,
    mean and std of the metric over non-failed runs. Varying = more than one value."""
    longf = flat.select(metric, F.explode(F.array(*[F.struct(F.lit(p).alias("param"), F.col(p).cast("double").alias("value"))
                                                    for p in params])).alias("_s")).select(metric, "_s.*")
    varying = longf.groupBy("param").agg(F.count_distinct("value").alias("_nv")).filter("_nv > 1").select("param")
    x = longf.join(varying, "param", "left_semi")
    ok = F.col(metric) >= fail_below
    return x.groupBy("param", "value").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(~ok).alias("failures"),
        (F.count_if(~ok) / F.count(F.lit(1))).alias("failure_rate"),
        F.avg(F.when(ok, F.col(metric))).alias("mean_ok"), F.stddev_samp(F.when(ok, F.col(metric))).alias("std_ok"))


def top_runs(flat: DataFrame, metric: str = "f1", n: int = 10, run_id: str = "run_id") -> DataFrame:
    """The n best runs by the metric (the feature is a top-n list)."""
    return flat.orderBy(F.desc(metric), F.asc(run_id)).limit(n)
