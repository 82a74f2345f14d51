"""The skew route of ordered scans must equal the single-window route exactly."""

import random

from pyspark.sql import functions as F

from cadence.operators.ordered import exact_quantiles, ordered_scan
from cadence.operators.windows import amount_islands, amount_windows
from cadence.plans import lexical
from cadence.sources.fixtures import txn

from conftest import SF_SMALL


def _rows(spark, n=3000, seed=1):
    random.seed(seed)
    data = [(("hot" if i % 3 else f"k{i % 17}"), float(random.randint(-50, 50)), f"id{i:05d}", random.random())
            for i in range(n)]
    return spark.createDataFrame(data, "k string, v double, id string, w double")


def test_hot_route_equals_cold(spark):
    df = _rows(spark)
    kw = dict(sums={"s": "w"}, maxes={"m": "v"}, lags={"p": "v"})
    cold = ordered_scan(df, ["k"], ["v", "id"], "pos", check_skew=False, **kw)
    hot = ordered_scan(df, ["k"], ["v", "id"], "pos", hot_rows=50, **kw)
    a = {r.id: (r.pos, round(r.s, 9), r.m, r.p) for r in cold.collect()}
    b = {r.id: (r.pos, round(r.s, 9), r.m, r.p) for r in hot.collect()}
    assert a == b


def test_exact_quantiles_match_numpy(spark):
    import numpy as np

    df = _rows(spark, 1000, 2)
    got = {r.k: r.q50 for r in exact_quantiles(df, ["k"], "v", [0.5], ["q50"], hot_rows=30).collect()}
    pdf = df.toPandas()
    for k, g in pdf.groupby("k"):
        assert abs(got[k] - float(np.quantile(g.v.to_numpy(), 0.5))) < 1e-9


def test_windows_and_islands_unchanged_by_skew_route(spark):
    t = txn(spark, SF_SMALL)
    a = {r.trId: r.win for r in amount_windows(t).collect()}
    b = {r.trId: r.win for r in amount_windows(t, hot_rows=20).collect()}
    assert a == b
    i1 = {r.trId: r.global_group_id for r in amount_islands(t, min_size=3).collect()}
    i2 = {r.trId: r.global_group_id for r in amount_islands(t, min_size=3, hot_rows=20).collect()}
    assert i1 == i2


def test_detector_unchanged_by_skew_route(spark):
    t = txn(spark, SF_SMALL)
    a = {r.trId: r.recurring_group_id for r in lexical.detect_recurring(t).collect()}
    b = {r.trId: r.recurring_group_id for r in lexical.detect_recurring(t, hot_rows=20).collect()}
    assert a == b
    assert sum(v is not None for v in a.values()) > 0


def test_hot_route_with_payload_at_a_million_rows(spark):
    """Range boundaries are sampled: both readers of the ranges must see the same ones."""
    n = 1_000_000
    df = (spark.range(n).select(F.lit("hot").alias("k"), (F.pmod(F.xxhash64("id"), F.lit(250_000)) / 7.0).alias("v"),
                                F.col("id").cast("string").alias("id"), F.md5(F.col("id").cast("string")).alias("payload"),
                                (F.col("id") % 13).cast("double").alias("w")))
    got = ordered_scan(df, ["k"], ["v", "id"], "pos", hot_rows=100_000, sums={"s": "w"}, maxes={"m": "w"}, lags={"p": "v"})
    want = ordered_scan(df, ["k"], ["v", "id"], "pos_w", check_skew=False, sums={"s_w": "w"}, maxes={"m_w": "w"}, lags={"p_w": "v"})
    both = got.join(want.select("id", "pos_w", "s_w", "m_w", "p_w"), "id")
    same = (F.col("pos") == F.col("pos_w")) & (F.col("s") == F.col("s_w")) & F.col("m").eqNullSafe(F.col("m_w")) & F.col("p").eqNullSafe(F.col("p_w"))
    r = both.agg(F.count("*"), F.sum((~same).cast("int")), F.countDistinct("pos"), F.max(F.length("payload"))).first()
    assert tuple(r) == (n, 0, n, 32)


def test_hot_windows_stay_within_200_rows(spark):
    t = txn(spark, SF_SMALL).withColumn("accountId", F.lit("one"))
    w = amount_windows(t, hot_rows=500)
    assert w.groupBy("win").count().agg(F.max("count")).first()[0] <= 200
