"""Pipeline step registry and model store."""

import json
import tempfile

import pytest
from pyspark.sql import functions as F

from cadence.operators import ml
from cadence.plans.hooks import run_pipeline


def _rows(spark):
    return spark.createDataFrame(
        [("a", "t1", 5.0), ("a", "t2", -3.0), ("b", "t3", 7.0)], "accountId string, trId string, amount double")


def test_hooks_accept_names_and_callables(spark):
    df = _rows(spark)
    same = run_pipeline(df)
    assert sorted(same.collect()) == sorted(df.collect())
    pos = run_pipeline(df, prepare=lambda d: d.filter("amount > 0"),
                       build=lambda d: d.groupBy("accountId").agg(F.sum("amount").alias("s")))
    assert sorted((r.accountId, r.s) for r in pos.collect()) == [("a", 5.0), ("b", 7.0)]
    with pytest.raises(KeyError):
        run_pipeline(df, prepare="no_such_step")


def test_model_store_roundtrip(spark):
    df = spark.createDataFrame([(float(i), float(i % 2), i % 2) for i in range(40)], "x double, y double, label int")
    model = ml.group_classifier(df, features=["x", "y"], label="label", max_depth=3, max_iter=5)
    path = tempfile.mkdtemp(prefix="cadence-model-")
    ml.save_model(model, path, threshold=0.4, params={"depth": 3})
    back, thr, params = ml.load_model(path)
    assert thr == 0.4 and params == {"depth": 3}
    a = ml.batch_scoring(model, df).select("probability").collect()
    b = ml.batch_scoring(back, df).select("probability").collect()
    assert a == b
