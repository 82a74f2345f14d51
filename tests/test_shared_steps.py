"""Steps that several queries share: inputs are read once, null keys and wide structs do not travel."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cadence.operators import aggregates as A
from cadence.operators import clean as C
from cadence.operators import groups as G
from cadence.operators import split as S
from tests.conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["run_trends", "broken_patterns", "amount_islands"])
def test_input_is_not_read_again_for_every_branch(spark, name):
    assert ".parquet" not in plan(entry.queries()[name](spark, SF_SMALL)) and "Relation [" not in plan(entry.queries()[name](spark, SF_SMALL))


def test_rows_without_a_component_do_not_meet_in_one_key(spark):
    day = dt.datetime(2023, 1, 1)
    rows = spark.createDataFrame([(f"t{i}", day + dt.timedelta(days=7 * i)) for i in range(20)] + [(None, day)], "trId string, date timestamp")
    pairs = spark.createDataFrame([("t0", "t1", 0.9), ("t1", "t2", 0.9), ("t5", "t6", 0.1), ("t8", "t8", 0.9)], "trId_1 string, trId_2 string, prob double")
    out = G.pairwise_groups(rows, pairs)
    assert {r.trId: r.pred_group_id for r in out.collect()} == {None: None, **{f"t{i}": "t0" if i < 3 else None for i in range(20)}}
    assert next(line for line in plan(out).splitlines() if "Join " in line).count("LeftOuter, (trId") == 1


def test_dedup_ships_key_and_order_once(spark):
    rows = spark.createDataFrame([("a", "B2", 1), ("a", "B1", 2), ("a", None, None), (None, "B1", 4), (None, "B1", 4), ("b", "B9", 5)], "trId string, bank_name string, x int")
    out = C.dedup_transactions(rows)
    assert out.columns == rows.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("a", None, None), (None, "B1", 4), ("b", "B9", 5)], key=str)
    packed = [line for line in plan(out).splitlines() if "_r#" in line and "Project" in line][-1]
    assert packed.count("trId#") <= 1 or "trId, trId#" not in packed


def test_candidate_features_have_one_row_a_group_from_the_start(spark):
    day = dt.datetime(2023, 1, 31)
    rows = spark.createDataFrame([("a", "g", f"t{i}", day + dt.timedelta(days=d), 10.0 + i, x, 5.0)
                                  for i, (d, x) in enumerate([(0, "u"), (3, "v"), (10, "u"), (11, None)])] + [("a", "h", "t9", day, 1.0, "w", 5.0)],
                                 "accountId string, cluster string, trId string, date timestamp, amount double, bankRawDescription string, _win_text_len double")
    out = A.candidate_features(rows, ["accountId", "cluster"])
    got = {r.cluster: (r.interval_median, r.unique_descriptions, r["count"]) for r in out.collect()}
    assert got == {"g": (3.0, 2, 4), "h": (None, 1, 1)}
    assert dict(out.dtypes)["unique_descriptions"] == "bigint" and "distinct" not in plan(out)


def test_segments_of_a_batch_are_handed_on_together():
    import numpy as np
    import pandas as pd

    pdf = pd.DataFrame([(g, 0, 4, i, float(i == 2)) for g in range(50) for i in range(3)], columns=["gid", "lo", "n", "i", "score"])
    run = S._by_segment(lambda p, s, lo, n: S.solve(p, s, lo, n, 3, 1))
    frames = list(run(iter([pdf.iloc[:70], pdf.iloc[:0], pdf.iloc[70:]])))
    assert len(frames) <= 3
    got = pd.concat(frames)
    assert got["gid"].tolist() == list(range(50)) and np.all(got["i"] == 2) and got.columns.tolist()[:4] == ["gid", "lo", "n", "i"]
