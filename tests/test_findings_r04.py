"""Steps that store their rows as compressed columns, ship fewer of them and bound their groups."""

import datetime as dt
import glob
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cadence.operators import density as D
from cadence.operators import pairs as P
from cadence.operators.text_cluster import text_cluster
from cadence.operators.windows import amount_seed_overlap
from cadence.plans import catalog_clean, lexical
from cadence.session import checkpoint_dir, materialize, store
from cadence.sources.fixtures import txn
from tests.conftest import SF_SMALL

DAY = dt.datetime(2023, 1, 1)


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def shuffle_files(spark) -> set:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for i in range(files.size()) if (f := files.apply(i).getName()).startswith("shuffle_")}


def _rows(spark, n=60):
    rows = [(f"a{i % 2}", f"t{i}", DAY + dt.timedelta(days=i), round(10.0 + i % 7, 2), f"SHOP {'XY'[i % 2]} {i}", i % 2) for i in range(n)]
    return spark.createDataFrame(rows, "accountId string, trId string, date timestamp, amount double, bankRawDescription string, isRecurring int")


@pytest.mark.parametrize("keep", [store, materialize])
def test_stored_rows_leave_no_shuffle_files(spark, keep):
    before = shuffle_files(spark)
    rows = spark.createDataFrame([(None, float("nan"), -0.0, DAY), ("a", None, 1.5, None)], "a string, b double, c double, d timestamp")
    got = keep(rows.repartition(3, "a"))
    assert got.dtypes == rows.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.collect()))
    assert not shuffle_files(spark) - before


def test_window_texts_are_clustered_without_a_join(spark):
    rows = spark.createDataFrame([("a", 0, "1", "spotify one", "R1"), ("a", 0, "2", "spotify one", "R2"), ("a", 0, "3", "gym", "R3"), ("a", 0, "4", None, "R4"),
                                  ("a", 1, "5", "", "R5"), ("a", 1, "6", " ", "R5"), (None, 0, "7", "gym", "R7"), (None, 0, "8", "gym", "R7"), ("b", 0, "9", None, None)],
                                 "accountId string, win int, id string, text string, raw string")
    out = text_cluster(rows, ["accountId", "win"], "text", "raw", "id")
    assert {r.id: r.cluster for r in out.collect()} == {"1": "spotify one", "2": "spotify one", "3": None, "4": "raw:R4", "5": "raw:R5", "6": "raw:R5",
                                                         "7": "raw:R7", "8": "raw:R7", "9": None}
    assert out.columns == [*rows.columns, "cluster"] and "Join" not in plan(out)


@pytest.mark.parametrize("exact", [True, False])
def test_groups_are_mapped_back_by_one_join_of_the_stored_rows(spark, monkeypatch, exact):
    out = lexical.detect_recurring(_rows(spark), exact_text=exact)
    want = sorted(map(tuple, out.select("trId", "recurring_group_id").collect()))
    assert sum(g is not None for _, g in want) > 0
    assert plan(out).count("Join ") == 1 and "Window" not in plan(out)
    monkeypatch.setattr(lexical, "KEPT_ROWS", 10)  # accounts above it are spread by window
    again = lexical.detect_recurring(_rows(spark), exact_text=exact)
    assert sorted(map(tuple, again.select("trId", "recurring_group_id").collect())) == want
    groups = {r.group_id for r in lexical.membership(_rows(spark), exact_text=exact).collect()}
    assert {g for _, g in want if g} <= groups


def test_overlapping_groups_are_listed_from_stored_columns(spark):
    out = amount_seed_overlap(_rows(spark).union(_rows(spark).limit(3)))
    assert "ReusedExchange" not in plan(out) and re.search(r"Relation \[[^\]]*_kind", plan(out))
    ids = {r.trId: r.n for r in out.groupBy("trId").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(ids) == 60


def test_both_sides_of_the_band_join_read_stored_positions(spark):
    out = P.candidate_pairs(_rows(spark))
    assert "Window" not in plan(out)
    assert out.count() == 2 * (30 * 29 // 2)  # all amounts of an account are within 10


def test_suppliers_meet_line_items_before_parts(spark):
    joins = [line for line in plan(txn(spark, SF_SMALL)).splitlines() if "Join " in line]
    depth = {k: line.index("Join ") for line in joins for k in ("p_partkey", "s_suppkey") if k in line}
    assert depth["p_partkey"] < depth["s_suppkey"]


def test_dedup_query_moves_three_columns(spark):
    out = entry.queries()["dedup_transactions"](spark, SF_SMALL)
    assert "upper(" not in plan(out) and "l_returnflag#" not in plan(out).split("Relation")[0]


def test_bank_files_are_compressed(spark):
    before = set(glob.glob(_folder(spark)))
    assert catalog_clean.q_consolidate(spark, SF_SMALL).count() > 0
    new = set(glob.glob(_folder(spark))) - before
    assert new and all(f.endswith(".csv.gz") for f in new)


def _folder(spark) -> str:
    return f"{checkpoint_dir(spark).removeprefix('file:').rstrip('/')}/banks-*/*/part-*"


def test_ball_assignment_has_small_groups(spark, monkeypatch):
    real = D._assign

    def watched(eps):
        run = real(eps)

        def checked(rows, centres):
            assert len(rows) < 2000
            return run(rows, centres)
        return checked
    monkeypatch.setattr(D, "_assign", watched)
    v = spark.createDataFrame([("a", i, [float(i % 61), float(i)]) for i in range(4000)], "account string, id long, v array<double>")
    assert D.ball_blocks(v, 0.5).filter("home").count() == 4000
