"""Rank merge, halo frames, ball joins, star rounds and grouped regressions against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window

from cadence.operators import density as D
from cadence.operators import ml as ML
from cadence.operators.components import connected_components
from cadence.operators.ordered import bounded_frames
from cadence.operators.pairs import amount_band_pairs, recover_missed
from cadence.operators.range_join import BLOCK, expand, rank_intervals
from cadence.operators.windows import amount_seed_overlap, sequence_windows
from cadence.sources.fixtures import vectors

from conftest import SF_SMALL


# --- rank merge ------------------------------------------------------------------

def _overlap(amounts, tol_abs=1.0, tol_pct=0.05, least=2):
    """Groups by definition: seeds in order, members by the stated test, subsets of kept ones dropped."""
    kept = []
    for seed in sorted({round(a, 2) + 0.0 for _, a in amounts}):
        m = {i for i, a in amounts if abs(a - seed) <= tol_abs or abs(a - seed) <= abs(seed) * tol_pct}
        if len(m) >= least and not any(m <= k for _, k in kept):
            kept.append((seed, m))
    return {(seed, i) for seed, m in kept for i in m}


@pytest.mark.parametrize("hot_rows", [None, 40])
def test_seed_overlap_by_definition(spark, hot_rows):
    rng = random.Random(4)
    rows = []
    for acc, n in (("big", 300), ("small", 25), ("one", 1)):
        for i in range(n):
            a = rng.choice([rng.uniform(-60, 60), rng.choice([10.0, 11.0, 10.5, 9.0, -20.0, 0.0, 19.0, 20.0, 21.0])])
            rows.append((acc, f"{acc}{i}", round(a, 2)))
    rows += [("null", "n1", None), ("small", "twice", 10.0), ("small", "twice2", 10.0)]
    df = spark.createDataFrame(rows, "accountId string, trId string, amount double")
    got = amount_seed_overlap(df, hot_rows=hot_rows).collect()
    for acc in ("big", "small", "one"):
        mine = {(r.cluster_seed_amount + 0.0, r.trId) for r in got if r.accountId == acc}
        assert mine == _overlap([(t, a) for c, t, a in rows if c == acc])


def test_no_join_before_pruning(spark):
    """Member counts come from positions; a hot account's join keys hold at most BLOCK rows."""
    n = 30_000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("a"), F.col("id") % 50)).alias("acc"),
                               F.col("id").cast("string").alias("t"), (F.pmod(F.xxhash64("id"), F.lit(100000)) / 100).alias("x"))
    seeds = df.select("acc", "x").distinct()
    placed, spans = rank_intervals(df, seeds.select("acc", F.col("x").alias("s"), (F.col("x") - 1).alias("low"), (F.col("x") + 1).alias("high")),
                                   ["acc"], "x", "t", "s", hot_rows=2000)
    key = placed.groupBy("acc", F.floor(F.col("_pos") / BLOCK)).count().agg(F.max("count")).first()[0]
    assert key <= BLOCK
    counts = spans.select("acc", F.col("s").alias("x"), (F.col("_after") - F.col("_first")).alias("n"))
    w = Window.partitionBy("acc").orderBy("x").rangeBetween(-1, 1)
    want = df.withColumn("n", F.count(F.lit(1)).over(w)).select("acc", "x", "n").distinct()
    assert counts.exceptAll(want).count() == 0 and counts.count() == want.count()
    kept = spans.filter("acc = 'hot'").orderBy("s").limit(5)
    listed = expand(placed, kept, ["acc"]).groupBy("s").count().collect()
    sizes = {r.s: r._after - r._first for r in kept.collect()}
    assert {r.s: r["count"] for r in listed} == sizes


def test_recover_missed_tests_only_the_amount_band(spark):
    rng = random.Random(8)
    rows = [(f"a{i % 3}", i, round(rng.uniform(-100, 100), 2), [rng.random(), rng.random()]) for i in range(200)]
    groups = [(f"a{g % 3}", g, [rng.random(), rng.random()], round(rng.uniform(-100, 100), 2)) for g in range(30)]
    groups += [("a0", 100, [0.5, 0.5], 20.0), ("a0", 101, [0.5, 0.5], 0.0)]
    rows += [("a0", 900, 22.0, [0.5, 0.5]), ("a0", 901, 18.0, [0.5, 0.5]), ("a0", 902, None, [0.5, 0.5]), ("a0", 903, 21.999, [0.5, 0.5])]
    r = spark.createDataFrame(rows, "accountId string, vec_id long, amount double, embedding array<double>")
    g = spark.createDataFrame(groups, "accountId string, group_id long, centroid array<double>, amt_median double")
    band = lambda x, m: abs(x - m) < 2.0 or abs(x - m) < abs(m) * 0.1
    pairs = {(i, k) for a, i, x, _ in rows for b, k, _, m in groups if a == b and x is not None and band(x, m)}
    tested = {(p.vec_id, p.group_id) for p in amount_band_pairs(r, g, "accountId", "vec_id", "amount", "group_id", 2.0, 0.1).collect()}
    assert tested == pairs and (900, 100) not in tested and (903, 100) in tested  # strictly inside the half-width
    vec, cen = {i: v for _, i, _, v in rows}, {k: c for _, k, c, _ in groups}
    want = {}
    for i, k in pairs:
        if math.dist(vec[i], cen[k]) < 0.3:
            want[i] = max(want.get(i, -1), k)
    assert {x.vec_id: x.recovered_group for x in recover_missed(r, g, distance=0.3).collect()} == want


# --- halo frames -------------------------------------------------------------------

@pytest.mark.parametrize("hot_rows", [20, 7])
def test_halo_frames_equal_the_plain_window(spark, hot_rows):
    rng = random.Random(hot_rows)
    rows = [(f"k{min(i % 9, 2)}", i, rng.randint(0, 9)) for i in range(260)]
    df = spark.createDataFrame(rows, "k string, t long, v int")
    frames = {"h": lambda w: F.collect_list("v").over(w.rowsBetween(-5, -1)), "nx": lambda w: F.lead("v", 2).over(w),
              "s": lambda w: F.sum("v").over(w.rowsBetween(-3, 2)), "p": lambda w: F.lag("t", 4).over(w)}
    plain = df.withColumns({n: f(Window.partitionBy("k").orderBy("t")) for n, f in frames.items()})
    got = bounded_frames(df, ["k"], ["t"], frames, back=5, ahead=2, hot_rows=hot_rows)
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


def test_one_series_of_a_million_rows(spark):
    """Equal to the plain window where one key holds everything, without a task that holds the key."""
    n = 1_000_000
    df = spark.range(n).select(F.lit("one").alias("k"), F.col("id").alias("time_idx"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("v"))
    frames = {"s": lambda w: F.sum("v").over(w.rowsBetween(-8, -1)), "l": lambda w: F.lag("v", 3).over(w)}
    got = bounded_frames(df, ["k"], ["time_idx"], frames, back=8, hot_rows=100_000)
    plain = df.withColumns({x: f(Window.partitionBy("k").orderBy("time_idx")) for x, f in frames.items()})
    digest = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*sorted(d.columns)).cast("decimal(38,0)"))).first()
    assert tuple(digest(got)) == tuple(digest(plain))
    parts = {r.n for r in got.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert max(parts) < n / 3


def test_predict_windows_on_split_series(spark):
    df = spark.createDataFrame([("a", i) for i in range(50)] + [("b", i) for i in range(3)], "s string, time_idx long")
    plain = sequence_windows(df, ["s"], ["time_idx"], min_len=2, max_len=6, predict=True)
    split = sequence_windows(df, ["s"], ["time_idx"], min_len=2, max_len=6, predict=True, hot_rows=10)
    want = [("a", 49, list(range(43, 49))), ("b", 2, [0, 1])]
    for d in (plain, split):
        assert sorted((r.s, r.time_idx, [h.time_idx for h in r.history]) for r in d.collect()) == want


# --- density groups ---------------------------------------------------------------

def _dbscan(points, eps, m):
    near = {i: [j for j, q in points.items() if q[0] == p[0] and math.dist(p[1], q[1]) <= eps] for i, p in points.items()}
    core = {i for i in points if len(near[i]) >= m}
    label = {}
    for i in sorted(core):
        if i in label:
            continue
        todo, label[i] = [i], i
        while todo:
            for j in near[todo.pop()]:
                if j in core and j not in label:
                    label[j] = i
                    todo.append(j)
    border = {i: min(label[j] for j in near[i] if j in core) for i in points if i not in core and any(j in core for j in near[i])}
    return {i: label.get(i, border.get(i)) for i in points}


@pytest.mark.parametrize("m,block,centres", [(2, 512, 64), (2, 5, 4), (3, 6, 3)])
def test_density_groups_by_definition(spark, m, block, centres):
    rng = np.random.default_rng(m + block)
    points = {}
    for i in range(140):
        centre = rng.integers(0, 3, 3) * 1.5
        points[i] = (f"a{i % 2}", [float(x) for x in np.float32(centre + rng.normal(0, 0.2, 3))])
    points[200], points[201] = points[3], points[3]  # repeated vectors
    rows = [(i, a, v, "x") for i, (a, v) in points.items()] + [(300, "a0", None, "x"), (301, None, [0.0] * 3, "x")]
    df = spark.createDataFrame(rows, "vec_id long, accountId string, embedding array<float>, ball string")
    got = {r.vec_id: r.cluster for r in D.density_groups(df, eps=0.4, min_samples=m, block=block, centres=centres).collect()}
    want = _dbscan(points, 0.4, m)
    assert got == {**want, 300: None, 301: None}
    assert len(set(want.values())) > 3


def test_far_fewer_distances_than_all_pairs(spark):
    """On the given vectors, and on clustered ones, with the pairs of an account counted."""
    v = vectors(spark, SF_SMALL).select(F.col("accountId").alias("account"), F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    pairs = v.groupBy("account").count().selectExpr("sum(count * (count - 1) / 2)").first()[0]
    assert D.pair_tests(D.ball_blocks(v, 0.05, block=8, centres=16), 0.05) < 0.35 * pairs
    rng = np.random.default_rng(1)
    rows = [("a", i, [float(x) for x in rng.integers(0, 40) * np.array([1.0, 0.5, -0.3]) + rng.normal(0, 0.02, 3)]) for i in range(3000)]
    c = spark.createDataFrame(rows, "account string, id long, v array<double>")
    assert D.pair_tests(D.ball_blocks(c, 0.1, block=32), 0.1) < 0.1 * 3000 * 2999 / 2


def test_density_groups_empty(spark):
    df = spark.createDataFrame([], "vec_id long, accountId string, embedding array<float>")
    assert D.density_groups(df).count() == 0


# --- components -------------------------------------------------------------------

def test_star_of_a_million_leaves_and_a_long_path(spark):
    star = spark.range(1, 1_000_001).select(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst"))
    c = connected_components(star, max_rounds=4)
    assert c.agg(F.count(F.lit(1)), F.max("component")).first()[:] == (1_000_001, 0)
    high = spark.range(1_000_000).select(F.col("id").alias("src"), F.lit(1_000_000).cast("long").alias("dst"))
    assert connected_components(high, max_rounds=5).filter("component <> 0").count() == 0
    n = 100_000
    path = spark.range(n - 1).select(F.pmod(F.col("id") * 77_777, F.lit(n)).alias("src"), F.pmod((F.col("id") + 1) * 77_777, F.lit(n)).alias("dst"))
    c = connected_components(path, max_rounds=20)
    assert c.agg(F.count(F.lit(1)), F.max("component")).first()[:] == (n, 0)


def test_components_of_random_graphs(spark):
    rng = random.Random(6)
    for n, m in ((40, 25), (60, 80), (5, 0)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(99, 99), (None, 3)]
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x
        for a, b in edges:
            if a is not None:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
        df = spark.createDataFrame(edges, "src int, dst int")
        assert {r.node: r.component for r in connected_components(df).collect()} == {x: find(x) for x in list(root)}


# --- regressions of all groups at once --------------------------------------------

def test_grouped_logistic_equals_single_fits(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = []
    for g, (w, b, n) in enumerate((([1.0, -2.0], 0.3, 400), ([0.2, 0.5], -1.0, 250), ([-3.0, 0.0], 2.0, 300))):
        x = rng.normal(0, 1, (n, 2))
        y = rng.uniform(0, 1, n) < 1 / (1 + np.exp(-(x @ w + b)))
        rows += [(f"g{g}", float(p), float(q), int(t)) for (p, q), t in zip(x, y)]
    rows += [("one class", 1.0, 2.0, 1), ("one class", None, 1.0, 1), (None, 1.0, 1.0, 0)]
    df = spark.createDataFrame(rows, "g string, a double, b double, y int")
    frame = type(df)
    plain, jobs = frame.checkpoint, []
    monkeypatch.setattr(frame, "checkpoint", lambda self, *a, **k: jobs.append(1) or plain(self, *a, **k))
    got = {r.g: r.coef for r in ML.grouped_logistic(df, "g", ["a", "b"], "y", l2=1e-6).collect()}
    assert len(jobs) <= 2 + 25 and set(got) == {"g0", "g1", "g2", "one class"}  # a table a step, none a group
    for g in ("g0", "g1", "g2"):
        m = ML.row_classifier(df.filter(F.col("g") == g), ["a", "b"], label="y").stages[-1]
        assert got[g][:2] == pytest.approx(m.coefficients.toArray().tolist(), abs=1e-4)
        assert got[g][2] == pytest.approx(m.intercept, abs=1e-4)
    p = ML.score_grouped(df, spark.createDataFrame(list(got.items()), "g string, coef array<double>"), "g", ["a", "b"])
    assert p.filter("g = 'one class' AND probability < 0.5").count() == 0 and p.count() == len(rows) - 1
