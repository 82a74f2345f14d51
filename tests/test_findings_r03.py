"""Small tests of the third round's findings."""

import datetime

import __spark_entry__ as E


def _line(i, supp, price, order=None, part=1, flag="N", status="F", quantity=20.0):
    return (order or i, part, supp, i, quantity, float(price), 0.05, 0.02, flag, status, datetime.date(2024, 1, 1) + datetime.timedelta(days=i))


def _tables(spark, folder, lines):
    """The tables behind the transaction view, with the given line items."""
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    put(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
               "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date", "lineitem")
    put([(1, "green forest almond", "B1", 3), (2, "metallic blue", None, 4)], "p_partkey long, p_name string, p_brand string, p_size int", "part")
    put([(1, 0), (2, 0)], "s_suppkey long, s_nationkey long", "supplier")
    put([(0, 0)], "n_nationkey long, n_regionkey long", "nation")
    put([(0, "R")], "r_regionkey long, r_name string", "region")
    return str(folder)


def test_rename_columns_query(spark, tmp_path):
    d = _tables(spark, tmp_path, [_line(1, 1, 10), _line(2, 1, 11, part=2), _line(3, 2, 12, quantity=5.0), _line(3, 2, 12, quantity=5.0)])
    got = sorted(((r.trId, r.counter_party) for r in E.queries()["rename_columns"](spark, d).collect()), key=str)
    assert got == [("1-1-1-1-1000", "B1"), ("2-2-1-2-1100", None), ("3-1-2-3-1200", ""), ("3-1-2-3-1200", "")]


def _brute_clusters(docs, eps, least):
    """{(win, text): label} of rows (win, text, m) by the definition, one pair at a time."""
    import math
    from collections import Counter

    from cadence.functions.text import word_ngrams

    out = {}
    for win in {w for w, _, _ in docs}:
        m = {t: n for w, t, n in docs if w == win}
        tf = {t: Counter(g for x in (t or "").lower().split() for g in word_ngrams(x)) for t in m}
        df = Counter()
        for t, c in tf.items():
            df.update({g: m[t] for g in c})
        vec = {t: {g: n * (math.log((1 + sum(m.values())) / (1 + df[g])) + 1) for g, n in c.items()} for t, c in tf.items()}
        unit = {t: {g: x / math.sqrt(sum(y * y for y in v.values())) for g, x in v.items()} for t, v in vec.items()}
        near = {t: [u for u in m if u != t and unit[t] and unit[u]
                    and round(1 - sum(x * unit[u].get(g, 0) for g, x in unit[t].items()), 9) <= eps] for t in m}
        core = {t for t in m if unit[t] and m[t] + sum(m[u] for u in near[t]) >= least}
        lab = {t: t for t in core}
        for _ in m:
            lab = {t: min([lab[t], *(lab[u] for u in near[t] if u in core)]) for t in core}
        out.update({(win, t): lab.get(t, min((lab[u] for u in near[t] if u in core), default=None)) for t in m})
    return out


def test_window_clusters_by_definition(spark, monkeypatch):
    import random

    from cadence.operators import text_cluster as TC

    rnd = random.Random(5)
    docs = {(w, " ".join(rnd.choice(["spot", "spotify", "Gym", "gyms", "rent 1", "café", "x"]) for _ in range(rnd.randint(0, 3))))
            for w in range(4) for _ in range(25)}
    docs = [(w, t, rnd.randint(1, 3)) for w, t in sorted(docs)] + [(1, None, 2), (9, "", 1), (9, " ", 4)]
    df = spark.createDataFrame([("a", w, t, m, sum(n for v, _, n in docs if v == w)) for w, t, m in docs],
                               "acc string, win int, text string, m long, n_docs long")
    for least, cells in ((2, 4_000_000), (3, 700), (4, 700)):  # 700: several blocks of rows a window
        monkeypatch.setattr(TC, "BLOCK_CELLS", cells)
        got = {(r.win, r.text): r._label for r in TC.window_clusters(df, ["acc", "win"], min_samples=least).collect()}
        assert got == _brute_clusters(docs, 0.29, least)


def test_grams_are_neither_shuffled_nor_sorted(spark):
    from cadence.operators import text_cluster as TC

    rows = spark.createDataFrame([("a", 0, "T1", "spot one"), ("a", 0, "T2", "spot two"), ("a", 1, "T3", "x"), (None, 1, "T4", "gym")],
                                 "acc string, win int, id string, text string")
    post = TC.tfidf_postings(TC.distinct_texts(rows, ["acc", "win"], "text"), ["acc", "win"])
    plan = post._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "gram" in x and ("Sort" in x or "Exchange" in x)]
    assert abs(sum(r.w * r.w for r in post.filter("text = 'gym'").collect()) - 1) < 1e-12
    assert post.filter("acc IS NULL AND win = 1").count() == 4 + 3 + 2


def test_group_means_come_without_a_join(spark, tmp_path):
    """Means of overlapping groups from running sums equal those of the listed members."""
    import random

    from pyspark.sql import functions as F

    from cadence.operators.windows import amount_seed_overlap

    rnd = random.Random(3)
    rows = [(f"a{i % 2}", f"t{i % 70}", rnd.choice([-1, 1]) * rnd.randint(1, 60) + 0.25, rnd.choice([None, rnd.random()])) for i in range(90)]
    rows += [("a1", "t1", None, 0.5), (None, "t2", 3.0, 0.5)]
    df = spark.createDataFrame(rows, "accountId string, trId string, amount double, prob double")
    for hot in (None, 20):  # 20: accounts split over ranges
        got = amount_seed_overlap(df, carry=("prob",), means={"gprob": "prob"}, hot_rows=hot)
        keys = ["accountId", "cluster_seed_amount"]
        for r in got.groupBy(*keys).agg(F.avg("prob").alias("want"), F.min("gprob").alias("lo"), F.max("gprob").alias("hi")).collect():
            assert r.lo == r.hi and (r.want is None) == (r.lo is None)
            assert r.want is None or abs(r.want - r.lo) < 1e-12
    assert got.select("trId", "amount").distinct().count() > 60


def test_max_prob_moves_a_row_once(spark, tmp_path):
    """The members of overlapping groups are not shuffled by group: only rows are, by id."""
    import re

    from cadence.operators import metrics as M

    seen = {}
    real = M.max_prob_per_row

    def spy(df, *args, **kw):
        seen["plan"] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, *args, **kw)
    d = _tables(spark, tmp_path, [_line(i, 1 + i % 2, 100 + i % 13, quantity=float(5 + i)) for i in range(1, 40)])
    M.max_prob_per_row = spy
    try:
        E.queries()["max_prob_per_row"](spark, d).collect()
    finally:
        M.max_prob_per_row = real
    assert not re.findall(r"hashpartitioning\(accountId#\d+, (?:cluster_)?seed", seen["plan"])


def test_overlapping_balls_meet_an_account_once(spark):
    """Where every ball sees every vector, tests stay near all pairs instead of all pairs a ball."""
    import numpy as np

    from cadence.operators import density as D

    rng = np.random.default_rng(2)
    rows = [("a", i, [float(x) for x in rng.normal(0, 1, 8)]) for i in range(400)]
    v = spark.createDataFrame(rows, "account string, id long, v array<double>")
    assert D.pair_tests(D.ball_blocks(v, 50.0, block=32, centres=16), 50.0) <= 400 * 400


def test_mix_words_come_from_the_training_order(spark, monkeypatch):
    """What the plan reports as taken is what stands in the range-sorted mix."""
    from collections import Counter

    from cadence.llm import curriculum

    rows = [(i % 45, " ".join(["w"] * (i % 9)) if i % 11 else None, [None, "a", "b", "c"][i % 4]) for i in range(60)]
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, source string")
    plan, order = curriculum.plan(docs).collect(), curriculum.mix(docs).collect()
    assert len(plan) == 65 and sum(len(r.positions) for r in plan) == len(order) > 0
    assert all(r.taken == r.size * len(r.positions) for r in plan)
    assert Counter((r.doc_id, p) for r in plan for p in r.positions) == Counter((r.doc_id, r.position) for r in order)
    # a mix without its second half is a plan of fewer words
    real = curriculum._sorted_mix
    monkeypatch.setattr(curriculum, "_sorted_mix", lambda s: real(s).filter("position < 0.5"))
    assert sum(r.taken for r in curriculum.plan(docs).collect()) < sum(r.taken for r in plan)
