"""Scalar helpers, similarity, components and small-fixture features."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cadence.functions.lcs import indel_ratios, lcs_lengths
from cadence.functions.text import char_wb_ngrams, fixed2, token_sorted
from cadence.operators import features as X
from cadence.operators.components import bounded_components, connected_components
from cadence.operators.pairs import ratio_upper_bound, token_sort_ratio


def test_fixed2_matches_python(spark):
    random.seed(1)
    vals = [-10286.175, 0.125, 2.675, 1.005, -0.001, 19.995, -0.0, 0.0, 0.015, 999999.995, 123456789.375,
            2.0 ** 46 - 0.01, 2.0 ** 45 + 0.125] + [round(random.uniform(-1e5, 1e5), 3) for _ in range(3000)]
    vals += [random.uniform(-1e12, 1e12) for _ in range(2000)] + [random.randint(-10 ** 7, 10 ** 7) / 8 for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(fixed2("x")).collect()]
    assert got == [f"{v:.2f}" for v in vals]


def _char_wb(text):
    out = []
    for w in text.lower().split():
        w = " " + w + " "
        for n in range(2, 5):
            off = 0
            out.append(w[off:off + n])
            while off + n < len(w):
                off += 1
                out.append(w[off:off + n])
            if off == 0:
                break
    return out


@pytest.mark.parametrize("text", ["a", "ab cd", "Netflix Monthly", "  x  yz  ", "", "abcdef g"])
def test_char_ngrams(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(char_wb_ngrams(F.col("t"))).first()[0]
    assert sorted(got) == sorted(_char_wb(text))


def test_lcs_and_ratio():
    def lcs(a, b):
        dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                dp[i + 1][j + 1] = dp[i][j] + 1 if a[i] == b[j] else max(dp[i][j + 1], dp[i + 1][j])
        return dp[-1][-1]
    random.seed(0)
    first, second = [], []
    for _ in range(700):  # up to four lanes of 64 characters, lengths around the lane borders included
        n, m = (random.choice([0, 1, 3, 25, 63, 64, 65, 130, 220]) for _ in range(2))
        first.append("".join(random.choice("abcé🙂 ") for _ in range(n)))
        second.append("".join(random.choice("abcdé🙂") for _ in range(m)))
    assert lcs_lengths(first, second).tolist() == [lcs(a, b) for a, b in zip(first, second)]
    assert lcs_lengths([], []).tolist() == []
    assert indel_ratios(["", "abc"], ["", "abd"]).tolist() == [100.0, pytest.approx(200 * 2 / 6)]


def test_character_bound_is_never_below_the_score(spark):
    random.seed(2)
    rows = [("".join(random.choice("ab c") for _ in range(random.randint(0, 12))), "".join(random.choice("abd ") for _ in range(random.randint(0, 12))))
            for _ in range(200)]
    df = spark.createDataFrame(rows + [("", ""), ("é", "e")], "a string, b string")
    for r in df.select(ratio_upper_bound(token_sorted(F.col("a")), token_sorted(F.col("b"))).alias("top"), token_sort_ratio(F.col("a"), F.col("b")).alias("s")).collect():
        assert r.s <= r.top + 1e-9


def test_token_sort_ratio_column(spark):
    df = spark.createDataFrame([("netflix com", "com netflix"), ("abc", "abd"), ("", "")], "a string, b string")
    got = [r[0] for r in df.select(token_sort_ratio(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 100.0 and got[1] == pytest.approx(66.6666, 1e-3) and got[2] == 100.0


def test_components_against_bfs(spark):
    random.seed(3)
    rows = [(f"g{g % 5}", g, f"t{random.randrange(30):02d}", f"t{random.randrange(30):02d}")
            for g in range(20) for _ in range(random.randint(1, 25))]
    df = spark.createDataFrame(rows, "acc string, win int, src string, dst string")
    import collections
    exp = {}
    by = collections.defaultdict(list)
    for a, w, s, d in rows:
        by[(a, w)].append((s, d))
    for key, es in by.items():
        adj = collections.defaultdict(set)
        for s, d in es:
            adj[s].add(d)
            adj[d].add(s)
        seen = set()
        for v in adj:
            if v in seen:
                continue
            comp, st = [], [v]
            seen.add(v)
            while st:
                x = st.pop()
                comp.append(x)
                for y in adj[x]:
                    if y not in seen:
                        seen.add(y)
                        st.append(y)
            for x in comp:
                exp[(key[0], key[1], x)] = min(comp)
    got = {(r.acc, r.win, r.node): r.component for r in bounded_components(df, ["acc", "win"]).collect()}
    assert got == exp
    cc = connected_components(df.selectExpr("struct(acc, win, src as t) as src", "struct(acc, win, dst as t) as dst"))
    got2 = {(r.node.acc, r.node.win, r.node.t): r.component.t for r in cc.collect()}
    assert got2 == exp


def _f1(spark):
    rows = [("A1", datetime(2023, 1, 1), -100.0, "Netflix", 1, "t1"), ("A1", datetime(2023, 1, 15), -100.0, "Netflix", 1, "t2"),
            ("A1", datetime(2023, 2, 1), -50.0, "Amazon", 0, "t3"), ("B2", datetime(2023, 3, 1), -10.5, "Coffee", 0, "t4"),
            ("B2", datetime(2023, 3, 2), 2000.0, "Paycheck", 1, "t5")]
    return spark.createDataFrame(rows, "accountId string, date timestamp_ntz, amount double, bankRawDescription string, isRecurring int, trId string")


def test_feature_fixture(spark):
    df = _f1(spark)
    d = X.categorical_dates(df).filter("trId = 't1'").first()
    assert d.day_of_week_id == 6  # 2023-01-01 is a Sunday
    b = X.account_behavior(df).filter("accountId = 'A1'").first()
    assert b.acc_stat_amount_mean == pytest.approx((4.615 + 4.615 + 3.932) / 3, abs=1e-3)
    v = X.amount_vocab_fit(df, k_top=1, n_bins=2)
    assert [r.amount for r in v.top.collect()] == [-100.0]
    tok = {r.trId: r.amount_token_id for r in X.amount_tokenize(df, v).collect()}
    assert tok["t1"] != tok["t3"]
    with pytest.raises(RuntimeError):
        X.amount_tokenize(df, None)
    empty = df.limit(0)
    assert X.FeatureSteps([X.date_cycles(), X.date_ids(), X.log_amount()]).add_to(empty).count() == 0
