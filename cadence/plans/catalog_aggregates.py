"""Aggregation and ordered-window queries."""

from pyspark.sql import functions as F

from cadence.operators import aggregates as A
from cadence.operators import clean as C
from cadence.operators import summaries as S
from cadence.operators import windows as W
from cadence.plans.catalog import register
from cadence.sources.fixtures import scored, txn, txn_orders, vectors

R = 6


def _rd(df, names):
    return df.select(*[F.round(c, R).alias(c) if c in names else F.col(c) for c in df.columns])


def _pat(spark, sf):
    return txn(spark, sf).filter(F.col("patternId").isNotNull())


_GAPS = """
gaps AS (SELECT accountId, patternId,
           (epoch_us(date) - epoch_us(lag(date) OVER (PARTITION BY accountId, patternId ORDER BY date, trId))) // 86400000000 AS gap
         FROM {src} WHERE patternId IS NOT NULL),
gs AS (SELECT accountId, patternId, count(*) AS n_gaps, quantile_cont(gap, 0.5) AS days_median, stddev_samp(gap) AS days_std
       FROM gaps WHERE gap IS NOT NULL GROUP BY ALL)"""


@register("interval_stats", f"""
WITH iv AS (SELECT *, (epoch_us(date) - epoch_us(lag(date) OVER (PARTITION BY accountId, patternId ORDER BY date, trId))) // 86400000000 AS _ival
            FROM txn WHERE patternId IS NOT NULL)
SELECT accountId, patternId, round(coalesce(stddev_samp(_ival), 0.0), {R}) AS interval_std, round(median(_ival), {R}) AS interval_median,
       round(coalesce(stddev_samp(dayofmonth(date)), 0.0), {R}) AS dom_std, round(coalesce(stddev_samp(isodow(date) - 1), 0.0), {R}) AS dow_std
FROM iv GROUP BY accountId, patternId""")
def q_interval_stats(spark, sf):
    return _rd(A.interval_stats(_pat(spark, sf), ["accountId", "patternId"]),
               ["interval_std", "interval_median", "dom_std", "dow_std"])


@register("amount_stats", f"""
SELECT accountId, patternId, round(stddev_samp(amount), {R}) AS amount_std,
       round(CASE WHEN avg(abs(amount)) > 0 THEN stddev_samp(amount) / avg(abs(amount)) ELSE 0.0 END, {R}) AS amount_cv
FROM txn WHERE patternId IS NOT NULL GROUP BY accountId, patternId""")
def q_amount_stats(spark, sf):
    return _rd(A.amount_stats(_pat(spark, sf), ["accountId", "patternId"]), ["amount_std", "amount_cv"])


@register("majority_label", """
SELECT accountId, counter_party, avg(CAST(isRecurring AS DOUBLE)) > 0.5 AS majority_label FROM txn GROUP BY ALL""")
def q_majority(spark, sf):
    return S.majority_label(txn(spark, sf), ["accountId", "counter_party"])


_GCF = ["confidence", "amt_median", "amt_cv", "days_median", "days_std"]


@register("group_candidate_features", "WITH " + _GAPS.format(src="scored") + f""",
g AS (SELECT accountId, patternId, count(*) AS size, avg(prob) AS confidence, stddev_samp(amount) AS sd,
             avg(abs(amount)) AS mabs, CAST(avg(CAST(isRecurring AS DOUBLE)) > 0.5 AS INTEGER) AS true_label,
             quantile_cont(amount, 0.5) AS amt_median
      FROM scored WHERE patternId IS NOT NULL GROUP BY ALL),
m AS (SELECT accountId, patternId, bankRawDescription AS description FROM (
        SELECT accountId, patternId, bankRawDescription,
               row_number() OVER (PARTITION BY accountId, patternId ORDER BY count(*) DESC, bankRawDescription) AS r
        FROM scored WHERE patternId IS NOT NULL GROUP BY accountId, patternId, bankRawDescription) WHERE r = 1)
SELECT g.accountId, g.patternId, m.description, g.size, round(g.confidence, {R}) AS confidence, round(g.amt_median, {R}) AS amt_median,
  round(CASE WHEN g.mabs > 1e-3 THEN g.sd / g.mabs ELSE 0.0 END, {R}) AS amt_cv,
  round(CASE WHEN g.size > 1 THEN gs.days_median ELSE 0.0 END, {R}) AS days_median,
  round(CASE WHEN g.size <= 1 THEN -1.0 WHEN gs.n_gaps = 1 THEN 0.0 ELSE gs.days_std END, {R}) AS days_std,
  g.true_label
FROM g JOIN m USING (accountId, patternId) LEFT JOIN gs USING (accountId, patternId)""", views=("scored",))
def q_gcf(spark, sf):
    t = scored(spark, sf).filter(F.col("patternId").isNotNull())
    g = S.group_candidate_features(t, ["accountId", "patternId"])
    # a single row has no deviation: NaN in the features, NULL in the report
    return _rd(g.withColumn("amt_cv", F.when(~F.isnan("amt_cv"), F.col("amt_cv"))), _GCF)


@register("group_summary", "WITH " + _GAPS.format(src="scored") + f""",
g AS (SELECT accountId, patternId, count(*) AS n, avg(prob) AS confidence, quantile_cont(amount, 0.5) AS amount_stats
      FROM scored WHERE patternId IS NOT NULL GROUP BY ALL),
m AS (SELECT accountId, patternId, bankRawDescription AS description FROM (
        SELECT accountId, patternId, bankRawDescription,
               row_number() OVER (PARTITION BY accountId, patternId ORDER BY count(*) DESC, bankRawDescription) AS r
        FROM scored WHERE patternId IS NOT NULL GROUP BY accountId, patternId, bankRawDescription) WHERE r = 1)
SELECT g.accountId, g.patternId, m.description, round(g.amount_stats, {R}) AS amount_stats,
  round(CASE WHEN g.n > 1 THEN gs.days_median ELSE 0.0 END, {R}) AS cycle_days,
  round(g.confidence, {R}) AS confidence, g.confidence >= 0.5 AS is_recurring
FROM g JOIN m USING (accountId, patternId) LEFT JOIN gs USING (accountId, patternId)""", views=("scored",))
def q_group_summary(spark, sf):
    t = scored(spark, sf).filter(F.col("patternId").isNotNull())
    s = S.group_summary(t, ["accountId", "patternId"], threshold=0.5)
    return s.select("accountId", "patternId", "description", F.round("amount_stats", R).alias("amount_stats"),
                    F.round("cycle_days", R).alias("cycle_days"),
                    F.round("confidence", R).alias("confidence"), "is_recurring")


@register("account_vector_mean", f"""
SELECT accountId, CAST(i - 1 AS INTEGER) AS dim, round(avg(embedding[i]), {R}) AS mean
FROM vectors, range(1, 65) t(i) GROUP BY accountId, i""", views=("vectors",))
def q_vec_mean(spark, sf):
    return _rd(S.account_vector_mean(vectors(spark, sf)), ["mean"])


@register("class_weight", f"""
SELECT round(sqrt((count(*) - sum(isRecurring)) / greatest(sum(isRecurring), 1)), {R}) AS pos_weight FROM txn""")
def q_class_weight(spark, sf):
    return _rd(S.class_weight(txn(spark, sf)), ["pos_weight"])


@register("account_size_scope", f"""
WITH a AS (SELECT accountId, count(*) AS n FROM txn GROUP BY accountId)
SELECT count(*) AS total_accounts, count(*) FILTER (WHERE n > 600) AS large_accounts, sum(n) AS total_rows,
       coalesce(sum(n) FILTER (WHERE n > 600), 0) AS large_rows,
       round(count(*) FILTER (WHERE n > 600) / count(*), {R}) AS large_account_share,
       round(coalesce(sum(n) FILTER (WHERE n > 600), 0) / sum(n), {R}) AS large_row_share
FROM a""")
def q_scope(spark, sf):
    return _rd(S.account_size_scope(txn(spark, sf), 600), ["large_account_share", "large_row_share"])


_DIRWIN = """
dw AS (SELECT *, CASE WHEN amount > 0 THEN 1 ELSE -1 END AS sign FROM txn),
dp AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY accountId, sign ORDER BY amount, date, trId) - 1) / 64) AS INTEGER) AS win FROM dw),
dseq AS (SELECT *, row_number() OVER (PARTITION BY accountId, sign, win ORDER BY date, trId) - 1 AS seq FROM dp)"""


@register("direction_windows", "WITH " + _DIRWIN + "\nSELECT trId, sign, win, seq FROM dseq")
def q_dirwin(spark, sf):
    return W.direction_windows(txn(spark, sf), max_seq_len=64).select("trId", "sign", "win", "seq")


_CYC = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(__import__('cadence.schema', fromlist=['x']).CYCLE_LABELS))


@register("window_signal", "WITH " + _DIRWIN + f""",
per AS (SELECT accountId, sign, win, bool_or((CASE patternCycle {_CYC} ELSE 0 END) > 0) AS has_signal FROM dseq GROUP BY ALL)
SELECT count(*) FILTER (WHERE has_signal) AS positive_windows, count(*) FILTER (WHERE NOT has_signal) AS negative_windows FROM per""")
def q_window_signal(spark, sf):
    d = C.cycle_code(W.direction_windows(txn(spark, sf), max_seq_len=64))
    return S.window_signal(d, ["accountId", "sign", "win"])


@register("amount_windows", """
WITH p AS (SELECT trId, accountId, CAST(floor((row_number() OVER (PARTITION BY accountId ORDER BY amount, date, trId) - 1) / 200) AS INTEGER) AS win FROM txn)
SELECT trId, win, win_rows FROM (SELECT *, count(*) OVER (PARTITION BY accountId, win) AS win_rows FROM p) WHERE win_rows >= 2""")
def q_amount_windows(spark, sf):
    return W.amount_windows(txn(spark, sf)).select("trId", "win", "win_rows")


@register("time_index", """
SELECT trId, row_number() OVER (PARTITION BY accountId ORDER BY date, trId) - 1 AS time_idx FROM txn_orders""",
          views=("txn_orders",))
def q_time_index(spark, sf):
    return W.time_index(txn_orders(spark, sf), ["accountId"]).select("trId", "time_idx")


@register("history_length_by_label", f"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY accountId ORDER BY date, trId) - 1 AS time_idx FROM txn_orders),
s AS (SELECT accountId, count(*) AS length, arg_max(isRecurring, time_idx) AS last_label FROM t GROUP BY accountId)
SELECT last_label, round(avg(length), {R}) AS mean_length, count(*) AS series FROM s GROUP BY last_label""",
          views=("txn_orders",))
def q_hist_len(spark, sf):
    t = W.time_index(txn_orders(spark, sf), ["accountId"])
    return _rd(S.history_length_by_label(t, ["accountId"]), ["mean_length"])


@register("rate_by_feature", f"""
SELECT isodow(date) - 1 AS feature, round(avg(CAST(isRecurring AS DOUBLE)), {R}) AS rate, count(*) AS n FROM txn GROUP BY 1""")
def q_rate(spark, sf):
    return _rd(S.rate_by_feature(txn(spark, sf), F.weekday("date")), ["rate"])


@register("describe_groups", f"""
WITH l AS (SELECT 'amount' AS "column", amount AS v FROM txn UNION ALL SELECT 'isRecurring', CAST(isRecurring AS DOUBLE) FROM txn)
SELECT "column", count(v) AS count, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, min(v) AS min,
       round(quantile_cont(v, 0.25), {R}) AS q25, round(quantile_cont(v, 0.5), {R}) AS q50, round(quantile_cont(v, 0.75), {R}) AS q75, max(v) AS max
FROM l GROUP BY 1""")
def q_describe(spark, sf):
    d = S.describe_groups(txn(spark, sf), ["amount", "isRecurring"])
    d = d.withColumn("mean", F.round("mean", 4)).withColumn("std", F.round("std", 4))
    return _rd(d, ["q25", "q50", "q75"])


@register("amount_islands", f"""
WITH s AS (SELECT *, lag(amount) OVER (PARTITION BY accountId ORDER BY amount, trId) AS prev FROM txn),
g AS (SELECT *, sum(CASE WHEN abs(amount - prev) > 1.0 AND abs(amount - prev) > abs(prev) * 0.05 THEN 1 ELSE 0 END)
                  OVER (PARTITION BY accountId ORDER BY amount, trId ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM s),
k AS (SELECT accountId, island, quantile_cont(amount, 0.5) AS med FROM g GROUP BY ALL HAVING count(*) >= 3)
SELECT g.trId, g.island, round(k.med, {R}) AS cluster_seed_amount, g.accountId || '_amt_' || printf('%.2f', k.med) AS global_group_id
FROM g JOIN k USING (accountId, island)""")
def q_islands(spark, sf):
    d = W.amount_islands(txn(spark, sf).select("accountId", "trId", "amount"), min_size=3)
    return d.select("trId", "island", F.round("cluster_seed_amount", R).alias("cluster_seed_amount"), "global_group_id")


@register("amount_seed_overlap", """
WITH seeds AS (SELECT DISTINCT accountId, round(amount, 2) AS seed FROM txn),
mem AS (SELECT s.accountId, s.seed, t.trId, t.amount FROM seeds s JOIN txn t ON s.accountId = t.accountId
        WHERE abs(t.amount - s.seed) <= 1.0 OR abs(t.amount - s.seed) <= abs(s.seed) * 0.05),
per AS (SELECT accountId, seed, max(amount) AS hi FROM mem GROUP BY ALL HAVING count(*) >= 2),
run AS (SELECT *, max(hi) OVER (PARTITION BY accountId ORDER BY seed ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_hi FROM per),
kept AS (SELECT accountId, seed FROM run WHERE prev_hi IS NULL OR hi > prev_hi)
SELECT m.trId, m.accountId || '_amt_' || printf('%.2f', m.seed) AS global_group_id FROM mem m JOIN kept USING (accountId, seed)""")
def q_seed_overlap(spark, sf):
    return W.amount_seed_overlap(txn(spark, sf)).select("trId", "global_group_id")


@register("sequence_windows", """
WITH t AS (SELECT *, row_number() OVER (PARTITION BY accountId ORDER BY date, trId) - 1 AS time_idx FROM txn_orders),
h AS (SELECT trId, time_idx, count(*) OVER (PARTITION BY accountId ORDER BY time_idx ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS hist_len,
             first_value(trId) OVER (PARTITION BY accountId ORDER BY time_idx ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS first_hist
      FROM t)
SELECT trId, hist_len, first_hist FROM h WHERE hist_len >= 3""", views=("txn_orders",))
def q_seq_windows(spark, sf):
    t = W.time_index(txn_orders(spark, sf), ["accountId"])
    s = W.sequence_windows(t, ["accountId"], ["trId", "amount"], min_len=3, max_len=8)
    return s.select("trId", F.size("history").alias("hist_len"), F.col("history")[0]["trId"].alias("first_hist"))


@register("sequence_windows_predict", """
WITH t AS (SELECT *, row_number() OVER (PARTITION BY accountId ORDER BY date, trId) - 1 AS time_idx FROM txn_orders),
h AS (SELECT trId, accountId, time_idx, list(trId) OVER w AS hist, max(time_idx) OVER (PARTITION BY accountId) AS last FROM t
      WINDOW w AS (PARTITION BY accountId ORDER BY time_idx ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))
SELECT trId, accountId, array_to_string(hist, ',') AS history FROM h WHERE time_idx = last AND len(hist) >= 3""", views=("txn_orders",))
def q_seq_predict(spark, sf):
    """Prediction mode: the encoder window of the last row of each series."""
    t = W.time_index(txn_orders(spark, sf), ["accountId"])
    s = W.sequence_windows(t, ["accountId"], ["trId"], min_len=3, max_len=8, predict=True)
    return s.select("trId", "accountId", F.array_join(F.transform("history", lambda h: h["trId"]), ",").alias("history"))


@register("widest_gaps", f"""
WITH s AS (SELECT accountId, patternId, amount, lead(amount) OVER (PARTITION BY accountId, patternId ORDER BY amount, trId) - amount AS g
           FROM txn WHERE patternId IS NOT NULL)
SELECT accountId, patternId, count(*) AS size, round(max(amount) - min(amount), {R}) AS range, round(stddev_pop(amount), {R}) AS std,
       round(coalesce(max(g), 0.0), {R}) AS max_gap FROM s GROUP BY ALL""")
def q_widest(spark, sf):
    return _rd(S.widest_gaps(_pat(spark, sf), ["accountId", "patternId"]), ["range", "std", "max_gap"])
