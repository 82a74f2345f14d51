"""Date/amount feature queries."""

import math

from pyspark.sql import functions as F

from cadence.operators import features as X
from cadence.operators import windows as W
from cadence.plans.catalog import register
from cadence.plans.sqlfrag import amount_vocab_ctes
from cadence.sources.fixtures import txn, txn_events

R = 6


def _r(c, name=None):
    return F.round(c, R).alias(name) if name else F.round(c, R)


_DOW = "(isodow(date) - 1)"
_C14 = "(((date_diff('day', DATE '2000-01-01', CAST(date AS DATE)) % 14) + 14) % 14)"


@register("parse_dates", """
WITH s AS (SELECT trId, CASE WHEN amount < 0 THEN strftime(date, '%m/%d/%Y %H:%M:%S')
                             WHEN isRecurring = 1 THEN strftime(date, '%Y-%m-%d') ELSE 'unknown' END AS s FROM txn)
SELECT trId, strftime(coalesce(try_strptime(s, '%m/%d/%Y %H:%M:%S'), TRY_CAST(s AS TIMESTAMP), TIMESTAMP '1970-01-01'),
                      '%Y-%m-%d %H:%M:%S') AS parsed FROM s""")
def q_parse_dates(spark, sf):
    t = txn(spark, sf)
    s = (F.when(F.col("amount") < 0, F.date_format("date", "MM/dd/yyyy HH:mm:ss"))
          .when(F.col("isRecurring") == 1, F.date_format("date", "yyyy-MM-dd")).otherwise(F.lit("unknown")))
    return t.select("trId", F.date_format(X.parse_dates(s), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@register("cyclical_dates", f"""
SELECT trId,
  round(sin({_DOW} * (2 * pi() / 7)), {R}) + 0.0 AS day_of_week_sin, round(cos({_DOW} * (2 * pi() / 7)), {R}) + 0.0 AS day_of_week_cos,
  round(sin(dayofmonth(date) * (2 * pi() / 31)), {R}) + 0.0 AS day_of_month_sin, round(cos(dayofmonth(date) * (2 * pi() / 31)), {R}) + 0.0 AS day_of_month_cos,
  round(sin({_C14} * (2 * pi() / 14)), {R}) + 0.0 AS day_of_14_cycle_sin, round(cos({_C14} * (2 * pi() / 14)), {R}) + 0.0 AS day_of_14_cycle_cos
FROM txn_events""", views=("txn_events",))
def q_cyclical(spark, sf):
    d = X.cyclical_dates(txn_events(spark, sf))
    names = ["day_of_week_sin", "day_of_week_cos", "day_of_month_sin", "day_of_month_cos",
             "day_of_14_cycle_sin", "day_of_14_cycle_cos"]
    return d.select("trId", *[_r(F.col(n), n) for n in names])


@register("categorical_dates", f"SELECT trId, {_DOW} AS day_of_week_id, dayofmonth(date) - 1 AS day_of_month_id FROM txn")
def q_catdates(spark, sf):
    return X.categorical_dates(txn(spark, sf)).select("trId", "day_of_week_id", "day_of_month_id")


@register("log_abs_amount", f"""
SELECT trId, round(ln(abs(amount) + 1), {R}) AS log_abs_amount, CAST(amount > 0 AS INTEGER) AS is_positive FROM txn""")
def q_logabs(spark, sf):
    d = X.log_abs_amount(txn(spark, sf), is_positive=True)
    return d.select("trId", _r(F.col("log_abs_amount"), "log_abs_amount"), "is_positive")


@register("signed_log_amount", f"""
SELECT trId, round(CASE WHEN amount > 0 THEN 1.0 ELSE -1.0 END * ln(1 + abs(amount)), {R}) AS signed_log FROM txn""")
def q_signedlog(spark, sf):
    return txn(spark, sf).select("trId", _r(X.signed_log_amount(F.col("amount")), "signed_log"))


@register("days_since_start", """
SELECT trId, date_diff('day', (SELECT min(CAST(date AS DATE)) FROM txn_events), CAST(date AS DATE)) AS days,
       date_diff('day', min(CAST(date AS DATE)) OVER (PARTITION BY accountId), CAST(date AS DATE)) AS days_in_account
FROM txn_events""", views=("txn_events",))
def q_days_since(spark, sf):
    t = txn_events(spark, sf)
    g = X.days_since_start(t)
    g = X.days_since_start(g, group=["accountId"], out="days_in_account")
    return g.select("trId", "days", "days_in_account")


_TE_D = 8
_TE_SQL = ", ".join(
    f"round({'sin' if i % 2 == 0 else 'cos'}(d * exp({(i // 2) * 2} * (-ln(10000.0) / {_TE_D}))), {R}) AS te{i}"
    for i in range(_TE_D))


@register("time_encoding", f"""
SELECT trId, {_TE_SQL} FROM (
  SELECT trId, CAST(date_diff('day', min(CAST(date AS DATE)) OVER (PARTITION BY accountId), CAST(date AS DATE)) AS DOUBLE) AS d
  FROM txn)""")
def q_time_enc(spark, sf):
    t = X.days_since_start(txn(spark, sf), group=["accountId"], out="d")
    te = X.time_encoding(F.col("d"), _TE_D)
    return t.select("trId", *[_r(te.getItem(i), f"te{i}") for i in range(_TE_D)])


@register("date_intervals", """
SELECT trId, ((epoch_us(date) - epoch_us(lag(date) OVER (PARTITION BY accountId ORDER BY date, trId))) // 86400000000) AS interval_days
FROM txn_events""", views=("txn_events",))
def q_date_intervals(spark, sf):
    return W.date_intervals(txn_events(spark, sf), ["accountId"]).select("trId", "interval_days")


@register("simple_cycle", """
SELECT trId, (g BETWEEN 5 AND 9) OR (g BETWEEN 12 AND 16) OR (g BETWEEN 27 AND 33) AS simple_cycle FROM (
  SELECT trId, date_diff('day', lag(date) OVER (PARTITION BY accountId, bankRawDescription ORDER BY date, trId), date) AS g
  FROM txn)""")
def q_simple_cycle(spark, sf):
    t = W.date_intervals(txn(spark, sf), ["accountId", "bankRawDescription"])
    return t.select("trId", X.simple_cycle(F.col("interval_days")).alias("simple_cycle"))


_VOCAB = amount_vocab_ctes("txn")


@register("amount_vocab_fit", "WITH " + _VOCAB + f"""
SELECT token, amount, NULL::DOUBLE AS edge_lo FROM toptok
UNION ALL SELECT token, NULL::DOUBLE, round(edge_lo, {R}) FROM bins""")
def q_vocab(spark, sf):
    v = X.amount_vocab_fit(txn(spark, sf))
    top = v.top.select("token", "amount", F.lit(None).cast("double").alias("edge_lo"))
    bins = v.bins.crossJoin(v.edges).select(
        "token", F.lit(None).cast("double").alias("amount"),
        _r(F.element_at("edges", F.col("bin") + 1), "edge_lo"))
    return top.unionByName(bins)


@register("amount_tokenize", "WITH " + _VOCAB + """
SELECT t.trId, CAST(coalesce(tt.token, b.token, 1) AS INTEGER) AS amount_token_id
FROM (SELECT txn.*, greatest(0, least(len(list_filter(e.edges, lambda x: x < ln(1 + abs(txn.amount)))) - 1, len(e.edges) - 2)) AS bin
      FROM txn, edges e) t
LEFT JOIN toptok tt ON t.amount = tt.amount LEFT JOIN bins b ON t.bin = b.bin""")
def q_tokenize(spark, sf):
    t = txn(spark, sf)
    v = X.amount_vocab_fit(t)
    return X.amount_tokenize(t, v).select("trId", "amount_token_id")


@register("cents_histogram", "WITH " + _VOCAB + """
SELECT CAST(round(abs(amount) * 100) AS BIGINT) % 100 AS cents, count(*) AS n FROM top GROUP BY 1""")
def q_cents(spark, sf):
    return X.cents_histogram(X.amount_vocab_fit(txn(spark, sf)))


@register("standard_scale", f"""
WITH st AS (SELECT avg(ln(1 + abs(amount))) AS m, stddev_pop(ln(1 + abs(amount))) AS s FROM txn WHERE amount > 0)
SELECT trId, round((ln(1 + abs(amount)) - m) / CASE WHEN s = 0 THEN 1.0 ELSE s END, {R}) + 0.0 AS log_abs_amount FROM txn, st""")
def q_scale(spark, sf):
    t = X.log_abs_amount(txn(spark, sf))
    stats = X.standard_scale_fit(t.filter("amount > 0"), ["log_abs_amount"])
    return X.standard_scale_apply(t, stats, ["log_abs_amount"]).select("trId", _r(F.col("log_abs_amount"), "log_abs_amount"))


_BEH = ["acc_stat_txn_freq", "acc_stat_amount_mean", "acc_stat_amount_std", "acc_stat_amount_max",
        "acc_stat_amount_median", "acc_stat_amount_q25", "acc_stat_amount_q75", "acc_stat_amount_iqr",
        "acc_stat_spike_ratio"]


@register("account_behavior", f"""
WITH s AS (
  SELECT accountId, count(*) / greatest(((epoch_us(max(date)) - epoch_us(min(date))) // 86400000000) + 1, 1) AS acc_stat_txn_freq,
         avg(ln(1 + abs(amount))) AS acc_stat_amount_mean, coalesce(stddev_samp(ln(1 + abs(amount))), 0.0) AS acc_stat_amount_std,
         max(amount) AS acc_stat_amount_max, quantile_cont(amount, 0.5) AS acc_stat_amount_median,
         quantile_cont(amount, 0.25) AS acc_stat_amount_q25, quantile_cont(amount, 0.75) AS acc_stat_amount_q75
  FROM txn_events GROUP BY accountId)
SELECT t.trId, {", ".join(f"round({c}, {R}) AS {c}" for c in _BEH[:7])},
  round(acc_stat_amount_q75 - acc_stat_amount_q25, {R}) AS acc_stat_amount_iqr,
  round(acc_stat_amount_max / CASE WHEN acc_stat_amount_median = 0 THEN 1.0 ELSE acc_stat_amount_median END, {R}) AS acc_stat_spike_ratio
FROM txn_events t JOIN s USING (accountId)""", views=("txn_events",))
def q_behavior(spark, sf):
    d = X.account_behavior(txn_events(spark, sf))
    return d.select("trId", *[_r(F.col(c), c) for c in _BEH])
