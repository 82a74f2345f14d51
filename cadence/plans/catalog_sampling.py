"""Split, sample and top-k queries."""

from pyspark.sql import functions as F

from cadence.operators import metrics as M
from cadence.operators import pairs as P
from cadence.operators import sampling as S
from cadence.operators import topk as K
from cadence.plans.catalog import register
from cadence.plans.catalog_pairs import _PAIRS
from cadence.sources.fixtures import scored, txn

R = 6
_ORDER = """
acc AS (SELECT DISTINCT accountId FROM txn),
o AS (SELECT accountId, row_number() OVER (ORDER BY md5('{seed}|' || accountId), accountId) - 1 AS r, count(*) OVER () AS n FROM acc)"""


@register("group_split", "WITH " + _ORDER.format(seed=42) + f""",
s AS (SELECT accountId, CASE WHEN r < ceil(0.2 * n) THEN 'test'
                             WHEN r < ceil(0.2 * n) + ceil({0.2 / (1.0 - 0.2)!r} * (n - ceil(0.2 * n))) THEN 'val' ELSE 'train' END AS split FROM o)
SELECT t.trId, s.split FROM txn t JOIN s USING (accountId)""")
def q_group_split(spark, sf):
    return S.group_split(txn(spark, sf), 0.2, 0.2, 42).select("trId", "split")


@register("group_split_two", "WITH " + _ORDER.format(seed=7) + """
SELECT t.trId, CASE WHEN r < ceil(0.2 * n) THEN 'test' ELSE 'train' END AS split FROM txn t JOIN o USING (accountId)""")
def q_group_split_two(spark, sf):
    return S.group_split_two(txn(spark, sf), 0.2, 7).select("trId", "split")


@register("ratio_split", "WITH " + _ORDER.format(seed=42) + """
SELECT t.trId, CASE WHEN r < floor(0.1 * n) THEN 'test' WHEN r < floor(0.1 * n) + floor(0.1 * n) THEN 'val' ELSE 'train' END AS split
FROM txn t JOIN o USING (accountId)""")
def q_ratio_split(spark, sf):
    return S.ratio_split(txn(spark, sf), 0.1, 0.1, 42).select("trId", "split")


@register("downsample_accounts", "WITH " + _ORDER.format(seed=3) + """
SELECT t.trId FROM txn t JOIN o USING (accountId) WHERE r < greatest(floor(0.3 * n), 1)""")
def q_downsample(spark, sf):
    return S.downsample_accounts(txn(spark, sf), 0.3, 3).select("trId")


@register("learning_curve", "WITH " + _ORDER.format(seed=42) + """,
f AS (SELECT * FROM (VALUES (0.1), (0.25), (0.5), (1.0)) v(fraction))
SELECT CAST(fraction AS DOUBLE) AS fraction, accountId FROM o, f WHERE fraction >= 1.0 OR r < floor(fraction * n)""")
def q_learning_curve(spark, sf):
    return S.learning_curve(txn(spark, sf), [0.1, 0.25, 0.5, 1.0], 42)


@register("per_bank_sample", """
WITH a AS (SELECT DISTINCT bank_name, accountId FROM txn),
r AS (SELECT *, row_number() OVER (PARTITION BY bank_name ORDER BY md5('42|' || accountId), accountId) - 1 AS rk,
             count(*) OVER (PARTITION BY bank_name) AS nb FROM a)
SELECT bank_name, accountId, CASE WHEN rk < 3 THEN 'train' ELSE 'test' END AS split FROM r WHERE nb >= 5 AND rk < 4""")
def q_per_bank(spark, sf):
    # the reference sizes (850 / 750 / 100) scaled to the fixture's 100-1000 accounts
    return S.per_bank_sample(txn(spark, sf), min_accounts=5, n_train=3, n_test=1)


@register("pair_holdout", "WITH " + _PAIRS + """
SELECT trId_1, trId_2, CAST(('0x' || substr(md5('42|' || trId_1 || '|' || trId_2), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0 < 0.2 AS holdout FROM pairs""")
def q_pair_holdout(spark, sf):
    return S.pair_holdout(P.candidate_pairs(txn(spark, sf)), 0.2, 42).select("trId_1", "trId_2", "holdout")


@register("group_kfold", "WITH " + _ORDER.format(seed=42) + """
SELECT t.trId, CAST(r % 3 AS INTEGER) AS fold FROM txn t JOIN o USING (accountId)""")
def q_kfold(spark, sf):
    return S.group_kfold(txn(spark, sf), 3, 42).select("trId", "fold")


@register("balanced_window_sample", """
WITH w AS (SELECT accountId, CASE WHEN amount > 0 THEN 1 ELSE -1 END AS sign, max(isRecurring) AS has_signal FROM txn GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY has_signal ORDER BY accountId, sign) - 1 AS at FROM w),
c AS (SELECT has_signal, count(*) AS nc, row_number() OVER (ORDER BY has_signal) AS i, count(*) OVER () AS k FROM w GROUP BY has_signal),
d AS (SELECT has_signal, nc, unnest(range(1000 // k + CASE WHEN i <= 1000 % k THEN 1 ELSE 0 END)) AS draw FROM c)
SELECT p.accountId, p.sign, p.has_signal, d.draw
FROM d JOIN p ON p.has_signal = d.has_signal
     AND p.at = ('0x' || substr(md5('42|' || d.has_signal || '|' || d.draw), 1, 8))::BIGINT % d.nc""")
def q_balanced(spark, sf):
    """Windows (account, direction) drawn with replacement, the classes equally often."""
    t = txn(spark, sf).withColumn("sign", F.when(F.col("amount") > 0, 1).otherwise(-1))
    w = t.groupBy("accountId", "sign").agg(F.max("isRecurring").alias("has_signal"))
    return S.balanced_window_sample(w, "has_signal", ["accountId", "sign"], 1000, seed=42)


_CT = "CASE WHEN isRecurring = 1 AND prob > 0.5 THEN 'TP' WHEN isRecurring = 0 AND prob > 0.5 THEN 'FP' WHEN isRecurring = 1 THEN 'FN' ELSE 'TN' END"


@register("top_mistakes", f"""
SELECT trId, result_type, round(prob, {R}) AS prob, rank FROM (
  SELECT trId, prob, result_type, row_number() OVER (PARTITION BY result_type ORDER BY CASE WHEN result_type = 'FP' THEN -prob ELSE prob END, trId) AS rank
  FROM (SELECT trId, prob, {_CT} AS result_type FROM scored) WHERE result_type IN ('FP', 'FN')) WHERE rank <= 5""", views=("scored",))
def q_top_mistakes(spark, sf):
    d = M.confusion_type(scored(spark, sf), "isRecurring", F.col("prob") > 0.5)
    return K.top_mistakes(d, 5).select("trId", "result_type", F.round("prob", R).alias("prob"), "rank")


@register("top_group_mistakes", f"""
WITH g AS (SELECT patternId, avg(prob) AS prob, max(isRecurring) AS truth, avg(prob) > 0.47 AS taken FROM scored WHERE patternId IS NOT NULL GROUP BY 1),
flip AS (SELECT patternId, round(prob, 9) AS prob, CASE WHEN taken THEN 'FP' ELSE 'FN' END AS result_type FROM g
         WHERE taken <> (CAST(split_part(patternId, '-', 2) AS INTEGER) % 2 = 0))
SELECT patternId, result_type, round(prob, {R}) AS prob, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY result_type ORDER BY CASE WHEN result_type = 'FP' THEN -prob ELSE prob END, patternId) AS rank FROM flip)
WHERE rank <= 5""", views=("scored",))
def q_top_group_mistakes(spark, sf):
    """Group form: each pattern group once, with its mean probability; even pattern numbers play the true groups."""
    g = (scored(spark, sf).filter(F.col("patternId").isNotNull()).groupBy("patternId")
         .agg(F.avg("prob").alias("p")).withColumn("prob", F.round("p", 9)))
    taken, truth = F.col("p") > 0.47, F.split("patternId", "-")[1].cast("int") % 2 == 0
    d = g.withColumn("result_type", F.when(taken & ~truth, "FP").when(~taken & truth, "FN").otherwise("OK"))
    return K.top_group_mistakes(d, 5, group="patternId").select("patternId", "result_type", F.round("prob", R).alias("prob"), "rank")


@register("largest_group_sample", """
WITH g AS (SELECT patternId, count(*) AS n FROM txn WHERE patternId IS NOT NULL GROUP BY patternId ORDER BY n DESC, patternId LIMIT 1)
SELECT trId, date FROM txn WHERE patternId IN (SELECT patternId FROM g)""")
def q_largest(spark, sf):
    return K.largest_group_sample(txn(spark, sf), "patternId").select("trId", "date")


@register("extreme_texts", """
WITH p AS (SELECT bankRawDescription, max(amount) AS value FROM txn GROUP BY 1)
SELECT * FROM (SELECT bankRawDescription, value, 'high' AS "end" FROM p ORDER BY value DESC, bankRawDescription LIMIT 5)
UNION ALL SELECT * FROM (SELECT bankRawDescription, value, 'low' FROM p ORDER BY value, bankRawDescription LIMIT 5)""")
def q_extreme(spark, sf):
    return K.extreme_texts(txn(spark, sf), "bankRawDescription", "amount", 5)


@register("ordered_report", f"SELECT trId, accountId, date, {_CT} AS result_type FROM scored", views=("scored",))
def q_ordered(spark, sf):
    d = M.confusion_type(scored(spark, sf), "isRecurring", F.col("prob") > 0.5)
    return K.ordered_report(d.select("trId", "accountId", "date", "result_type"))
