"""Evaluation queries over the scored view."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadence.operators import clean as C
from cadence.operators import metrics as M
from cadence.operators import windows as W
from cadence.plans.catalog import register
from cadence.schema import CYCLE_LABELS
from cadence.sources.fixtures import scored

R = 6
def _pred():
    return F.col("prob") > 0.5


def _rd(df, names=None):
    return df.select(*[F.round(c, R).alias(c) if (names is None and t in ("double", "float")) or
                       (names is not None and c in names) else F.col(c) for c, t in df.dtypes])


_PRF = f"""round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, {R}) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, {R}) AS recall,
  round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END, {R}) AS f1"""

_COUNTS = """count(*) FILTER (WHERE isRecurring = 1 AND {p}) AS tp, count(*) FILTER (WHERE isRecurring = 0 AND {p}) AS fp,
  count(*) FILTER (WHERE isRecurring = 1 AND NOT ({p})) AS fn, count(*) AS rows"""


def _prf_round(df):
    return _rd(df, ["precision", "recall", "f1"])


@register("row_prf", f"SELECT *, {_PRF} FROM (SELECT {_COUNTS.format(p='prob > 0.5')} FROM scored)", views=("scored",))
def q_row_prf(spark, sf):
    return _prf_round(M.row_prf(scored(spark, sf), "isRecurring", _pred()))


@register("bank_metrics", f"SELECT *, {_PRF} FROM (SELECT bank_name, {_COUNTS.format(p='prob > 0.5')} FROM scored GROUP BY bank_name)",
          views=("scored",))
def q_bank_metrics(spark, sf):
    return _prf_round(M.row_prf(scored(spark, sf), "isRecurring", _pred(), group=["bank_name"]))


@register("bank_leaderboard", f"""
SELECT bank_name, f1, row_number() OVER (ORDER BY f1 DESC, bank_name) AS rank FROM (
  SELECT bank_name, {_PRF} FROM (SELECT bank_name, {_COUNTS.format(p='prob > 0.5')} FROM scored GROUP BY bank_name))""",
          views=("scored",))
def q_bank_leaderboard(spark, sf):
    m = _prf_round(M.row_prf(scored(spark, sf), "isRecurring", _pred(), group=["bank_name"]))
    # one row per bank: ordering the small per-bank table is cheap
    return m.select("bank_name", "f1", F.row_number().over(Window.orderBy(F.desc("f1"), "bank_name")).alias("rank"))


_CT = "CASE WHEN isRecurring = 1 AND prob > 0.5 THEN 'TP' WHEN isRecurring = 0 AND prob > 0.5 THEN 'FP' WHEN isRecurring = 1 THEN 'FN' ELSE 'TN' END"


@register("confusion_type", f"SELECT trId, {_CT} AS result_type FROM scored", views=("scored",))
def q_confusion(spark, sf):
    return M.confusion_type(scored(spark, sf), "isRecurring", _pred()).select("trId", "result_type")


@register("mistake_rows", f"SELECT trId, result_type FROM (SELECT trId, {_CT} AS result_type FROM scored) WHERE result_type IN ('FP', 'FN')",
          views=("scored",))
def q_mistakes(spark, sf):
    return M.mistake_rows(scored(spark, sf), "isRecurring", _pred()).select("trId", "result_type")


_GRP = "CASE WHEN prob > 0.5 THEN accountId || '_' || counter_party END"


@register("group_prf", f"""
WITH d AS (SELECT *, {_GRP} AS recurring_group_id FROM scored),
pg AS (SELECT count(*) AS predicted_groups, count(*) FILTER (WHERE ok) AS true_positive_groups FROM (
         SELECT recurring_group_id, avg(CAST(isRecurring AS DOUBLE)) > 0.5 AS ok FROM d WHERE recurring_group_id IS NOT NULL GROUP BY 1)),
tg AS (SELECT count(*) AS true_groups, count(*) FILTER (WHERE found) AS detected_true_groups FROM (
         SELECT patternId, avg(CASE WHEN recurring_group_id IS NOT NULL THEN 1.0 ELSE 0.0 END) > 0.5 AS found
         FROM d WHERE isRecurring = 1 AND patternId IS NOT NULL GROUP BY 1))
SELECT *, round(gp, {R}) AS group_precision, round(gr, {R}) AS group_recall,
       round(CASE WHEN gp + gr > 0 THEN 2 * gp * gr / (gp + gr) ELSE 0.0 END, {R}) AS group_f1
FROM (SELECT *, CASE WHEN predicted_groups > 0 THEN true_positive_groups / predicted_groups ELSE 0.0 END AS gp,
             CASE WHEN true_groups > 0 THEN detected_true_groups / true_groups ELSE 0.0 END AS gr FROM pg, tg)""",
          views=("scored",))
def q_group_prf(spark, sf):
    d = scored(spark, sf).withColumn("recurring_group_id",
                                     F.when(_pred(), F.concat_ws("_", "accountId", "counter_party")))
    g = M.group_prf(d)
    g = g.withColumns({"gp": F.col("group_precision"), "gr": F.col("group_recall")})
    return _rd(g, ["group_precision", "group_recall", "group_f1"])


_SCAN = """
st AS (SELECT prob AS score, sum(isRecurring) AS pos, sum(1 - isRecurring) AS neg FROM scored GROUP BY prob),
sc AS (SELECT *, sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
                 sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp FROM st),
tot AS (SELECT sum(pos) AS P, sum(neg) AS N FROM st)"""


@register("average_precision", "WITH " + _SCAN + f"""
SELECT round(sum(pos / P * tp / (tp + fp)), {R}) AS average_precision FROM sc, tot""", views=("scored",))
def q_ap(spark, sf):
    return _rd(M.average_precision(scored(spark, sf), "prob", "isRecurring"))


@register("roc_auc", "WITH " + _SCAN + f"""
SELECT round(sum(pos * ((N - fp) + 0.5 * neg)) / (max(P) * max(N)), {R}) AS roc_auc FROM sc, tot""", views=("scored",))
def q_auc(spark, sf):
    return _rd(M.roc_auc(scored(spark, sf), "prob", "isRecurring"))


_CURVE = "WITH " + _SCAN + """,
cur AS (SELECT score AS threshold, tp / (tp + fp) AS precision, CASE WHEN P > 0 THEN tp / P ELSE 0.0 END AS recall FROM sc, tot)"""


@register("best_f1", _CURVE + f"""
SELECT round(max(f1), {R}) AS best_f1, arg_min(threshold, (-f1, threshold)) AS best_threshold FROM (
  SELECT *, 2 * precision * recall / (precision + recall + 1e-6) AS f1 FROM cur)""", views=("scored",))
def q_best_f1(spark, sf):
    return _rd(M.best_f1(scored(spark, sf), "prob", "isRecurring"), ["best_f1"])


@register("threshold_search", _CURVE + f"""
SELECT round(max(f1), {R}) AS f1, arg_min(threshold, (-f1, threshold)) AS threshold FROM (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM cur)""",
          views=("scored",))
def q_threshold(spark, sf):
    return _rd(M.threshold_search(scored(spark, sf), "prob", "isRecurring"), ["f1"])


@register("calibration", f"""
SELECT prob_bin, count(*) AS count, round(avg(prob), {R}) AS avg_conf FROM (
  SELECT prob, CASE WHEN prob > 0 AND prob <= 1 THEN len(list_filter([{", ".join(str(i / 10) for i in range(11))}], lambda e: e < prob)) - 1 END AS prob_bin
  FROM scored) WHERE prob_bin IS NOT NULL GROUP BY prob_bin""", views=("scored",))
def q_calibration(spark, sf):
    return _rd(M.calibration(scored(spark, sf), "prob"))


@register("calibration_extremes", f"""
SELECT count(*) FILTER (WHERE rt = 'FP') AS total_fp, count(*) FILTER (WHERE rt = 'FN') AS total_fn,
       count(*) FILTER (WHERE prob > 0.9 AND isRecurring = 0) AS high_conf_fp,
       count(*) FILTER (WHERE prob < 0.1 AND isRecurring = 1) AS high_conf_fn
FROM (SELECT *, {_CT} AS rt FROM scored)""", views=("scored",))
def q_cal_ext(spark, sf):
    d = M.confusion_type(scored(spark, sf), "isRecurring", _pred())
    return M.calibration_extremes(d, "prob")


_CYC = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CYCLE_LABELS))
_YP = f"(CASE patternCycle {_CYC} ELSE 0 END) AS y, CAST(floor(prob * 8) AS INTEGER) % 8 AS p"


def _yp(spark, sf):
    d = C.cycle_code(scored(spark, sf), out="y")
    return d.withColumn("p", (F.floor(F.col("prob") * 8) % 8).cast("int"))


@register("class_report", f"""
WITH d AS (SELECT {_YP} FROM scored),
cls AS (SELECT CAST(y AS VARCHAR) AS cls FROM d UNION SELECT CAST(p AS VARCHAR) FROM d),
per AS (SELECT cls.cls, coalesce(s.support, 0) AS support, coalesce(q.predicted, 0) AS predicted, coalesce(h.tp, 0) AS tp
        FROM cls LEFT JOIN (SELECT CAST(y AS VARCHAR) AS cls, count(*) AS support FROM d GROUP BY 1) s USING (cls)
        LEFT JOIN (SELECT CAST(p AS VARCHAR) AS cls, count(*) AS predicted FROM d GROUP BY 1) q USING (cls)
        LEFT JOIN (SELECT CAST(y AS VARCHAR) AS cls, count(*) AS tp FROM d WHERE y = p GROUP BY 1) h USING (cls)),
m AS (SELECT cls, support, tp, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
             CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM per),
m2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM m),
t AS (SELECT sum(support) AS n, sum(tp) AS hits, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
             sum(precision * support) AS wp, sum(recall * support) AS wr, sum(f1 * support) AS wf FROM m2)
SELECT cls, round(precision, {R}) AS precision, round(recall, {R}) AS recall, round(f1, {R}) AS f1, support FROM m2
UNION ALL SELECT 'accuracy', round(hits / n, {R}), round(hits / n, {R}), round(hits / n, {R}), n FROM t
UNION ALL SELECT 'macro avg', round(mp, {R}), round(mr, {R}), round(mf, {R}), n FROM t
UNION ALL SELECT 'weighted avg', round(wp / n, {R}), round(wr / n, {R}), round(wf / n, {R}), n FROM t""", views=("scored",))
def q_class_report(spark, sf):
    return _rd(M.class_report(_yp(spark, sf), "y", "p"))


@register("accuracy", f"SELECT round(avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END), {R}) AS accuracy FROM (SELECT {_YP} FROM scored)",
          views=("scored",))
def q_accuracy(spark, sf):
    return _rd(M.accuracy(_yp(spark, sf), "y", "p"))


@register("macro_ap", f"""
WITH d AS (SELECT trId, prob, {_YP} FROM scored),
l AS (SELECT d.trId, c.k AS cls, CASE WHEN c.k = d.p THEN d.prob ELSE (1 - d.prob) / 7 END AS score,
             CAST(c.k = d.y AS INTEGER) AS is_true FROM d, range(0, 8) c(k)),
st AS (SELECT cls, score, sum(is_true) AS pos, sum(1 - is_true) AS neg FROM l GROUP BY cls, score),
sc AS (SELECT *, sum(pos) OVER (PARTITION BY cls ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
                 sum(neg) OVER (PARTITION BY cls ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp,
                 sum(pos) OVER (PARTITION BY cls) AS P FROM st),
ap AS (SELECT cls, sum(pos / P * tp / (tp + fp)) AS ap FROM sc WHERE P > 0 GROUP BY cls)
SELECT round(CASE WHEN count(*) > 1 THEN avg(ap) ELSE 0.0 END, {R}) AS macro_ap FROM ap""", views=("scored",))
def q_macro_ap(spark, sf):
    d = _yp(spark, sf)
    ks = spark.range(8).select(F.col("id").cast("int").alias("cls"))  # the 8 cycle classes (fixed)
    long_ = d.crossJoin(F.broadcast(ks)).select(
        "trId", "cls", F.when(F.col("cls") == F.col("p"), F.col("prob")).otherwise((1 - F.col("prob")) / 7).alias("score"),
        (F.col("cls") == F.col("y")).cast("int").alias("is_true"))
    return _rd(M.macro_ap(long_, "cls", "score", "is_true"))


@register("bcubed", f"""
WITH d AS (SELECT trId, coalesce({_GRP}, 'n_' || trId) AS pr, coalesce(patternId, 'n_' || trId) AS tr FROM scored),
c AS (SELECT pr, tr, count(*) AS n FROM d GROUP BY ALL),
ps AS (SELECT pr, count(*) AS np FROM d GROUP BY pr), ts AS (SELECT tr, count(*) AS nt FROM d GROUP BY tr),
o AS (SELECT sum(n * n / np) / sum(n) AS p, sum(n * n / nt) / sum(n) AS r FROM c JOIN ps USING (pr) JOIN ts USING (tr))
SELECT round(p, {R}) AS bcubed_precision, round(r, {R}) AS bcubed_recall,
       round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, {R}) AS bcubed_f1 FROM o""", views=("scored",))
def q_bcubed(spark, sf):
    d = scored(spark, sf).select(
        F.coalesce(F.when(_pred(), F.concat_ws("_", "accountId", "counter_party")), F.concat(F.lit("n_"), "trId")).alias("pr"),
        F.coalesce("patternId", F.concat(F.lit("n_"), "trId")).alias("tr"))
    return _rd(M.bcubed(d, "pr", "tr"))


@register("cycle_accuracy_tp", f"""
SELECT round(avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END), {R}) AS cycle_accuracy, count(*) AS detected_true
FROM (SELECT isRecurring, prob, {_YP} FROM scored) WHERE isRecurring = 1 AND prob > 0.5""", views=("scored",))
def q_cycle_acc(spark, sf):
    d = _yp(spark, sf).filter((F.col("isRecurring") == 1) & _pred())
    return _rd(d.agg(F.avg((F.col("y") == F.col("p")).cast("double")).alias("cycle_accuracy"),
                     F.count(F.lit(1)).alias("detected_true")))


@register("row_log_loss", f"""
SELECT accountId, round(avg(-(isRecurring * ln(greatest(least(prob, 1 - 1e-7), 1e-7))
                          + (1 - isRecurring) * ln(1 - greatest(least(prob, 1 - 1e-7), 1e-7)))), {R}) AS mean_log_loss
FROM scored GROUP BY accountId""", views=("scored",))
def q_log_loss(spark, sf):
    d = M.row_log_loss(scored(spark, sf), "prob", "isRecurring")
    return _rd(d.groupBy("accountId").agg(F.avg("log_loss").alias("mean_log_loss")))


@register("worst_accounts", f"""
WITH l AS (SELECT *, -(isRecurring * ln(greatest(least(prob, 1 - 1e-7), 1e-7))
                       + (1 - isRecurring) * ln(1 - greatest(least(prob, 1 - 1e-7), 1e-7))) AS ll FROM scored),
a AS (SELECT accountId, avg(ll) AS m FROM l GROUP BY accountId ORDER BY m DESC, accountId LIMIT 3)
SELECT l.accountId, l.patternId, arg_max(l.trId, (l.date, l.trId)) AS last_trId, round(max(a.m), {R}) AS mean_log_loss
FROM l JOIN a USING (accountId) WHERE l.patternId IS NOT NULL GROUP BY l.accountId, l.patternId""", views=("scored",))
def q_worst(spark, sf):
    d = M.row_log_loss(scored(spark, sf), "prob", "isRecurring")
    acc = d.groupBy("accountId").agg(F.avg("log_loss").alias("mean_log_loss"))
    top = acc.orderBy(F.desc("mean_log_loss"), "accountId").limit(3)  # the feature is a top-3 report
    j = d.filter(F.col("patternId").isNotNull()).join(F.broadcast(top), "accountId")
    out = j.groupBy("accountId", "patternId").agg(
        F.max_by("trId", F.struct("date", "trId")).alias("last_trId"), F.max("mean_log_loss").alias("mean_log_loss"))
    return _rd(out, ["mean_log_loss"])


@register("before_after", f"""
WITH a AS (SELECT {_COUNTS.format(p='prob > 0.5')} FROM scored), b AS (SELECT {_COUNTS.format(p='prob > 0.6')} FROM scored),
pa AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM a),
pb AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM b),
fa AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM pa),
fb AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM pb)
SELECT fa.tp AS raw_tp, fa.fp AS raw_fp, fa.fn AS raw_fn, round(fa.p, {R}) AS raw_precision, round(fa.r, {R}) AS raw_recall, round(fa.f, {R}) AS raw_f1,
       fb.tp AS refined_tp, fb.fp AS refined_fp, fb.fn AS refined_fn, round(fb.p, {R}) AS refined_precision, round(fb.r, {R}) AS refined_recall,
       round(fb.f, {R}) AS refined_f1, round(fb.p - fa.p, {R}) AS delta_precision, round(fb.r - fa.r, {R}) AS delta_recall,
       round(fb.f - fa.f, {R}) AS delta_f1, fa.fp - fb.fp AS fp_removed FROM fa, fb""", views=("scored",))
def q_before_after(spark, sf):
    return _rd(M.before_after(scored(spark, sf), "isRecurring", _pred(), F.col("prob") > 0.6))


@register("max_prob_per_row", f"""
WITH seeds AS (SELECT DISTINCT accountId, round(amount, 2) AS seed FROM scored),
mem AS (SELECT s.accountId, s.seed, t.trId, t.prob, t.isRecurring FROM seeds s JOIN scored t ON s.accountId = t.accountId
        WHERE abs(t.amount - s.seed) <= 1.0 OR abs(t.amount - s.seed) <= abs(s.seed) * 0.05),
per AS (SELECT accountId, seed, max(amount_hi) AS hi FROM (SELECT m.*, t.amount AS amount_hi FROM mem m JOIN scored t USING (trId)) GROUP BY ALL HAVING count(*) >= 2),
run AS (SELECT *, max(hi) OVER (PARTITION BY accountId ORDER BY seed ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_hi FROM per),
kept AS (SELECT accountId, seed FROM run WHERE prev_hi IS NULL OR hi > prev_hi),
g AS (SELECT m.*, round(avg(m.prob) OVER (PARTITION BY m.accountId, m.seed), 9) AS gprob FROM mem m JOIN kept USING (accountId, seed)),
r AS (SELECT trId, max(gprob) AS prob, min(isRecurring) AS target FROM g GROUP BY trId),
c AS (SELECT count(*) FILTER (WHERE target = 1 AND prob > 0.5) AS tp, count(*) FILTER (WHERE target = 0 AND prob > 0.5) AS fp,
             count(*) FILTER (WHERE target = 1 AND NOT (prob > 0.5)) AS fn, count(*) AS rows FROM r)
SELECT *, {_PRF} FROM c""", views=("scored",))
def q_max_prob(spark, sf):
    # the group's probability comes with its members: each row is then reduced where it was listed
    g = W.amount_seed_overlap(scored(spark, sf), carry=("prob", "isRecurring"), means={"gprob": "prob"})
    # rounded to 9 decimals: summation order must not move a row across 0.5
    g = g.withColumn("gprob", F.round("gprob", 9))
    return _prf_round(M.max_prob_per_row(g, "trId", "gprob", "isRecurring"))
