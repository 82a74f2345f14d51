"""Evaluation and diagnostics as aggregates.

Curve metrics (AP, ROC AUC, best F1, threshold search) first collapse rows to
distinct scores (partial aggregation), then scan the score table in order with the
skew-aware ``ordered_scan`` (a global order becomes range partitions, never one
task holding every score).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.operators.ordered import ordered_scan
from cadence.session import materialize


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _prf(tp, fp, fn) -> list[Column]:
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return [p.alias("precision"), r.alias("recall"), f.alias("f1")]


def row_prf(df: DataFrame, label="isRecurring", pred=None, group: list[str] | None = None) -> DataFrame:
    """TP/FP/FN and precision/recall/F1 (0 when undefined); one row (per group)."""
    y = F.coalesce(_c(label).cast("boolean"), F.lit(False))
    p = F.coalesce(_c(pred), F.lit(False)) if pred is not None else F.col("recurring_group_id").isNotNull()
    base = df.select(*(group or []), y.alias("_y"), p.alias("_p"))
    agg = [F.count_if(F.col("_y") & F.col("_p")).alias("tp"), F.count_if(~F.col("_y") & F.col("_p")).alias("fp"),
           F.count_if(F.col("_y") & ~F.col("_p")).alias("fn"), F.count(F.lit(1)).alias("rows")]
    out = base.groupBy(*(group or [])).agg(*agg)
    return out.select("*", *_prf(F.col("tp"), F.col("fp"), F.col("fn")))


def confusion_type(df: DataFrame, label="isRecurring", pred=None, out: str = "result_type") -> DataFrame:
    y = F.coalesce(_c(label).cast("boolean"), F.lit(False))
    p = _c(pred) if pred is not None else F.col("recurring_group_id").isNotNull()
    t = (F.when(y & p, "TP").when(~y & p, "FP").when(y & ~p, "FN").otherwise("TN"))
    return df.withColumn(out, t)


def mistake_rows(df: DataFrame, label="isRecurring", pred=None) -> DataFrame:
    """False positives and false negatives, tagged by ``result_type``."""
    return confusion_type(df, label, pred).filter(F.col("result_type").isin("FP", "FN"))


def group_prf(df: DataFrame, group: str = "recurring_group_id", label: str = "isRecurring",
              pattern: str = "patternId") -> DataFrame:
    """Group precision (predicted group with mean label > 0.5), group recall (true
    pattern with > 50 % of its recurring rows detected; NULL pattern excluded), F1."""
    y = F.coalesce(F.col(label).cast("boolean"), F.lit(False))
    pg = (df.filter(F.col(group).isNotNull()).groupBy(group)
            .agg((F.avg(y.cast("double")) > 0.5).alias("_ok"))
            .agg(F.count(F.lit(1)).alias("predicted_groups"), F.count_if("_ok").alias("true_positive_groups")))
    tg = (df.filter(y & F.col(pattern).isNotNull()).groupBy(pattern)
            .agg((F.avg(F.col(group).isNotNull().cast("double")) > 0.5).alias("_found"))
            .agg(F.count(F.lit(1)).alias("true_groups"), F.count_if("_found").alias("detected_true_groups")))
    j = pg.crossJoin(tg)  # two one-row tables
    p = F.when(F.col("predicted_groups") > 0, F.col("true_positive_groups") / F.col("predicted_groups")).otherwise(0.0)
    r = F.when(F.col("true_groups") > 0, F.col("detected_true_groups") / F.col("true_groups")).otherwise(0.0)
    return j.select("*", p.alias("group_precision"), r.alias("group_recall"),
                    F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("group_f1"))


def score_table(df: DataFrame, score, label, group: list[str] | None = None) -> DataFrame:
    """(group..., score, pos, neg) per distinct score (rows collapse before any shuffle)."""
    y = F.coalesce(_c(label).cast("int"), F.lit(0))
    return (df.select(*(group or []), _c(score).cast("double").alias("score"), y.alias("_y"))
              .groupBy(*(group or []), "score")
              .agg(F.sum("_y").alias("pos"), F.sum(1 - F.col("_y")).alias("neg")))


def _desc_scan(st: DataFrame, group: list[str] | None) -> DataFrame:
    """Cumulative positives/negatives with score >= s (descending score order)."""
    keys = list(group or [])
    t = st.withColumn("_neg_score", -F.col("score"))
    if not keys:
        t = t.withColumn("_all", F.lit(0))
        keys = ["_all"]
    out = ordered_scan(t, keys, ["_neg_score"], None, sums={"tp": "pos", "fp": "neg"})
    return out.drop("_neg_score")


def average_precision(df: DataFrame | None, score, label, group: list[str] | None = None,
                      table: DataFrame | None = None) -> DataFrame:
    """AP = sum over distinct thresholds (descending) of (R_k - R_{k-1}) * P_k.

    ``table``: a ready ``score_table`` instead of the rows.
    """
    st = table if table is not None else score_table(df, score, label, group)
    sc = _desc_scan(st, group)
    keys = list(group or []) or ["_all"]
    tot = sc.groupBy(*keys).agg(F.sum("pos").alias("_P"))
    j = sc.join(tot, keys)
    contrib = F.when(F.col("_P") > 0, (F.col("pos") / F.col("_P")) * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    out = j.groupBy(*keys).agg(F.sum(contrib).alias("average_precision"))
    return out.drop("_all") if not group else out


def roc_auc(df: DataFrame | None, score, label, group: list[str] | None = None,
            table: DataFrame | None = None) -> DataFrame:
    """Mann-Whitney AUC with ties counted one half; ``table`` as in ``average_precision``."""
    st = table if table is not None else score_table(df, score, label, group)
    sc = _desc_scan(st, group)  # fp = negatives with score >= s
    keys = list(group or []) or ["_all"]
    tot = sc.groupBy(*keys).agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    j = sc.join(tot, keys)
    below = F.col("_N") - F.col("fp")  # negatives strictly below s
    out = j.groupBy(*keys).agg(
        (F.sum(F.col("pos") * (below + 0.5 * F.col("neg"))) / (F.max("_P") * F.max("_N"))).alias("roc_auc"))
    return out.drop("_all") if not group else out


def areas(table: DataFrame) -> DataFrame:
    """``average_precision`` and ``roc_auc`` of a ``score_table`` in one row, from one ordered scan.

    The totals are plain factors, so one aggregate over the scan gives them with the sums; a table
    without scores has no row.
    """
    pos, neg, tp, fp = (F.col(c) for c in ("pos", "neg", "tp", "fp"))
    # sum of pos * (N - fp + neg / 2) = N * P - sum of pos * (fp - neg / 2)
    sums = _desc_scan(table, None).groupBy("_all").agg(
        F.sum("pos").alias("_P"), F.sum("neg").alias("_N"), F.sum(pos.cast("double") * tp / (tp + fp)).alias("_ap"),
        F.sum(pos * (fp - 0.5 * neg)).alias("_above"))
    p, n = F.col("_P"), F.col("_N")
    return sums.select(F.when(p > 0, F.col("_ap") / p).alias("average_precision"),
                       ((n.cast("double") * p - F.col("_above")) / (p.cast("double") * n)).alias("roc_auc"))


def prf_at(table: DataFrame, threshold: float) -> DataFrame:
    """Row metrics at score > threshold from a ``score_table``: one row like ``row_prf``."""
    hit = F.col("score") > threshold
    at = lambda take, c: F.coalesce(F.sum(F.when(take, F.col(c))), F.lit(0))
    out = table.agg(at(hit, "pos").alias("tp"), at(hit, "neg").alias("fp"), at(~hit, "pos").alias("fn"),
                    F.coalesce(F.sum(F.col("pos") + F.col("neg")), F.lit(0)).alias("rows"))
    return out.select("*", *_prf(F.col("tp"), F.col("fp"), F.col("fn")))


def pr_curve(df: DataFrame, score, label, group: list[str] | None = None) -> DataFrame:
    """(group..., threshold, precision, recall) at every distinct score (predict score >= t)."""
    st = score_table(df, score, label, group)
    sc = _desc_scan(st, group)
    keys = list(group or []) or ["_all"]
    tot = sc.groupBy(*keys).agg(F.sum("pos").alias("_P"))
    j = sc.join(tot, keys).select(
        *keys, F.col("score").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.when(F.col("_P") > 0, F.col("tp") / F.col("_P")).otherwise(F.lit(0.0)).alias("recall"))
    return j.drop("_all") if not group else j


def best_f1(df: DataFrame, score, label, eps: float = 1e-6, group: list[str] | None = None) -> DataFrame:
    """Max F1 = 2PR/(P+R+eps) along the PR curve and its threshold (lowest on ties)."""
    c = pr_curve(df, score, label, group)
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + eps)
    c = c.withColumn("f1", f1)
    keys = list(group or [])
    return c.groupBy(*keys).agg(F.max("f1").alias("best_f1"),
                                F.min_by("threshold", F.struct(-F.col("f1"), F.col("threshold"))).alias("best_threshold"))


def threshold_search(df: DataFrame, score, label, group: list[str] | None = None) -> DataFrame:
    """Probability cut (predict score >= t) with the highest exact row-level F1."""
    c = pr_curve(df, score, label, group)
    p, r = F.col("precision"), F.col("recall")
    c = c.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)))
    keys = list(group or [])
    return c.groupBy(*keys).agg(F.max("f1").alias("f1"),
                                F.min_by("threshold", F.struct(-F.col("f1"), F.col("threshold"))).alias("threshold"))


def max_prob_per_row(df: DataFrame, row_id: str, prob: str, target: str, threshold: float = 0.5) -> DataFrame:
    """Overlapping groups: max probability and first target per row, then P/R/F1 at prob > threshold."""
    per = df.groupBy(row_id).agg(F.max(prob).alias("prob"), F.min(target).alias("target"))
    return row_prf(per, F.col("target"), F.col("prob") > threshold)


def calibration(df: DataFrame, prob: str = "pred_prob", label: str = "isRecurring",
                result_type: str = "result_type") -> DataFrame:
    """Decile bins (a, b] of the probability (0 and values outside (0, 1] are unbinned):
    count and mean confidence per bin."""
    edges = F.array(*[F.lit(i / 10) for i in range(11)])
    p = F.col(prob)
    b = F.size(F.filter(edges, lambda e: e < p)) - 1
    b = F.when((p > 0) & (p <= 1), b)
    return (df.withColumn("prob_bin", b).filter(F.col("prob_bin").isNotNull())
              .groupBy("prob_bin").agg(F.count(F.lit(1)).alias("count"), F.avg(prob).alias("avg_conf")))


def calibration_extremes(df: DataFrame, prob: str = "pred_prob", label: str = "isRecurring",
                         result_type: str = "result_type") -> DataFrame:
    """One row: FP/FN totals and high-confidence (>0.9 with label 0, <0.1 with label 1) counts."""
    return df.agg(
        F.count_if(F.col(result_type) == "FP").alias("total_fp"),
        F.count_if(F.col(result_type) == "FN").alias("total_fn"),
        F.count_if((F.col(prob) > 0.9) & (F.col(label) == 0)).alias("high_conf_fp"),
        F.count_if((F.col(prob) < 0.1) & (F.col(label) == 1)).alias("high_conf_fn"))


def class_report(df: DataFrame, y: str, p: str) -> DataFrame:
    """Per class precision/recall/F1/support plus 'accuracy', 'macro avg', 'weighted avg' rows."""
    # one pass over the rows: counts of (true, predicted); everything else reads those
    cells = materialize(df.groupBy(F.col(y).cast("string").alias("y"), F.col(p).cast("string").alias("p")).agg(F.count(F.lit(1)).alias("n")))
    n, same = F.col("n"), F.col("y") == F.col("p")
    side = F.explode(F.array(F.struct(F.col("y").alias("cls"), n.alias("support"), F.lit(0).cast("long").alias("predicted"),
                                      F.when(same, n).otherwise(0).alias("tp")),
                             F.struct(F.col("p").alias("cls"), F.lit(0).cast("long").alias("support"), n.alias("predicted"),
                                      F.lit(0).cast("long").alias("tp")))).alias("s")
    per = cells.select(side).select("s.*").groupBy("cls").agg(*(F.sum(c).alias(c) for c in ("support", "predicted", "tp")))
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    per = per.select("cls", prec.alias("precision"), rec.alias("recall"), "support", "tp")
    per = per.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                      2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                         .otherwise(0.0))
    tot = per.agg(F.sum("support").alias("n"), F.sum("tp").alias("hits"), F.count(F.lit(1)).alias("k"),
                  F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                  F.sum(F.col("precision") * F.col("support")).alias("wp"),
                  F.sum(F.col("recall") * F.col("support")).alias("wr"),
                  F.sum(F.col("f1") * F.col("support")).alias("wf"))
    acc = tot.select(F.lit("accuracy").alias("cls"), (F.col("hits") / F.col("n")).alias("precision"),
                     (F.col("hits") / F.col("n")).alias("recall"), (F.col("hits") / F.col("n")).alias("f1"),
                     F.col("n").alias("support"))
    mac = tot.select(F.lit("macro avg").alias("cls"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                     F.col("mf").alias("f1"), F.col("n").alias("support"))
    wei = tot.select(F.lit("weighted avg").alias("cls"), (F.col("wp") / F.col("n")).alias("precision"),
                     (F.col("wr") / F.col("n")).alias("recall"), (F.col("wf") / F.col("n")).alias("f1"),
                     F.col("n").alias("support"))
    return per.select("cls", "precision", "recall", "f1", "support").unionByName(acc).unionByName(mac).unionByName(wei)


def accuracy(df: DataFrame, y, p) -> DataFrame:
    return df.agg(F.avg((_c(y) == _c(p)).cast("double")).alias("accuracy"))


def macro_ap(long_scores: DataFrame, cls: str, score: str, is_true: str) -> DataFrame:
    """One-vs-rest AP per class averaged; 0 when fewer than two classes occur.

    long_scores: one row per (row, class) with the class score and whether it is the row's class.
    """
    per = average_precision(long_scores, score, is_true, group=[cls])
    present = long_scores.filter(F.col(is_true).cast("boolean")).select(cls).distinct()
    n_cls = present.agg(F.count(F.lit(1)).alias("_k"))
    ap = per.join(present, cls).agg(F.avg("average_precision").alias("_ap"))
    return ap.crossJoin(n_cls).select(F.when(F.col("_k") > 1, F.col("_ap")).otherwise(F.lit(0.0)).alias("macro_ap"))


def bcubed(df: DataFrame, pred: str, true: str) -> DataFrame:
    """B-cubed precision/recall/F1 from contingency counts n(pred, true), no pair join:
    P = sum n^2/|pred| / N, R = sum n^2/|true| / N."""
    # the rows are read once, for the counts
    cont = materialize(df.groupBy(pred, true).agg(F.count(F.lit(1)).alias("n")))
    ps = cont.groupBy(pred).agg(F.sum("n").alias("np"))
    ts = cont.groupBy(true).agg(F.sum("n").alias("nt"))
    j = cont.join(ps, pred).join(ts, true)
    out = j.agg((F.sum(F.col("n") * F.col("n") / F.col("np")) / F.sum("n")).alias("bcubed_precision"),
                (F.sum(F.col("n") * F.col("n") / F.col("nt")) / F.sum("n")).alias("bcubed_recall"))
    p, r = F.col("bcubed_precision"), F.col("bcubed_recall")
    return out.withColumn("bcubed_f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def row_log_loss(df: DataFrame, prob: str, label: str, eps: float = 1e-7) -> DataFrame:
    """Clipped binary log loss per row (adds ``log_loss``)."""
    p = F.least(F.greatest(F.col(prob), F.lit(eps)), F.lit(1 - eps))
    y = F.col(label).cast("double")
    return df.withColumn("log_loss", -(y * F.log(p) + (1 - y) * F.log(1 - p)))


def before_after(df: DataFrame, label, raw_pred, refined_pred) -> DataFrame:
    """P/R/F1 of the raw and refined predictions, their deltas and the FPs removed."""
    y = F.coalesce(_c(label).cast("boolean"), F.lit(False))
    kinds = {"raw": F.coalesce(_c(raw_pred), F.lit(False)), "refined": F.coalesce(_c(refined_pred), F.lit(False))}
    base = df.select(y.alias("_y"), *(p.alias(f"_{k}") for k, p in kinds.items()))
    j = base.agg(*[F.count_if(test).alias(f"{k}_{name}") for k in kinds for name, test in (
        ("tp", F.col("_y") & F.col(f"_{k}")), ("fp", ~F.col("_y") & F.col(f"_{k}")), ("fn", F.col("_y") & ~F.col(f"_{k}")))])
    for k in kinds:
        j = j.select("*", *[c.alias(f"{k}_{m}") for c, m in zip(_prf(*(F.col(f"{k}_{x}") for x in ("tp", "fp", "fn"))), ("precision", "recall", "f1"))])
    return j.select("*", *[(F.col(f"refined_{m}") - F.col(f"raw_{m}")).alias(f"delta_{m}") for m in ("precision", "recall", "f1")],
                    (F.col("raw_fp") - F.col("refined_fp")).alias("fp_removed"))
