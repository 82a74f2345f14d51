"""Joins: band pairs, pair features, truth edges, recovery, map-back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.functions.lcs import indel_ratios
from cadence.functions.text import token_sorted
from cadence.operators.features import day_alignment, pair_amount_feats
from cadence.operators.ordered import ordered_positions
from cadence.operators.windows import days_between
from cadence.schema import Cols


# --- token-sort similarity (the one Arrow UDF on the pair path) ------------------

@F.pandas_udf(T.DoubleType())
def _ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(indel_ratios(a.fillna("").tolist(), b.fillna("").tolist()))


def token_sort_ratio(a, b) -> Column:
    """Similarity 0-100 of whitespace-token-sorted strings (case-sensitive), by the Arrow UDF.

    Spark evaluates a Python UDF before any CASE around it: callers filter first
    (see ``scored_text_pairs``).
    """
    return _ratio_udf(token_sorted(a), token_sorted(b))


def ratio_upper_bound(sa, sb) -> Column:
    """Exact prefilter for two token-sorted columns: a common subsequence has at most
    min(count in a, count in b) of each character."""
    sa, sb = (F.col(x) if isinstance(x, str) else x for x in (sa, sb))
    count = lambda x, c: F.length(x) - F.length(F.replace(x, c, F.lit("")))
    chars = F.filter(F.array_distinct(F.split(sa, "")), lambda c: c != "")
    shared = F.aggregate(chars, F.lit(0), lambda n, c: n + F.least(count(sa, c), count(sb, c)))
    total = F.length(sa) + F.length(sb)
    return F.when(total == 0, F.lit(100.0)).otherwise(200.0 * shared / total)


def scored_text_pairs(pairs: DataFrame, t1: str, t2: str, threshold: float = 60.0) -> DataFrame:
    """Pairs whose texts reach ``threshold``, with ``str_score`` computed once per distinct (t1, t2).

    Equal sorted texts score 100 in the JVM; of the others only those that the exact
    length and character-count bounds admit reach the UDF. Pairs below the threshold are dropped.
    """
    from cadence.session import store

    pairs = store(pairs)  # read for the distinct texts and for the scores' way back: the band join runs once
    # sorted once a distinct text pair and stored: the bound reads them once a character
    cand = store(pairs.select(F.col(t1).alias("_a"), F.col(t2).alias("_b")).distinct()
                       .withColumns({"_sa": token_sorted(F.col("_a")), "_sb": token_sorted(F.col("_b"))}))
    equal = F.col("_sa") == F.col("_sb")
    same = cand.filter(equal).select("_a", "_b", F.lit(100.0).alias("str_score"))
    rest = cand.filter(~equal & (2 * F.least(F.length("_sa"), F.length("_sb")) * 100.0 >= threshold * (F.length("_sa") + F.length("_sb"))))
    rest = rest.filter(ratio_upper_bound("_sa", "_sb") >= threshold)
    scored = (same.unionByName(rest.select("_a", "_b", _ratio_udf("_sa", "_sb").alias("str_score")))
              .filter(F.col("str_score") >= threshold))
    return pairs.join(scored, (pairs[t1].eqNullSafe(scored["_a"])) & (pairs[t2].eqNullSafe(scored["_b"]))) \
                .drop("_a", "_b")


# --- band pairs ------------------------------------------------------------------

def candidate_pairs(df: DataFrame, cols: Cols = Cols(), window_size: int = 200,
                    extra: list[str] | None = None, hot_rows: int | None = None) -> DataFrame:
    """Pairs (i, j) of one account with 1 <= pos_j - pos_i <= window_size in (amount, date,
    trId) order whose amounts pass the scan's stop rule: |a_j - a_i| <= 100, and
    <= 10 when |a_i| < 100. (Amounts grow with j, so the reference's early `break`
    is exactly this filter.)

    Band self-join as an equi-join: rows are bucketed by floor(pos / window_size) and
    bucket b meets buckets b and b + 1 — each bucket holds at most window_size rows,
    so no key is hot even for a huge account. Output columns carry suffixes _1 / _2.
    """
    from cadence.session import store

    c = cols
    keep = [c.trId, c.accountId, c.amount, c.date] + [x for x in (extra or []) if x not in (c.trId, c.accountId, c.amount, c.date)]
    p = ordered_positions(df.select(*keep), [c.accountId], [c.amount, c.date, c.trId], "_pos", hot_rows)
    p = store(p)  # both sides of the join read it
    p = p.withColumn("_bkt", F.floor(F.col("_pos") / window_size).cast("long"))
    left = p.select(*[F.col(x).alias(f"{x}_1") for x in keep], F.col("_pos").alias("_p1"),
                    F.col("_bkt").alias("_b"))
    right = p.select(*[F.col(x).alias(f"{x}_2") for x in keep], F.col("_pos").alias("_p2"),
                     F.explode(F.array(F.col("_bkt"), F.col("_bkt") - 1)).alias("_b"))
    j = left.join(right, (left[f"{c.accountId}_1"] == right[f"{c.accountId}_2"]) & (left["_b"] == right["_b"]))
    gap = F.col("_p2") - F.col("_p1")
    diff = F.abs(F.col(f"{c.amount}_1") - F.col(f"{c.amount}_2"))
    ok = (gap >= 1) & (gap <= window_size) & (diff <= 100.0) & ~((diff > 10.0) & (F.abs(F.col(f"{c.amount}_1")) < 100))
    return j.filter(ok).drop("_b", f"{c.accountId}_2").withColumnRenamed(f"{c.accountId}_1", c.accountId)


def pair_features(pairs: DataFrame, cols: Cols = Cols()) -> DataFrame:
    """Amount, day and alignment features of band pairs."""
    c = cols
    a1, a2 = F.col(f"{c.amount}_1"), F.col(f"{c.amount}_2")
    d1, d2 = F.col(f"{c.date}_1"), F.col(f"{c.date}_2")
    feats = pair_amount_feats(a1, a2)
    feats["diff_days"] = days_between(F.least(d1, d2), F.greatest(d1, d2))
    feats["day_align"] = day_alignment(F.dayofmonth(d1), F.dayofmonth(d2))
    return pairs.withColumns(feats)


def pair_label(pairs: DataFrame, cols: Cols = Cols()) -> DataFrame:
    """Training label: same pattern id (noise ids are unique, so they never match)."""
    return pairs.withColumn("is_match", (F.col(f"{cols.patternId}_1") == F.col(f"{cols.patternId}_2")).cast("int"))


def pair_details(pairs: DataFrame, rows: DataFrame, cols: Cols = Cols(), id1: str = "trId_1",
                 id2: str = "trId_2") -> DataFrame:
    """Attach every column of both rows, suffixed _1 / _2 (two equi-joins on the id)."""
    r1 = rows.select(*[F.col(x).alias(f"{x}_1") for x in rows.columns])
    r2 = rows.select(*[F.col(x).alias(f"{x}_2") for x in rows.columns])
    base = pairs.select(id1, id2, *[x for x in pairs.columns if x not in (id1, id2) and not x.endswith(("_1", "_2"))])
    return base.join(r1, id1).join(r2, id2)


def label_errors(pairs: DataFrame, rows: DataFrame, t1: str, t2: str, threshold: float = 0.9, digits: int = 6,
                 cols: Cols = Cols()) -> DataFrame:
    """Pairs of a false label with a probability above ``threshold``: the report for human labellers.

    Adds the text score and both rows' dates, amounts and texts; ``rank`` orders by probability, then
    text score, then ids (positions of a range-partitioned order, no global window).
    """
    from cadence.operators.ordered import global_positions
    from cadence.session import store

    c = cols
    bad = pairs.filter((F.col("is_match") == 0) & (F.round("prob", 9) > threshold)).select(c.accountId, "trId_1", "trId_2", "prob", t1, t2)
    d = scored_text_pairs(bad, t1, t2, 0.0).drop(t1, t2)
    d = store(d.withColumns({"_p": -F.round("prob", 9), "_s": -F.round("str_score", 9)}))
    d = global_positions(d, ["_p", "_s", "trId_1", "trId_2"], "_r")
    d = pair_details(d, rows.select(c.trId, c.date, c.amount, c.text))
    shown = [f"{x}_{k}" for x in (c.date, c.amount, c.text) for k in (1, 2)]
    return d.select((F.col("_r") + 1).alias("rank"), "trId_1", "trId_2", c.accountId, F.round("prob", digits).alias("prob"),
                    F.round("str_score", digits).alias("str_score"), *shown)


def adjacency_truth(windows: DataFrame, keys: list[str], cols: Cols = Cols()) -> DataFrame:
    """True edges (i < j) inside each window: same pattern and not noise.

    Windows are bounded (max_seq_len rows), so the pair explosion per key is bounded.
    """
    c = cols
    r = windows.filter(F.col(c.patternId).isNotNull()).select(*keys, c.trId, c.patternId)
    a = r.select(*keys, F.col(c.trId).alias("trId_1"), F.col(c.patternId).alias("_p"))
    b = r.select(*keys, F.col(c.trId).alias("trId_2"), F.col(c.patternId).alias("_p"))
    return a.join(b, [*keys, "_p"]).filter(F.col("trId_1") < F.col("trId_2")).drop("_p")


# --- map-back and lookups ----------------------------------------------------------

def map_candidates_to_rows(rows: DataFrame, members: DataFrame, group_scores: DataFrame,
                           row_id: str = "trId", group_id: str = "group_id", prob: str = "probability",
                           threshold: float | None = None) -> DataFrame:
    """Group probability onto member rows: max over a row's groups, 0 without any.

    With ``threshold`` also ``predicted`` = best group probability >= threshold.
    """
    best = (members.join(group_scores.select(group_id, prob), group_id)
                   .groupBy(row_id).agg(F.max(prob).alias("_best")))
    out = rows.join(best, row_id, "left").withColumn("score", F.coalesce(F.col("_best"), F.lit(0.0))).drop("_best")
    if threshold is not None:
        out = out.withColumn("predicted", F.col("score") >= threshold)
    return out


def join_patterns(txn: DataFrame, patterns: DataFrame, cols: Cols = Cols()) -> DataFrame:
    """Transactions left-joined with the pattern table on (patternId, bank_name).

    The pattern table is a dimension; AQE broadcasts it when its runtime size is small.
    """
    p = patterns.withColumnRenamed(cols.patternCycle, f"{cols.patternCycle}_pattern")
    return txn.join(p, [cols.patternId, cols.bank_name], "left")


def broadcast_group_scores(rows: DataFrame, scores: DataFrame, group: str, score: str) -> DataFrame:
    """Group score on every member row; rows without a scored group get 0."""
    return rows.join(scores.select(group, score), group, "left").withColumn(score, F.coalesce(F.col(score), F.lit(0.0)))


def attach_predictions(rows: DataFrame, preds: DataFrame, row_id: str = "trId", prob: str = "pred_prob",
                       pred: str = "pred_label") -> DataFrame:
    """Predictions onto the source rows; missing -> probability 0 and label 0."""
    return (rows.join(preds.select(row_id, prob, pred), row_id, "left")
                .withColumn(prob, F.coalesce(F.col(prob), F.lit(0.0)))
                .withColumn(pred, F.coalesce(F.col(pred), F.lit(0))))


def semi_filter(rows: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(allowed.select(*keys).distinct(), keys, "left_semi")


def leakage_check(splits: DataFrame, account: str = "accountId", split: str = "split") -> DataFrame:
    """Accounts present in more than one split (must be empty)."""
    return (splits.groupBy(account).agg(F.count_distinct(split).alias("n_splits"))
                  .filter(F.col("n_splits") > 1))


# --- vectors -----------------------------------------------------------------------

def centroids(vec: DataFrame, group: list[str], col: str = "embedding") -> DataFrame:
    """Mean vector per group: posexplode + avg per (group, dim), re-assembled in dim order."""
    long_ = vec.select(*group, F.posexplode(col).alias("_d", "_v"))
    per = long_.groupBy(*group, "_d").agg(F.avg("_v").alias("_m"))
    return per.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_d", "_m"))).alias("_s")) \
              .select(*group, F.transform("_s", lambda s: s["_m"]).alias("centroid"))


def vector_distance(a, b) -> Column:
    """Euclidean distance of two equal-length arrays (JVM higher-order functions)."""
    sq = F.zip_with(a if not isinstance(a, str) else F.col(a), b if not isinstance(b, str) else F.col(b),
                    lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda acc, x: acc + x))


def recover_missed(rows: DataFrame, groups: DataFrame, account: str = "accountId", row_id: str = "vec_id",
                   vec: str = "embedding", amount: str = "amount", group_id: str = "group_id",
                   distance: float = 2.0, amt_abs: float = 2.0, amt_rel: float = 0.1, hot_rows: int | None = None) -> DataFrame:
    """Unpredicted rows joined to the accepted groups of their account: recovered when
    |amount - group median| < amt_abs or < amt_rel * |median| and the distance to the group centroid
    < ``distance``; the largest group id among matches wins.

    An interval join on the amount first (each group's own half-width), so only rows of a group's
    amount band meet its centroid.

    rows: (account, row_id, vec, amount) of unpredicted rows;
    groups: (account, group_id, centroid, amt_median) of accepted groups.
    """
    j = amount_band_pairs(rows, groups, account, row_id, amount, group_id, amt_abs, amt_rel, hot_rows)
    near = vector_distance(F.col(vec), F.col("centroid")) < distance
    return j.filter(near).groupBy(account, row_id).agg(F.max(group_id).alias("recovered_group"))


def amount_band_pairs(rows: DataFrame, groups: DataFrame, account: str, row_id: str, amount: str, group_id: str,
                      amt_abs: float, amt_rel: float, hot_rows: int | None = None) -> DataFrame:
    """(row, group) pairs of an account whose amount lies strictly within the group's half-width."""
    from cadence.operators.range_join import expand, float_ends, rank_intervals

    m = F.col("amt_median")
    low, high = float_ends(m, F.greatest(F.lit(float(amt_abs)), F.abs(m) * amt_rel),
                           lambda x: (F.abs(x - m) < amt_abs) | (F.abs(x - m) < F.abs(m) * amt_rel))
    bands = groups.select(account, group_id, low.alias("low"), high.alias("high"))
    placed, spans = rank_intervals(rows, bands, [account], amount, row_id, group_id, hot_rows=hot_rows)
    return expand(placed, spans.drop("_top"), [account]).join(groups, [account, group_id])
