"""Grouping, gates and amount splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.operators.components import connected_components
from cadence.operators.density import density_groups  # noqa: F401
from cadence.operators.features import simple_cycle
from cadence.operators.ordered import ordered_scan
from cadence.operators.split import split_segments  # noqa: F401
from cadence.operators.summaries import gap_stats, group_summary
from cadence.schema import Cols


# --- stability, pairwise grouping ----------------------------------------------------

def stability_filter(rows: DataFrame, group: str, cols: Cols = Cols(), keys: list[str] | None = None) -> DataFrame:
    """Groups kept when size >= 2, median day gap >= 4 and, with >= 2 gaps, gap std <= 3
    (median < 20) or <= 5 (otherwise). Returns (keys..., group, kept)."""
    k = [*(keys or []), group]
    g = rows.filter(F.col(group).isNotNull())
    size = g.groupBy(*k).agg(F.count(F.lit(1)).alias("size"))
    gs = gap_stats(g, k, cols)
    j = size.join(gs, k, "left")
    med, std, n = F.col("days_median"), F.coalesce(F.col("days_std"), F.lit(0.0)), F.col("n_gaps")
    tol = F.when(med < 20, 3.0).otherwise(5.0)
    kept = (F.col("size") >= 2) & n.isNotNull() & (F.round(med, 9) >= 4) & ((n < 2) | (F.round(std, 9) <= tol))
    return j.select(*k, F.coalesce(kept, F.lit(False)).alias("kept"))


def pairwise_groups(rows: DataFrame, scored_pairs: DataFrame, cols: Cols = Cols(), match_threshold: float = 0.5,
                    prob: str = "prob") -> DataFrame:
    """Pairs with probability > threshold -> connected components -> stability filter.

    Returns rows with ``pred_group_id`` (smallest trId of the component, NULL when the
    component is a single row or unstable).
    """
    c = cols
    e = scored_pairs.filter(F.col(prob) > match_threshold).select(F.col("trId_1").alias("src"), F.col("trId_2").alias("dst"))
    comp = connected_components(e, node=c.trId, label="_comp")
    # rows without a component, most of them, meet no join by component: that one null key would fill a task
    st = stability_filter(rows.select(c.trId, c.date).join(comp, c.trId), "_comp", c)
    pred = comp.join(st.filter("kept"), "_comp").select(c.trId, F.col("_comp").alias("pred_group_id"))
    return rows.join(pred, c.trId, "left")


# --- gates ---------------------------------------------------------------------------

def cluster_stats(rows: DataFrame, keys: list[str], prob: str = "prob", cols: Cols = Cols()) -> DataFrame:
    """Per cluster: mean/max probability, amount CV, cycle days (median gap, 0 for one row),
    period std (sample std of gaps, 0 with fewer than two gaps)."""
    c = cols
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("size"), F.avg(prob).alias("mean_prob"), F.max(prob).alias("max_prob"),
        F.stddev_samp(c.amount).alias("_sd"), F.avg(F.abs(c.amount)).alias("_mabs"))
    gs = gap_stats(rows, keys, c)
    j = base.join(gs, keys, "left")
    return j.select(*keys, "size", "mean_prob", "max_prob",
                    F.when(F.col("_mabs") > 1e-3, F.col("_sd") / F.col("_mabs")).otherwise(0.0).alias("amt_cv"),
                    F.coalesce(F.col("days_median"), F.lit(0.0)).alias("cycle_days"),
                    F.when(F.col("n_gaps") > 1, F.col("days_std")).otherwise(0.0).alias("period_std"))


GATES_DEFAULT = dict(voting_threshold=0.4, anchoring_threshold=0.85, max_amount_cv=0.2,
                     min_cycle_days=6.0, max_period_std=4.0)
# relaxed preset used by the per-bank experiments
GATES_RELAXED = dict(voting_threshold=0.4, anchoring_threshold=0.85, max_amount_cv=2.0,
                     min_cycle_days=0.9, max_period_std=10.0)


def logic_gates(stats: DataFrame, voting_threshold: float = 0.4, anchoring_threshold: float = 0.85,
                max_amount_cv: float = 0.2, min_cycle_days: float = 6.0, max_period_std: float = 4.0) -> DataFrame:
    """Adds ``accepted``: model vote (mean > voting or max > anchoring) and the physics rules
    (CV <= max, cycle >= min, period std <= max). Statistics rounded to 9 decimals first."""
    r = lambda x: F.round(F.col(x), 9)
    vote = (r("mean_prob") > voting_threshold) | (r("max_prob") > anchoring_threshold)
    phys = ~(F.coalesce(r("amt_cv") > max_amount_cv, F.lit(False))) & (r("cycle_days") >= min_cycle_days) & \
        (r("period_std") <= max_period_std)
    return stats.withColumn("accepted", vote & phys)


def refine_by_cycle(summary: DataFrame, conf_threshold: float = 0.40) -> DataFrame:
    """Groups accepted when confidence > threshold and the cycle is simple; adds ``decision``
    and ``reason`` ('low_conf' / 'bad_cycle' / NULL)."""
    low = ~(F.round("confidence", 9) > conf_threshold)
    bad = ~simple_cycle(F.col("cycle_days"))
    return summary.withColumns({
        "reason": F.when(low, "low_conf").when(bad, "bad_cycle"),
        "decision": (~low & ~bad).cast("int"),
    })


def rejection_counts(decisions: DataFrame) -> DataFrame:
    return decisions.filter(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# --- amount splitting (cuts in operators/split.py) --------------------------------------

def chunk_listing(chunks: DataFrame, keys: list[str], value: str, row_id: str = "trId") -> DataFrame:
    """Per chunk: size, bounds, smallest internal gap, gap to the next chunk."""
    k = [*keys, "chunk"]
    rows = ordered_scan(chunks.select(*k, value, row_id), k, [value, row_id], None, lags={"_prev": value})
    per = rows.groupBy(*k).agg(F.count(F.lit(1)).alias("size"), F.min(value).alias("lo"), F.max(value).alias("hi"),
                               F.min(F.col(value) - F.col("_prev")).alias("min_internal_gap"))
    per = ordered_scan(per.withColumn("_back", -F.col("chunk")), keys, ["_back"], None, lags={"_next": "lo"})
    return per.withColumn("gap_to_next", F.col("_next") - F.col("hi")).drop("_next", "_back")


def broken_patterns(chunks: DataFrame, keys: list[str], pattern: str, value: str, large_accounts: DataFrame) -> DataFrame:
    """Per (account, pattern) in large accounts: broken (spread over > 1 chunk), size,
    range, widest internal gap and population std of the amounts."""
    from cadence.operators.summaries import widest_gaps

    c = chunks.join(large_accounts, keys, "left_semi")
    br = c.groupBy(*keys, pattern).agg((F.count_distinct("chunk") > 1).alias("broken"))
    cols = Cols(amount=value, trId="trId")
    wg = widest_gaps(c.withColumnRenamed(value, value), [*keys, pattern], cols)
    return br.join(wg, [*keys, pattern])


def split_impact(stats: DataFrame, keys: list[str], pattern: str) -> DataFrame:
    """Accounts / groups / rows affected by splitting (groups counted globally)."""
    acc = stats.groupBy(*keys).agg(F.bool_or("broken").alias("acc_broken"))
    return stats.agg(
        F.count_if("broken").alias("broken_groups"),
        F.count_distinct(pattern).alias("large_groups"),
        F.sum(F.when(F.col("broken"), F.col("size")).otherwise(0)).alias("affected_rows"),
        F.sum("size").alias("large_rows"),
    ).crossJoin(acc.agg(F.count_if("acc_broken").alias("broken_accounts"), F.count(F.lit(1)).alias("large_accounts")))
