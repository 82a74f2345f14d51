"""Group summaries and report aggregates.

Arbitrary groups may be skewed, so medians use ranked positions
(``exact_quantiles``), modes use two partial aggregates, and day gaps use a
position self-join instead of a group-wide window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.operators.ordered import exact_quantiles, ordered_positions, ordered_scan
from cadence.operators.windows import days_between
from cadence.schema import Cols
from cadence.session import materialize, store


def group_mode(df: DataFrame, keys: list[str], col: str, out: str = "mode") -> DataFrame:
    """Most frequent non-null value per group; ties -> smallest value (pandas .mode()[0])."""
    cnt = df.filter(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_c"))
    return cnt.groupBy(*keys).agg(F.min_by(col, F.struct(-F.col("_c"), F.col(col))).alias(out))


def group_gaps(df: DataFrame, keys: list[str], cols: Cols = Cols(), hot_rows: int | None = None) -> DataFrame:
    """(keys, gap) day gaps between consecutive dates of a group.

    Positions come from the skew-aware ranking; each row meets its successor by an
    equi-join on (keys, position), which spreads any group over many tasks.
    """
    p = ordered_positions(df.select(*keys, cols.date, cols.trId), keys, [cols.date, cols.trId], "_gp", hot_rows)
    nxt = p.select(*keys, (F.col("_gp") - 1).alias("_gp"), F.col(cols.date).alias("_next"))
    return p.join(nxt, [*keys, "_gp"]).select(*keys, days_between(F.col(cols.date), F.col("_next")).alias("gap"))


def gap_stats(df: DataFrame, keys: list[str], cols: Cols = Cols(), hot_rows: int | None = None) -> DataFrame:
    """(keys, n_gaps, days_median, days_std) per group with at least one gap."""
    g = group_gaps(df, keys, cols, hot_rows)
    med = exact_quantiles(g, keys, "gap", [0.5], ["days_median"], hot_rows)
    st = g.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_gaps"), F.stddev_samp("gap").alias("days_std"))
    return st.join(med, keys)


def group_candidate_features(rows: DataFrame, keys: list[str], prob: str = "prob", cols: Cols = Cols(),
                             hot_rows: int | None = None) -> DataFrame:
    """Per group: mode text, amount median and CV, cycle median/std, mean prob, size, majority label.

    cycle std is -1 for a single row and 0 with one gap; cycle median is 0 for a single row.
    """
    c = cols
    # four branches read the rows: run the upstream plan once
    rows = store(rows.select(*keys, prob, c.amount, c.text, c.date, c.trId, c.label))
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("size"),
        F.avg(prob).alias("confidence"),
        F.stddev_samp(c.amount).alias("_std"),
        F.avg(F.abs(c.amount)).alias("_mabs"),
        (F.avg(F.col(c.label).cast("double")) > 0.5).cast("int").alias("true_label"))
    med = exact_quantiles(rows, keys, c.amount, [0.5], ["amt_median"], hot_rows)
    mode = group_mode(rows, keys, c.text, "description")
    gs = gap_stats(rows, keys, c, hot_rows)
    out = base.join(med, keys).join(mode, keys, "left").join(gs, keys, "left")
    return out.select(
        *keys, F.coalesce("description", F.lit("Unknown")).alias("description"), "size", "confidence",
        "amt_median",
        F.when(F.col("_mabs") > 1e-3, F.coalesce(F.col("_std"), F.lit(float("nan"))) / F.col("_mabs"))
         .otherwise(F.lit(0.0)).alias("amt_cv"),
        F.when(F.col("size") > 1, F.col("days_median")).otherwise(F.lit(0.0)).alias("days_median"),
        F.when(F.col("size") <= 1, F.lit(-1.0)).when(F.col("n_gaps") == 1, F.lit(0.0))
         .otherwise(F.col("days_std")).alias("days_std"),
        "true_label")


def group_summary(rows: DataFrame, keys: list[str], prob: str = "prob", threshold: float = 0.5,
                  cols: Cols = Cols(), hot_rows: int | None = None) -> DataFrame:
    """Per recurring group: mode description, median amount, median cycle (0 if one row),
    mean confidence, is_recurring = confidence >= threshold."""
    c = cols
    # four branches read the rows: run the upstream plan once
    rows = materialize(rows.select(*keys, prob, c.amount, c.text, c.date, c.trId))
    base = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg(prob).alias("confidence"))
    med = exact_quantiles(rows, keys, c.amount, [0.5], ["amount_stats"], hot_rows)
    mode = group_mode(rows, keys, c.text, "description")
    gs = gap_stats(rows, keys, c, hot_rows).select(*keys, "days_median")
    out = base.join(med, keys).join(mode, keys, "left").join(gs, keys, "left")
    return out.select(
        *keys, F.coalesce("description", F.lit("Unknown")).alias("description"), "amount_stats",
        F.when(F.col("_n") > 1, F.col("days_median")).otherwise(F.lit(0.0)).alias("cycle_days"),
        "confidence", (F.col("confidence") >= threshold).alias("is_recurring"))


def majority_label(rows: DataFrame, keys: list[str], cols: Cols = Cols()) -> DataFrame:
    return rows.groupBy(*keys).agg((F.avg(F.col(cols.label).cast("double")) > 0.5).alias("majority_label"))


def account_vector_mean(vec: DataFrame, key: str = "accountId", col: str = "embedding") -> DataFrame:
    """Long form (key, dim, mean): mean of each vector component per key."""
    return (vec.select(key, F.posexplode(col).alias("dim", "_v"))
               .groupBy(key, "dim").agg(F.avg("_v").alias("mean")))


def class_weight(df: DataFrame, label: str = "isRecurring") -> DataFrame:
    """One row: sqrt(n_neg / max(n_pos, 1))."""
    pos = F.sum(F.col(label).cast("long"))
    neg = F.count(F.lit(1)) - pos
    return df.agg(F.sqrt(neg / F.greatest(pos, F.lit(1))).alias("pos_weight"))


def account_size_scope(df: DataFrame, max_size: int = 200, cols: Cols = Cols()) -> DataFrame:
    """One row: total/large accounts and rows, and the shares above the window size."""
    acc = df.groupBy(cols.accountId).agg(F.count(F.lit(1)).alias("n"))
    return acc.agg(
        F.count(F.lit(1)).alias("total_accounts"),
        F.count_if(F.col("n") > max_size).alias("large_accounts"),
        F.sum("n").alias("total_rows"),
        F.coalesce(F.sum(F.when(F.col("n") > max_size, F.col("n"))), F.lit(0)).alias("large_rows"),
    ).withColumns({
        "large_account_share": F.col("large_accounts") / F.col("total_accounts"),
        "large_row_share": F.col("large_rows") / F.col("total_rows"),
    })


def window_signal(windows: DataFrame, keys: list[str], code: str = "cycle_code") -> DataFrame:
    """Per window: any cycle code > 0; plus overall positive / negative window counts."""
    per = windows.groupBy(*keys).agg(F.bool_or(F.col(code) > 0).alias("has_signal"))
    return per.agg(F.count_if("has_signal").alias("positive_windows"),
                   F.count_if(~F.col("has_signal")).alias("negative_windows"))


def history_length_by_label(df: DataFrame, series: list[str], time_idx: str = "time_idx",
                            label: str = "isRecurring") -> DataFrame:
    """Series length and last label, then mean length per last label."""
    s = df.groupBy(*series).agg(F.count(F.lit(1)).alias("length"), F.max_by(label, time_idx).alias("last_label"))
    return s.groupBy("last_label").agg(F.avg("length").alias("mean_length"), F.count(F.lit(1)).alias("series"))


def rate_by_feature(df: DataFrame, feature, label: str = "isRecurring", name: str = "feature") -> DataFrame:
    return df.groupBy(feature.alias(name) if not isinstance(feature, str) else F.col(feature).alias(name)) \
             .agg(F.avg(F.col(label).cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"))


def describe_groups(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long form (column, count, mean, std, min, q25, q50, q75, max) with exact quartiles."""
    longf = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v"))
                                          for c in columns])).alias("_s")).select("_s.*")
    st = longf.groupBy("column").agg(F.count("v").alias("count"), F.avg("v").alias("mean"),
                                     F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    q = exact_quantiles(longf, ["column"], "v", [0.25, 0.5, 0.75], ["q25", "q50", "q75"])
    return st.join(q, "column").select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def widest_gaps(rows: DataFrame, keys: list[str], cols: Cols = Cols(), hot_rows: int | None = None) -> DataFrame:
    """Per group: max gap between sorted amounts, range, population std, size."""
    a = cols.amount
    p = ordered_scan(rows.select(*keys, a, cols.trId), keys, [a, cols.trId], None, lags={"_pa": a}, hot_rows=hot_rows)
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()  # groups of a null key have no gaps
    return p.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), (F.max(a) - F.min(a)).alias("range"), F.stddev_pop(a).alias("std"),
                                F.coalesce(F.max(F.when(known, F.col(a) - F.col("_pa"))), F.lit(0.0)).alias("max_gap"))
