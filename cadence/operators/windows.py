"""Ordered-row windows: amount chunks, direction chunks, time index, islands, sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.operators.ordered import ordered_positions
from cadence.schema import Cols


def amount_windows(df: DataFrame, cols: Cols = Cols(), size: int = 200, min_rows: int = 2,
                   hot_rows: int | None = None) -> DataFrame:
    """Chunks of ``size`` rows per account in (amount, date, trId) order.

    Adds ``win`` (chunk number) and ``win_rows``; chunks below ``min_rows`` are dropped.
    """
    c = cols
    pos = ordered_positions(df, [c.accountId], [c.amount, c.date, c.trId], "_apos", hot_rows=hot_rows)
    out = pos.withColumn("win", F.floor(F.col("_apos") / size).cast("int")).drop("_apos")
    # a window partition holds at most `size` rows
    out = out.withColumn("win_rows", F.count(F.lit(1)).over(Window.partitionBy(c.accountId, "win")))
    return out.filter(F.col("win_rows") >= min_rows)


def direction_windows(df: DataFrame, cols: Cols = Cols(), max_seq_len: int = 200,
                      hot_rows: int | None = None) -> DataFrame:
    """Per (account, sign) chunks by (amount, date); inside a chunk, ``seq`` orders by date.

    sign = 1 for amount > 0 else -1 (zero counts as negative).
    """
    c = cols
    d = df.withColumn("sign", F.when(F.col(c.amount) > 0, F.lit(1)).otherwise(F.lit(-1)))
    pos = ordered_positions(d, [c.accountId, "sign"], [c.amount, c.date, c.trId], "_dpos", hot_rows=hot_rows)
    pos = pos.withColumn("win", F.floor(F.col("_dpos") / max_seq_len).cast("int")).drop("_dpos")
    w = Window.partitionBy(c.accountId, "sign", "win").orderBy(c.date, c.trId)
    return pos.withColumn("seq", F.row_number().over(w) - 1)


def time_index(df: DataFrame, keys: list[str], cols: Cols = Cols(), hot_rows: int | None = None) -> DataFrame:
    """0-based position by date (ties by trId) inside each key group."""
    return ordered_positions(df, keys, [cols.date, cols.trId], "time_idx", hot_rows=hot_rows)


def date_intervals(df: DataFrame, keys: list[str], cols: Cols = Cols(), hot_rows: int | None = None) -> DataFrame:
    """Whole days since the previous row of the group by date (NULL for the first)."""
    from cadence.operators.ordered import ordered_scan

    d = ordered_scan(df, keys, [cols.date, cols.trId], None, lags={"_prev_date": cols.date}, hot_rows=hot_rows)
    return d.withColumn("interval_days", days_between(F.col("_prev_date"), F.col(cols.date))).drop("_prev_date")


def days_between(a, b):
    """Whole elapsed days from a to b (floor for a <= b), like a floored timedelta."""
    return F.timestamp_diff("DAY", a, b)


def amount_islands(df: DataFrame, cols: Cols = Cols(), gap_abs: float = 1.0, gap_pct: float = 0.05,
                   min_size: int = 2, hot_rows: int | None = None) -> DataFrame:
    """Non-overlapping amount clusters per account (gaps-and-islands).

    A new island starts where the step from the previous amount exceeds both gap_abs
    and gap_pct * |previous amount|. Islands below min_size are dropped. Adds
    ``island`` (number inside the account), ``cluster_seed_amount`` (median amount)
    and ``global_group_id`` = '{account}_amt_{median:.2f}'.
    """
    from cadence.functions.text import group_key
    from cadence.operators.ordered import exact_quantiles, key_skew, ordered_scan
    from cadence.session import materialize

    c = cols
    order = [c.amount, c.trId]
    skew = key_skew(df, [c.accountId], hot_rows)  # both scans walk the same rows of the same keys
    s = ordered_scan(df, [c.accountId], order, None, lags={"_prev": c.amount}, hot_rows=hot_rows, skew=skew)
    step = F.abs(F.col(c.amount) - F.col("_prev"))
    s = s.withColumn("_gap", F.coalesce(((step > gap_abs) & (step > F.abs(F.col("_prev")) * gap_pct)).cast("int"),
                                        F.lit(0)))
    s = ordered_scan(s, [c.accountId], order, None, sums={"island": "_gap"}, hot_rows=hot_rows, skew=skew).drop("_prev", "_gap")
    s = materialize(s)  # sizes, medians and the rows themselves are read from it
    keys = [c.accountId, "island"]
    size = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("_isz")).filter(F.col("_isz") >= min_size)
    med = exact_quantiles(s.join(size.select(*keys), keys, "left_semi"), keys, c.amount, [0.5],
                          ["cluster_seed_amount"], hot_rows)
    med = med.withColumn("global_group_id", group_key(F.col(c.accountId), F.col("cluster_seed_amount")))
    return s.join(size.select(*keys), keys).join(med, keys)


def amount_seed_overlap(df: DataFrame, cols: Cols = Cols(), tol_abs: float = 1.0, tol_pct: float = 0.05,
                        min_bin_size: int = 2, hot_rows: int | None = None, carry: tuple[str, ...] = (),
                        means: dict[str, str] | None = None) -> DataFrame:
    """Overlapping amount groups: every distinct 2-decimal amount of an account is a seed,
    members are rows with |a - s| <= tol_abs or <= tol_pct*|s|; a seed is dropped if its
    member set is inside the set of an earlier kept seed. A row may be in several groups.

    Rank merge, no join before seeds are pruned: a seed's members are an interval of amounts, and its
    member count a difference of positions. Both interval ends grow with the seed, so "subset of an
    earlier set" is "largest member amount <= running max of earlier ones". Only kept seeds are expanded,
    in blocks of positions. Rows without an amount belong to no group.

    ``means[out]``: the mean of a carried column over the group's members (nulls apart), as a difference of
    exact running sums, so that no listed member has to meet its group again. A group with a value that is
    not finite has the mean NaN.
    """
    from cadence.functions.text import group_key
    from cadence.operators.ordered import ordered_scan
    from cadence.operators.range_join import expand, float_ends, rank_intervals
    from cadence.session import store

    c = cols
    rows = store(df.select(c.accountId, c.trId, c.amount, *carry).filter(F.col(c.amount).isNotNull()))
    seeds = rows.select(c.accountId, F.round(c.amount, 2).alias("seed")).distinct()
    seed = F.col("seed")
    low, high = float_ends(seed, F.greatest(F.lit(float(tol_abs)), F.abs(seed) * tol_pct),
                           lambda x: (F.abs(x - seed) <= tol_abs) | (F.abs(x - seed) <= F.abs(seed) * tol_pct))
    sums, mean = {}, {}
    for out, col in (means or {}).items():
        x = F.col(col).cast("double")
        finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e18)
        zero = F.lit(0).cast("decimal(38,18)")
        sums |= {f"_s_{out}": F.coalesce(F.when(finite, x).cast("decimal(38,18)"), zero), f"_n_{out}": x.isNotNull().cast("long"),
                 f"_odd_{out}": (x.isNotNull() & ~finite).cast("long")}
        of = F.col(f"_s_{out}").cast("double") / F.col(f"_n_{out}")
        mean[out] = F.when(F.col(f"_odd_{out}") > 0, F.lit(float("nan"))).when(F.col(f"_n_{out}") > 0, of)
    placed, spans = rank_intervals(rows, seeds.withColumns({"low": low, "high": high}), [c.accountId], c.amount, c.trId, "seed",
                                   hot_rows=hot_rows, sums=sums)
    # read for the sizes of accounts and for the running maximum; the listing of members then starts from stored rows
    per = store(spans.filter(F.col("_after") - F.col("_first") >= min_bin_size))
    per = ordered_scan(per, [c.accountId], ["seed"], None, maxes={"_prev_hi": "_top"}, hot_rows=hot_rows)
    # the key is formatted once per kept seed, not once per (row, seed) membership
    kept = per.filter(F.col("_prev_hi").isNull() | (F.col("_top") > F.col("_prev_hi"))).select(
        c.accountId, "seed", "_first", "_after", group_key(F.col(c.accountId), F.col("seed")).alias("global_group_id"),
        *(m.alias(out) for out, m in mean.items()))
    return expand(placed, kept, [c.accountId]).select(c.accountId, c.trId, c.amount, F.col("seed").alias("cluster_seed_amount"),
                                                      "global_group_id", *carry, *mean)


def sequence_windows(df: DataFrame, series: list[str], fields: list[str], cols: Cols = Cols(),
                     min_len: int = 5, max_len: int = 64, predict: bool = False,
                     time_col: str = "time_idx", hot_rows: int | None = None) -> DataFrame:
    """Encoder windows: for each row with >= min_len earlier rows in its series, the
    array of up to max_len earlier rows (oldest first) plus the target row.

    predict=True keeps only the last row of each series. Frames are bounded by
    max_len, so a long series never builds an unbounded array, and ranges of a split series
    see each other's edges (``bounded_frames``). ``time_col`` must be unique in a series.
    """
    from cadence.operators.ordered import bounded_frames

    frames = {"history": lambda w: F.collect_list(F.struct(*fields)).over(w.rowsBetween(-max_len, -1))}
    if predict:
        frames["_next"] = lambda w: F.lead(F.lit(1)).over(w)
    out = bounded_frames(df, series, [time_col], frames, max_len, 1 if predict else 0, hot_rows)
    out = out.filter(F.size("history") >= min_len)
    return out.filter(F.col("_next").isNull()).drop("_next") if predict else out
