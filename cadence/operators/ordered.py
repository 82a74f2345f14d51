"""Skew-aware scans over ordered groups: positions, running sums/maxima, lags.

Most operators of the reference walk the rows of one account in a fixed order
(amount windows, band pairs, islands). A plain ``row_number() over (partition by
account ...)`` puts a whole account in one task; an account may hold a third of
all rows, so groups above ``hot_rows`` take another route:

1. range-partition the hot rows on (keys, order): Spark samples the boundaries and
   spreads one key over many partitions, each a contiguous run of the order;
2. scan locally per (range partition, key) — a hash shuffle whose groups are at
   most one range partition;
3. carry the totals of the earlier ranges of the same key (row count, sums, maxima,
   last values). That carry table has at most (range partitions + hot keys) rows, a
   bound independent of the data, so it is broadcast.

Cold groups keep the single-window plan. Results are exact in both routes; the
order must be total (end it with a unique column).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.session import conf_int, materialize, shuffles_released

HOT_ROWS_CONF = "cadence.skew.hotRows"
DEFAULT_HOT_ROWS = 5_000_000


class Skew(NamedTuple):
    """Keys above the row limit: the keys with their counts, how many, and their rows in all."""

    keys: DataFrame
    n: int
    rows: int
    limit: int


def key_skew(df: DataFrame, keys: list[str], hot_rows: int | None = None) -> Skew:
    """Keys with more than ``hot_rows`` rows (at most rows/hot_rows of them); one aggregate job.

    Scans of the same rows by the same keys can share the answer.
    """
    if hot_rows is None:
        hot_rows = conf_int(df.sparkSession, HOT_ROWS_CONF, DEFAULT_HOT_ROWS)
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    with shuffles_released(df.sparkSession):
        n, total = hot.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    return Skew(hot, n, int(total), hot_rows)


def _ranges(df: DataFrame, keys: list[str], order: list[str], skew: Skew) -> tuple[DataFrame, DataFrame]:
    """(rows of cold keys, rows of hot keys with the number ``_rp`` of their range)."""
    spark = df.sparkSession
    hot_b = F.broadcast(skew.keys.select(*keys).withColumn("_hot", F.lit(True)))  # <= rows / hot_rows keys
    # both routes and the carry table read the input: materialise it once (also keeps
    # nested scans from multiplying the plan)
    tagged = materialize(df.join(hot_b, keys, "left"))
    # ranges of about hot_rows/4 rows each, at least a few per core
    n_parts = max(spark.sparkContext.defaultParallelism * 2, -(-skew.rows // max(1, skew.limit // 4)))
    # the range number is fixed by the checkpoint: the local scan and the carry table below need
    # different columns, and an exchange of their own each would sample boundaries of its own
    ranged = materialize(tagged.filter(F.col("_hot")).drop("_hot").repartitionByRange(n_parts, *keys, *order)
                         .withColumn("_rp", F.spark_partition_id()))
    return tagged.filter(F.col("_hot").isNull()).drop("_hot"), ranged


def ordered_scan(df: DataFrame, keys: list[str], order: list[str], pos_col: str | None = "_pos",
                 sums: dict | None = None, maxes: dict | None = None, lags: dict | None = None,
                 hot_rows: int | None = None, check_skew: bool = True, skew: Skew | None = None) -> DataFrame:
    """Add per-group scan columns under ``order`` (column names):

    pos_col: 0-based position; sums[out] = running sum of a column (inclusive);
    maxes[out] = running max over the *earlier* rows (exclusive); lags[out] = previous value.
    ``skew``: a known ``key_skew`` of the same rows and keys.
    """
    sums, maxes, lags = sums or {}, maxes or {}, lags or {}
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)

    def cold(d: DataFrame) -> DataFrame:
        cols = {}
        if pos_col:
            cols[pos_col] = F.row_number().over(w) - 1
        for o, c in sums.items():
            cols[o] = F.sum(c).over(upto)
        for o, c in maxes.items():
            cols[o] = F.max(c).over(before)
        for o, c in lags.items():
            cols[o] = F.lag(c).over(w)
        return d.withColumns(cols)

    if not check_skew:
        return cold(df)
    skew = skew or key_skew(df, keys, hot_rows)
    if skew.n == 0:
        return cold(df)

    cold_rows, ranged = _ranges(df, keys, order, skew)
    cold_part = cold(cold_rows)
    wl = Window.partitionBy(*keys, "_rp").orderBy(*order)
    wl_upto = wl.rowsBetween(Window.unboundedPreceding, 0)
    wl_before = wl.rowsBetween(Window.unboundedPreceding, -1)
    loc = {"_lpos": F.row_number().over(wl) - 1}
    for o, c in sums.items():
        loc[f"_ls_{o}"] = F.sum(c).over(wl_upto)
    for o, c in maxes.items():
        loc[f"_lm_{o}"] = F.max(c).over(wl_before)
    for o, c in lags.items():
        loc[f"_ll_{o}"] = F.lag(c).over(wl)
    local = ranged.withColumns(loc)

    order_key = F.struct(*order)
    per_aggs = [F.count(F.lit(1)).alias("_sz")]
    per_aggs += [F.sum(c).alias(f"_ts_{o}") for o, c in sums.items()]
    per_aggs += [F.max(c).alias(f"_tm_{o}") for o, c in maxes.items()]
    per_aggs += [F.max_by(c, order_key).alias(f"_tl_{o}") for o, c in lags.items()]
    per = local.groupBy(*keys, "_rp").agg(*per_aggs)
    wr = Window.partitionBy(*keys).orderBy("_rp")
    wr_before = wr.rowsBetween(Window.unboundedPreceding, -1)
    carry = {"_shift": F.coalesce(F.sum("_sz").over(wr_before), F.lit(0))}
    carry.update({f"_cs_{o}": F.sum(f"_ts_{o}").over(wr_before) for o in sums})
    carry.update({f"_cm_{o}": F.max(f"_tm_{o}").over(wr_before) for o in maxes})
    carry.update({f"_cl_{o}": F.lag(f"_tl_{o}").over(wr) for o in lags})
    shift = per.withColumns(carry).select(*keys, "_rp", *carry.keys())

    # bounded: one row per (range partition, hot key) pair present
    j = local.join(F.broadcast(shift), [*keys, "_rp"])
    out = {}
    if pos_col:
        out[pos_col] = F.col("_lpos") + F.col("_shift")
    for o in sums:
        out[o] = F.col(f"_ls_{o}") + F.coalesce(F.col(f"_cs_{o}"), F.lit(0))
    for o in maxes:
        out[o] = F.greatest(F.col(f"_lm_{o}"), F.col(f"_cm_{o}"))
    for o in lags:
        out[o] = F.when(F.col("_lpos") == 0, F.col(f"_cl_{o}")).otherwise(F.col(f"_ll_{o}"))
    hot_out = j.withColumns(out).select(*cold_part.columns)
    return cold_part.unionByName(hot_out)


def bounded_frames(df: DataFrame, keys: list[str], order: list[str], frames: dict, back: int, ahead: int = 0,
                   hot_rows: int | None = None) -> DataFrame:
    """Window columns whose frames reach at most ``back`` rows before and ``ahead`` rows after a row.

    ``frames[name]`` builds a column from an ordered window. Hot keys are range-partitioned as in
    ``ordered_scan``; each range hands its first ``ahead`` and last ``back`` rows to the ranges that
    can see them (a halo), so every frame is complete inside its own range and no task holds a
    whole key. Halos hold at most (back + ahead) rows for each pair of neighbouring ranges.
    """
    columns = df.columns

    def framed(rows: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order)
        return rows.withColumns({name: fn(w) for name, fn in frames.items()})

    skew = key_skew(df, keys, hot_rows)
    if skew.n == 0:
        return framed(df, keys)
    cold, ranged = _ranges(df, keys, order, skew)
    local = ranged.withColumn("_lpos", F.row_number().over(Window.partitionBy(*keys, "_rp").orderBy(*order)) - 1)
    sizes = ranged.groupBy(*keys, "_rp").agg(F.count(F.lit(1)).alias("_sz"))
    end = F.sum("_sz").over(Window.partitionBy(*keys).orderBy("_rp"))  # a row a range of the key
    bounds = sizes.withColumn("_end", end).withColumn("_start", F.col("_end") - F.col("_sz"))
    # bounded: one row per (range partition, hot key) pair present
    placed = local.join(F.broadcast(bounds), [*keys, "_rp"])
    at = F.col("_start") + F.col("_lpos")
    edge = (placed.filter((F.col("_lpos") < ahead) | (F.col("_lpos") >= F.col("_sz") - back))
            .select(*columns, F.col("_rp").alias("_from"), at.alias("_at")))
    sees = (((F.col("_at") >= F.col("_start") - back) & (F.col("_at") < F.col("_start")))
            | ((F.col("_at") >= F.col("_end")) & (F.col("_at") < F.col("_end") + ahead)))
    halo = (edge.join(F.broadcast(bounds.drop("_sz")), keys).filter(sees & (F.col("_rp") != F.col("_from")))
            .select(*columns, "_rp", F.lit(False).alias("_own")))
    both = ranged.select(*columns, "_rp", F.lit(True).alias("_own")).unionByName(halo)
    out = framed(both, [*keys, "_rp"]).filter("_own").drop("_own", "_rp")
    return framed(cold, keys).unionByName(out)


def ordered_positions(df: DataFrame, keys: list[str], order: list[str], pos_col: str = "_pos",
                      hot_rows: int | None = None, check_skew: bool = True) -> DataFrame:
    """Add ``pos_col``: 0-based position of the row inside its key under ``order``."""
    return ordered_scan(df, keys, order, pos_col, hot_rows=hot_rows, check_skew=check_skew)


def global_positions(df: DataFrame, order: list[str], pos_col: str = "_gpos", hot_rows: int | None = None) -> DataFrame:
    """0-based position over the whole table (range-partitioned once it is large)."""
    return ordered_positions(df.withColumn("_all", F.lit(0)), ["_all"], order, pos_col, hot_rows).drop("_all")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float],
                    names: list[str] | None = None, hot_rows: int | None = None) -> DataFrame:
    """Linear-interpolated quantiles per key group (pandas/numpy 'linear' rule).

    Computed from ranked positions (skew-aware) instead of a per-group value map, so
    a key holding a third of the table never has to fit one task. Empty -> no row.
    """
    names = names or [f"q{int(round(q * 100))}" for q in qs]
    base = df.filter(F.col(value).isNotNull())
    if not keys:
        base = base.withColumn("_all", F.lit(0))
        keys_ = ["_all"]
    else:
        keys_ = list(keys)
    ranked = ordered_positions(base.select(*keys_, value), keys_, [value], "_qp", hot_rows)
    n = base.groupBy(*keys_).agg(F.count(F.lit(1)).alias("_qn"))
    r = ranked.join(n, keys_)
    aggs, need = [], None
    for q, nm in zip(qs, names):
        p = F.lit(q) * (F.col("_qn") - 1)
        lo, hi = F.floor(p), F.ceil(p)
        aggs.append(F.max(F.when(F.col("_qp") == lo, F.col(value))).alias(f"_{nm}_lo"))
        aggs.append(F.max(F.when(F.col("_qp") == hi, F.col(value))).alias(f"_{nm}_hi"))
        aggs.append(F.max(p - lo).alias(f"_{nm}_f"))
        cond = (F.col("_qp") == lo) | (F.col("_qp") == hi)
        need = cond if need is None else (need | cond)
    # only the (at most 2 per quantile) rows at the needed positions survive the filter
    out = r.filter(need).groupBy(*keys_).agg(*aggs)
    out = out.select(*keys_, *[
        (F.col(f"_{nm}_lo") + (F.col(f"_{nm}_hi") - F.col(f"_{nm}_lo")) * F.col(f"_{nm}_f")).alias(nm)
        for nm in names])
    return out.drop("_all") if not keys else out
