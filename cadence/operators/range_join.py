"""Interval joins inside key groups by rank, for intervals of any width.

Points and both ends of every interval of a key are put into one order. Running counts turn an
interval into a range of point positions, so its number of members is a difference (no join), and
members are listed by joining blocks of BLOCK positions: a join key holds at most that many points,
whatever the size of the key or of the interval. The scan is skew-aware (``ordered_scan``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.operators.ordered import ordered_scan
from cadence.session import store

BLOCK = 64


def float_ends(center: Column, reach: Column, test) -> tuple[Column, Column]:
    """(lowest, highest) double that a monotone floating-point ``test`` around ``center`` accepts.

    They lie within a few units in the last place of center -+ reach; all those are tried. Null, null if
    the test accepts none.
    """
    def near(x: Column) -> Column:
        unit = F.greatest(F.abs(x), F.abs(center) * 1e-3) * 1.15e-16
        return F.filter(F.array(*[x + unit * k for k in range(-8, 9)]), test)
    return F.array_min(near(center - reach)), F.array_max(near(center + reach))


def rank_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], x: str, point_id: str, interval_id: str,
                   low: str = "low", high: str = "high", hot_rows: int | None = None,
                   sums: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(points with ``_pos``, intervals as keys, interval_id, ``_first``, ``_after``, ``_top`` and ``sums``).

    Points of positions [_first, _after) lie in [low, high]; ``_top`` is the largest point up to ``high``.
    ``sums[out]``: an exact number (long or decimal, not null) of each point, summed over an interval's points.
    Positions count by (x, point id); points without x are dropped, intervals without ends too.
    ``interval_id`` must be unique inside a key.
    """
    kind, sums = F.lit, sums or {}
    a = points.filter(F.col(x).isNotNull()).select(
        *points.columns, F.col(x).cast("double").alias("_x"), kind(1).alias("_kind"),
        F.lit(None).cast(intervals.schema[interval_id].dataType).alias("_iv"), *(c.alias(f"_of_{o}") for o, c in sums.items()))
    ends = F.explode(F.array(F.struct(kind(0).alias("_kind"), F.col(low).cast("double").alias("_x")),
                             F.struct(kind(2).alias("_kind"), F.col(high).cast("double").alias("_x")))).alias("_e")
    # ends have the points' columns empty; ends of one place and kind need no order among them
    b = (intervals.select(*keys, F.col(interval_id).alias("_iv"), ends).filter(F.col("_e._x").isNotNull())
         .select(*(F.col(c) if c in keys else F.lit(None).cast(points.schema[c].dataType).alias(c) for c in points.columns), "_e._x", "_e._kind", "_iv",
                 *(F.lit(0).cast(a.schema[f"_of_{o}"].dataType).alias(f"_of_{o}") for o in sums)))
    merged = a.unionByName(b).withColumns({"_one": (F.col("_kind") == 1).cast("long"), "_val": F.when(F.col("_kind") == 1, F.col("_x"))})
    merged = ordered_scan(merged, keys, ["_x", "_kind", point_id], None, sums={"_cnt": "_one", **{o: f"_of_{o}" for o in sums}}, maxes={"_top": "_val"}, hot_rows=hot_rows)
    merged = store(merged.select(*points.columns, "_kind", "_iv", "_cnt", "_top", *sums))
    placed = merged.filter("_kind = 1").select(*points.columns, (F.col("_cnt") - 1).alias("_pos"))
    at = lambda k, c: F.max(F.when(F.col("_kind") == k, F.col(c)))
    spans = (merged.filter("_kind <> 1").groupBy(*keys, F.col("_iv").alias(interval_id))
             .agg(at(0, "_cnt").alias("_first"), at(2, "_cnt").alias("_after"), at(2, "_top").alias("_top"),
                  *((at(2, o) - at(0, o)).alias(o) for o in sums)))
    return placed, spans


def expand(placed: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Every (point, interval) pair of ``rank_intervals``, one row each; empty intervals have none."""
    block = lambda c: F.floor(c / BLOCK).cast("long")
    pieces = (spans.filter("_after > _first")
              .withColumn("_b", F.explode(F.sequence(block(F.col("_first")), block(F.col("_after") - 1)))))
    rows = placed.withColumn("_b", block(F.col("_pos")))
    inside = (F.col("_pos") >= F.col("_first")) & (F.col("_pos") < F.col("_after"))
    return rows.join(pieces, [*keys, "_b"]).filter(inside).drop("_b", "_pos", "_first", "_after")
