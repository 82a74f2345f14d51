"""Amount splitting: recursive cuts of a sorted order at its widest gaps, without a round per depth.

A segment of more than ``max_size`` rows is cut after its best gap. Recursion depth can grow with
the rows (amounts in geometric steps cut off one end again and again), so levels are not what is
distributed here. Positions are computed once; what decides a cut are the candidate gaps only:

- a key group with at most ``local`` candidates is solved whole inside one task, to any depth, by
  range-maximum look-ups over its sorted candidates;
- a larger one is cut by many gaps a round: of each segment the ``local`` best candidates go to one
  task, which replays the recursion on them. A cut found there is the true one, since every gap left
  out is smaller than all of them. Where more than ``local`` gaps tie as best, the round makes the
  one cut that the tie rule names (nearest to the middle), which halves such a plateau.

So rounds grow with the logarithm of the rows (base ``local`` for mixed gaps, base two for ties); only
a strictly monotone run of more gaps than ``local`` needs a round for each ``local`` of them. Segments
leave the rounds as soon as they are small enough for one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.operators.ordered import ordered_positions, ordered_scan
from cadence.session import conf_int, materialize

LOCAL_CONF = "cadence.split.local"
DEFAULT_LOCAL = 2_000_000  # candidates that one task solves: about 16 bytes each


@dataclass(frozen=True)
class Setting:
    """widest: every gap qualifies and scores by its width. hybrid: gap > abs_t and
    gap / |left amount| > rel_t qualify (|left| <= 1e-9 counts as 1), scored by that ratio."""

    mode: str = "widest"
    abs_t: float = 0.0
    rel_t: float = 0.0


class Ranges:
    """Maxima of ranges and nearest places of a value, by blocks."""

    BLOCK = 512

    def __init__(self, score: np.ndarray):
        self.s = score
        self.top_of = np.maximum.reduceat(score, np.arange(0, len(score), self.BLOCK)) if len(score) else score

    def top(self, a: int, b: int) -> float:
        p, q = -(-a // self.BLOCK), b // self.BLOCK
        if p >= q:
            return self.s[a:b].max()
        best = self.top_of[p:q].max()
        if a < p * self.BLOCK:
            best = max(best, self.s[a:p * self.BLOCK].max())
        if q * self.BLOCK < b:
            best = max(best, self.s[q * self.BLOCK:b].max())
        return best

    def first(self, a: int, b: int, v: float) -> int | None:
        """Smallest index in [a, b) with a score of at least ``v``."""
        while a < b:
            p = a // self.BLOCK
            if a % self.BLOCK == 0:  # whole blocks at once
                hit = np.flatnonzero(self.top_of[p:-(-b // self.BLOCK)] >= v)
                if not len(hit):
                    return None
                p += int(hit[0])
                a = p * self.BLOCK
            end = min(b, (p + 1) * self.BLOCK)
            hit = np.flatnonzero(self.s[a:end] >= v)
            if len(hit):
                return a + int(hit[0])
            a = end
        return None

    def last(self, a: int, b: int, v: float) -> int | None:
        """Largest index in [a, b) with a score of at least ``v``."""
        while a < b:
            p = (b - 1) // self.BLOCK
            if b % self.BLOCK == 0:
                first = a // self.BLOCK
                hit = np.flatnonzero(self.top_of[first:p + 1] >= v)
                if not len(hit):
                    return None
                p = first + int(hit[-1])
                b = (p + 1) * self.BLOCK
            start = max(a, p * self.BLOCK)
            hit = np.flatnonzero(self.s[start:b] >= v)
            if len(hit):
                return start + int(hit[-1])
            b = start
        return None


def valid_range(n, max_size: int, min_size: int):
    """Local gap indices [start, end) at which a segment of n rows may be cut (any, if no cut leaves min_size)."""
    start, end = min_size - 1, n - min_size
    return (start, end) if start < end else (0, n - 1)


def solve(pos: np.ndarray, score: np.ndarray, lo: int, n: int, max_size: int, min_size: int) -> list[int]:
    """Cuts of the segment of n rows from ``lo`` on; a candidate at ``pos`` cuts after that row.

    The best score wins, then the place nearest to the middle, then the earlier one. A segment without
    a candidate stays whole.
    """
    ranges = Ranges(score)
    out, todo = [], [(lo, n)]
    while todo:
        lo, n = todo.pop()
        if n <= max_size:
            continue
        start, end = valid_range(n, max_size, min_size)
        mid = lo + n / 2
        a, m, b = np.searchsorted(pos, (lo + start, mid, lo + end)).tolist()
        if a >= b:
            continue
        v = ranges.top(a, b)
        m = min(max(m, a), b)
        left, right = ranges.last(a, m, v), ranges.first(m, b, v)
        if left is not None and (right is None or mid - pos[left] <= pos[right] - mid):
            cut = int(pos[left])
        else:
            cut = int(pos[right])
        out.append(cut)
        todo.append((lo, cut - lo + 1))
        todo.append((cut + 1, n - (cut - lo + 1)))
    return out


def _by_segment(fn):
    """mapInPandas over rows sorted by (gid, lo, i): calls ``fn`` once a segment, carrying one that a batch cuts.

    Cuts are handed on once a batch: most segments are short, and a frame for each would cost more than its cuts.
    """
    names = ("gid", "lo", "n", "i", "score")

    def run(batches):
        held: list[tuple] = []  # arrays of the segment that may go on

        def close() -> np.ndarray:
            g, lo, n, i, score = (np.concatenate(c) if len(held) > 1 else c[0] for c in zip(*held))
            cuts = np.array(fn(i.astype(np.int64), score.astype(np.float64), int(lo[0]), int(n[0])), dtype=np.int64)
            return np.stack([np.broadcast_to(np.int64(x[0]), len(cuts)) for x in (g, lo, n)] + [cuts])

        def frame(done: list[np.ndarray]) -> pd.DataFrame:
            return pd.DataFrame(dict(zip(names, np.concatenate(done, axis=1))))

        for pdf in batches:
            if pdf.empty:
                continue
            cols, done = [pdf[c].to_numpy() for c in names], []
            edge = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)) + 1
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(pdf)]):
                if held and (held[-1][0][0] != cols[0][a] or held[-1][1][0] != cols[1][a]):
                    done.append(close())
                    held = []
                held.append(tuple(c[a:b] for c in cols))
            if done:
                yield frame(done)
        if held:
            yield frame([close()])
    return run


_SEG = "gid long, lo long, n long, i long"


def _replay(max_size: int, min_size: int, local: int):
    """Recursion on the ``local`` best gaps of a segment, or its single best where they all tie."""
    def fn(pos, score, lo, n):
        if len(pos) <= local:
            return solve(pos, score, lo, n, max_size, min_size)
        above = score > score.min()
        if above.any():
            return solve(pos[above], score[above], lo, n, max_size, min_size)
        far = np.abs(pos - (lo + n / 2))
        return [int(pos[np.lexsort((pos, far))[0]])]
    return fn


def _in_task(cand: DataFrame, fn) -> DataFrame:
    return (cand.select("gid", "lo", "n", "i", "score").repartition("gid", "lo").sortWithinPartitions("gid", "lo", "i")
            .mapInPandas(_by_segment(fn), _SEG))


def _valid(cand: DataFrame, max_size: int, min_size: int) -> DataFrame:
    at, n = F.col("i") - F.col("lo"), F.col("n")
    tight = F.lit(min_size - 1) >= n - min_size
    return cand.filter((n > max_size) & F.when(tight, at < n - 1).otherwise((at >= min_size - 1) & (at < n - min_size)))


def _oversize(cand: DataFrame, local: int) -> DataFrame:
    """Segments with more than ``local`` candidates: few, each holds that many rows."""
    return cand.groupBy("gid", "lo").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > local).select("gid", "lo")


def _rounds(cand: DataFrame, max_size: int, min_size: int, local: int) -> tuple[DataFrame, list[DataFrame]]:
    """(candidates of segments that one task can solve, cuts already made)."""
    ready, cuts = [], []
    # near the ends of a segment no cut is allowed, unless a later segment is too small for two minima
    live = (lambda c: _valid(c, max_size, min_size)) if max_size >= 2 * min_size - 1 else (lambda c: c.filter(F.col("n") > max_size))
    todo = materialize(live(cand))
    while True:
        big = materialize(_oversize(_valid(todo, max_size, min_size), local))
        if big.isEmpty():
            ready.append(todo)
            break
        big = F.broadcast(big)  # at most rows / local segments
        ready.append(todo.join(big, ["gid", "lo"], "left_anti"))
        todo = todo.join(big, ["gid", "lo"], "left_semi")
        far = F.abs(F.col("i") - F.col("lo") - F.col("n") / 2)
        best = ordered_positions(_valid(todo, max_size, min_size).withColumns({"_d": -F.col("score"), "_far": far}),
                                 ["gid", "lo"], ["_d", "_far", "i"], "_r")
        made = materialize(_in_task(best.filter(F.col("_r") <= local), _replay(max_size, min_size, local)))
        cuts.append(made)
        # the new segments of each old one; at most local + 1 of them
        starts = made.select("gid", "lo", "n", (F.col("i") + 1).alias("s")).unionByName(
            made.select("gid", "lo", "n", F.col("lo").alias("s")).distinct())
        after = F.lead("s").over(Window.partitionBy("gid", "lo").orderBy("s"))
        segments = starts.select("gid", "lo", F.col("s").alias("_s"), (F.coalesce(after, F.col("lo") + F.col("n")) - F.col("s")).alias("_n"))
        marked = todo.join(made.select("gid", "lo", "i", (F.col("i") + 1).alias("_cut")), ["gid", "lo", "i"], "left")
        placed = ordered_scan(marked, ["gid", "lo"], ["i"], None, maxes={"_from": "_cut"})
        placed = (placed.filter(F.col("_cut").isNull()).withColumn("_s", F.coalesce("_from", "lo"))
                  .join(segments, ["gid", "lo", "_s"])
                  .select("gid", F.col("_s").alias("lo"), F.col("_n").alias("n"), "i", "score"))
        todo = materialize(live(placed))
    out = ready[0]
    for part in ready[1:]:
        out = out.unionByName(part)
    return out, cuts


def split_positions(placed: DataFrame, keys: list[str], value: str, max_size: int, min_size: int,
                    settings: list[Setting], local: int | None = None) -> DataFrame:
    """Cuts of every key group: (keys..., setting, at), ``at`` the position where the right part starts.

    ``placed`` has the position ``_p`` of each row in its key group and the previous value ``_prev``; it is
    read twice. All settings share the positions.
    """
    local = local or conf_int(placed.sparkSession, LOCAL_CONF, DEFAULT_LOCAL)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("setting"), F.lit(s.mode == "widest").alias("wide"),
                                        F.lit(float(s.abs_t)).alias("a"), F.lit(float(s.rel_t)).alias("r"))
                               for k, s in enumerate(settings)])).alias("s")
    groups = (placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_size)
              .select(*keys, "n", each).select(*keys, "n", "s.*").withColumn("gid", F.monotonically_increasing_id()))
    groups = materialize(groups)
    gap = F.col(value) - F.col("_prev")
    ratio = gap / F.when(F.abs(F.col("_prev")) > 1e-9, F.abs(F.col("_prev"))).otherwise(F.lit(1.0))
    rows = placed.filter(F.col("_p") > 0)
    if all(s.mode != "widest" for s in settings):
        rows = rows.filter((gap > min(s.abs_t for s in settings)) & (ratio > min(s.rel_t for s in settings)))
    cand = (rows.select(*keys, (F.col("_p") - 1).alias("i"), gap.alias("gap"), ratio.alias("ratio"))
            .join(groups, keys).filter(F.col("wide") | ((F.col("gap") > F.col("a")) & (F.col("ratio") > F.col("r"))))
            .select("gid", F.lit(0).cast("long").alias("lo"), "n", "i", F.when(F.col("wide"), F.col("gap")).otherwise(F.col("ratio")).alias("score"))
            .filter(F.col("score").isNotNull() & ~F.isnan("score")))
    small, cuts = _rounds(cand, max_size, min_size, local)
    found = _in_task(small, lambda p, s, lo, n: solve(p, s, lo, n, max_size, min_size))
    for part in cuts:
        found = found.unionByName(part)
    found = found.select("gid", (F.col("i") + 1).alias("at"))
    return materialize(found.join(groups.select("gid", *keys, "setting"), "gid").select(*keys, "setting", "at"))


def place_rows(df: DataFrame, keys: list[str], value: str, row_id: str) -> DataFrame:
    """Positions and previous values by (value, row id); rows with a null key are dropped."""
    kept = df.select(*keys, value, row_id).dropna(subset=keys)
    return materialize(ordered_scan(kept, keys, [value, row_id], "_p", lags={"_prev": value}))


def chunk_columns(placed: DataFrame, keys: list[str], cuts: DataFrame, names: list[str]) -> DataFrame:
    """Rows with the start position of their chunk for each setting, in one scan."""
    marks = cuts.groupBy(*keys, F.col("at").alias("_p")).agg(F.collect_set("setting").alias("_cuts"))
    rows = placed.join(marks, [*keys, "_p"], "left")
    rows = rows.withColumns({f"_m{k}": F.when(F.array_contains("_cuts", k), F.col("_p")) for k in range(len(names))})
    rows = ordered_scan(rows, keys, ["_p"], None, maxes={f"_x{k}": f"_m{k}" for k in range(len(names))})
    start = lambda k: F.coalesce(F.greatest(f"_m{k}", f"_x{k}"), F.lit(0).cast("long"))
    inner = [c for k in range(len(names)) for c in (f"_m{k}", f"_x{k}")]
    return rows.withColumns({name: start(k) for k, name in enumerate(names)}).drop("_cuts", *inner)


def chunk_sizes(placed: DataFrame, keys: list[str], cuts: DataFrame, settings: list[Setting]) -> DataFrame:
    """(keys..., setting, chunk, chunk_size) from the cuts alone."""
    every = F.explode(F.array(*[F.lit(k) for k in range(len(settings))])).alias("setting")
    total = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(*keys, "_n", every)
    starts = cuts.unionByName(total.select(*keys, "setting", F.lit(0).cast("long").alias("at")))
    starts = ordered_scan(starts.withColumn("_back", -F.col("at")), [*keys, "setting"], ["_back"], None, lags={"_next": "at"})
    return (starts.join(total, [*keys, "setting"])
            .select(*keys, "setting", F.col("at").alias("chunk"), (F.coalesce("_next", "_n") - F.col("at")).alias("chunk_size")))


def split_segments(df: DataFrame, keys: list[str], value: str, row_id: str, max_size: int, min_size: int,
                   mode: str = "widest", abs_thresh: float = 0.0, rel_thresh: float = 0.0,
                   local: int | None = None) -> DataFrame:
    """Recursive splitting of sorted values into chunks of at most ``max_size`` rows.

    widest: cut at the widest gap whose sides keep >= min_size (anywhere if impossible);
    ties -> closest to the middle, then the lowest index. hybrid: see ``Setting``; no qualifying
    gap -> left whole. Returns keys, value, row id, chunk (start position of the chunk inside the
    key group) and chunk_size.
    """
    settings = [Setting(mode, abs_thresh, rel_thresh)]
    placed = place_rows(df, keys, value, row_id)
    cuts = split_positions(placed, keys, value, max_size, min_size, settings, local)
    rows = chunk_columns(placed, keys, cuts, ["chunk"])
    sizes = chunk_sizes(placed, keys, cuts, settings).drop("setting")
    return rows.join(sizes, [*keys, "chunk"]).select(*keys, value, row_id, "chunk", "chunk_size")
