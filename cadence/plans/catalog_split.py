"""Amount-splitter queries: Spark cuts against a recursive DuckDB query."""

from pyspark.sql import functions as F

from cadence.operators import groups as G
from cadence.operators import split as S
from cadence.operators.ordered import exact_quantiles
from cadence.plans.catalog import register
from cadence.session import materialize
from cadence.sources.fixtures import txn

MAX_SIZE, MIN_CHUNK, R = 200, 32, 6
GRID = [(a, r) for a in (5.0, 10.0, 20.0) for r in (0.1, 0.2, 0.3, 0.5)]
HYBRID = (5.0, 0.3)


def _segments(src: str, settings: list[tuple[float, float]] | None) -> str:
    """CTEs p (rows with position i) and done (accountId, abs_t, rel_t, lo, hi): the recursion as stated."""
    grid = ", ".join(f"({a}::DOUBLE, {r}::DOUBLE)" for a, r in (settings or [(0.0, 0.0)]))
    score = "gap / CASE WHEN abs(amount) > 1e-9 THEN abs(amount) ELSE 1.0 END" if settings else "gap"
    admitted = "g.gap > s.abs_t AND g.score > s.rel_t" if settings else "g.gap IS NOT NULL"
    n = "(s.hi - s.lo + 1)"
    tight = f"{MIN_CHUNK - 1} >= {n} - {MIN_CHUNK}"
    return f"""
p AS (SELECT *, row_number() OVER (PARTITION BY accountId ORDER BY amount, trId) - 1 AS i FROM {src}),
gap AS (SELECT accountId, i, amount, lead(amount) OVER (PARTITION BY accountId ORDER BY i) - amount AS gap FROM p),
g AS (SELECT accountId, i, gap, {score} AS score FROM gap),
seg AS (
  SELECT accountId, abs_t, rel_t, 0::BIGINT AS lo, max(i) AS hi, 0 AS done FROM p, (VALUES {grid}) t(abs_t, rel_t) GROUP BY ALL
  UNION ALL
  SELECT accountId, abs_t, rel_t, CASE WHEN side = 0 THEN lo ELSE c + 1 END, CASE WHEN side = 0 AND c IS NOT NULL THEN c ELSE hi END,
         CASE WHEN c IS NULL THEN 1 ELSE 0 END
  FROM (SELECT s.*, CASE WHEN {n} > {MAX_SIZE} THEN (
          SELECT arg_min(g.i, (-g.score, abs(g.i - s.lo - {n} / 2.0), g.i)) FROM g
          WHERE g.accountId = s.accountId AND {admitted}
            AND g.i >= s.lo + CASE WHEN {tight} THEN 0 ELSE {MIN_CHUNK - 1} END
            AND g.i < CASE WHEN {tight} THEN s.hi ELSE s.hi + 1 - {MIN_CHUNK} END) END AS c
        FROM seg s WHERE done = 0) t, (VALUES (0), (1)) sides(side)
  WHERE side = 0 OR c IS NOT NULL),
done AS (SELECT * FROM seg WHERE done = 1),
ch AS (SELECT p.*, d.abs_t, d.rel_t, d.lo AS chunk, d.hi - d.lo + 1 AS chunk_size
       FROM p JOIN done d ON p.accountId = d.accountId AND p.i BETWEEN d.lo AND d.hi)"""


_ROWS = "\nSELECT accountId, amount, trId, chunk, chunk_size FROM ch"


@register("split_by_widest_gap", "WITH RECURSIVE " + _segments("txn", None) + _ROWS)
def q_split_widest(spark, sf):
    return S.split_segments(txn(spark, sf), ["accountId"], "amount", "trId", MAX_SIZE, MIN_CHUNK, mode="widest")


@register("split_hybrid", "WITH RECURSIVE " + _segments("txn", [HYBRID]) + _ROWS)
def q_split_hybrid(spark, sf):
    return S.split_segments(txn(spark, sf), ["accountId"], "amount", "trId", MAX_SIZE, MIN_CHUNK, "hybrid", *HYBRID)


@register("chunk_listing", "WITH RECURSIVE " + _segments("txn", None) + f""",
st AS (SELECT *, amount - lag(amount) OVER (PARTITION BY accountId, chunk ORDER BY i) AS step FROM ch),
per AS (SELECT accountId, chunk, count(*) AS size, min(amount) AS lo, max(amount) AS hi, min(step) AS mg FROM st GROUP BY ALL)
SELECT accountId, chunk, size, lo, hi, round(mg, {R}) AS min_internal_gap,
       round(lead(lo) OVER (PARTITION BY accountId ORDER BY chunk) - hi, {R}) AS gap_to_next FROM per""")
def q_chunk_listing(spark, sf):
    d = G.chunk_listing(q_split_widest(spark, sf), ["accountId"], "amount")
    return d.withColumns({c: F.round(c, R) for c in ("min_internal_gap", "gap_to_next")})


def _pattern_rows(spark, sf):
    """Rows of a pattern, and the accounts with more rows than a chunk may hold."""
    t = materialize(txn(spark, sf).select("accountId", "trId", "amount", "patternId"))  # counts, cuts and patterns read it
    big = t.groupBy("accountId").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MAX_SIZE).select("accountId")
    return t.filter(F.col("patternId").isNotNull()), big


def _broken(spark, sf, mode="widest"):
    t, big = _pattern_rows(spark, sf)
    ch = S.split_segments(t, ["accountId"], "amount", "trId", MAX_SIZE, MIN_CHUNK, mode, *HYBRID)
    ch = ch.join(t.select("trId", "patternId"), "trId")
    return G.broken_patterns(ch, ["accountId"], "patternId", "amount", big)


def _broken_sql(settings) -> str:
    return "WITH RECURSIVE " + _segments("(SELECT * FROM txn WHERE patternId IS NOT NULL)", settings) + f""",
large AS (SELECT accountId FROM txn GROUP BY 1 HAVING count(*) > {MAX_SIZE}),
gp AS (SELECT *, lead(amount) OVER (PARTITION BY accountId, patternId ORDER BY amount, trId) - amount AS step
       FROM ch WHERE accountId IN (FROM large)),
st AS (SELECT accountId, patternId, count(DISTINCT chunk) > 1 AS broken, count(*) AS size, max(amount) - min(amount) AS range,
              stddev_pop(amount) AS std, coalesce(max(step), 0.0) AS max_gap FROM gp GROUP BY ALL)"""


@register("broken_patterns", _broken_sql(None) + f"""
SELECT broken, count(*) AS groups, round(avg(max_gap), {R}) AS mean_max_gap, round(avg(range), {R}) AS mean_range,
       round(avg(std), {R}) AS mean_std, round(quantile_cont(max_gap, 0.95), {R}) AS p95_max_gap,
       round(quantile_cont(range, 0.95), {R}) AS p95_range,
       (SELECT round(count(*) FILTER (WHERE broken) / count(*), {R}) FROM st) AS destruction_rate
FROM st GROUP BY broken""")
def q_broken(spark, sf):
    """Destruction rate and broken-vs-intact diagnostics (means and 95th percentiles)."""
    st = materialize(_broken(spark, sf))  # a row a pattern; means, two quantiles and the rate read it
    means = st.groupBy("broken").agg(F.count(F.lit(1)).alias("groups"), F.avg("max_gap").alias("mean_max_gap"),
                                     F.avg("range").alias("mean_range"), F.avg("std").alias("mean_std"))
    p95 = exact_quantiles(st, ["broken"], "max_gap", [0.95], ["p95_max_gap"]).join(
        exact_quantiles(st, ["broken"], "range", [0.95], ["p95_range"]), "broken")
    rate = st.agg((F.count_if("broken") / F.count(F.lit(1))).alias("destruction_rate"))
    out = means.join(p95, "broken", "left").crossJoin(rate)
    return out.select("broken", "groups", *[F.round(c, R).alias(c) for c in out.columns if c not in ("broken", "groups")])


@register("split_impact", _broken_sql([HYBRID]) + """,
acc AS (SELECT accountId, bool_or(broken) AS b FROM st GROUP BY 1)
SELECT count(*) FILTER (WHERE broken) AS broken_groups, count(DISTINCT patternId) AS large_groups,
       sum(CASE WHEN broken THEN size ELSE 0 END)::BIGINT AS affected_rows, sum(size)::BIGINT AS large_rows,
       (SELECT count(*) FILTER (WHERE b) FROM acc) AS broken_accounts, (SELECT count(*) FROM acc) AS large_accounts FROM st""")
def q_impact(spark, sf):
    return G.split_impact(_broken(spark, sf, mode="hybrid"), ["accountId"], "patternId")


@register("tune_split", "WITH RECURSIVE " + _segments(
    f"(SELECT * FROM txn WHERE patternId IS NOT NULL AND accountId IN (SELECT accountId FROM txn GROUP BY 1 HAVING count(*) > {MAX_SIZE}))", GRID) + f""",
pat AS (SELECT abs_t, rel_t, accountId, patternId, count(DISTINCT chunk) > 1 AS broken FROM ch GROUP BY ALL),
dest AS (SELECT abs_t, rel_t, count(*) FILTER (WHERE broken) / count(*) AS dest FROM pat GROUP BY ALL),
res AS (SELECT abs_t, rel_t, count(*) FILTER (WHERE chunk_size <= {MAX_SIZE}) / count(*) AS res FROM ch GROUP BY ALL),
b AS (SELECT *, row_number() OVER (ORDER BY round(dest, 9) > 0.01, -round(res, 9), abs_t, rel_t) = 1 AS best FROM dest JOIN res USING (abs_t, rel_t))
SELECT abs_t, rel_t, round(dest, {R}) AS dest, round(res, {R}) AS res, best FROM b""")
def q_tune(spark, sf):
    """Grid abs {5,10,20} x rel {.1,.2,.3,.5}; best = destruction <= 1 % first, then highest resolution.

    All settings share one pass over positions, and one scan gives every row its chunk under each.
    """
    t, big = _pattern_rows(spark, sf)
    t = t.join(big, "accountId", "left_semi")
    settings = [S.Setting("hybrid", a, r) for a, r in GRID]
    names = [f"c{k}" for k in range(len(GRID))]
    placed = S.place_rows(t, ["accountId"], "amount", "trId")
    cuts = S.split_positions(placed, ["accountId"], "amount", MAX_SIZE, MIN_CHUNK, settings)
    rows = S.chunk_columns(placed, ["accountId"], cuts, names).join(t.select("trId", "patternId"), "trId")
    pat = rows.groupBy("accountId", "patternId").agg(*[(F.min(c) != F.max(c)).alias(c) for c in names])
    dest = pat.agg(*[(F.count_if(c) / F.count(F.lit(1))).alias(c) for c in names])
    res = (S.chunk_sizes(placed, ["accountId"], cuts, settings).groupBy("setting")
           .agg((F.sum(F.when(F.col("chunk_size") <= MAX_SIZE, F.col("chunk_size")).otherwise(0)) / F.sum("chunk_size")).alias("res")))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("setting"), F.lit(a).alias("abs_t"), F.lit(r).alias("rel_t"), F.col(f"c{k}").alias("dest"))
                               for k, (a, r) in enumerate(GRID)])).alias("s")
    out = dest.select(each).select("s.*").join(F.broadcast(res), "setting").drop("setting")  # a row each setting
    order = F.struct(F.round("dest", 9) > 0.01, -F.round("res", 9), F.col("abs_t"), F.col("rel_t"))
    best = out.agg(F.min_by(F.struct("abs_t", "rel_t"), order).alias("b"))
    return out.crossJoin(F.broadcast(best)).select(
        "abs_t", "rel_t", F.round("dest", R).alias("dest"), F.round("res", R).alias("res"),
        ((F.col("abs_t") == F.col("b.abs_t")) & (F.col("rel_t") == F.col("b.rel_t"))).alias("best"))
