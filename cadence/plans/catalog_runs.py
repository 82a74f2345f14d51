"""Experiment-run analytics queries over a rule grid evaluated on the data."""

from pyspark.sql import functions as F

from cadence.operators import runs as RN
from cadence.plans import lexical
from cadence.plans.catalog import register
from cadence.plans.catalog_lexical import _EXACT_CLUSTERS
from cadence.session import materialize
from cadence.sources.fixtures import txn

TOL, CV, DOM = [5.0, 10.0, 15.0], [0.1, 0.2, 0.3], [1.5]
R = 6


def _runs(spark, sf):
    cand = lexical.detect_recurring(txn(spark, sf), return_candidates=True, exact_text=True)
    # a record a setting: names, values and trends are read from them, the detector runs once
    return materialize(RN.heuristic_grid_runs(cand, TOL, CV, DOM))


_GRID = "WITH " + _EXACT_CLUSTERS + f""",
grid AS (SELECT * FROM (VALUES {", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for a in TOL for b in CV for c in DOM)}) g(interval_tolerance, amount_cv_threshold, dom_std_threshold)),
x AS (SELECT cand.*, grid.*, CASE WHEN count < 3 THEN round(interval_std, 9) < interval_tolerance AND round(amount_cv, 9) < amount_cv_threshold
             ELSE (round(interval_std, 9) < interval_tolerance OR round(dom_std, 9) < dom_std_threshold OR round(dow_std, 9) < 1.0)
                  AND round(amount_cv, 9) < amount_cv_threshold END AS acc FROM cand, grid),
m AS (SELECT interval_tolerance, amount_cv_threshold, dom_std_threshold,
             count(*) FILTER (WHERE acc AND label) AS tp, count(*) FILTER (WHERE acc AND NOT label) AS fp,
             count(*) FILTER (WHERE NOT acc AND label) AS fn, count(*) FILTER (WHERE acc) AS accepted FROM x GROUP BY ALL),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
              CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM m),
flat AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pr)"""


@register("run_flatten", _GRID + f"""
SELECT interval_tolerance, amount_cv_threshold, dom_std_threshold, round(precision, {R}) AS precision,
       round(recall, {R}) AS recall, round(f1, {R}) AS f1, CAST(accepted AS DOUBLE) AS accepted FROM flat""")
def q_run_flatten(spark, sf):
    f = RN.run_flatten(_runs(spark, sf)).drop("run_id")
    return f.select(*[F.round(c, R).alias(c) if c in ("precision", "recall", "f1") else F.col(c) for c in f.columns])


@register("run_trends", _GRID + f""",
l AS (SELECT f1, 'interval_tolerance' AS param, interval_tolerance AS value FROM flat
      UNION ALL SELECT f1, 'amount_cv_threshold', amount_cv_threshold FROM flat
      UNION ALL SELECT f1, 'dom_std_threshold', dom_std_threshold FROM flat),
v AS (SELECT param FROM l GROUP BY param HAVING count(DISTINCT value) > 1)
SELECT param, value, count(*) AS runs, count(*) FILTER (WHERE f1 < 0.3) AS failures,
       round(count(*) FILTER (WHERE f1 < 0.3) / count(*), {R}) AS failure_rate,
       round(avg(f1) FILTER (WHERE f1 >= 0.3), {R}) AS mean_ok, round(stddev_samp(f1) FILTER (WHERE f1 >= 0.3), {R}) AS std_ok
FROM l WHERE param IN (SELECT param FROM v) GROUP BY param, value""")
def q_run_trends(spark, sf):
    f = RN.run_flatten(_runs(spark, sf))
    t = RN.run_trends(f, ["interval_tolerance", "amount_cv_threshold", "dom_std_threshold"], "f1", 0.3)
    return t.select(*[F.round(c, R).alias(c) if c in ("failure_rate", "mean_ok", "std_ok") else F.col(c) for c in t.columns])
