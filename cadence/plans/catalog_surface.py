"""Function surface queries: per-value functions, per-group
functions and caller-supplied pipeline steps, all as native expressions."""

from pyspark.sql import functions as F

from cadence.functions import text as T
from cadence.operators.summaries import group_mode
from cadence.plans.catalog import register
from cadence.plans.hooks import run_pipeline
from cadence.plans.sqlfrag import clean_description, keyword
from cadence.sources.fixtures import txn


@register("row_functions", f"""
SELECT trId, {clean_description('bankRawDescription')} AS clean_text,
       {keyword('bankRawDescription')} AS has_keyword,
       length(list_filter(regexp_split_to_array(bankRawDescription, '\\s+'), lambda w: length(w) > 0)) AS n_words
FROM txn""")
def q_row_functions(spark, sf):
    d = F.col("bankRawDescription")
    return txn(spark, sf).select("trId", T.clean_description(d).alias("clean_text"),
                                 T.recurrence_keyword(d).alias("has_keyword"),
                                 F.size(T.words(d)).alias("n_words"))


@register("group_functions", """
WITH cp AS (SELECT accountId, counter_party, count(*) AS c FROM txn WHERE counter_party IS NOT NULL
            GROUP BY accountId, counter_party),
top AS (SELECT accountId, counter_party FROM (
          SELECT *, row_number() OVER (PARTITION BY accountId ORDER BY c DESC, counter_party) AS r FROM cp)
        WHERE r = 1),
ag AS (SELECT accountId, round(avg(amount), 6) AS amount_mean, round(max(amount) - min(amount), 6) AS amount_range
       FROM txn GROUP BY accountId)
SELECT ag.*, top.counter_party AS top_counter_party FROM ag LEFT JOIN top USING (accountId)""")
def q_group_functions(spark, sf):
    t = txn(spark, sf)
    stats = t.groupBy("accountId").agg(
        F.round(F.avg("amount"), 6).alias("amount_mean"),
        F.round(F.max("amount") - F.min("amount"), 6).alias("amount_range"))
    # two partial aggregates (count per value, then min_by): no task holds all distinct
    # values of a hot account, as a single mode() buffer would
    return stats.join(group_mode(t, ["accountId"], "counter_party", "top_counter_party"), "accountId", "left")


@register("pipeline_hooks", """
SELECT accountId, count(*) AS n, round(sum(amount), 6) AS amount_sum, min(date) AS first_date, max(date) AS last_date
FROM txn WHERE NOT coalesce(lower(CAST(isForeignCurrency AS VARCHAR)) = 'true', false) AND status = 'Cleared'
GROUP BY accountId""")
def q_pipeline_hooks(spark, sf):
    return run_pipeline(txn(spark, sf), prepare="cleared_domestic", build="account_summary")
