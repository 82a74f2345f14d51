"""Lexical detector queries."""

from pyspark.sql import functions as F

from cadence.plans import lexical
from cadence.operators.text_cluster import distinct_texts, text_cluster, tfidf_postings
from cadence.plans.catalog import register
from cadence.plans.sqlfrag import (HEURISTIC, candidate_features_select, days, detector_text,
                                    tfidf_cluster_ctes, windows_cte)
from cadence.schema import Cols
from cadence.session import store
from cadence.sources.fixtures import txn

_R = 6


def _round(df, names):
    return df.select(*[F.round(c, _R).alias(c) if c in names else F.col(c) for c in df.columns])


_FEATS = ["interval_std", "interval_median", "dom_std", "dow_std", "amount_std", "amount_cv",
          "description_length"]


def _rows(spark, sf):
    """The columns that the detector reads; the queries of its groups return no other."""
    return txn(spark, sf).select("accountId", "trId", "date", "amount", "bankRawDescription", "isRecurring")


_EXACT_CLUSTERS = windows_cte() + f""",
texts AS (SELECT *, {detector_text('bankRawDescription')} AS _text FROM wins),
tl AS (SELECT *, avg(length(_text)) OVER (PARTITION BY accountId, win) AS _win_text_len FROM texts),
cl AS (SELECT *, _text AS cluster, count(*) OVER (PARTITION BY accountId, win, _text) AS _csize FROM tl),
mem AS (SELECT * FROM cl WHERE _csize >= 2),
iv AS (SELECT *, {days('lag(date) OVER (PARTITION BY accountId, win, cluster ORDER BY date, trId)', 'date')} AS _ival FROM mem),
cand AS ({candidate_features_select('accountId, win, cluster', 'iv')})"""

_ROUND_SQL = ", ".join(f"round({c}, {_R}) AS {c}" for c in _FEATS)


@register("candidate_features_exact", "WITH " + _EXACT_CLUSTERS + f"""
SELECT accountId, win, cluster, {_ROUND_SQL}, count, days_span, unique_descriptions, label, group_id FROM cand""")
def q_candidate_features_exact(spark, sf):
    cand = lexical.detect_recurring(txn(spark, sf), return_candidates=True, exact_text=True)
    return _round(cand, _FEATS)


@register("detect_recurring_exact", "WITH " + _EXACT_CLUSTERS + f""",
acc AS (SELECT accountId, win, cluster, group_id FROM cand WHERE {HEURISTIC})
SELECT t.trId, a.group_id AS recurring_group_id
FROM txn t LEFT JOIN (SELECT m.trId, acc.group_id FROM mem m JOIN acc USING (accountId, win, cluster)) a
  ON t.trId = a.trId""")
def q_detect_recurring_exact(spark, sf):
    return lexical.detect_recurring(_rows(spark, sf), exact_text=True).select("trId", "recurring_group_id")


def _tfidf_clusters(least: int = 2) -> str:
    return windows_cte(min_rows=least) + f""",
texts AS (SELECT *, {detector_text('bankRawDescription')} AS _text FROM wins),
tl AS (SELECT *, avg(length(_text)) OVER (PARTITION BY accountId, win) AS _win_text_len FROM texts),
""" + tfidf_cluster_ctes(min_samples=least).strip() + f""",
cl AS (SELECT *, count(*) OVER (PARTITION BY accountId, win, cluster) AS _csize FROM clus WHERE cluster IS NOT NULL),
mem AS (SELECT * FROM cl WHERE _csize >= {least}),
iv AS (SELECT *, {days('lag(date) OVER (PARTITION BY accountId, win, cluster ORDER BY date, trId)', 'date')} AS _ival FROM mem),
cand AS ({candidate_features_select('accountId, win, cluster', 'iv')})"""


@register("candidate_features", "WITH RECURSIVE " + _tfidf_clusters() + f"""
SELECT accountId, win, cluster, {_ROUND_SQL}, count, days_span, unique_descriptions, label, group_id FROM cand""")
def q_candidate_features(spark, sf):
    cand = lexical.detect_recurring(txn(spark, sf), return_candidates=True)
    return _round(cand, _FEATS)


_DETECT = f""",
acc AS (SELECT accountId, win, cluster, group_id FROM cand WHERE {HEURISTIC})
SELECT t.trId, a.group_id AS recurring_group_id
FROM txn t LEFT JOIN (SELECT m.trId, acc.group_id FROM mem m JOIN acc USING (accountId, win, cluster)) a
  ON t.trId = a.trId"""


@register("detect_recurring", "WITH RECURSIVE " + _tfidf_clusters() + _DETECT)
def q_detect_recurring(spark, sf):
    return lexical.detect_recurring(_rows(spark, sf)).select("trId", "recurring_group_id")


@register("detect_recurring_min3", "WITH RECURSIVE " + _tfidf_clusters(3) + _DETECT)
def q_detect_recurring_min3(spark, sf):
    """Clusters of core texts with at least three rows around them."""
    return lexical.detect_recurring(_rows(spark, sf), min_transactions=3).select("trId", "recurring_group_id")


_WIN_TEXTS = windows_cte() + f""",
texts AS (SELECT *, {detector_text('bankRawDescription')} AS _text FROM wins),
tl AS (SELECT *, avg(length(_text)) OVER (PARTITION BY accountId, win) AS _win_text_len FROM texts),
""" + tfidf_cluster_ctes().strip()


def _win_texts(spark, sf):
    c = Cols()
    t = store(txn(spark, sf).select(c.accountId, c.trId, c.date, c.amount, c.text))  # read for sizes and for the windows
    return lexical._windowed(t, c, 200, 2, None)


@register("tfidf_char_wb", "WITH RECURSIVE " + _WIN_TEXTS + """
SELECT accountId, win, _text AS text, gram, round(w, 6) AS w FROM post""")
def q_tfidf_char_wb(spark, sf):
    w = _win_texts(spark, sf)
    post = tfidf_postings(distinct_texts(w, lexical.WIN, "_text"), lexical.WIN, "_text")
    return post.select(*lexical.WIN, F.col("_text").alias("text"), "gram", F.round("w", 6).alias("w"))


@register("text_cluster", "WITH RECURSIVE " + _WIN_TEXTS + """
SELECT trId, cluster FROM clus""")
def q_text_cluster(spark, sf):
    w = _win_texts(spark, sf)
    return text_cluster(w, lexical.WIN, "_text", "bankRawDescription", "trId").select("trId", "cluster")
