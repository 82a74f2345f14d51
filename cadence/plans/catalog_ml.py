"""Model, vector and feature-pipeline queries.

Model outputs depend on the learner, so these are row-count checks; the feature
pipeline has a SQL oracle.
"""

import uuid

from pyspark.sql import functions as F

from cadence.operators import clean as C
from cadence.operators import features as X
from cadence.operators import ml as ML
from cadence.operators import pairs as P
from cadence.operators import sampling as S
from cadence.operators import summaries as SM
from cadence.operators import vectors as V
from cadence.plans import lexical
from cadence.plans.catalog import register
from cadence.plans.sqlfrag import amount_vocab_ctes, char_wb_grams
from cadence.session import checkpoint_dir, materialize, store
from cadence.sources import io
from cadence.sources.fixtures import scored, txn, vectors

R = 6


def _cands(spark, sf):
    """Candidates with their split, stored once: training and scoring read them, the detector runs once."""
    cand = lexical.detect_recurring(txn(spark, sf), return_candidates=True, exact_text=True)
    return store(S.group_split_two(cand, 0.2, 42))


@register("group_classifier")
def q_group_clf(spark, sf):
    c = _cands(spark, sf)
    m = ML.group_classifier(c.filter("split = 'train'"), max_iter=20)
    return ML.batch_scoring(m, c.filter("split = 'test'"), fill=ML.GROUP_FEATURES).select("group_id", "probability")


@register("batch_scoring")
def q_batch(spark, sf):
    c = _cands(spark, sf)
    m = ML.group_classifier(c.filter("split = 'train'"), max_iter=10)
    s = ML.batch_scoring(m, c, fill=ML.GROUP_FEATURES)
    return s.select("group_id", "split", "probability", (F.col("probability") >= 0.5).alias("selected"))


_GF = ["size", "confidence", "amt_median", "amt_cv", "days_median", "days_std"]


@register("group_classifier_rf")
def q_group_rf(spark, sf):
    """Scores of every (account, counterparty) group, with the importance of each feature beside them."""
    g = store(SM.group_candidate_features(scored(spark, sf), ["accountId", "counter_party"]))
    m = ML.group_classifier_rf(g, _GF, "true_label")
    imp = ML.feature_importances(m, _GF).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "feature", F.round("importance", 4)))), ",").alias("importances"))
    p = ML.batch_scoring(m, g, fill=_GF).select("accountId", "counter_party", "true_label", "probability")
    return p.crossJoin(F.broadcast(imp))  # one row


def _pairs_labeled(spark, sf):
    t = C.noise_pattern_ids(C.with_pair_text(txn(spark, sf)))
    p = P.pair_features(P.candidate_pairs(t, extra=["clean_text", "patternId", "has_keyword"]))
    p = P.scored_text_pairs(p, "clean_text_1", "clean_text_2", 60.0).filter(F.col("str_score") >= 60.0)
    p = P.pair_label(p).withColumn("keyword_score", F.col("has_keyword_1") + F.col("has_keyword_2"))
    return S.pair_holdout(p, 0.2, 42)


@register("pair_match_classifier")
def q_pair_clf(spark, sf):
    """Average precision on held-out pairs and violations of the order on probes: the monotone model and its free twin."""
    from cadence.operators.boosting import order_violations
    from cadence.operators.metrics import average_precision

    p = store(_pairs_labeled(spark, sf).select("holdout", "is_match", *ML.PAIR_FEATURES_EXT))
    ens = ML.pair_match_classifier(p.filter("NOT holdout"), max_depth=5, step_size=0.1, max_iter=15, with_free=True)
    parts = [average_precision(ens.predict(p.filter("holdout"), model=k), "probability", "is_match")
             .withColumns({"model": F.lit(name), "violations": F.lit(order_violations(ens, k, ML.PAIR_ORDER))})
             for k, name in enumerate(("monotone", "free"))]
    return parts[0].unionByName(parts[1])


_ROWF = ["day_of_week_sin", "day_of_week_cos", "day_of_month_sin", "day_of_month_cos",
         "day_of_14_cycle_sin", "day_of_14_cycle_cos", "log_abs_amount"]


@register("row_classifier")
def q_row_clf(spark, sf):
    from pyspark.ml.functions import array_to_vector
    t = S.group_split_two(X.log_abs_amount(X.cyclical_dates(txn(spark, sf))), 0.2, 42)
    tv = V.text_vectors(t, "bankRawDescription", dim=16).withColumn("tv", array_to_vector("vec"))
    # the iterative learner scans its input many times: store the features once
    tv = store(tv.select("trId", "split", "isRecurring", "tv", *_ROWF))
    m = ML.row_classifier(tv.filter("split = 'train'"), _ROWF, vector_col="tv", max_iter=20)
    return ML.batch_scoring(m, tv.filter("split = 'test'")).select("trId", "probability")


@register("param_search")
def q_param_search(spark, sf):
    c = _cands(spark, sf).filter("split = 'train'")
    return ML.param_search(c, ML.GROUP_FEATURES, "label", n=8, folds=2, rungs=(3, 6, 12))


@register("permutation_importance")
def q_perm(spark, sf):
    c = _cands(spark, sf)
    feats = ["interval_std", "amount_cv", "count"]
    m = ML.group_classifier(c.filter("split = 'train'"), feats, max_iter=10)
    return ML.permutation_importance(m, c.filter("split = 'test'"), feats, "label", "group_id", repeats=3)


@register("per_bank_models")
def q_per_bank(spark, sf):
    """A model for every bank with enough rows, all fitted together; metrics in one aggregate."""
    from cadence.operators.metrics import row_prf

    t = S.group_split_two(X.log_abs_amount(X.cyclical_dates(txn(spark, sf))), 0.2, 42)
    t = materialize(t.select("bank_name", "split", "isRecurring", *_ROWF))
    sizes = t.groupBy("bank_name").agg(F.count(F.lit(1)).alias("n")).filter("n >= 1000")
    coef = ML.grouped_logistic(t.filter("split = 'train'").join(sizes.select("bank_name"), "bank_name", "left_semi"),
                               "bank_name", _ROWF, "isRecurring")
    p = ML.score_grouped(t.filter("split = 'test'"), coef, "bank_name", _ROWF)
    return row_prf(p, "isRecurring", F.round("probability", 9) > 0.5, group=["bank_name"])


def _vector_sql(dim: int, src: str) -> str:
    """CTE vec (text, vec): md5 buckets of character n-grams of the padded words, scaled to length one."""
    return f"""
dt AS (SELECT DISTINCT text FROM {src}),
wd AS (SELECT text, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS w FROM dt),
gr AS (SELECT text, unnest({char_wb_grams('w')}) AS g FROM wd),
bk AS (SELECT text, ('0x' || substr(md5(g), 1, 8))::BIGINT % {dim} AS b, count(*)::DOUBLE AS c FROM gr GROUP BY ALL),
nm AS (SELECT text, sqrt(sum(c * c)) AS norm FROM bk GROUP BY text),
cell AS (SELECT dt.text, i AS b, coalesce(bk.c / nm.norm, 0.0) AS x FROM dt CROSS JOIN range({dim}) r(i)
         LEFT JOIN bk ON bk.text = dt.text AND bk.b = i LEFT JOIN nm ON nm.text = dt.text),
vec AS (SELECT text, string_agg(CAST(round(x * 10000) AS BIGINT)::VARCHAR, ',' ORDER BY b) AS vec FROM cell GROUP BY text)"""


def _told(vec):
    return F.array_join(F.transform(vec, lambda x: F.round(x * 10000).cast("long").cast("string")), ",")


@register("text_vectors", "WITH t AS (SELECT trId, bankRawDescription AS text FROM txn)," + _vector_sql(64, "t") + """
SELECT trId, vec FROM t JOIN vec USING (text)""")
def q_text_vectors(spark, sf):
    t = txn(spark, sf).select("trId", "bankRawDescription")
    enc = lambda d: V.hashed_ngram_vectors(d, "bankRawDescription", 64, hashing="md5")
    return V.text_vectors(t, "bankRawDescription", encoder=enc).select("trId", _told("vec").alias("vec"))


@register("embedding_cache", "WITH t AS (SELECT trId, accountId, bankRawDescription AS text FROM txn)," + _vector_sql(32, "t") + """,
even AS (SELECT DISTINCT text FROM t WHERE CAST(accountId AS INTEGER) % 2 = 0)
SELECT trId, vec, (SELECT count(*) FROM even) AS encoded_first, (SELECT count(*) FROM dt WHERE text NOT IN (FROM even)) AS encoded_second,
       0::BIGINT AS encoded_third FROM t JOIN vec USING (text)""")
def q_emb_cache(spark, sf):
    """Three runs over a cache on storage: even accounts, all accounts (only new texts are encoded), all again (none)."""
    t = materialize(txn(spark, sf).select("trId", "accountId", F.col("bankRawDescription").alias("text")))
    enc = lambda d: V.hashed_ngram_vectors(d, "text", 32, hashing="md5")
    cache = io.VectorCache(spark, f"{checkpoint_dir(spark).rstrip('/')}/vectors-{uuid.uuid4().hex}", "hashed/md5-32")
    _, first = cache.vectors(t.filter(F.col("accountId").cast("int") % 2 == 0), enc)
    _, second = cache.vectors(t, enc)
    rows, third = cache.vectors(t, enc)
    return rows.select("trId", _told("vec").alias("vec"), F.lit(first).cast("long").alias("encoded_first"),
                       F.lit(second).cast("long").alias("encoded_second"), F.lit(third).cast("long").alias("encoded_third"))


@register("pca_reduce")
def q_pca(spark, sf):
    v = S.group_split_two(vectors(spark, sf), 0.2, 42)
    fitted = V.pca_fit(v.filter("split = 'train'"), "embedding", 16)
    return V.pca_transform(v.filter("split = 'test'").select("vec_id", "embedding"), "embedding", fitted).drop("embedding")


_DOW = "(isodow(date) - 1)"
_C14 = "(((date_diff('day', DATE '2000-01-01', CAST(date AS DATE)) % 14) + 14) % 14)"


_CYCLES = f"""round(sin({_DOW} * (2 * pi() / 7)), {R}) + 0.0 AS day_of_week_sin, round(cos({_DOW} * (2 * pi() / 7)), {R}) + 0.0 AS day_of_week_cos,
  round(sin(dayofmonth(date) * (2 * pi() / 31)), {R}) + 0.0 AS day_of_month_sin, round(cos(dayofmonth(date) * (2 * pi() / 31)), {R}) + 0.0 AS day_of_month_cos,
  round(sin({_C14} * (2 * pi() / 14)), {R}) + 0.0 AS day_of_14_cycle_sin, round(cos({_C14} * (2 * pi() / 14)), {R}) + 0.0 AS day_of_14_cycle_cos"""


@register("assemble_features", f"""
SELECT trId, {_CYCLES}, round(ln(abs(amount) + 1), {R}) AS log_abs_amount, 0.0::DOUBLE AS missing FROM txn""")
def q_assemble(spark, sf):
    """Every component of the assembled vector; a null input counts as 0."""
    from pyspark.ml.functions import vector_to_array

    t = X.log_abs_amount(X.cyclical_dates(txn(spark, sf))).withColumn("missing", F.lit(None).cast("double"))
    names = [*_ROWF, "missing"]
    a = ML.assemble_features(t, names).withColumn("a", vector_to_array("features"))
    return a.select("trId", *[(F.round(F.col("a")[i], R) + 0.0).alias(n) for i, n in enumerate(names)])


_BEHAVIOR = ["acc_stat_txn_freq", "acc_stat_amount_mean", "acc_stat_amount_std", "acc_stat_amount_max", "acc_stat_amount_median",
             "acc_stat_amount_q25", "acc_stat_amount_q75", "acc_stat_amount_iqr", "acc_stat_spike_ratio"]


@register("feature_pipeline", "WITH train AS (SELECT * FROM txn WHERE CAST(accountId AS INTEGER) % 2 = 0)," + amount_vocab_ctes("train") + f""",
s AS (
  SELECT accountId, count(*) / greatest(((epoch_us(max(date)) - epoch_us(min(date))) // 86400000000) + 1, 1) AS acc_stat_txn_freq,
         avg(ln(1 + abs(amount))) AS acc_stat_amount_mean, coalesce(stddev_samp(ln(1 + abs(amount))), 0.0) AS acc_stat_amount_std,
         max(amount) AS acc_stat_amount_max, quantile_cont(amount, 0.5) AS acc_stat_amount_median,
         quantile_cont(amount, 0.25) AS acc_stat_amount_q25, quantile_cont(amount, 0.75) AS acc_stat_amount_q75
  FROM txn GROUP BY accountId),
tok AS (
  SELECT t.trId, CAST(coalesce(tt.token, b.token, 1) AS INTEGER) AS amount_token_id
  FROM (SELECT txn.*, greatest(0, least(len(list_filter(e.edges, lambda x: x < ln(1 + abs(txn.amount)))) - 1, len(e.edges) - 2)) AS bin FROM txn, edges e) t
  LEFT JOIN toptok tt ON t.amount = tt.amount LEFT JOIN bins b ON t.bin = b.bin)
SELECT t.trId, {_CYCLES},
  {_DOW} AS day_of_week_id, dayofmonth(date) - 1 AS day_of_month_id, round(ln(abs(amount) + 1), {R}) AS log_abs_amount,
  CAST(amount > 0 AS INTEGER) AS is_positive, tok.amount_token_id, {", ".join(f"round({c}, {R}) AS {c}" for c in _BEHAVIOR[:7])},
  round(acc_stat_amount_q75 - acc_stat_amount_q25, {R}) AS acc_stat_amount_iqr,
  round(acc_stat_amount_max / CASE WHEN acc_stat_amount_median = 0 THEN 1.0 ELSE acc_stat_amount_median END, {R}) AS acc_stat_spike_ratio
FROM txn t JOIN tok USING (trId) JOIN s USING (accountId)""")
def q_feature_pipeline(spark, sf):
    """All steps; the amount tokens are learned from the accounts of even number and applied to all."""
    t = materialize(txn(spark, sf).select("trId", "accountId", "date", "amount"))  # no step reads another column
    fp = X.FeatureSteps([X.date_cycles(), X.date_ids(), X.log_amount(with_sign=True), X.amount_token(20, 20), X.behavior()])
    out = fp.learned(t.filter(F.col("accountId").cast("int") % 2 == 0)).add_to(t)
    return out.select("trId", *[F.round(c, R).alias(c) if out.schema[c].dataType.simpleString() == "double" else F.col(c)
                                for c in fp.columns])
