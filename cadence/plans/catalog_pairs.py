"""Join and pair queries."""

from pyspark.sql import functions as F

from cadence.operators import clean as C
from cadence.operators import groups as G
from cadence.operators import metrics as M
from cadence.operators import pairs as P
from cadence.operators import windows as W
from cadence.operators.ordered import exact_quantiles
from cadence.plans.catalog import register
from cadence.session import materialize
from cadence.sources import io
from cadence.sources.fixtures import scored, txn, vectors

R = 6

_PAIRS = """
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY accountId ORDER BY amount, date, trId) - 1 AS pos,
                          CAST(floor(amount / 100) AS BIGINT) AS hundred FROM txn),
near AS (SELECT *, unnest([hundred - 1, hundred, hundred + 1]) AS meet FROM p),  -- amounts at most 100 apart
pairs AS MATERIALIZED (
  SELECT a.accountId, a.trId AS trId_1, b.trId AS trId_2, a.amount AS a1, b.amount AS a2, a.date AS d1, b.date AS d2,
         a.patternId AS pat_1, b.patternId AS pat_2, a.bankRawDescription AS txt_1, b.bankRawDescription AS txt_2
  FROM p a JOIN near b ON a.accountId = b.accountId AND a.hundred = b.meet AND b.pos - a.pos BETWEEN 1 AND 200
  WHERE abs(a.amount - b.amount) <= 100 AND NOT (abs(a.amount - b.amount) > 10 AND abs(a.amount) < 100)),
feats AS (
  SELECT *, abs(a1 - a2) AS diff_amt, abs(a1 - a2) / (greatest(abs(a1), abs(a2)) + 1e-9) AS rel_diff,
         CAST(abs(a1 - a2) < 0.01 AS INTEGER) AS is_exact, CAST(sign(a1) = sign(a2) AS INTEGER) AS sign_match,
         (epoch_us(greatest(d1, d2)) - epoch_us(least(d1, d2))) // 86400000000 AS diff_days,
         1 - least(abs(day(d1) - day(d2)), 30 - abs(day(d1) - day(d2))) / 15 AS day_align
  FROM pairs)"""


def _pairs(spark, sf, extra=None):
    return P.pair_features(P.candidate_pairs(txn(spark, sf), extra=extra))


@register("candidate_pairs", "WITH " + _PAIRS + f"""
SELECT trId_1, trId_2, round(diff_amt, {R}) AS diff_amt, round(rel_diff, {R}) AS rel_diff, is_exact, sign_match,
       diff_days, round(day_align, {R}) AS day_align FROM feats""")
def q_pairs(spark, sf):
    p = _pairs(spark, sf)
    return p.select("trId_1", "trId_2", F.round("diff_amt", R).alias("diff_amt"), F.round("rel_diff", R).alias("rel_diff"),
                    "is_exact", "sign_match", "diff_days", F.round("day_align", R).alias("day_align"))


@register("day_alignment", "WITH " + _PAIRS + f"\nSELECT trId_1, trId_2, round(day_align, {R}) AS day_align FROM feats")
def q_day_align(spark, sf):
    return _pairs(spark, sf).select("trId_1", "trId_2", F.round("day_align", R).alias("day_align"))


@register("pair_amount_feats", "WITH " + _PAIRS + f"""
SELECT trId_1, trId_2, round(diff_amt, {R}) AS diff_amt, round(rel_diff, {R}) AS rel_diff, is_exact, sign_match FROM feats""")
def q_pair_amt(spark, sf):
    p = _pairs(spark, sf)
    return p.select("trId_1", "trId_2", F.round("diff_amt", R).alias("diff_amt"), F.round("rel_diff", R).alias("rel_diff"),
                    "is_exact", "sign_match")


from cadence.plans.sqlfrag import clean_description as _cd_sql, keyword as _kw_sql, lcs_ctes, token_sorted as _ts_sql  # noqa: E402


@register("candidate_pairs_ext", "WITH " + _PAIRS + f"""
SELECT trId_1, trId_2, {_kw_sql('txt_1')} + {_kw_sql('txt_2')} AS keyword_score, sign_match,
       {_cd_sql('txt_1')} AS clean_text_1, {_cd_sql('txt_2')} AS clean_text_2 FROM feats""")
def q_pairs_ext(spark, sf):
    t = C.with_pair_text(txn(spark, sf))
    p = P.pair_features(P.candidate_pairs(t, extra=["has_keyword", "clean_text"]))
    return p.select("trId_1", "trId_2", (F.col("has_keyword_1") + F.col("has_keyword_2")).alias("keyword_score"),
                    "sign_match", "clean_text_1", "clean_text_2")


@register("pair_label", "WITH " + _PAIRS + """
SELECT trId_1, trId_2, CAST(coalesce(pat_1, 'NOISE_' || trId_1) = coalesce(pat_2, 'NOISE_' || trId_2) AS INTEGER) AS is_match FROM feats""")
def q_pair_label(spark, sf):
    t = C.noise_pattern_ids(txn(spark, sf))
    p = P.pair_label(P.candidate_pairs(t, extra=["patternId"]))
    return p.select("trId_1", "trId_2", "is_match")


_RULE = "least(1.0, greatest(0.0, 1.0 - rel_diff * 20)) * CASE WHEN diff_days >= 4 THEN 1.0 ELSE 0.5 END"


def _rule_prob():
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - F.col("rel_diff") * 20)) * \
        F.when(F.col("diff_days") >= 4, 1.0).otherwise(0.5)


@register("label_error_pairs", "WITH RECURSIVE " + _PAIRS + f""",
bad AS MATERIALIZED (
  SELECT *, {_ts_sql(_cd_sql('txt_1'))} AS s, {_ts_sql(_cd_sql('txt_2'))} AS t FROM (
    SELECT *, {_RULE} AS prob, coalesce(pat_1, 'NOISE_' || trId_1) = coalesce(pat_2, 'NOISE_' || trId_2) AS same FROM feats)
  WHERE NOT same AND round(prob, 9) > 0.9),""" + lcs_ctes("bad") + f"""
SELECT row_number() OVER (ORDER BY round(prob, 9) DESC, round(score, 9) DESC, trId_1, trId_2) AS rank, trId_1, trId_2, accountId,
       round(prob, {R}) AS prob, round(score, {R}) AS str_score, d1 AS date_1, d2 AS date_2, a1 AS amount_1, a2 AS amount_2,
       txt_1 AS bankRawDescription_1, txt_2 AS bankRawDescription_2 FROM bad JOIN ratio USING (s, t)""")
def q_label_errors(spark, sf):
    """Pairs labelled as no match that score above 0.9, most suspicious first (probability, then text score)."""
    t = C.noise_pattern_ids(C.with_pair_text(txn(spark, sf)))
    p = P.pair_label(P.pair_features(P.candidate_pairs(t, extra=["patternId", "clean_text"]))).withColumn("prob", _rule_prob())
    return P.label_errors(p, txn(spark, sf), "clean_text_1", "clean_text_2", 0.9, R)


@register("pair_details", "WITH " + _PAIRS + f"""
SELECT trId_1, trId_2, a1 AS amount_1, a2 AS amount_2, txt_1 AS bankRawDescription_1, txt_2 AS bankRawDescription_2
FROM feats WHERE is_exact = 1""")
def q_pair_details(spark, sf):
    p = _pairs(spark, sf).filter("is_exact = 1").select("trId_1", "trId_2")
    d = P.pair_details(p, txn(spark, sf).select("trId", "amount", "bankRawDescription"))
    return d.select("trId_1", "trId_2", "amount_1", "amount_2", "bankRawDescription_1", "bankRawDescription_2")


@register("token_sort_ratio", "WITH RECURSIVE " + _PAIRS + f""",
ct AS MATERIALIZED (SELECT trId_1, trId_2, {_ts_sql(_cd_sql('txt_1'))} AS s, {_ts_sql(_cd_sql('txt_2'))} AS t FROM pairs),""" + lcs_ctes("ct") + f"""
SELECT trId_1, trId_2, round(score, {R}) AS str_score FROM ct JOIN ratio USING (s, t) WHERE score >= 60.0""")
def q_token_sort(spark, sf):
    """Similarity of the cleaned texts of band pairs, on distinct text pairs."""
    t = C.with_pair_text(txn(spark, sf))
    p = P.candidate_pairs(t, extra=["clean_text"])
    s = P.scored_text_pairs(p, "clean_text_1", "clean_text_2", 60.0)
    return s.select("trId_1", "trId_2", F.round("str_score", R).alias("str_score"))


_DIRWIN = """
dw AS (SELECT *, CASE WHEN amount > 0 THEN 1 ELSE -1 END AS sign FROM txn),
dp AS MATERIALIZED (SELECT *, CAST(floor((row_number() OVER (PARTITION BY accountId, sign ORDER BY amount, date, trId) - 1) / 64) AS INTEGER) AS win FROM dw)"""


@register("adjacency_truth", "WITH " + _DIRWIN + """,
pt AS MATERIALIZED (SELECT accountId, sign, win, patternId, trId FROM dp WHERE patternId IS NOT NULL),
met AS MATERIALIZED (SELECT a.trId AS trId_1, b.trId AS trId_2 FROM pt a JOIN pt b USING (accountId, sign, win, patternId))
SELECT trId_1, trId_2 FROM met WHERE trId_1 < trId_2""")
def q_adjacency(spark, sf):
    w = W.direction_windows(txn(spark, sf), max_seq_len=64)
    return P.adjacency_truth(w, ["accountId", "sign", "win"]).select("trId_1", "trId_2")


_EDGE_SCORED = "WITH " + _DIRWIN + """,
met AS MATERIALIZED (
  SELECT a.trId AS trId_1, b.trId AS trId_2, a.bankRawDescription AS txt_1, b.bankRawDescription AS txt_2, a.amount AS amt_1, b.amount AS amt_2,
         CAST(coalesce(a.patternId = b.patternId, false) AS INTEGER) AS truth, 1.0 / (1.0 + abs(a.amount - b.amount) / 100.0) AS prob
  FROM dp a JOIN dp b ON a.accountId = b.accountId AND a.sign = b.sign AND a.win = b.win),
e AS MATERIALIZED (SELECT * FROM met WHERE trId_1 < trId_2)"""


def _edges(spark, sf):
    w = W.direction_windows(txn(spark, sf), max_seq_len=64)
    keys = ["accountId", "sign", "win"]
    a = w.select(*keys, F.col("trId").alias("trId_1"), F.col("patternId").alias("p1"), F.col("amount").alias("a1"),
                 F.col("bankRawDescription").alias("txt_1"))
    b = w.select(*keys, F.col("trId").alias("trId_2"), F.col("patternId").alias("p2"), F.col("amount").alias("a2"),
                 F.col("bankRawDescription").alias("txt_2"))
    # all pairs of one direction window: bounded by max_seq_len^2 per window
    e = a.join(b, keys).filter(F.col("trId_1") < F.col("trId_2"))
    return e.select("trId_1", "trId_2", "txt_1", "txt_2", F.col("a1").alias("amt_1"), F.col("a2").alias("amt_2"),
                    F.coalesce(F.col("p1") == F.col("p2"), F.lit(False)).cast("int").alias("truth"),
                    (1.0 / (1.0 + F.abs(F.col("a1") - F.col("a2")) / 100.0)).alias("prob"))


@register("edge_prf", _EDGE_SCORED + f""",
c AS (SELECT count(*) FILTER (WHERE truth = 1 AND prob > 0.5) AS tp, count(*) FILTER (WHERE truth = 0 AND prob > 0.5) AS fp,
             count(*) FILTER (WHERE truth = 1 AND NOT prob > 0.5) AS fn, count(*) AS rows FROM e),
st AS (SELECT prob AS score, sum(truth) AS pos, sum(1 - truth) AS neg FROM e GROUP BY prob),
sc AS (SELECT *, sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS ctp,
                 sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cfp FROM st),
tot AS (SELECT sum(pos) AS P, sum(neg) AS N FROM st),
ap AS (SELECT round(sum(pos / P * ctp / (ctp + cfp)), 4) AS average_precision,
              round(sum(pos * ((N - cfp) + 0.5 * neg)) / (max(P) * max(N)), 4) AS roc_auc FROM sc, tot)
SELECT c.*, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, {R}) AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, {R}) AS recall,
       round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END, {R}) AS f1, ap.* FROM c, ap""")
def q_edge_prf(spark, sf):
    # the window pairs are built once: one table of counts a score feeds the counts and one scan for both areas
    st = materialize(M.score_table(_edges(spark, sf), "prob", "truth"))
    prf = M.prf_at(st, 0.5)
    prf = prf.select(*[F.round(c, R).alias(c) if c in ("precision", "recall", "f1") else F.col(c) for c in prf.columns])
    return prf.crossJoin(M.areas(st).select(*[F.round(c, 4).alias(c) for c in ("average_precision", "roc_auc")]))


@register("best_neighbor_detection", _EDGE_SCORED + f""",
s AS (SELECT trId_1 AS trId, prob FROM e UNION ALL SELECT trId_2, prob FROM e),
b AS (SELECT trId, max(prob) AS score FROM s GROUP BY trId),
r AS (SELECT t.trId, coalesce(b.score, 0.0) AS score, t.isRecurring FROM txn t LEFT JOIN b USING (trId)),
c AS (SELECT count(*) FILTER (WHERE isRecurring = 1 AND score > 0.5) AS tp, count(*) FILTER (WHERE isRecurring = 0 AND score > 0.5) AS fp,
             count(*) FILTER (WHERE isRecurring = 1 AND NOT score > 0.5) AS fn, count(*) AS rows FROM r)
SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, {R}) AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, {R}) AS recall,
       round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END, {R}) AS f1 FROM c""")
def q_best_neighbor(spark, sf):
    e = _edges(spark, sf)
    sym = e.select(F.col("trId_1").alias("trId"), "prob").unionByName(e.select(F.col("trId_2").alias("trId"), "prob"))
    best = sym.groupBy("trId").agg(F.max("prob").alias("score"))
    r = txn(spark, sf).select("trId", "isRecurring").join(best, "trId", "left").fillna(0.0, ["score"])
    out = M.row_prf(r, "isRecurring", F.col("score") > 0.5)
    return out.select(*[F.round(c, R).alias(c) if c in ("precision", "recall", "f1") else F.col(c) for c in out.columns])


@register("edge_mistakes", _EDGE_SCORED + f"""
SELECT trId_1, trId_2, truth, round(prob, {R}) AS prob, CASE WHEN truth = 1 THEN 'missed' ELSE 'false' END AS kind,
       CASE WHEN length(txt_1) > 25 THEN substr(txt_1, 1, 25) || '..' ELSE txt_1 END AS text_1,
       CASE WHEN length(txt_2) > 25 THEN substr(txt_2, 1, 25) || '..' ELSE txt_2 END AS text_2,
       amt_1 AS amount_1, amt_2 AS amount_2
FROM e WHERE CAST(prob > 0.5 AS INTEGER) <> truth""")
def q_edge_mistakes(spark, sf):
    from cadence.functions.text import truncate_text
    e = _edges(spark, sf).filter((F.col("prob") > 0.5).cast("int") != F.col("truth"))
    return e.select("trId_1", "trId_2", "truth", F.round("prob", R).alias("prob"),
                    F.when(F.col("truth") == 1, "missed").otherwise("false").alias("kind"),
                    truncate_text(F.col("txt_1"), 25).alias("text_1"), truncate_text(F.col("txt_2"), 25).alias("text_2"),
                    F.col("amt_1").alias("amount_1"), F.col("amt_2").alias("amount_2"))


@register("join_patterns", """
WITH pat AS (SELECT patternId, min(patternCycle) AS pc, min(bank_name) AS bank_name FROM txn WHERE patternId IS NOT NULL GROUP BY patternId)
SELECT t.trId, p.pc AS patternCycle_pattern FROM txn t LEFT JOIN pat p ON t.patternId = p.patternId AND t.bank_name = p.bank_name""")
def q_join_patterns(spark, sf):
    t = txn(spark, sf)
    return P.join_patterns(t, io.pattern_table(t)).select("trId", "patternCycle_pattern")


@register("broadcast_group_scores", f"""
WITH g AS (SELECT accountId || '_' || patternId AS g, avg(prob) AS s FROM scored WHERE patternId IS NOT NULL AND prob > 0.3 GROUP BY 1)
SELECT t.trId, round(coalesce(g.s, 0.0), {R}) AS s FROM scored t LEFT JOIN g ON t.accountId || '_' || t.patternId = g.g""",
          views=("scored",))
def q_bcast_scores(spark, sf):
    s = scored(spark, sf).withColumn("g", F.concat_ws("_", "accountId", "patternId"))
    g = s.filter(F.col("patternId").isNotNull() & (F.col("prob") > 0.3)).groupBy("g").agg(F.avg("prob").alias("s"))
    return P.broadcast_group_scores(s, g, "g", "s").select("trId", F.round("s", R).alias("s"))


@register("attach_predictions", f"""
SELECT t.trId, round(coalesce(CASE WHEN t.amount > 0 THEN s.prob END, 0.0), {R}) AS pred_prob,
       coalesce(CASE WHEN t.amount > 0 THEN CAST(s.prob > 0.5 AS INTEGER) END, 0) AS pred_label
FROM txn t LEFT JOIN scored s USING (trId)""", views=("scored",))
def q_attach(spark, sf):
    s = scored(spark, sf).filter("amount > 0").select("trId", F.col("prob").alias("pred_prob"),
                                                       (F.col("prob") > 0.5).cast("int").alias("pred_label"))
    out = P.attach_predictions(txn(spark, sf), s)
    return out.select("trId", F.round("pred_prob", R).alias("pred_prob"), "pred_label")


@register("semi_filter", "SELECT trId FROM txn WHERE accountId IN (SELECT accountId FROM txn GROUP BY accountId HAVING sum(isRecurring) * 2 > count(*))")
def q_semi(spark, sf):
    t = txn(spark, sf)
    ok = t.groupBy("accountId").agg((F.sum("isRecurring") * 2 > F.count(F.lit(1))).alias("k")).filter("k")
    return P.semi_filter(t, ok, ["accountId"]).select("trId")


@register("map_candidates_to_rows", """
WITH g AS (SELECT accountId, counter_party, avg(prob) AS probability FROM scored GROUP BY ALL),
m AS (SELECT s.trId, g.probability FROM scored s JOIN g USING (accountId, counter_party) WHERE s.counter_party <> ''
      UNION ALL SELECT s.trId, g.probability FROM scored s JOIN g ON s.accountId = g.accountId AND g.counter_party = '' AND s.amount < 0),
b AS (SELECT trId, max(probability) AS best FROM m GROUP BY trId)
SELECT t.trId, round(coalesce(b.best, 0.0), 6) AS score, coalesce(b.best, 0.0) >= 0.5 AS predicted FROM scored t LEFT JOIN b USING (trId)""",
          views=("scored",))
def q_map_back(spark, sf):
    s = scored(spark, sf)
    g = s.groupBy("accountId", "counter_party").agg(F.avg("prob").alias("probability")) \
         .withColumn("group_id", F.concat_ws("|", "accountId", "counter_party"))
    m1 = s.filter(F.col("counter_party") != "").select("trId", F.concat_ws("|", "accountId", "counter_party").alias("group_id"))
    m2 = s.filter(F.col("amount") < 0).select("trId", F.concat_ws("|", "accountId", F.lit("")).alias("group_id"))
    out = P.map_candidates_to_rows(s.select("trId"), m1.unionByName(m2), g, threshold=0.5)
    return out.select("trId", F.round("score", R).alias("score"), "predicted")


@register("leakage_check", """
WITH s AS (SELECT accountId, CASE WHEN md5('7|' || accountId) < '4' THEN 'test' WHEN md5('7|' || accountId) < '8' THEN 'val' ELSE 'train' END AS split FROM txn
           UNION ALL SELECT accountId, 'train' FROM txn WHERE accountId = '7')
SELECT accountId, count(DISTINCT split) AS n_splits FROM s GROUP BY accountId HAVING count(DISTINCT split) > 1""")
def q_leakage(spark, sf):
    t = txn(spark, sf)
    h = F.md5(F.concat(F.lit("7|"), F.col("accountId")))
    s = t.select("accountId", F.when(h < "4", "test").when(h < "8", "val").otherwise("train").alias("split"))
    s = s.unionByName(t.filter(F.col("accountId") == "7").select("accountId", F.lit("train").alias("split")))
    return P.leakage_check(s)


_CENTROID = """
lv AS (SELECT v.accountId, v.vec_id, i - 1 AS dim, v.embedding[i] AS x FROM vectors v, range(1, 65) t(i)),
cen AS (SELECT accountId, dim, avg(x) AS cx FROM lv GROUP BY accountId, dim)"""


@register("vector_distance", "WITH " + _CENTROID + f"""
SELECT lv.vec_id, round(sqrt(sum((lv.x - cen.cx) * (lv.x - cen.cx))), {R}) AS dist
FROM lv JOIN cen USING (accountId, dim) GROUP BY lv.vec_id""", views=("vectors",))
def q_vec_dist(spark, sf):
    v = vectors(spark, sf)
    c = P.centroids(v, ["accountId"])
    return v.join(c, "accountId").select("vec_id", F.round(P.vector_distance(F.col("embedding"), F.col("centroid")), R).alias("dist"))


# recovery on V5: a row's amount is derived from its id; rows with vec_id % 3 = 0 are the
# unpredicted candidates, the others form accepted groups (account, vec_id % 4).
_REC = """
rows AS (SELECT vec_id, accountId, embedding, CAST(vec_id % 7 AS DOUBLE) * 10.0 AS amount, vec_id % 4 AS grp FROM vectors),
acc AS (SELECT * FROM rows WHERE vec_id % 3 <> 0),
lv AS (SELECT a.accountId, a.grp, a.amount, i - 1 AS dim, a.embedding[i] AS x FROM acc a, range(1, 65) t(i)),
cen AS (SELECT accountId, grp, dim, avg(x) AS cx FROM lv GROUP BY ALL),
med AS (SELECT accountId, grp, median(amount) AS amt_median FROM acc GROUP BY ALL),
cand AS (SELECT * FROM rows WHERE vec_id % 3 = 0),
d AS (SELECT c.vec_id, c.accountId, n.grp, sqrt(sum((c.embedding[n.dim + 1] - n.cx) * (c.embedding[n.dim + 1] - n.cx))) AS dist,
             any_value(c.amount) AS amount
      FROM cand c JOIN cen n ON c.accountId = n.accountId GROUP BY c.vec_id, c.accountId, n.grp)"""


def _rec_inputs(spark, sf, threshold):
    v = vectors(spark, sf).withColumn("amount", (F.col("vec_id") % 7).cast("double") * 10.0) \
                          .withColumn("grp", F.col("vec_id") % 4)
    acc = v.filter(F.col("vec_id") % 3 != 0)
    cen = P.centroids(acc, ["accountId", "grp"])
    med = exact_quantiles(acc, ["accountId", "grp"], "amount", [0.5], ["amt_median"])  # skew-safe median
    groups = cen.join(med, ["accountId", "grp"]).withColumnRenamed("grp", "group_id")
    cand = v.filter(F.col("vec_id") % 3 == 0)
    return P.recover_missed(cand, groups, distance=threshold)


@register("recover_missed", "WITH " + _REC + """
SELECT d.vec_id, d.accountId, max(d.grp) AS recovered_group FROM d JOIN med m ON d.accountId = m.accountId AND d.grp = m.grp
WHERE d.dist < 2.0 AND (abs(d.amount - m.amt_median) < 2.0 OR abs(d.amount - m.amt_median) < abs(m.amt_median) * 0.1)
GROUP BY d.vec_id, d.accountId""", views=("vectors",))
def q_recover(spark, sf):
    return _rec_inputs(spark, sf, 2.0)
