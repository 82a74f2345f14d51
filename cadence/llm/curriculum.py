"""Mixing sources to target weights along a time-varying curriculum.

Every source gets a target in words: a share of the mix by weight, capped at ``max_epochs`` times the
source, the excess reshared by weight until no source is above its cap. Over the training time t in
[0, 1] a source's intensity is the schedule f(t) = 1 + slope * (2t - 1), whose integral
F(t) = t + slope * (t^2 - t) is its cumulative share of the target. A source's documents stand in
an order by hash on its word axis, once per epoch; a copy is taken when its middle lies below the
target, and the inverse F gives its training position, by which the mix is range-sorted. The copies taken
of an epoch are the first of that order, so one last row per source and epoch decides: ``training_order``
reads whole documents once, with bounded lookups, and moves them once, into training order.

Word offsets are prefix sums over (source, 4096 hash buckets): bucket sums first, then inside a
bucket, so a source with a third of all rows is never in one task. Everything is DataFrame code.

Defined results: null and empty texts have size 0 and take no words; a null source is a source, the
last in order; a null doc_id has one hash; repeated rows are documents of their own; without words
every target is 0. Other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.llm.store import stored

BUCKET_DIGITS = 3
FRACTION_DIGITS = 12  # of the key, after the bucket's: a document's place inside its bucket
BROADCAST_SOURCES = 64  # up to 64 x 4096 bucket starts go to every task, more meet the documents by a join
ORDER = ("key", "size", "tie")


def _words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def _tie(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size (words), key (hash order), tie (order of rows of one id and size), bucket."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        _words(F.col(text_col)).alias("size"), _key(F.col(id_col)).alias("key"), _tie(F.col(text_col)).alias("tie"),
    ).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))


def targets(rows: DataFrame, weights=(5, 2, 1), slopes=(-0.5, 0.0, 0.5), share: float = 1.5,
            max_epochs: int = 2) -> DataFrame:
    """One row per source: source_size, target, slope. Works on one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "rank")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.pmod(F.col("rank") - 1, F.lit(len(values))) + 1)
    s = (rows.groupBy("source").agg(F.sum("size").alias("source_size"))
         .withColumn("rank", F.row_number().over(by_name))
         .withColumn("weight", pick(weights).cast("double")).withColumn("slope", pick(slopes).cast("double"))
         .withColumn("cap", (max_epochs * F.col("source_size")).cast("double"))
         .withColumn("ratio", F.col("cap") / F.col("weight"))
         .withColumn("total", F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy()))
         .withColumn("before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("open_weight", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
         # words per unit of weight if this and all later sources stay below their caps
         .withColumn("level", (F.col("total") - F.col("before")) / F.col("open_weight"))
         .withColumn("place", F.row_number().over(by_ratio)))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(Window.partitionBy())["level"]
    return (s.withColumn("common", level)
            .select("source", "source_size", "slope",
                    F.least("cap", F.coalesce(F.col("common") * F.col("weight"), F.col("cap"))).alias("target")))


def _position(u: Column, slope: Column) -> Column:
    """Inverse of F(t) = t + slope * (t^2 - t) on [0, 1]."""
    root = (F.sqrt((1 - slope) * (1 - slope) + 4 * slope * u) - (1 - slope)) / (2 * slope)
    return F.least(F.greatest(F.when(F.abs(slope) < 1e-12, u).otherwise(root), F.lit(0.0)), F.lit(1.0))


def _starts(rows: DataFrame) -> DataFrame:
    """s, b, bucket_start, bucket_size: the stretch of a source's word axis that a bucket covers."""
    upto = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    return (rows.groupBy(F.col("source").alias("s"), F.col("bucket").alias("b")).agg(F.sum("size").alias("bucket_size"))
            .withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(upto), F.lit(0))))


def _placed(rows: DataFrame, starts: DataFrame, goal: DataFrame) -> DataFrame:
    """The rows with their start on the source's word axis and the source's target."""
    inside = Window.partitionBy("source", "bucket").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    at = (rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
          .join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
          .withColumn("start", F.col("inside") + F.col("bucket_start")).select("doc_id", "source", "start", *ORDER))
    return at.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))


def _middle(k: int) -> Column:
    return F.col("start") + k * F.col("source_size") + F.col("size") / 2


def _taken(k: int) -> Column:
    return (F.col("size") > 0) & (_middle(k) < F.col("target"))


def _scheduled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               weights=(5, 2, 1), slopes=(-0.5, 0.0, 0.5), share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """Per document: doc_id, s (its source), start, size, source_size, target, positions of the copies to take."""
    rows = stored(sizes(docs, id_col, text_col, source_col), "sizes")
    full = _placed(rows, _starts(rows), targets(rows, weights, slopes, share, max_epochs))
    copies = F.filter(F.array(*[
        F.when(_taken(k), _position(_middle(k) / F.col("target"), F.col("slope")))
        for k in range(max_epochs)]), lambda x: x.isNotNull())
    return full.withColumn("positions", copies).select("doc_id", "s", "start", "size", "source_size", "target", "positions")


def _sorted_mix(scheduled: DataFrame) -> DataFrame:
    """The copies in training order: range-partitioned and sorted by position."""
    return (scheduled.select("doc_id", "s", "start", "size", F.posexplode("positions").alias("copy", "position"))
            .repartitionByRange("position", "doc_id", "copy").sortWithinPartitions("position", "doc_id", "copy"))


def plan(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, positions (array, one per copy taken).

    Words taken and positions are read from the mix in its training order. A document with words is the
    only one of its source that starts at its place.
    """
    full = stored(_scheduled(docs, **options), "plan")
    order = stored(_sorted_mix(full), "order")
    got = (order.groupBy(F.col("s").alias("t"), F.col("start").alias("at"))
           .agg(F.sum("size").alias("words"), F.array_sort(F.collect_list(F.struct("copy", "position"))).alias("copies")))
    same = F.col("s").eqNullSafe(F.col("t")) & (F.col("start") == F.col("at")) & (F.col("size") > 0)
    positions = F.coalesce(F.col("copies.position"), F.array().cast("array<double>"))
    return (full.drop("positions").join(got, same, "left")
            .select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"),
                    positions.alias("positions")))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The training order: doc_id, copy (from 0), position, range-partitioned and sorted by position."""
    return _sorted_mix(_scheduled(docs, **options)).select("doc_id", "copy", "position")


def training_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                   weights=(5, 2, 1), slopes=(-0.5, 0.0, 0.5), share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """Whole documents of the mix in training order: doc (all columns of ``docs``), copy (from 0), position.

    The copies are those of ``plan``. A position is read from the start of the document's bucket and its
    place by hash inside it, so it is within one bucket's words of the position that ``plan`` gives. Rows that
    are equal in id, size and text are taken together.
    """
    rows = stored(sizes(docs, id_col, text_col, source_col), "sizes")
    starts, goal = stored(_starts(rows), "starts"), stored(targets(rows, weights, slopes, share, max_epochs), "targets")
    # a document's middle grows along the order, so the copies taken end with one row per source and epoch
    last = (_placed(rows, starts, goal).groupBy(F.col("source").alias("t"))
            .agg(*(F.max(F.when(_taken(k), F.struct(*ORDER))).alias(f"last{k}") for k in range(max_epochs))))
    cuts = stored(goal.join(last, F.col("source").eqNullSafe(F.col("t"))).drop("t").withColumnRenamed("source", "t"), "cuts")
    small = F.broadcast if goal.count() <= BROADCAST_SOURCES else (lambda df: df)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"),
                        F.col(source_col).cast("string").alias("source"), F.col(id_col).cast("long").alias("id"),
                        _key(F.col(id_col)).alias("key"))
    text = F.col("doc")[text_col].cast("string")
    found = (whole.join(small(starts), F.col("source").eqNullSafe(F.col("s"))
                        & (F.substring("key", 1, BUCKET_DIGITS) == F.col("b")))
             .join(small(cuts), F.col("source").eqNullSafe(F.col("t"))))
    place = (F.conv(F.substring("key", BUCKET_DIGITS + 1, FRACTION_DIGITS), 16, 10).cast("double")
             / float(16 ** FRACTION_DIGITS))
    at = lambda k: F.col("bucket_start") + place * F.col("bucket_size") + k * F.col("source_size")

    def taken(k: int) -> Column:
        end = F.col(f"last{k}")
        upto = (F.when(F.col("key") != end["key"], F.col("key") < end["key"])
                .otherwise(F.struct(_words(text).alias("size"), _tie(text).alias("tie"))
                           <= F.struct(end["size"].alias("size"), end["tie"].alias("tie"))))
        return end.isNotNull() & upto & text.rlike(r"[^\x20\x09-\x0D]")

    copies = F.filter(F.array(*[
        F.when(taken(k), F.struct(F.lit(k).alias("copy"), _position(F.least(at(k) / F.col("target"), F.lit(1.0)), F.col("slope")).alias("position")))
        for k in range(max_epochs)]), lambda x: x.isNotNull())
    return (found.select("doc", "id", F.inline(copies)).repartitionByRange("position", "id", "copy")
            .sortWithinPartitions("position", "id", "copy").select("doc", "copy", "position"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5(COALESCE(doc_id::VARCHAR, '')) AS k FROM documents),
s0 AS (SELECT source, SUM(size)::BIGINT AS source_size,
              [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS weight,
              row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
s1 AS (SELECT *, (2 * source_size)::DOUBLE AS cap, (2 * source_size)::DOUBLE / weight AS ratio FROM s0),
s2 AS (SELECT *, (1.5::DOUBLE * SUM(source_size) OVER ()
                  - COALESCE(SUM(cap) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / SUM(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
              row_number() OVER (ORDER BY ratio, rank) AS place FROM s1),
s3 AS (SELECT source, source_size, LEAST(cap, (SELECT arg_min(level, place) FROM s2 WHERE level <= ratio) * weight) AS target FROM s2),
p AS (SELECT d.doc_id, d.source, d.size,
             COALESCE(SUM(size) OVER (PARTITION BY source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d)
SELECT p.doc_id, p.size, s3.source_size, s3.target,
       (p.size * ((p.start + p.size / 2 < s3.target AND p.size > 0)::INT
                  + (p.start + s3.source_size + p.size / 2 < s3.target AND p.size > 0)::INT))::BIGINT AS taken
FROM p JOIN s3 ON p.source IS NOT DISTINCT FROM s3.source
"""
