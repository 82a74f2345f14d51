"""Merkle fixity audit of WARC replicas.

A record is its WARC header and payload; a leaf is the record's digest, offset and length. ``FANOUT``
leaves in order form a node, whose digest covers its children's digests and the offset range they
span, and so on up to one root per file. Two replicas are compared root by root; only the children
of differing nodes are looked at, level by level, down to the records. Everything is DataFrame code;
payloads are hashed where they are read, only digests are shuffled.

A record is ``corrupt`` (other bytes), ``missing`` (not in the replica), ``extra`` (only there) or
``moved`` (same bytes at another place). Records are matched inside a file by id and by the
occurrence among records of that id.

Defined results: null urls and payloads are written as empty; a null id is the id 0; repeated rows are records of
their own. Other columns are ignored; empty tables have no roots and nothing differs. A file's
records are put in order in one task: a WARC file is bounded (``FILE_RECORDS`` ids here).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.llm.store import stored

FANOUT = 16
FILE_RECORDS = 4096


def record_text(id_: Column, url: Column, payload: Column) -> Column:
    """The WARC/1.1 response record of one page."""
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), id_.cast("string"),
                    F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
                    F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"), payload, F.lit("\r\n\r\n"))


def leaves(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """One row per record: file, idx (order in the file), offset, length, digest, record_id, nth."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rid = F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long"))
    rec = record_text(rid, text(url_col), text(payload_col))
    raw = pages.select(rid.alias("record_id"), F.sha2(rec, 256).alias("digest"), F.octet_length(rec).cast("long").alias("length"))
    raw = raw.withColumn("file", F.floor(F.col("record_id") / FILE_RECORDS).cast("long"))
    w = Window.partitionBy("file").orderBy("record_id", "digest")
    return (raw.withColumn("idx", (F.row_number().over(w) - 1).cast("long"))
            .withColumn("offset", F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("nth", F.row_number().over(Window.partitionBy("file", "record_id").orderBy("idx"))))


def _parents(level: DataFrame) -> DataFrame:
    """Nodes of up to FANOUT children: file, idx, digest, offset, length."""
    kids = F.sort_array(F.collect_list(F.struct("idx", "digest", "offset", "length")))
    line = F.array_join(F.transform(kids, lambda k: F.concat_ws(":", k["digest"], k["offset"], k["length"])), ",")
    return (level.groupBy("file", F.floor(F.col("idx") / FANOUT).alias("idx"))
            .agg(F.sha2(line, 256).alias("digest"), F.min("offset").alias("offset"), F.sum("length").alias("length")))


def tree(records: DataFrame) -> list[DataFrame]:
    """Stored levels from the leaves up to the roots (one node per file)."""
    levels = [stored(records, "leaves")]
    top = levels[0].agg(F.max("idx")).first()[0]
    while top is not None and top > 0:
        levels.append(stored(_parents(levels[-1]), "nodes"))
        top //= FANOUT
    return levels


def audit(good: list[DataFrame], replica: list[DataFrame]) -> DataFrame:
    """Rows (file, record_id, nth, status, offset, length, digest, replica_offset, replica_digest) that differ."""
    depth = max(len(good), len(replica))
    good = good + _lifted(good, depth)
    replica = replica + _lifted(replica, depth)
    open_ = None
    for lev in range(depth - 1, 0, -1):
        a, b = (t[lev].select("file", "idx", F.col("digest").alias(f"d{s}")) for t, s in ((good, "a"), (replica, "b")))
        if open_ is not None:
            up = lambda t: t.join(open_, (t["file"] == open_["f"]) & (F.floor(t["idx"] / FANOUT) == open_["i"]), "left_semi")
            a, b = up(a), up(b)
        differ = a.join(b, ["file", "idx"], "full").filter(~F.col("da").eqNullSafe(F.col("db")))
        open_ = stored(differ.select(F.col("file").alias("f"), F.col("idx").alias("i")), "open")
    sides = []
    for t, s in ((good[0], "a"), (replica[0], "b")):
        if open_ is not None:
            t = t.join(open_, (t["file"] == open_["f"]) & (F.floor(t["idx"] / FANOUT) == open_["i"]), "left_semi")
        sides.append(t.select("file", "record_id", "nth", *(F.col(c).alias(f"{c}_{s}") for c in ("offset", "length", "digest"))))
    both = sides[0].join(sides[1], ["file", "record_id", "nth"], "full")
    status = (F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra")
              .when(F.col("digest_a") != F.col("digest_b"), "corrupt").when(F.col("offset_a") != F.col("offset_b"), "moved"))
    return (both.withColumn("status", status).filter("status is not null")
            .select("file", "record_id", "nth", "status", F.col("offset_a").alias("offset"), F.col("length_a").alias("length"),
                    F.col("digest_a").alias("digest"), F.col("offset_b").alias("replica_offset"),
                    F.col("digest_b").alias("replica_digest")))


def _lifted(levels: list[DataFrame], depth: int) -> list[DataFrame]:
    """Further levels over the roots, for replicas of different depth."""
    out = []
    while len(levels) + len(out) < depth:
        out.append(stored(_parents((levels + out)[-1]), "nodes"))
    return out


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with known damage: a byte changed in some records, the last records of some files cut off."""
    page = F.coalesce(F.col("page_id").cast("long"), F.lit(0))
    cut = (F.floor(page / FILE_RECORDS) % 3 == 1) & (page % FILE_RECORDS >= FILE_RECORDS - 40)
    html = F.when((page % 97 == 13) & (F.col("html") != ""), F.concat(F.lit("#"), F.substring(F.col("html"), 2, 2147483647))).otherwise(F.col("html"))
    return pages.filter(~cut).select("page_id", "url", html.alias("html"))


ORACLE = r"""
WITH p AS (SELECT COALESCE(page_id, 0)::BIGINT AS record_id, COALESCE(url, '') AS url, COALESCE(html, '') AS html FROM pages),
q AS (SELECT record_id, url, CASE WHEN record_id % 97 = 13 AND html <> '' THEN '#' || substring(html, 2) ELSE html END AS html FROM p
      WHERE NOT ((record_id // 4096) % 3 = 1 AND record_id % 4096 >= 4056)),
t AS (SELECT 'a' AS side, * FROM p UNION ALL SELECT 'b', * FROM q),
r AS (SELECT side, record_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:'
             || record_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html'
             || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html
             || chr(13) || chr(10) || chr(13) || chr(10) AS rec FROM t),
l AS (SELECT side, record_id, record_id // 4096 AS file, sha256(rec) AS digest, strlen(rec)::BIGINT AS length FROM r),
o AS (SELECT *, COALESCE(SUM(length) OVER (PARTITION BY side, file ORDER BY record_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off,
             row_number() OVER (PARTITION BY side, file, record_id ORDER BY digest)::INT AS nth FROM l),
j AS (SELECT COALESCE(a.file, b.file) AS file, COALESCE(a.record_id, b.record_id) AS record_id, COALESCE(a.nth, b.nth) AS nth,
             a.off AS "offset", a.length, a.digest, b.off AS replica_offset, b.digest AS replica_digest
      FROM (SELECT * FROM o WHERE side = 'a') a FULL JOIN (SELECT * FROM o WHERE side = 'b') b
        ON a.file = b.file AND a.record_id = b.record_id AND a.nth = b.nth)
SELECT file, record_id, nth, CASE WHEN replica_digest IS NULL THEN 'missing' WHEN digest IS NULL THEN 'extra'
            WHEN digest <> replica_digest THEN 'corrupt' ELSE 'moved' END AS status, "offset", length, digest, replica_offset, replica_digest
FROM j WHERE replica_digest IS NULL OR digest IS NULL OR digest <> replica_digest OR "offset" <> replica_offset
"""
