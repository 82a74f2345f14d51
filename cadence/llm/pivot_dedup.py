"""Embedding near-dedup with a pivot-permutation index.

Reference points ("pivots") are chosen for each vector length from a bounded sample of its own rows, the
``4 * pivots`` with the smallest id hashes: in that order up to ``pivots`` that lie below cosine ``SPREAD`` to each other, so that a large group
of copies does not fill the list with near-equal points. A vector is described by the ordered list of its ``nearest`` pivots by cosine. The inverted lists are
keyed by the length and sets of ``shared`` pivots: two vectors meet in a list exactly when their descriptions share
at least that many pivots, however many rows there are. Lists of one member are dropped, the others
are verified in blocks: exact cosines in double precision, each pair counted only in the list of its
first shared pivots. No pair becomes a row: a block returns, per vector, its number of links and
the smallest member of its block component. Long lists are cut into chunks, and every pair of
chunks is a block of its own.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with
nothing and stay alone; vectors of different length do not link. Rows that repeat a vec_id count as
one vector, its smallest embedding. Null ids are left out. Other columns are ignored, an empty table
gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm.store import components, stored

CHUNK = 1024
SPREAD = 0.8


def usable(vec):
    """Condition: not null or empty, all components finite numbers."""
    return F.coalesce((F.size(vec) > 0) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))),
                      F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _spread(x: np.ndarray, most: int) -> np.ndarray:
    keep = [0]
    for i in range(1, len(x)):
        if len(keep) < most and (x[keep] @ x[i]).max() < SPREAD:
            keep.append(i)
    return x[keep]


def _pivots(most: int):
    """Pivots of one length from its sampled rows (size, hash, vec_id, vec)."""
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("hash", "ascending"), ("vec_id", "ascending")]).slice(0, 4 * most).combine_chunks()
        p = _spread(_unit(_matrix(t.column("vec").combine_chunks())), most)
        return pa.table([pa.array([t.column("size")[0].as_py()] * len(p), pa.int32()), pa.array(np.arange(len(p), dtype=np.int32)),
                         pa.array(list(p), pa.list_(pa.float64()))], names=["size", "number", "vec"])
    return run


def _describe(pivots, nearest: int, shared: int, stride: int):
    """vec_id -> its nearest pivots (sorted by number) and the keys of its pivot sets."""
    def lists(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))

    def run(it):
        for b in it:
            lengths = b.column(1).value_lengths().to_numpy()
            for d in np.unique(lengths).tolist():
                rows = pa.array(np.flatnonzero(lengths == d))
                number, p = pivots.value[d]
                picks = np.array(list(combinations(range(min(nearest, len(p))), min(shared, len(p)))))
                near = np.argsort(-(_unit(_matrix(b.column(1).take(rows))) @ p.T), axis=1, kind="stable")[:, :nearest]
                near = np.sort(near, axis=1)
                key = np.zeros((len(near), len(picks)), np.int64)
                for j in range(picks.shape[1]):
                    key = key * len(p) + near[:, picks[:, j]]
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), lists(near.astype(np.int32)), lists(key + number * stride)],
                                                 names=["vec_id", "near", "keys"])
    return run


def _block(key: int, ci: np.ndarray, ids: np.ndarray, near: np.ndarray, x: np.ndarray, least: float, shared: int,
           base: int):
    """(ids, links, roots) of one block; chunk numbers ci are equal inside a plain block."""
    cos = x @ x.T >= least
    cross = ci.min() != ci.max()
    r, c = np.nonzero(np.triu(cos, 1))
    if cross:
        keep = ci[r] != ci[c]
        r, c = r[keep], c[keep]
    if not len(r):
        return None
    want = np.array([key // base ** (shared - 1 - j) % base for j in range(shared)])
    good = np.zeros(len(r), bool)
    for lo in range(0, len(r), 200_000):
        a, b = near[r[lo:lo + 200_000]], near[c[lo:lo + 200_000]]
        both = (a[:, :, None] == b[:, None, :]).any(axis=2)
        first = both & (np.cumsum(both, axis=1) <= shared)
        good[lo:lo + 200_000] = (first == (a[:, :, None] == want).any(axis=2)).all(axis=1)
    r, c = r[good], c[good]
    if not len(r):
        return None
    n = len(ids)
    links = np.bincount(r, minlength=n) + np.bincount(c, minlength=n)
    root = np.arange(n)  # rows are sorted by id
    while True:
        low = np.minimum(root[r], root[c])
        new = root.copy()
        np.minimum.at(new, r, low)
        np.minimum.at(new, c, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    hit = links > 0
    return ids[hit], links[hit], ids[root[hit]]


def _verify(least: float, shared: int, stride: int, bases: dict[int, int]):
    """Blocks of a sorted partition (key, i, j): an unfinished block is carried to the next batch."""
    def run(it):
        held = None
        for batch in it:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            if not t.num_rows:
                continue
            group = np.stack([t.column(c).to_numpy() for c in ("key", "i", "j")], axis=1)
            cut = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
            last = int(cut[-1]) if len(cut) else 0
            held, done = t.slice(last), t.slice(0, last)
            yield from results(done, group[:last])
        if held is not None and held.num_rows:
            yield from results(held, np.stack([held.column(c).to_numpy() for c in ("key", "i", "j")], axis=1))

    def results(t, group):
        if not t.num_rows:
            return
        t = t.combine_chunks()
        ids, ci = t.column("vec_id").to_numpy(), t.column("chunk").to_numpy()
        near = t.column("near").to_numpy()
        size = t.column("vec").combine_chunks()
        size = (size.chunk(0) if isinstance(size, pa.ChunkedArray) else size)
        lengths = size.value_lengths().to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1, [len(ids)]))
        out = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            rows = a + np.argsort(ids[a:b])
            if len(rows) > 1:
                base = bases[int(lengths[a])]  # a list holds one length
                got = _block(int(group[a, 0]) % stride, ci[rows], ids[rows], np.stack(near[rows]),
                             _unit(_matrix(size.take(pa.array(rows)))), least, min(shared, base), base)
                if got:
                    out.append(got)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out]).astype(np.int64)) for k in range(3)],
                                             names=["vec_id", "links", "root"])
    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *, least: float = 0.95,
                    pivots: int = 256, nearest: int = 9, shared: int = 4) -> DataFrame:
    """Return vec_id, n_links, component_id, kept for links at cosine >= ``least``."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = stored(rows.filter("vec_id is not null").groupBy("vec_id").agg(F.min("vec").alias("vec")), "vectors")
    fit = rows.filter(usable(F.col("vec")) & F.exists("vec", lambda x: x != 0))
    fit = fit.withColumn("size", F.size("vec"))
    lengths = F.broadcast(fit.groupBy("size").agg(F.count("*").alias("n")).filter("n > 1"))  # a row a length
    # twice the rows that are needed, by hash; a length's task takes the smallest of them
    share = F.least(F.lit(1.0), F.lit(8.0 * pivots) / F.col("n"))
    sample = (fit.join(lengths, "size").withColumn("hash", F.xxhash64("vec_id"))
              .filter(F.col("hash").cast("double") <= share * 2.0 ** 64 - 2.0 ** 63).select("size", "hash", "vec_id", "vec"))
    chosen = (sample.groupBy("size").applyInArrow(_pivots(pivots), "size int, number int, vec array<double>")
              .orderBy("size", "number").toArrow())
    alone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                        F.lit(True).alias("kept"))
    if not chosen.num_rows:
        return alone
    sizes, vecs, points = chosen.column("size").to_numpy(), chosen.column("vec").combine_chunks(), {}
    for number, d in enumerate(np.unique(sizes).tolist()):
        points[d] = (number, _matrix(vecs.take(pa.array(np.flatnonzero(sizes == d)))))
    stride = pivots ** shared
    if len(points) * stride >= 1 << 63:
        raise ValueError("keys of the lists exceed 64 bits")
    described = stored(fit.join(lengths, "size").select("vec_id", "vec").mapInArrow(
        _describe(rows.sparkSession.sparkContext.broadcast(points), nearest, shared, stride),
        "vec_id long, near array<int>, keys array<long>"), "described")
    post = described.select("vec_id", F.explode("keys").alias("key"))
    lists = post.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    post = stored(post.join(lists, "key"), "lists")
    member = (described.select("vec_id", "near").join(post.select("vec_id").distinct(), "vec_id")
              .join(rows, "vec_id"))
    chunks = F.ceil(F.col("n") / CHUNK).cast("long")
    blocks = (post.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), chunks))
              .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
              .select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "vec_id")
              .join(member, "vec_id").select("key", "i", "j", "chunk", "vec_id", "near", "vec"))
    found = stored(blocks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
                   .mapInArrow(_verify(least, shared, stride, {d: len(p) for d, (_, p) in points.items()}), "vec_id long, links long, root long"), "links")
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    comp = components(found, "vec_id", "root").withColumnRenamed("node", "vec_id")
    return (rows.select("vec_id").join(counts, "vec_id", "left").join(comp, "vec_id", "left")
            .select("vec_id", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"),
                    F.coalesce("component", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id") == F.col("component_id")))


ORACLE = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
n AS MATERIALIZED (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS len FROM v
      WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND a.len > 0 AND b.len > 0
      AND len(a.e) = len(b.e) AND list_inner_product(a.e, b.e) / (a.len * b.len) >= 0.95),
r AS (SELECT vec_id AS node, vec_id AS reach FROM v UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id)::BIGINT AS n_links, c.component_id,
       v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.node = v.vec_id
"""
