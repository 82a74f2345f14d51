"""Exact top-k by inner product with a paged M-tree, searched best first.

Vectors become integers, floor(scale * x). Routing objects are a bounded sample (the ``routers`` rows
with the smallest id hashes); every vector belongs to its nearest routing object, and a routing object's
vectors are dealt over groups of about ``group_rows``. A group is one subtree: pages around centres
chosen farthest first, each page with its covering radius and its centre's distance to the group's centre
(the parent distance), each entry with its distance to the page's centre.

For a query q and any x within r of a centre c: q.x <= q.c + |q| r. A group's subtree is searched page by
page, the best bound first, each query against its running k-th score. The parent distance bounds q.c before
it is computed, the entry distance bounds q.x before it is computed; only bounds below the k-th score skip
work, so the result is exact. The first k-th score comes from the routing objects, which are rows too.

Queries meet the groups in blocks: one row holds the queries of a batch that a group's bound admits.
Scores are exact: products are summed in double precision while they fit 2**53, else in 64-bit integers.

Defined results: vectors that are null, empty or hold null or non-finite components take no part; vectors of
another length than the query's are no candidates. Rows that repeat a vec_id count as one vector, its
smallest embedding. Ties go to the smaller vec_id; a query with fewer candidates gets them all. Null ids
are left out, other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.llm.pivot_dedup import usable
from cadence.llm.store import stored

PAGE = 256
_SLACK = 1 + 1e-9  # bounds are rounded up


def _ints(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of a with all rows of b."""
    if len(a) and len(b) and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _pages(x: np.ndarray, page: int = PAGE):
    """Pages of a group: index arrays around centres chosen farthest first, as many as pages are needed."""
    n = len(x)
    y = x.astype(np.float64)
    seeds = [0]
    near = ((y - y[0]) ** 2).sum(axis=1)
    owner = np.zeros(n, int)
    while len(seeds) * page < n:
        far = int(near.argmax())
        if near[far] == 0:
            break
        seeds.append(far)
        d = ((y - y[far]) ** 2).sum(axis=1)
        closer = d < near
        owner[closer] = len(seeds) - 1
        near = np.minimum(near, d)
    for s in range(len(seeds)):
        rows = np.flatnonzero(owner == s)
        for lo in range(0, len(rows), page):
            yield rows[lo:lo + page]


class Subtree:
    """The pages of one group."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        y = x.astype(np.float64)
        self.root = y.mean(axis=0)
        self.nodes = []
        for rows in _pages(x):
            centre = y[rows].mean(axis=0)
            entry = np.sqrt(((y[rows] - centre) ** 2).sum(axis=1)) * _SLACK
            order = np.argsort(-entry, kind="stable")
            rows = rows[order]
            self.nodes.append((ids[rows], x[rows], entry[order], centre))
        self.centres = np.array([n[3] for n in self.nodes])
        self.radius = np.array([n[2][0] for n in self.nodes])
        self.parent = np.sqrt(((self.centres - self.root) ** 2).sum(axis=1)) * _SLACK

    def search(self, qid: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int):
        """Best k (score, id) per query with scores of at least ``floor``; unused places have id -1."""
        y = q.astype(np.float64)
        norm = np.sqrt((y * y).sum(axis=1)) * _SLACK
        best = np.full((len(q), k), np.iinfo(np.int64).min)
        who = np.full((len(q), k), -1, np.int64)
        bar = floor.astype(np.float64)
        slack = 1e-6 * (1 + norm)
        outer = (y @ self.root + slack)[:, None] + norm[:, None] * (self.parent + self.radius)
        bound = np.full(outer.shape, -np.inf)
        need = outer >= bar[:, None]  # q.c is computed only where the parent distance does not settle it
        for p in np.flatnonzero(need.any(axis=0)):
            rows = np.flatnonzero(need[:, p])
            bound[rows, p] = y[rows] @ self.centres[p] + slack[rows] + norm[rows] * self.radius[p]
        for p in np.argsort(-bound.max(axis=0, initial=-np.inf), kind="stable"):
            rows = np.flatnonzero(bound[:, p] >= bar)
            if not len(rows):
                continue
            ids, x, entry, centre = self.nodes[p]
            middle = bound[rows, p] - norm[rows] * self.radius[p]
            # entries stand by falling distance: those that no query can reach are a tail
            reach = ((bar[rows] - middle) / np.maximum(norm[rows], 1e-300)).min()
            upto = int(np.searchsorted(-entry, -reach, side="right"))
            if upto == 0:
                continue
            ids, x = ids[:upto], x[:upto]
            score = _dots(q[rows], x)
            own = qid[rows][:, None] == ids[None, :]
            score[own] = np.iinfo(np.int64).min
            all_s = np.concatenate((best[rows], score), axis=1)
            all_i = np.concatenate((who[rows], np.where(own, -1, np.broadcast_to(ids, own.shape))), axis=1)
            top = np.lexsort((all_i, -all_s.astype(np.float64) if all_s.max() < 2 ** 52 else ~all_s), axis=1)[:, :k]
            best[rows] = np.take_along_axis(all_s, top, 1)
            who[rows] = np.take_along_axis(all_i, top, 1)
            bar[rows] = np.maximum(bar[rows], np.where(who[rows, -1] >= 0, best[rows, -1], -np.inf))
        who[best < floor[:, None]] = -1
        return best, who


def top_k(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *, every: int = 100, k: int = 10,
          scale: int = 1024, routers: int = 256, group_rows: int = 4096) -> DataFrame:
    """Return query_id, rank, vec_id, score; queries are the rows whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    raw = raw.filter(F.col("vec_id").isNotNull() & usable(F.col("vec"))).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    rows = stored(raw.select("vec_id", F.transform("vec", lambda x: F.floor(x * scale).cast("long")).alias("vec")), "ints")
    head = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(routers).toArrow()
    out = "query_id long, rank int, vec_id long, score long"
    if not head.num_rows:
        return spark.createDataFrame([], out)
    by_len: dict[int, list] = {}
    for i, v in zip(head.column("vec_id").to_pylist(), head.column("vec").to_pylist()):
        by_len.setdefault(len(v), []).append((i, v))
    routing = {d: (np.array([i for i, _ in r]), np.array([v for _, v in r], np.int64)) for d, r in by_len.items()}
    shared = spark.sparkContext.broadcast(routing)  # at most ``routers`` vectors

    def nearest(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of and distance to the nearest routing object of the same length (-1: none)."""
        if x.shape[1] not in shared.value:
            return np.full(len(x), -1), np.zeros(len(x))
        y, r = x.astype(np.float64), shared.value[x.shape[1]][1].astype(np.float64)
        d = (y * y).sum(axis=1)[:, None] - 2 * y @ r.T + (r * r).sum(axis=1)
        at = d.argmin(axis=1)
        return at, np.sqrt(((y - r[at]) ** 2).sum(axis=1)) * _SLACK

    def route(it):
        for b in it:
            length = b.column(1).value_lengths().to_numpy()
            for d in np.unique(length):
                part = b.filter(pa.array(length == d))
                at, dist = nearest(_ints(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.full(len(at), d, np.int32)),
                                                  pa.array(at.astype(np.int32)), pa.array(dist)],
                                                 names=["vec_id", "vec", "dim", "router", "dist"])

    routed = stored(rows.mapInArrow(route, "vec_id long, vec array<long>, dim int, router int, dist double"), "routed")
    # one row per routing object and length: bounded by ``routers`` plus the lengths that none of them has
    sizes = routed.groupBy("dim", "router").agg(F.count("*").alias("n"), F.max("dist").alias("radius"))
    groups = F.greatest(F.ceil(F.col("n") / group_rows), F.lit(1)).cast("long")
    dealt = (routed.join(sizes.select("dim", "router", groups.alias("parts")), ["dim", "router"])
             .select("dim", "router", F.pmod(F.xxhash64("vec_id"), F.col("parts")).alias("part"), "vec_id", "vec"))
    ball = {(r["dim"], r["router"]): (r["radius"], r["parts"])
            for r in sizes.select("dim", "router", "radius", groups.alias("parts")).orderBy("dim", "router").toLocalIterator()}
    balls = spark.sparkContext.broadcast(ball)

    def admit(it):
        """Rows (dim, router, part, queries): the queries of a batch that a group's bound admits."""
        for b in it:
            length = b.column(1).value_lengths().to_numpy()
            for d in np.unique(length):
                part = b.filter(pa.array(length == d))
                qid, q = part.column(0).to_numpy(), _ints(part.column(1))
                y = q.astype(np.float64)
                norm = np.sqrt((y * y).sum(axis=1)) * _SLACK
                floor = np.full(len(q), np.iinfo(np.int64).min)
                if d in shared.value:
                    rid, r = shared.value[d]
                    s = np.where(qid[:, None] == rid, np.iinfo(np.int64).min, _dots(q, r))
                    if s.shape[1] >= k:
                        floor = np.sort(s, axis=1)[:, -k]
                cols = [[] for _ in range(6)]
                for (dim, router), (radius, parts) in balls.value.items():
                    if dim != d:
                        continue
                    if router >= 0:
                        at = shared.value[d][1][router].astype(np.float64)
                        keep = np.flatnonzero(y @ at + 1e-6 * (1 + norm) + norm * radius >= floor)
                    else:
                        keep = np.arange(len(q))
                    if len(keep):
                        for p in range(parts):
                            for c, v in zip(cols, (dim, router, p, qid[keep].tobytes(), q[keep].tobytes(), floor[keep].tobytes())):
                                c.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 3))],
                    names=["dim", "router", "part", "qid", "q", "floor"])

    asked = (rows.filter(F.col("vec_id") % every == 0)
             .mapInArrow(admit, "dim int, router int, part long, qid binary, q binary, floor binary"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        cols = [[], [], []]
        if left.num_rows and right.num_rows:
            tree = Subtree(left.column("vec_id").to_numpy(), _ints(left.column("vec")))
            for qid, q, floor in zip(*(right.column(c).to_pylist() for c in ("qid", "q", "floor"))):
                qid, floor = np.frombuffer(qid, np.int64), np.frombuffer(floor, np.int64)
                best, who = tree.search(qid, np.frombuffer(q, np.int64).reshape(len(qid), -1), floor, k)
                r, c = np.nonzero(who >= 0) if (who >= 0).any() else (np.zeros(0, int), np.zeros(0, int))
                for col, v in zip(cols, (qid[r], who[r, c], best[r, c])):
                    col.append(v)
        flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols]
        return pa.table({"query_id": flat[0], "vec_id": flat[1], "score": flat[2]})

    by = ["dim", "router", "part"]
    found = (dealt.groupBy(*by).cogroup(asked.groupBy(*by))
             .applyInArrow(search, "query_id long, vec_id long, score long"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


ORACLE = """
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
      WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 100 = 0 AND len(q.e) = len(c.e)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
