"""MinHash near-dedup: SuperMinHash signatures, banding, exact verification, union of links.

1. Every text becomes the set of its distinct word shingles (64-bit hashes) and a SuperMinHash
   signature. Equal sets form one class; only its smallest id goes on.
2. Signatures are cut into bands; classes that agree on a band share a bucket. With 128 bins in
   32 bands of 4, a pair at similarity 0.8 shares no bucket with probability 5e-8.
3. Links are confirmed on the full sets. A bucket is not expanded into its pairs: hub rounds
   test each member against one hub, the links merge components, and buckets that lie inside
   one component are done. The sets of the other buckets are joined on their rarest shingles
   (a prefix filter, without loss) where one-bit sketches of their signatures admit a link (a pair at
   similarity 0.8 differs in more bits with probability 1e-8), and pairs of different components are
   tested one by one, so no link that could join two components is skipped.

Defined results: null or empty texts and texts without words have no shingles and stay alone.
Repeated rows give repeated result rows; rows of one doc_id with different texts are judged each
by its own text. A null doc_id gets a null component and kept = false. An empty
table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.llm.store import components, stored
from cadence.llm.superminhash import signatures
from cadence.llm.wordhash import hash_words, mix, shingles, slices

_U = np.uint64
SMALL_PAIRS = 250_000  # 4 MB of ids
SMALL_BUCKET = 16


def _sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    h, counts, _, _ = hash_words(texts)
    s, per = shingles(h, counts, width)
    ends = np.cumsum(per)
    return [np.unique(s[e - n:e]) for e, n in zip(ends, per)]


def _batches(batch: pa.RecordBatch):
    for part in slices(batch, 1):
        yield part.column(0), [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]


def _band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    bands = sig.shape[1] // rows
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), bands))
    for j in range(rows):
        key = mix(key * _U(0x9E3779B97F4A7C15) + sig[:, j:bands * rows:rows])
    return key.view(np.int64)


def _sketch(sig: np.ndarray) -> np.ndarray:
    """One bit per bin, in 64-bit words; unequal bins differ in every second bit."""
    bits = (mix(sig.astype(np.uint64)) & _U(1)).astype(np.uint8)
    return np.packbits(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64))), axis=1).view(np.int64)


def _most_apart(percent: int, bins: int) -> int:
    """Sketch bits in which a linked pair may differ: 7.5 standard deviations above the mean at the threshold."""
    p = (1 - percent / 100) / 2
    return int(bins * p + 7.5 * (bins * p * (1 - p)) ** 0.5)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def _profiler(width: int, bins: int, rows: int):
    def run(it):
        for batch in it:
            for ids, texts in _batches(batch):
                sets = _sets(texts, width)
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                sig = signatures(np.concatenate(sets), sizes, bins)
                keys = _band_keys(sig, rows)
                cheap = (sig ^ (sig >> np.uint32(24))).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([
                    ids.cast(pa.int64()), pa.array(sizes),
                    pa.array([_digest(s) for s in sets], pa.binary()),
                    _lists(keys), pa.array([row.tobytes() for row in cheap], pa.binary()), _lists(_sketch(sig))],
                    names=["doc_id", "n_shingles", "digest", "bands", "cheap", "sketch"])
    return run


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _setter(width: int):
    def run(it):
        for batch in it:
            for _, texts in _batches(batch):
                sets = _sets(texts, width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_digest(s) for s in sets], pa.binary()),
                     pa.array([s.tobytes() for s in sets], pa.binary())], names=["digest", "members"])
    return run


def _agreeing(least: int):
    """Pairs whose 8-bit signatures agree in at least ``least`` bins."""
    def run(it):
        for b in it:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(b.num_rows, -1)
                        for i in (2, 3))
                keep = pa.array((x == y).sum(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])
    return run


def _linked(percent: int):
    """Pairs whose full sets have 100 * intersection >= percent * union."""
    def run(it):
        for b in it:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])
    return run


def _tokens(it):
    """(node, shingle) for every shingle of a set."""
    for b in it:
        sets = [np.frombuffer(m, np.int64) for m in b.column(1).to_pylist()]
        if sets:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), [len(m) for m in sets])),
                                              pa.array(np.concatenate(sets))], names=["node", "shingle"])


def _near(pairs: DataFrame, info: DataFrame, percent: int, bins: int) -> DataFrame:
    """Candidate pairs (a, b) whose sizes and signatures allow a link, as a stored table."""
    # 6 standard deviations of the signature's agreement below the threshold
    p = percent / 100
    least = max(1, int(bins * (p - 6 * (p * (1 - p) / bins) ** 0.5)))
    side = lambda c: info.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("cheap").alias(f"s_{c}"))
    return stored(pairs.join(side("a"), "a").join(side("b"), "b")
                  .filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
                  .select("a", "b", "s_a", "s_b").mapInArrow(_agreeing(least), "a long, b long"), "near")


def _links(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among ``near`` pairs, on full sets. Up to SMALL_PAIRS pairs of ids are broadcast to the sets."""
    few = near.count() <= SMALL_PAIRS
    with_a = sets.withColumnsRenamed({"node": "a", "members": "members_a"}).join(F.broadcast(near) if few else near, "a")
    with_b = sets.withColumnsRenamed({"node": "b", "members": "members_b"})
    if few:
        with_b = with_b.join(F.broadcast(near.select("b").distinct()), "b", "left_semi")
    return (with_a.join(with_b, "b").select("a", "b", "members_a", "members_b")
            .mapInArrow(_linked(percent), "a long, b long"))


def minhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5,
                  percent: int = 80, bins: int = 128, rows: int = 4, hub_rounds: int = 2) -> DataFrame:
    """Return doc_id, n_shingles, component_id (smallest id reachable by links), kept.

    ``width`` words per shingle, links at ``percent`` / 100 Jaccard similarity or more.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prof = stored(base.mapInArrow(_profiler(width, bins, rows),
                                  "doc_id long, n_shingles long, digest binary, bands array<long>, cheap binary, sketch array<long>"),
                  "profiles")
    # a node is a distinct set; its smallest doc_id stands for it. The number is fixed by the stored table
    nodes = stored(prof.filter("n_shingles > 0 and doc_id is not null").groupBy("digest")
                   .agg(F.min(F.struct("doc_id", "n_shingles", "bands", "cheap", "sketch")).alias("r"))
                   .select(F.monotonically_increasing_id().alias("node"), "digest", "r.*"), "nodes")
    post = nodes.select("node", F.explode("bands").alias("key"))
    shared = post.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    post = stored(post.join(shared, "key"), "postings")
    degree = post.groupBy("node").agg(F.sum("size").alias("degree"))
    info = stored(nodes.join(degree, "node"), "info")
    # one strategy at every size: texts are shuffled once, ids are never broadcast to them
    sets = stored(base.join(info.select("doc_id").distinct().hint("merge"), "doc_id").select("doc_id", "text")
                  .mapInArrow(_setter(width), "digest binary, members binary").dropDuplicates(["digest"])
                  .join(info.select("digest", "node"), "digest").select("node", "members"), "sets")

    def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
        """Labels after contracting the components of new links."""
        cross = (links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a")
                 .join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b"))
        comp = components(cross, "la", "lb")
        return stored(labels.join(comp.withColumnRenamed("node", "label"), "label", "left")
                      .select("node", F.coalesce("component", "label").alias("label")), "merged")

    def unsettled(labels: DataFrame) -> DataFrame:
        """Postings of the buckets that hold several components."""
        named = post.join(labels, "node")
        mixed = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
        return stored(named.join(mixed.select("key"), "key").select("key", "node", "label", "size"), "active")

    labels = info.select("node", F.col("node").alias("label"))
    active = post.withColumn("label", F.col("node"))
    tested = None
    for r in range(hub_rounds):
        if r:
            large = active.filter(F.col("size") > SMALL_BUCKET)
            hubs = large.groupBy("key").agg(F.max_by(F.struct("node", "label"), F.xxhash64("node", F.lit(r))).alias("h"))
        else:
            large = active
            hubs = (active.join(info.select("node", "degree"), "node").groupBy("key")
                    .agg(F.max_by(F.struct("node", "label"), F.struct("degree", "node")).alias("h")))
        pairs = (large.join(hubs, "key").filter(F.col("label") != F.col("h.label"))
                 .select(F.least("node", "h.node").alias("a"), F.greatest("node", "h.node").alias("b"))
                 .distinct())
        near = _near(pairs, info, percent, bins)
        tested = near if tested is None else tested.unionByName(near)
        labels = merged(labels, _links(near, sets, percent))
        active = unsettled(labels)
        if active.filter(F.col("size") > SMALL_BUCKET).isEmpty():
            break

    # what is left: pairs of different components. Sets at the threshold share a shingle among the first
    # n - ceil(threshold * n) + 1 of any fixed order; here by the number of these sets that hold them
    left = active.select("node", "label").distinct().join(info.select("node", F.col("n_shingles").alias("n"), "sketch"), "node")
    tokens = stored(sets.join(left.select("node"), "node").select("node", "members")
                    .mapInArrow(_tokens, "node long, shingle long"), "tokens")
    seen = tokens.groupBy("shingle").agg(F.count("*").alias("seen")).filter("seen > 1")
    rarest = Window.partitionBy("node").orderBy("seen", "shingle")
    words = [f"bits{i}" for i in range(-(-bins // 64))]
    first = stored(tokens.join(seen, "shingle", "left").select("node", "shingle", F.coalesce("seen", F.lit(1)).alias("seen"))
                   .withColumn("place", F.row_number().over(rarest) - 1).filter("seen > 1").join(left, "node")
                   .filter(f"place <= n - ({percent} * n + 99) div 100")
                   .select("shingle", "place", "node", "label", "n", *(F.col("sketch")[i].alias(w) for i, w in enumerate(words))),
                   "prefixes")
    x, y = (first.select(*(F.col(c).alias(f"{c}_{s}") for c in first.columns)) for s in "xy")
    apart = sum((F.bit_count(F.col(f"{w}_x").bitwiseXOR(F.col(f"{w}_y"))) for w in words), F.lit(0))
    rest = (x.join(y, (F.col("shingle_x") == F.col("shingle_y")) & (F.col("node_x") < F.col("node_y"))
                   & (F.col("label_x") != F.col("label_y"))
                   # what two sets can share from their first common shingle on
                   & ((100 + percent) * F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y"))
                      >= percent * (F.col("n_x") + F.col("n_y")))
                   & (apart <= _most_apart(percent, bins)))
            .select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct())
    near = _near(rest.join(tested, ["a", "b"], "left_anti"), info, percent, bins)
    labels = merged(labels, _links(near, sets, percent))

    group = (nodes.select("node", "digest", "doc_id").join(labels, "node", "left")
             .select("digest", "doc_id", F.coalesce("label", "node").alias("label")))
    least = group.groupBy("label").agg(F.min("doc_id").alias("least"))
    named = group.join(least, "label").select("digest", "least")
    out = prof.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest"))
    return (out.join(named, "digest", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))))
