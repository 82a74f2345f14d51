"""Substring dedup with compact windows.

A text is the sequence of its five-word shingles. Under one hash function every position c rules a
compact window [l, r]: the longest stretch in which c has the smallest hash, a node of the Cartesian
tree over the hashes. Any stretch inside that holds c has c's hash as its min-hash, so the windows of
at least ``least`` positions stand for all stretches of that length. They are found without the
full tree: the positions that are the minimum of some stretch of ``least`` positions, and among them the nearest
smaller ones to both sides.

Windows of equal min-hash meet; each is paired with the first window of its value (a star, never
all pairs), the paired windows of two texts are joined where they overlap along one diagonal, and where at
least ``enough`` of the hash functions agree the passages are verified on their full shingles: every
stretch of ``least`` positions of which ``percent`` per cent occur in the other passage is a near-duplicate.

A text that shares some of the functions only may be first there and split these votes. So windows that
others share are also joined to signatures: the ``enough`` min-hashes that one stretch of ``least`` positions
has at once, for each choice of the functions. Equal signatures meet in the same way, without votes. A signature
none of whose stretches is verified then meets the next ones of its value in order, RANKS times as many in
every round, until it is verified (with the smallest id of the round that verifies it) or has met all earlier ones;
exact copies share every signature and always meet.

Defined results: null and empty texts and texts below ``least`` shingles have no windows. Repeated rows
are texts of one id: windows of one id and position meet nothing. Passages repeated inside one text are found
too. Null ids are left out, other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm.store import stored
from cadence.llm.wordhash import chunks, hash_words, mix, shingles, slices

_U = np.uint64
MOST = 8  # hash functions; a window is packed as at = c * MOST + function, span = (c - l) << 32 | (r - c)
PLACES = 36  # bits of a place in a text where several texts are looked up at once
RANKS = 8  # growth of the number of earlier signatures that an unverified one meets in a round
BATCH = 4 << 20  # bytes of an Arrow batch: texts and passages are of very unequal size, and a worker holds a batch more than once
GROUP = 1000  # passages of one first text that a task verifies
DRIFT = 32  # how far inserted and deleted words may shift two passages against each other


def _slid(x: np.ndarray, t: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) of every t neighbours."""
    low, width, n = x, 1, len(x)
    while 2 * width <= t:
        low = best(low[:len(low) - width], low[width:])
        width *= 2
    return best(low[:n - t + 1], low[t - width:][:n - t + 1]) if width < t else low


def windows(v: np.ndarray, t: int, per: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r), inclusive, of all compact windows of at least t positions.

    ``per``: lengths of the sequences that ``v`` joins; no window crosses two of them. The nearest smaller
    position of such a window's c is itself the smallest of a stretch of t, so the neighbours are looked for
    among the smallest ones of stretches only. Equal values count as smaller to the left.
    """
    n, ends = len(v), np.cumsum([len(v)] if per is None else per)
    if n < t:
        return (np.zeros(0, np.int64),) * 3
    starts = np.concatenate(([0], ends[:-1]))
    of = np.repeat(np.arange(len(ends)), np.diff(np.concatenate(([0], ends))))
    low = np.where(of[:n - t + 1] == of[t - 1:], _slid(v, t, np.minimum), 0)
    pad = np.zeros(t - 1, v.dtype)
    c = np.flatnonzero(_slid(np.concatenate((pad, low, pad)), t, np.maximum) == v)
    seq = of[c]
    left, right = starts[seq].tolist(), (ends[seq] - 1).tolist()  # unless a smaller one lies nearer
    key, at = v[c].tolist(), c.tolist()
    edge = np.flatnonzero(np.diff(seq, prepend=-1)).tolist() + [len(at)]
    for a, b in zip(edge[:-1], edge[1:]):
        stack: list[int] = []
        for i in range(a, b):
            k = key[i]
            while stack and key[stack[-1]] > k:
                right[stack.pop()] = at[i] - 1
            if stack:
                left[i] = at[stack[-1]] + 1
            stack.append(i)
    l, r = np.array(left, np.int64), np.array(right, np.int64)
    whole = r - l + 1 >= t
    return l[whole], c[whole], r[whole]


def _sequences(batch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, shingles a text, shingle hashes of all texts in order) of a batch; texts below one shingle's words are left out."""
    texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
    h, counts, _, _ = hash_words(texts)
    s, per = shingles(h, counts, width)
    whole = counts >= width
    return batch.column(0).to_numpy(zero_copy_only=False)[whole], per[whole], s[np.repeat(whole, per)]


def _windowed(width: int, least: int, functions: int):
    seeds = mix(np.arange(1, functions + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))

    def run(it):
        for batch in (part for whole in it for part in slices(whole, 1, 1 << 18)):
            docs, per, s = _sequences(batch, width)
            long = per >= least
            docs, per, s = docs[long], per[long], s[np.repeat(long, per)]
            if not len(docs):
                continue
            starts = np.cumsum(per) - per
            of, place = np.repeat(np.arange(len(per)), per), np.arange(len(s)) - np.repeat(starts, per)
            copy = (np.add.reduceat(mix(s + place.astype(np.uint64)), starts) >> _U(49)).astype(np.int64)  # tells texts of one id apart
            for f in range(functions):
                v = mix(s ^ seeds[f])
                l, c, r = windows(v, least, per)
                cols = (mix(v[c] + _U(f)).view(np.int64), docs[of[c]], place[c] * MOST + f, (c - l << 32) + (r - c), copy[of[c]])
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in cols],
                                                 names=["key", "doc_id", "at", "span", "copy"])
    return run


def signatures(key: np.ndarray, at: np.ndarray, span: np.ndarray, text: np.ndarray, least: int, enough: int) -> list[np.ndarray]:
    """text, key, at, span, core of the signatures of windows; the function number in ``at`` is 0.

    ``text`` numbers the texts of the windows: each has a range of places of its own, so all are looked up at once.

    The starts of the stretches that a window rules are one interval, and the intervals of a function are
    disjoint. Where intervals of several functions overlap, one of them begins.
    """
    f, c = at % MOST, at // MOST + (text << PLACES)
    l, r = c - (span >> 32), c + (span & 0xFFFFFFFF)
    begin, end = np.maximum(l, c - least + 1), np.minimum(c, r - least + 1)
    per = {}
    for k in np.unique(f).tolist():
        rows = np.flatnonzero(f == k)
        per[k] = rows[np.unique(begin[rows], return_index=True)[1]]
    out = [[] for _ in range(5)]
    for chosen in combinations(sorted(per), enough):
        p = np.unique(np.concatenate([begin[per[k]] for k in chosen]))
        hit = np.stack([per[k][np.maximum(np.searchsorted(begin[per[k]], p, "right") - 1, 0)] for k in chosen])
        hit = hit[:, ((begin[hit] <= p) & (p <= end[hit])).all(axis=0)]
        if not hit.shape[1]:
            continue
        value = np.zeros(hit.shape[1], np.uint64)
        for row in hit:
            value = mix(value * _U(0x9E3779B97F4A7C15) + key[row].view(np.uint64))
        a, b, lo, hi, x = l[hit].max(axis=0), r[hit].min(axis=0), c[hit].min(axis=0), c[hit].max(axis=0), c[hit[0]]
        for col, y in zip(out, (x >> PLACES, value.view(np.int64), (x & (1 << PLACES) - 1) * MOST, (x - a << 32) + (b - x), (x - lo << 32) + (hi - x))):
            col.append(y)
    return [np.concatenate(col) if col else np.zeros(0, np.int64) for col in out]


def _signed(least: int, enough: int):
    """Signatures of windows sorted by (doc_id, copy); the last text of a batch is carried over."""
    def emit(t):
        doc, copy, key, at, span = (t.column(c).to_numpy() for c in ("doc_id", "copy", "key", "at", "span"))
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1])))
        text, *cols = signatures(key, at, span, np.cumsum(new) - 1, least, enough)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[new][text], *cols)], names=["doc_id", "key", "at", "span", "core"])

    def run(it):
        held = None
        for batch in it:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            if not t.num_rows:
                continue
            doc, copy = t.column("doc_id").to_numpy(), t.column("copy").to_numpy()
            first = int(np.flatnonzero((doc == doc[-1]) & (copy == copy[-1]))[0])
            held, done = t.slice(first), t.slice(0, first)
            if first:
                yield from emit(done)
        if held is not None and held.num_rows:
            yield from emit(held)
    return run


def _ranked(names: tuple[str, ...]):
    """Rows sorted by (key, doc_id, at, span) whose key occurs again: columns ``names``, the place in the group and the group's first row."""
    first = ("doc_id", "at", "span")

    def emit(t, rank, head, keep):
        keep = np.flatnonzero(keep)
        if len(keep):
            yield pa.RecordBatch.from_arrays([*(pa.array(t.column(c).to_numpy()[keep]) for c in names), pa.array(rank[keep]),
                                              *(pa.array(h[keep]) for h in head)],
                                             names=[*names, "rank", "other", "other_at", "other_span"])

    def run(it):
        held, held_rank, held_head = None, 0, ()  # the last row so far: only the next one tells whether its key occurs again
        for batch in it:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            if not t.num_rows:
                continue
            key, place = t.column("key").to_numpy(), np.arange(t.num_rows)
            again = key[1:] == key[:-1]
            start = np.maximum.accumulate(np.where(np.concatenate(([True], ~again)), place, 0))
            rank = place - start
            head = [t.column(c).to_numpy()[start] for c in first]
            if held is not None:
                rank = np.where(start == 0, rank + held_rank, rank)
                head = [np.where(start == 0, x, h) for x, h in zip(held_head, head)]
            yield from emit(t, rank, head, np.concatenate(((rank[:-1] > 0) | again, [False])))
            held, held_rank, held_head = t.slice(t.num_rows - 1), int(rank[-1]), [h[-1] for h in head]
        if held is not None and held_rank:
            yield from emit(held, np.array([held_rank]), [np.array([h]) for h in held_head], np.array([True]))
    return run


def _joined(least: int, enough: int):
    """Runs of paired windows (sorted by doc, other, c): extents in both texts, by overlap along a diagonal.

    Sorted rows of one pair may be cut by a batch border: the last pair is carried over.
    """
    names = ("doc_id", "other", "at", "span", "other_at", "other_span")

    def solve(x):
        doc, other, at, span, other_at, other_span = x
        f, c, oc = at % MOST, at // MOST, other_at // MOST
        l, r = c - (span >> 32), c + (span & 0xFFFFFFFF)
        ol, orr = oc - (other_span >> 32), oc + (other_span & 0xFFFFFFFF)
        a, b = c - np.minimum(c - l, oc - ol), c + np.minimum(r - c, orr - oc)  # both sides share this min-hash inside
        oa, ob = oc - (c - a), oc + (b - c)
        fits = b - a + 1 >= least
        doc, other, f, c, oc, a, b, oa, ob = (y[fits] for y in (doc, other, f, c, oc, a, b, oa, ob))
        order = np.lexsort((c, np.floor_divide(c - oc, DRIFT), other, doc))
        doc, other, f, c, oc, a, b, oa, ob = (y[order] for y in (doc, other, f, c, oc, a, b, oa, ob))
        if not len(doc):
            return None
        diag = np.floor_divide(c - oc, DRIFT)
        top = np.maximum.accumulate
        new = np.ones(len(doc), bool)
        same = (doc[1:] == doc[:-1]) & (other[1:] == other[:-1]) & (diag[1:] == diag[:-1])
        group = np.cumsum(np.concatenate(([True], ~same))) - 1
        reach = top(b + group * (1 << 33)) - group * (1 << 33)  # furthest end so far in the group
        new[1:] = ~same | (a[1:] > reach[:-1])
        at = np.flatnonzero(new)
        used = np.bitwise_or.reduceat(1 << f.astype(np.int64), at)
        votes = sum((used >> k) & 1 for k in range(int(f.max()) + 1))
        out = [doc[at], other[at], np.minimum.reduceat(a, at), np.maximum.reduceat(b, at),
               np.minimum.reduceat(oa, at), np.maximum.reduceat(ob, at)]
        keep = votes >= enough
        return [y[keep] for y in out]

    def run(it):
        held = None
        for batch in it:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            if not t.num_rows:
                continue
            doc, other = t.column("doc_id").to_numpy(), t.column("other").to_numpy()
            first = int(np.flatnonzero((doc == doc[-1]) & (other == other[-1]))[0])
            held, done = t.slice(first), t.slice(0, first)
            yield from emit(done)
        if held is not None:
            yield from emit(held)

    def emit(t):
        got = solve([t.column(c).to_numpy().astype(np.int64) for c in names]) if t.num_rows else None
        if got and len(got[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=["doc_id", "other", "a", "b", "oa", "ob"])
    return run


def _passages(width: int):
    """Shingles of the stretches that are asked for: (doc_id, text, asked) -> a row each, the text read once."""
    names = ("other", "salt", "kind", "doc_id", "a", "oa", "ob")

    def run(it):
        for batch in (one for whole in it for one in slices(whole, 1)):
            for doc, text, asked in zip(*(batch.column(i).to_pylist() for i in range(3))):
                h, counts, _, _ = hash_words([text.encode()])
                seq = shingles(h, counts, width)[0]
                for x, y in chunks([8 * (q["b"] - q["a"] + 1) for q in asked]):
                    some = [{**q, "doc_id": doc} for q in asked[x:y]]
                    parts = pa.array([seq[q["a"]:q["b"] + 1].tobytes() for q in some], pa.binary())
                    yield pa.RecordBatch.from_arrays([*(pa.array([q[c] for q in some], pa.int64()) for c in names), parts], names=[*names, "part"])
    return run


def _verified(least: int, percent: int, width: int):
    """Stretches of ``least`` shingles of which ``percent`` % occur in the other passage, united.

    Rows sorted by (other, salt, kind): the stretch of the other text (of each text of its id) comes before its passages.
    """
    def run(it):
        head, heads = None, {}
        for batch in (one for whole in it for one in slices(whole, 7)):
            rows = []
            for other, salt, kind, doc, a, oa, ob, x in zip(*(batch.column(i).to_pylist() for i in range(8))):
                if head != (other, salt):
                    head, heads, sets = (other, salt), {}, {}
                if kind == 0:
                    heads[x] = a
                    continue
                if (oa, ob) not in sets:
                    sets = {(oa, ob): [np.unique(np.frombuffer(y, _U)[oa - lo:ob - lo + 1]) for y, lo in heads.items()]}
                x = np.frombuffer(x, _U)
                for y in sets[oa, ob] if len(x) >= least else ():
                    rows.extend(_agreeing(x, y, doc, other, a, least, percent, width))
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                             names=["doc_id", "other_id", "start_word", "end_word", "shared", "shingles"])
    return run


def _agreeing(x: np.ndarray, y: np.ndarray, doc: int, other: int, a: int, least: int, percent: int, width: int):
    """Rows of the passages of ``x`` (from place ``a`` on) that occur in the sorted distinct shingles ``y``."""
    if not len(y):
        return
    hit = y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x
    total = np.concatenate(([0], np.cumsum(hit)))
    good = np.flatnonzero(100 * (total[least:] - total[:-least]) >= percent * least)
    for part in np.split(good, np.flatnonzero(np.diff(good) > least) + 1) if len(good) else ():
        lo, hi = int(part[0]), int(part[-1]) + least - 1
        inside = np.flatnonzero(hit[lo:hi + 1])
        lo, hi = lo + int(inside[0]), lo + int(inside[-1])
        yield doc, other, a + lo, a + hi + width, int(hit[lo:hi + 1].sum()), hi - lo + 1


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 50, width: int = 5,
                      functions: int = 4, enough: int = 3, percent: int = 80) -> DataFrame:
    """Return doc_id, other_id, start_word, end_word (exclusive), n_words, similarity, one row per passage.

    ``other_id`` is the text that the passage is paired with (the first text of its windows);
    ``similarity`` the share of the passage's shingles that occur there.
    """
    least = words - width + 1
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = base.filter("doc_id is not null and text is not null")
    if functions > MOST:
        raise ValueError(f"at most {MOST} hash functions")
    wins = base.mapInArrow(_windowed(width, least, functions), "key long, doc_id long, at long, span long, copy long")
    elsewhere = "(doc_id <> other or at <> other_at)"

    def ranked(rows: DataFrame, name: str) -> DataFrame:
        """Rows whose value occurs again, with their rank and the first of the value: its smallest id, then its first position there."""
        extra = ", ".join(f"{c} long" for c in (*rows.columns, "rank", "other", "other_at", "other_span"))
        return stored(rows.repartition("key").sortWithinPartitions("key", "doc_id", "at", "span")
                      .mapInArrow(_ranked(tuple(rows.columns)), extra), name, BATCH)

    def joined(meet: DataFrame, votes: int) -> DataFrame:
        return (meet.select("doc_id", "other", "at", "span", "other_at", "other_span")
                .repartition("doc_id").sortWithinPartitions("doc_id", "other", "at")
                .mapInArrow(_joined(least, votes), "doc_id long, other long, a long, b long, oa long, ob long"))

    def verified(runs: DataFrame) -> DataFrame:
        runs = stored(runs.distinct(), "runs", BATCH)
        # a first text of many runs goes to a task for each GROUP of them
        heads = runs.groupBy("other").agg(F.ceil(F.count("*") / GROUP).alias("salts"), F.min("oa").alias("lo"), F.max("ob").alias("hi"))
        ask = lambda kind, *cols: F.struct("other", F.col("salt").cast("long").alias("salt"), F.lit(kind).alias("kind"),
                                           *(F.col(c).alias(n) for c, n in zip(cols, ("a", "b", "oa", "ob")))).alias("asked")
        asked = (runs.join(heads.select("other", "salts"), "other").withColumn("salt", F.pmod(F.xxhash64("doc_id"), "salts"))
                 .select("doc_id", ask(1, "a", "b", "oa", "ob"))
                 .unionByName(heads.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
                              .select(F.col("other").alias("doc_id"), ask(0, "lo", "hi", "lo", "hi")))
                 .groupBy("doc_id").agg(F.collect_list("asked").alias("asked")))  # stretches of one text, which travels once
        parts = (asked.join(base, "doc_id").select("doc_id", "text", "asked")
                 .mapInArrow(_passages(width), "other long, salt long, kind long, doc_id long, a long, oa long, ob long, part binary"))
        return stored(parts.repartition("other", "salt").sortWithinPartitions("other", "salt", "kind", "oa", "ob")
                      .mapInArrow(_verified(least, percent, width),
                                  "doc_id long, other_id long, start_word long, end_word long, shared long, shingles long"), "passages", BATCH)

    def within(rows: DataFrame, found: DataFrame, how: str) -> DataFrame:
        """``rows`` joined to the passages of their text that hold their min-hashes."""
        spot = F.floor(F.col("at") / MOST)
        seen = found.select(F.col("doc_id").alias("d"), *(["other_id"] if how == "inner" else []), "start_word", "end_word").distinct()
        return rows.join(seen, (F.col("doc_id") == F.col("d"))
                         & (F.col("start_word") <= spot - F.shiftright("core", 32))
                         & (F.col("end_word") - width >= spot + F.col("core").bitwiseAND(0xFFFFFFFF)), how)

    def first_verified(rows: DataFrame, found: DataFrame) -> DataFrame:
        """``found`` without the pairs of texts all of whose signatures are verified by a smaller id as well."""
        held = within(rows, found, "inner").select("key", "doc_id", "at", "span", "other_id")
        first = held.groupBy("key", "doc_id", "at", "span").agg(F.min("other_id").alias("first"))
        more = (held.join(first, ["key", "doc_id", "at", "span"]).groupBy("doc_id", "other_id")
                .agg(F.max(F.col("other_id") == F.col("first")).alias("chosen")).filter("not chosen"))
        return found.join(more, ["doc_id", "other_id"], "left_anti")

    common = ranked(wins, "shared")
    signed = ranked(common.select("doc_id", "key", "at", "span", "copy").repartition("doc_id")
                    .sortWithinPartitions("doc_id", "copy", "at")
                    .mapInArrow(_signed(least, enough), "doc_id long, key long, at long, span long, core long"), "signed")
    star = lambda rows: rows.filter(f"rank > 0 and {elsewhere}")
    found = verified(joined(star(common), enough).unionByName(joined(star(signed), 1)))
    # a first one has nothing before it, a second one has met the first
    left = within(signed.select("key", "doc_id", "at", "span", "core", "rank").filter("rank > 1"), found, "left_anti")
    low, high = 1, RANKS
    while True:
        left = stored(left.filter(F.col("rank") > low), "unverified")
        if left.isEmpty():
            break
        heads = signed.filter((F.col("rank") >= low) & (F.col("rank") < high)).select(
            "key", F.col("doc_id").alias("other"), F.col("rank").alias("other_rank"), F.col("at").alias("other_at"),
            F.col("span").alias("other_span"))
        more = verified(joined(left.join(heads, "key").filter("other_rank < rank").filter(elsewhere), 1))
        found, left = found.unionByName(first_verified(left, more)), within(left, more, "left_anti")
        low, high = high, high * RANKS
    return (found.groupBy("doc_id", "other_id", "start_word", "end_word")
            .agg(F.max(F.col("shared") / F.col("shingles")).alias("similarity"))
            .withColumn("n_words", F.col("end_word") - F.col("start_word"))
            .select("doc_id", "other_id", "start_word", "end_word", "n_words", "similarity"))
