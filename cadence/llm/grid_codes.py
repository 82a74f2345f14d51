"""Vector code compression: product codebooks fitted by Lloyd rounds, cells of a grid memoised.

A component x becomes the integer floor(256 * x). A vector is cut into consecutive parts (part p
of n covers components floor(p*L/n) to floor((p+1)*L/n) of L), and each part is replaced by the
index of its nearest codebook entry (squared Euclidean distance, ties to the lower index).

The nearest entry is found through a grid. A part falls into a coarse cell, a box. An entry whose
smallest distance to the box exceeds the smallest among all entries' largest distances to it is
dominated: it is nearest to no point of the box. The set of the other entries is kept under the
hash of the cell, once for each task, and only these are evaluated exactly. Whatever the cells'
width, no nearest entry is lost; the width (a share of the codebook's extent) decides only how many
entries remain.

Training reads all rows in each round; a task adds up its parts for each entry before the shuffle,
so a round moves at most parts * entries rows a task, and the driver holds one codebook.

Defined results: rows whose vector is null or has null or non-finite components are dropped. The
codebook starts from the smallest vec_ids (null ids last, repeated ids in order of their vectors); a
table with fewer rows has fewer entries. Its first row fixes the vector length; rows of another
length have no code (code and error null) and train nothing. A component counts as +-2**26 beyond
that range (|x| > 262,144), which keeps squared distances within 64 bits. Repeated rows and null
labels are rows like others; a label's error beyond 64 bits is null. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm.store import stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LIMIT = 1 << 26
CELLS_A_SIDE = 24  # cells along the codebook's extent in each direction
CACHE_CELLS = 400_000  # a task's memory of cells, emptied when full
BLOCK_ROWS = 4_096


def cuts(length: int, parts: int) -> list[int]:
    return [p * length // parts for p in range(parts + 1)]


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    return np.clip(np.floor(x * float(scale)), -LIMIT, LIMIT).astype(np.int64)


class Part:
    """Nearest-entry search in one part of the vectors."""

    def __init__(self, entries: np.ndarray, seed: int):
        self.entries = entries
        extent = int(entries.max(initial=0) - entries.min(initial=0)) if entries.size else 0
        self.width = 1 + extent // CELLS_A_SIDE
        rng = np.random.default_rng(seed)
        self.odd = rng.integers(1, 2**62, size=entries.shape[1], dtype=np.int64) * 2 + 1
        self.seen: dict[int, tuple[bytes, bytes]] = {}  # cell hash -> (cell, bit set of entries)

    def undominated(self, cells: np.ndarray) -> np.ndarray:
        """Entries that can be nearest to some integer point of each cell, as a boolean matrix."""
        low = (cells * self.width)[:, None, :]
        high = low + (self.width - 1)
        under, over = low - self.entries, self.entries - high  # positive on the side where the entry lies outside
        nearest = np.maximum(np.maximum(under, over), 0)
        farthest = np.maximum(np.abs(under), np.abs(over))
        return (nearest ** 2).sum(axis=2) <= (farthest ** 2).sum(axis=2).min(axis=1, keepdims=True)

    def candidates(self, x: np.ndarray) -> np.ndarray:
        """Boolean matrix rows x entries, from the memory of cells."""
        cells = np.floor_divide(x, self.width)
        with np.errstate(over="ignore"):
            key = (cells * self.odd).sum(axis=1)
        keys, first, of = np.unique(key, return_index=True, return_inverse=True)
        found = [self.seen.get(k) for k in keys.tolist()]
        told = [c.tobytes() for c in cells[first]]
        new = [i for i, (f, c) in enumerate(zip(found, told)) if f is None or f[0] != c]
        if new:
            if len(self.seen) + len(new) > CACHE_CELLS // PARTS:
                self.seen.clear()
            bits = np.packbits(self.undominated(cells[first[new]]), axis=1)
            for i, b in zip(new, bits):
                found[i] = self.seen[int(keys[i])] = told[i], b.tobytes()
        n = len(self.entries)
        bits = np.frombuffer(b"".join(f[1] for f in found), np.uint8).reshape(len(found), -1)
        out = np.unpackbits(bits, axis=1, count=n).astype(bool)[of]
        other = (cells != cells[first][of]).any(axis=1)  # two cells of one hash: all entries
        out[other] = True
        return out

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) of each row."""
        row, entry = np.nonzero(self.candidates(x))
        gap = x[row] - self.entries[entry]
        d = np.einsum("ij,ij->i", gap, gap)
        start = np.searchsorted(row, np.arange(len(x)))
        best = np.minimum.reduceat(d, start)
        hit = np.flatnonzero(d == best[row])  # the first of a row has the lowest index
        return entry[hit[np.searchsorted(row[hit], np.arange(len(x)))]], best


class Codebook:
    """Entries of every part: an integer array of shape (entries, length)."""

    def __init__(self, entries: np.ndarray, parts: int = PARTS):
        self.entries, self.parts = entries, parts
        self.at = cuts(entries.shape[1], parts)
        self.part = [Part(np.ascontiguousarray(entries[:, a:b]), p)
                     for p, (a, b) in enumerate(zip(self.at, self.at[1:]))]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes rows x parts, summed squared distances)."""
        codes = np.zeros((len(x), self.parts), dtype=np.int64)
        total = np.zeros(len(x), dtype=np.int64)
        for p, (a, b) in enumerate(zip(self.at, self.at[1:])):
            if b > a and len(x):
                codes[:, p], d = self.part[p].nearest(x[:, a:b])
                total += d
        return codes, total

    def sha256(self) -> str:
        """By part, entry and position within the part."""
        rows = (self.entries[:, a:b].ravel() for a, b in zip(self.at, self.at[1:]))
        return hashlib.sha256(",".join(str(v) for r in rows for v in r.tolist()).encode()).hexdigest()


def usable(rows: DataFrame, vec_col: str) -> DataFrame:
    """Rows with a vector of finite components, as array<double> ``v``."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col(vec_col).isNotNull() & F.coalesce(finite, F.lit(False))).withColumn("v", v)


def _blocks(batches, column: int, length: int, scale: int):
    """(Arrow slice, rows of the given length, their integers) of bounded size."""
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(a, BLOCK_ROWS)
            v = part.column(column)
            size = np.asarray(v.value_lengths())
            fits = np.flatnonzero(size == length)
            flat = np.asarray(v.filter(pa.array(size == length)).flatten(), dtype=np.float64)
            yield part, fits, integers(flat.reshape(len(fits), length), scale)


def _sums(book: Codebook, scale: int):
    def run(batches):
        k, length = book.entries.shape
        count = np.zeros((book.parts, k), dtype=np.int64)
        total = np.zeros((k, length), dtype=object if length else np.int64)
        for _, fits, x in _blocks(batches, 0, length, scale):
            if not len(fits):
                continue
            codes, _ = book.assign(x)
            for p, (a, b) in enumerate(zip(book.at, book.at[1:])):
                count[p] += np.bincount(codes[:, p], minlength=k)
                part = np.zeros((k, b - a), dtype=np.int64)
                np.add.at(part, codes[:, p], x[:, a:b])
                total[:, a:b] += part
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e], pa.int64()),
             pa.array([[int(s) for s in total[j, book.at[i]:book.at[i + 1]]] for i, j in zip(p, e)],
                      pa.list_(pa.int64()))], names=["part", "entry", "n", "s"])
    return run


def fit(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", parts: int = PARTS,
        entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebook | None:
    """Codebook after ``rounds`` Lloyd rounds over all rows; None for an empty table."""
    if not 1 <= entries <= 256:
        raise ValueError("1 to 256 entries (two hexadecimal digits)")
    kept = usable(rows, vec_col).select(F.col(id_col).alias("i"), "v")
    first = kept.orderBy(F.col("i").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return None
    first = [r.v for r in first if len(r.v) == len(first[0].v)]
    book = Codebook(integers(np.array(first, dtype=np.float64).reshape(len(first), -1), scale), parts)
    for _ in range(rounds):
        sums = kept.select("v").mapInArrow(_sums(book, scale), "part int, entry int, n long, s array<long>")
        # one row for each place of the part: sums of many tasks add up without a group in one task
        total = (sums.select("part", "entry", "n", F.posexplode_outer("s").alias("at", "s"))
                 .groupBy("part", "entry", "at")
                 .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")))
        new = book.entries.copy()
        for r in total.collect():  # at most entries * length rows
            if r["at"] is not None:
                new[r.entry, book.at[r.part] + r["at"]] = int(r.s) // r.n
        book = Codebook(new, parts)
    return book


def encode(rows: DataFrame, book: Codebook, id_col: str = "vec_id", vec_col: str = "embedding",
           carry: tuple[str, ...] = (), scale: int = SCALE) -> DataFrame:
    """Return vec_id, code, error of every usable row, and carried columns as c_<name>."""
    base = usable(rows, vec_col).select(F.col(id_col).alias("vec_id"), "v", *(F.col(c).alias(f"c_{c}") for c in carry))
    names = ["vec_id", *(f"c_{c}" for c in carry)]
    hexes = np.array([f"{i:02x}" for i in range(256)])

    def run(batches):
        for part, fits, x in _blocks(batches, 1, book.entries.shape[1], scale):
            codes, total = book.assign(x)
            code = np.full(part.num_rows, None, dtype=object)
            code[fits] = ["".join(c) for c in hexes[codes].tolist()]
            error = np.zeros(part.num_rows, dtype=np.int64)
            error[fits] = total
            missing = np.ones(part.num_rows, dtype=bool)
            missing[fits] = False
            kept = [part.column(i) for i in range(part.num_columns) if i != 1]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(code.tolist(), pa.string()), pa.array(error, pa.int64(), mask=missing)],
                names=[*names, "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in base.schema.fields}
    return base.mapInArrow(run, ", ".join([f"`{n}` {kinds[n]}" for n in names] + ["code string", "error long"]))


def compress(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
             **settings) -> DataFrame:
    """Return vec_id, code, error, label_error (error summed over equal labels, nulls together), codebooks_sha256."""
    book = fit(rows, id_col, vec_col, **settings)
    if book is None:
        return (rows.limit(0).select(F.col(id_col).alias("vec_id"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                                     F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")))
    coded = stored(encode(rows, book, id_col, vec_col, carry=(label_col,), scale=settings.get("scale", SCALE)), "codes")
    label = F.col(f"c_{label_col}")
    total = (coded.groupBy(label.alias("l")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("t"))
             .select("l", F.expr("try_cast(t as bigint)").alias("label_error")))
    return (coded.join(total, label.eqNullSafe(F.col("l")))
            .select("vec_id", "code", "error", "label_error", F.lit(book.sha256()).alias("codebooks_sha256")))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """DuckDB text of ``compress`` over embeddings: every part against every entry, place by place."""
    nearest = """
a{r} AS (SELECT row, part, min(d * 256 + entry) % 256 AS entry, min(d) AS d FROM (
    SELECT x.row, x.part, c.entry, sum((x.v - c.v) * (x.v - c.v)) AS d
    FROM x JOIN c{r} c USING (part, pos) GROUP BY ALL) GROUP BY row, part)"""
    update = """
c{s} AS (SELECT c.part, c.entry, c.pos, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
    SELECT a.part, a.entry, x.pos, floor(sum(x.v)::DOUBLE / count(*))::BIGINT AS v
    FROM a{r} a JOIN x USING (row, part) GROUP BY ALL) m USING (part, entry, pos))"""
    steps = [nearest.format(r=r) + "," + (update.format(r=r, s=r + 1) + "," if r < rounds else "") for r in range(rounds + 1)]
    return f"""
WITH kept AS (
    SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS row, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
x AS (SELECT row, pos * {parts} // n AS part, pos, floor({scale} * y)::BIGINT AS v FROM (
    SELECT row, len(e) AS n, unnest(e) AS y, generate_subscripts(e, 1) - 1 AS pos FROM kept)),
c0 AS (SELECT part, row AS entry, pos, v FROM x WHERE row < {entries}),
{"".join(steps)}
book AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM c{rounds}),
coded AS (SELECT row, string_agg(lpad(to_hex(entry), 2, '0'), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
    FROM a{rounds} GROUP BY row)
SELECT k.vec_id, lower(c.code) AS code, c.error, sum(c.error) OVER (PARTITION BY k.label)::BIGINT AS label_error, codebooks_sha256
FROM kept k JOIN coded c USING (row) CROSS JOIN book"""
