"""op12: grid cells never lose the nearest entry; Lloyd rounds equal to a plain version."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import types as T

from cadence.llm import grid_codes as G

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("label", T.IntegerType()), T.StructField("code", T.StringType()),
                       T.StructField("v", T.StringType())])  # the last two clash with inner names


def plain(rows, parts=16, entries=64, rounds=2):
    kept = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([[int(np.floor(256 * float(np.float32(c)))) for c in r[1]] for r in kept], dtype=object)
    n = x.shape[1]
    at = [p * n // parts for p in range(parts + 1)]
    book = x[:entries].copy()

    def assign():
        codes, errors = [], []
        for v in x:
            code, error = [], 0
            for a, b in zip(at, at[1:]):
                d = [sum((int(s) - int(t)) ** 2 for s, t in zip(v[a:b], e[a:b])) for e in book]
                code.append(d.index(min(d)))
                error += min(d)
            codes.append(code)
            errors.append(error)
        return codes, errors

    for _ in range(rounds):
        codes, _ = assign()
        new = book.copy()
        for p, (a, b) in enumerate(zip(at, at[1:])):
            for e in range(len(book)):
                mine = [v[a:b] for v, c in zip(x, codes) if c[p] == e]
                if mine:
                    new[e, a:b] = [sum(int(m[j]) for m in mine) // len(mine) for j in range(b - a)]
        book = new
    codes, errors = assign()
    flat = [str(v) for a, b in zip(at, at[1:]) for e in book for v in e[a:b]]
    by_label = {}
    for r, e in zip(kept, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(flat).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{c:02x}" for c in code), e, by_label[r[2]], sha)
                   for r, code, e in zip(kept, codes, errors)), key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def run(spark, rows, **settings):
    return sorted((tuple(r) for r in G.compress(table(spark, rows), **settings).collect()), key=str)


@pytest.mark.parametrize("n,length,scale", [(150, 32, 0.3), (90, 21, 4.0), (40, 64, 0.001)])
def test_equal_to_plain_rounds(spark, n, length, scale):
    rng = np.random.default_rng(n)
    rows = [(int(i), [float(v) for v in np.float32(rng.normal(0, scale, length))], int(i % 3) or None) for i in range(n)]
    rows += rows[:3] + [(None, rows[5][1], 2), (900, None, 1), (901, [float("nan")] * length, 1),
                        (902, [None] * length, 1), (903, [float("inf")] * length, None)]
    assert run(spark, rows) == plain(rows)


def test_ties_and_equal_vectors(spark):
    rows = [(i, [float(i % 2)] * 16, None) for i in range(80)]  # equal entries: the lowest index wins
    got = run(spark, rows)
    assert got == plain(rows)
    assert {r[1][:2] for r in got} == {"00", "01"}


def test_cells_keep_every_nearest_entry():
    rng = np.random.default_rng(7)
    for entries in (rng.integers(-90, 90, (64, 4)), rng.integers(-3, 3, (64, 4)), rng.integers(-10**6, 10**6, (10, 2))):
        part = G.Part(entries.astype(np.int64), 1)
        x = np.concatenate([rng.integers(-200, 200, (4000, entries.shape[1])), entries, entries + 1])
        d = ((x[:, None, :] - entries) ** 2).sum(axis=2)
        for _ in range(2):  # the second time from memory
            code, best = part.nearest(x)
            assert (code == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    part = G.Part(rng.integers(-90, 90, (64, 4)), 1)
    assert part.candidates(rng.normal(0, 40, (5000, 4)).astype(np.int64)).mean() < 0.4  # most entries are not evaluated


def test_cells_of_one_hash_fall_back_to_all_entries():
    part = G.Part(np.arange(20, dtype=np.int64).reshape(10, 2) * 30, 1)
    part.odd = np.zeros(2, dtype=np.int64)  # every cell has the same hash
    x = np.random.default_rng(0).integers(-100, 700, (500, 2))
    d = ((x[:, None, :] - part.entries) ** 2).sum(axis=2)
    assert (part.nearest(x)[0] == d.argmin(axis=1)).all()


def test_other_lengths_empty_vectors_and_large_components(spark):
    rows = [(1, [1.0] * 16, 1), (2, [1.0, 2.0], 1), (3, [], None), (4, [3e38] * 16, 7), (5, [-3e38] * 16, 7)]
    got = {r[0]: r for r in run(spark, rows)}
    assert got[2][1:4] == (None, None, 0) and got[3][1:4] == (None, None, None)
    assert got[1][1:4] == ("00" * 16, 0, 0)
    assert got[4][1] == "01" * 16 and got[4][2] == 0
    assert run(spark, [(1, [], 3), (2, [], 3)]) == [(i, "00" * 16, 0, 0, hashlib.sha256(b"").hexdigest()) for i in (1, 2)]


def test_empty_table(spark):
    df = G.compress(table(spark, []))
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and df.count() == 0
    assert G.compress(table(spark, [(1, None, 1)])).count() == 0
