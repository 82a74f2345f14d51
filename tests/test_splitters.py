"""Level-synchronous splitters against a recursive DuckDB query."""

import random

import pytest

from cadence.operators.groups import split_segments


def _expected(nums, max_size, min_size, mode="widest", abs_t=0.0, rel_t=0.0):
    """Chunk sizes by a recursive DuckDB query over segments [lo, hi] of the sorted values.

    Every oversize segment is cut after its best-scored position; ties go to the position that is
    nearest to the middle, then to the earlier one.
    """
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE v AS SELECT row_number() OVER (ORDER BY x) - 1 AS i, x FROM (SELECT unnest($1::DOUBLE[]) AS x)", [list(map(float, nums))])
    score = "gap" if mode == "widest" else "gap / CASE WHEN abs(x) > 1e-9 THEN abs(x) ELSE 1 END"
    admitted = "true" if mode == "widest" else f"gap > {abs_t} AND score > {rel_t}"
    con.execute(f"CREATE TABLE g AS SELECT i, gap, {score} AS score FROM (SELECT i, x, lead(x) OVER (ORDER BY i) - x AS gap FROM v)")
    cut = f"""(SELECT arg_min(g.i, (-score, abs(g.i - s.lo - (s.hi - s.lo + 1) / 2.0), g.i)) FROM g WHERE {admitted}
               AND g.i >= s.lo + CASE WHEN {min_size} - 1 >= s.hi - s.lo + 1 - {min_size} THEN 0 ELSE {min_size} - 1 END
               AND g.i < CASE WHEN {min_size} - 1 >= s.hi - s.lo + 1 - {min_size} THEN s.hi ELSE s.hi + 1 - {min_size} END)"""
    rows = con.execute(f"""
        WITH RECURSIVE seg AS (
          SELECT 0 AS lo, (SELECT max(i) FROM v) AS hi, NULL::BIGINT AS cut, 0 AS done
          UNION ALL
          SELECT CASE WHEN side = 0 THEN lo ELSE c + 1 END, CASE WHEN side = 0 AND c IS NOT NULL THEN c ELSE hi END, NULL,
                 CASE WHEN c IS NULL THEN 1 ELSE 0 END
          FROM (SELECT s.lo, s.hi, CASE WHEN s.hi - s.lo + 1 > {max_size} THEN {cut} END AS c FROM seg s WHERE done = 0) t,
               (VALUES (0), (1)) sides(side)
          WHERE side = 0 OR c IS NOT NULL)
        SELECT hi - lo + 1 FROM seg WHERE done = 1 ORDER BY lo""").fetchall()
    return [r[0] for r in rows]


def _spark_sizes(spark, nums, max_size, min_size, **kw):
    df = spark.createDataFrame([("a", float(x), f"{i:06d}") for i, x in enumerate(nums)], "acc string, v double, id string")
    out = split_segments(df, ["acc"], "v", "id", max_size, min_size, **kw).select("chunk", "chunk_size").distinct()
    return [r.chunk_size for r in sorted(out.collect(), key=lambda r: r.chunk)]


# worked examples
CASES = [
    ([10, 12, 15, 100, 102, 105, 500, 501], 3, 2),
    (list(range(1, 11)), 5, 3),
    ([9.9] + [10] * 5 + [50] * 3, 5, 2),
    ([1, 2, 10, 11, 12, 13, 20, 21], 5, 3),
]


@pytest.mark.parametrize("nums,mx,mn", CASES)
def test_widest_gap_examples(spark, nums, mx, mn):
    assert _spark_sizes(spark, nums, mx, mn) == _expected(nums, mx, mn)


def test_widest_gap_random(spark):
    random.seed(5)
    nums = [round(random.expovariate(0.05), 2) for _ in range(700)]
    assert _spark_sizes(spark, nums, 60, 8) == _expected(nums, 60, 8)


def test_hybrid_random(spark):
    random.seed(9)
    nums = [round(random.choice([5, 20, 80, 300]) * random.uniform(0.8, 1.2), 2) for _ in range(600)]
    assert _spark_sizes(spark, nums, 50, 8, mode="hybrid", abs_thresh=5.0, rel_thresh=0.3) == \
        _expected(nums, 50, 8, "hybrid", 5.0, 0.3)


def _checkpoints(spark, monkeypatch):
    """Counts materialised tables."""
    made, frame = [], type(spark.range(1))
    plain = frame.checkpoint
    monkeypatch.setattr(frame, "checkpoint", lambda self, *a, **k: made.append(1) or plain(self, *a, **k))
    return made


@pytest.mark.parametrize("local,most", [(2_000_000, 6), (300, 20)])
def test_geometric_account_needs_few_rounds(spark, monkeypatch, local, most):
    """Every cut takes one end off: recursion depth is about rows / min_size, rounds are not."""
    nums = [1.01 ** i for i in range(800)]
    made = _checkpoints(spark, monkeypatch)
    assert _spark_sizes(spark, nums, 20, 2, local=local) == _expected(nums, 20, 2)
    assert len(made) <= most


@pytest.mark.parametrize("kind,local", [("mixed", 25), ("ties", 10), ("steps", 40), ("flat", 15)])
def test_rounds_equal_the_recursion(spark, kind, local):
    """Segments above ``local`` candidates go through the distributed rounds."""
    rng = random.Random(kind)
    nums = {"mixed": [round(rng.expovariate(0.02), 2) for _ in range(400)],
            "ties": [rng.randint(0, 60) for _ in range(300)],
            "steps": [i * (i + 1) / 2 for i in range(200)],
            "flat": [7.0] * 130}[kind]
    assert _spark_sizes(spark, nums, 12, 4, local=local) == _expected(nums, 12, 4)
    if kind == "mixed":
        assert _spark_sizes(spark, nums, 12, 4, mode="hybrid", abs_thresh=0.5, rel_thresh=0.01, local=local) == \
            _expected(nums, 12, 4, "hybrid", 0.5, 0.01)


def test_chunks_smaller_than_two_minima(spark):
    nums = [round(random.Random(1).uniform(0, 100), 1) for _ in range(90)]
    assert _spark_sizes(spark, nums, 3, 5) == _expected(nums, 3, 5)
    assert _spark_sizes(spark, nums, 3, 5, local=20) == _expected(nums, 3, 5)


def test_solver_equals_plain_recursion():
    import numpy as np

    from cadence.operators.split import Ranges, solve, valid_range

    rng = np.random.default_rng(4)
    for trial in range(60):
        n = int(rng.integers(1, 1600))
        pos = np.sort(rng.choice(n, size=int(rng.integers(0, n + 1)), replace=False))
        score = rng.integers(0, int(rng.integers(1, 40)) + 1, len(pos)).astype(float)
        mx, mn = int(rng.integers(1, 60)), int(rng.integers(1, 30))
        want, todo = [], [(0, n)]
        while todo:
            lo, k = todo.pop()
            start, end = valid_range(k, mx, mn)
            cand = [(-s, abs(p - (lo + k / 2)), p) for p, s in zip(pos, score) if lo + start <= p < lo + end]
            if k > mx and cand:
                cut = min(cand)[2]
                want.append(cut)
                todo += [(lo, cut - lo + 1), (cut + 1, k - (cut - lo + 1))]
        assert sorted(solve(pos, score, 0, n, mx, mn)) == sorted(want)
    s = rng.integers(0, 50, 5000).astype(float)
    r = Ranges(s)
    for _ in range(300):
        a, b = sorted(rng.integers(0, 5001, 2).tolist())
        if a == b:
            continue
        v = float(rng.integers(40, 51))
        hit = np.flatnonzero(s[a:b] >= v)
        assert r.top(a, b) == s[a:b].max()
        assert r.first(a, b, v) == (a + hit[0] if len(hit) else None)
        assert r.last(a, b, v) == (a + hit[-1] if len(hit) else None)


def test_empty_and_null_keys(spark):
    df = spark.createDataFrame([(None, 1.0, "x"), ("a", None, "y")], "acc string, v double, id string")
    out = split_segments(df, ["acc"], "v", "id", 3, 2).collect()
    assert [(r.acc, r.v, r.chunk, r.chunk_size) for r in out] == [("a", None, 0, 1)]
    assert split_segments(df.limit(0), ["acc"], "v", "id", 3, 2).count() == 0
