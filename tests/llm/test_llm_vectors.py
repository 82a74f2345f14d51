"""Vector operators, the fixity audit, the pipeline and the registered oracles."""

import math
import os
import sys

import numpy as np
import pytest

import __spark_entry__ as E
from cadence.llm import mtree_topk, pivot_dedup, warc_audit

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))
SF = "/root/testdata/sf0.001"
VEC = "vec_id long, embedding array<float>, label int"


def vectors(n=1500, dim=64, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for k in range(0, n, 3):  # near copies, some in long chains
        x[k] = x[max(0, k - 6)] + rng.normal(size=dim) * rng.choice([0.02, 0.1, 0.15])
    x[5] = x[4] * 3
    return x.astype(np.float32)


def rows_of(x):
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    odd = [(5001, None, 1), (5002, [0.0] * x.shape[1], 1), (5003, [math.nan] * x.shape[1], 1), (5004, [math.inf] + [0.0] * (x.shape[1] - 1), 1),
           (5005, [], 1), (5006, [1.0, 2.0], 1), (5007, [None] * x.shape[1], 1)]
    return rows + odd + rows[:3]


def test_pivot_dedup_matches_brute_force(spark):
    x = vectors()
    got = {r.vec_id: r for r in pivot_dedup.near_duplicates(spark.createDataFrame(rows_of(x), VEC)).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    found = sum(got[i].n_links for i in range(len(x)))
    assert found <= link.sum() and found >= 0.97 * link.sum()
    root = np.arange(len(x))
    while True:
        new = np.array([min(root[i], root[link[i]].min(initial=10 ** 9)) for i in range(len(x))])
        if (new == root).all():
            break
        root = new
    same = sum(got[i].component_id == root[i] for i in range(len(x)))
    assert same >= 0.97 * len(x) and all(got[i].kept == (got[i].component_id == i) for i in got)
    for i in range(5001, 5008):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert pivot_dedup.near_duplicates(spark.createDataFrame([], VEC)).count() == 0


def test_pivot_dedup_links_every_length(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(np.repeat(rng.normal(size=(200, 16)), 2, axis=0))]
    rows += [(1000 + i, [float(v) for v in r], 0) for i, r in enumerate(np.repeat(rng.normal(size=(3, 24)), 2, axis=0))]
    rows += [(2000, [1.0] * 40, 0), (2001, [2.0], 0), (2002, [5.0], 0)]
    got = {r.vec_id: r for r in pivot_dedup.near_duplicates(spark.createDataFrame(rows, VEC)).collect()}
    assert all(got[i].n_links >= 1 and got[i].component_id <= i - i % 2 for i in (*range(400), *range(1000, 1006)))
    assert all(got[i].component_id >= 1000 for i in range(1000, 1006))
    assert (got[2000].n_links, got[2001].n_links, got[2002].component_id) == (0, 1, 2001)


def test_pivot_dedup_long_lists_are_split(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.concatenate((np.repeat(rng.normal(size=(1, 64)), 300, axis=0) + rng.normal(size=(300, 64)) * 0.02, rng.normal(size=(600, 64))))
    monkeypatch.setattr(pivot_dedup, "CHUNK", 64)
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    got = {r.vec_id: r for r in pivot_dedup.near_duplicates(spark.createDataFrame(rows, VEC)).collect()}
    assert all(got[i].n_links == 299 and got[i].component_id == 0 for i in range(300))


@pytest.mark.parametrize("group_rows", [4096, 64])
def test_mtree_matches_brute_force(spark, group_rows):
    x = vectors(1200, 16, 3)
    x[700] = x[300]  # ties
    x[100] = 0
    df = spark.createDataFrame(rows_of(x), VEC)
    got = {}
    for r in mtree_topk.top_k(df, group_rows=group_rows, routers=20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    z = np.floor(1024 * x.astype(np.float64)).astype(np.int64)
    for q in range(0, 1200, 100):
        s = z @ z[q]
        order = sorted((i for i in range(len(x)) if i != q), key=lambda i: (-s[i], i))[:10]
        assert sorted(got[q]) == [(k + 1, i, int(s[i])) for k, i in enumerate(order)]
    assert set(got) == set(range(0, 1200, 100))
    assert mtree_topk.top_k(spark.createDataFrame([], VEC)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.5], 0), (1, [0.3, 0.1], 0)], VEC)
    assert [tuple(r) for r in mtree_topk.top_k(few).collect()] == [(0, 1, 1, 307 * 1024 + 102 * 512)]


def test_subtree_skips_work_and_stays_exact(monkeypatch):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(1, 8)) * 500 + rng.normal(size=(600, 8)) * 3 for _ in range(6)]).astype(np.int64)
    tree = mtree_topk.Subtree(np.arange(len(x)), x)
    done = []
    plain = mtree_topk._dots
    monkeypatch.setattr(mtree_topk, "_dots", lambda a, b: done.append(a.shape[0] * b.shape[0]) or plain(a, b))
    q = x[::400]
    best, who = tree.search(np.arange(0, len(x), 400), q, np.full(len(q), np.iinfo(np.int64).min), 10)
    assert sum(done) < 0.7 * len(q) * len(x)
    for i, row in enumerate(q):
        s = x @ row
        s[400 * i] = np.iinfo(np.int64).min
        assert list(best[i]) == sorted(s.tolist(), reverse=True)[:10]


def test_audit_locates_damage(spark):
    pages = [(i, f"http://h/{i}", f"<p>{'text ' * (i % 9)}{i}</p>") for i in range(9000)]
    good = spark.createDataFrame(pages, "page_id long, url string, html string")
    other = [(i, u, h.replace("p", "q", 1) if i in (17, 4100) else h) for i, u, h in pages if i not in (8999, 5000)] + [(9500, "x", "y")]
    found = warc_audit.audit(warc_audit.tree(warc_audit.leaves(good)),
                             warc_audit.tree(warc_audit.leaves(spark.createDataFrame(other, "page_id long, url string, html string")))).collect()
    by = {}
    for r in found:
        by.setdefault(r.status, set()).add(r.record_id)
    assert by["corrupt"] == {17, 4100} and by["missing"] == {8999, 5000} and by["extra"] == {9500}
    assert by["moved"] == set(range(5001, 8192))  # those behind the lost record of their file
    same = warc_audit.tree(warc_audit.leaves(good))
    assert warc_audit.audit(same, same).count() == 0
    none = warc_audit.tree(warc_audit.leaves(good.limit(0)))
    assert warc_audit.audit(none, none).count() == 0
    odd = spark.createDataFrame([(None, None, None), (1, "u", "h"), (1, "u", "h")], "page_id long, url string, html string")
    assert {r.status for r in warc_audit.audit(warc_audit.tree(warc_audit.leaves(odd)), none).collect()} == {"missing"}


def test_pipeline_stages(spark):
    import corpus_pipeline as P
    from test_llm_text import brute_components, plain_spans

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(90000, None, "en", "src0", 0), (90001, "123 456", "en", "src0", 7), (90002, "Mail bob@example.org or the other one of them and that.", "en", "src0", 55)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    one = P.stored(P.language_stage(spark, docs, SF))
    assert ids(docs) - ids(one) == {90000, 90001} and one.columns == list(P.COLUMNS)
    two = P.stored(P.dedup_stage(spark, one, SF))
    comp = brute_components([(r.doc_id, r.text) for r in one.collect()], 5)
    assert ids(two) == {i for i, (_, c) in comp.items() if i == c}
    three = P.stored(P.pii_stage(spark, two, SF))
    before = {r.doc_id: r.text for r in two.collect()}
    for r in three.collect():
        assert r.n_chars == len(r.text) and not plain_spans(r.text)
        if not plain_spans(before[r.doc_id]):
            assert r.text == before[r.doc_id] or "<" in r.text
    four = P.stored(P.mix_stage(spark, three, SF))
    words = sum(len(r.text.split()) for r in three.collect())
    assert sum(len(r.text.split()) for r in four.collect()) == pytest.approx(1.5 * words, rel=0.2)
    assert four.columns == list(P.COLUMNS) and ids(four) <= ids(three)
    five = P.tokens_stage(spark, four, SF)
    assert five.count() == four.count() and five.filter("n_tokens <> size(ids)").count() == 0
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        empty = P.stored(stage(spark, empty, SF))
        assert empty.count() == 0


def test_pipeline_dedup_by_row(spark):
    import corpus_pipeline as P

    rng = np.random.default_rng(3)
    a, b, c, d = (" ".join(f"w{x}" for x in rng.integers(0, 10 ** 9, 60)) for _ in range(4))
    texts = [(None, a), (None, a + " end"), (1, b), (None, b + " end"), (2, c), (2, d), (3, d + " end"), (4, c + " more"), (4, a + " more"),
             (5, " ".join(a.split()[::-1])), (5, " ".join(a.split()[::-1]) + " end")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text.split()[0]) for r in P.dedup_stage(spark, docs, SF).collect()]
    assert sorted(got) == sorted([(4, a.split()[0]), (1, b.split()[0]), (2, c.split()[0]), (2, d.split()[0]), (5, a.split()[-1])])


@pytest.mark.parametrize("name", ["op1_pivot_dedup", "op3_curriculum_mix", "op4_merkle_audit", "op10_mtree_topk"])
def test_oracles(spark, duck, name):
    from oracle_check import digest

    got = E.queries()[name](spark, SF)
    cur = duck.execute(E.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert digest(got.columns, [tuple(r) for r in got.collect()])[1] == digest(names, cur.fetchall())[1]
