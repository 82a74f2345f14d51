"""op13: fixed rules against a plain reading, mined rules and verdicts against all token combinations."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from cadence.llm import url_rules as U

SCHEMA = "page_id long, url string, host string, rule string, tokens string, row long"  # clashing extra columns


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", "r", "t", 1) for i, u in enumerate(urls)], SCHEMA)


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


ODD = [None, "", "no scheme/x", "://", "http://", "http://ORG", "http://org/", "https://Example.ORG/es/a?b#c", "http://a.example.org/en/12",
       "http://example.org/en/2", "http://xexample.org/es/", "http://com/fr/x", "http://a.com?/fr/", "http://a.com#/de/", "http://a.com/de/",
       "http://É.com/de/é", "a://b://org/", "http://a.b\nc.org/x\ny?z", "http://.org/es/", "http://example.org/ES/", "//x.org/"]


def test_host_path_and_fixed_rules(spark):
    got = U.judge(pages(spark, ODD), U.mine(U.labelled_by_rules(pages(spark, [])))).orderBy("page_id").collect()
    for url, row in zip(ODD, got):
        host, path, rule, verdict = plain_rule(url)
        assert (row.host, row.path, row.rule, row.verdict) == (host, path, rule, verdict or "allow"), url


def brute(rows, min_support, min_urls, min_confidence, max_items):
    """rows: (tokens, label). All combinations of merged tokens, by definition."""
    n = len(rows)
    least = max(1, min_urls, math.ceil(n * min_support))
    where = {}
    for i, (tokens, _) in enumerate(rows):
        for t in tokens:
            where.setdefault(t, set()).add(i)
    merged = {}
    for t, at in where.items():
        if len(at) >= least:
            merged.setdefault(frozenset(at), []).append(t)
    for i in range(n):
        mine = sorted((len(at) for at in merged if i in at), reverse=True)
        if len(mine) > max_items:
            least = max(least, mine[max_items] + 1)
    items = [(at, sorted(ts)) for at, ts in merged.items() if len(at) >= least]
    rules = {}
    for size in range(1, len(items) + 1):
        for chosen in itertools.combinations(range(len(items)), size):
            at = frozenset.intersection(*(items[c][0] for c in chosen))
            for v in ("allow", "block"):
                s = sum(rows[i][1] == v for i in at)
                if s >= least and s / len(at) >= min_confidence:
                    rules[frozenset(chosen), v] = s, s / len(at)
    kept = {(c, v): m for (c, v), m in rules.items()
            if not any(c2 < c and v2 == v and m2[1] >= m[1] for (c2, v2), m2 in rules.items())}
    return {(tuple(sorted(t for i in c for t in items[i][1])), v, *m) for (c, v), m in kept.items()}


def made(seed, n):
    rng = random.Random(seed)
    urls = []
    for _ in range(n):
        host = rng.choice(["shop.net", "www.casino-win.net", "a.info", "b.info"])
        urls.append(f"{rng.choice(['http', 'https'])}://{host}/{rng.choice(['en', 'de'])}/{rng.choice(['buy', 'read'])}{rng.choice(['', '?page=1', '#top'])}")
    return urls


@pytest.mark.parametrize("seed,max_items", [(1, 14), (2, 4), (3, 6)])
def test_rules_and_verdicts_equal_all_combinations(spark, seed, max_items):
    urls = made(seed, 60)
    rng = random.Random(seed)
    label = ["block" if "casino" in u or ("/de/" in u and "info" in u) or rng.random() < 0.1 else "allow" for u in urls]
    urls += urls[:5]
    label += label[:5]
    given = spark.createDataFrame(list(zip(urls, label)) + [("http://x.net/", None), ("http://x.net/", "unknown")], "url string, verdict string")
    settings = dict(min_support=0.05, min_urls=2, min_confidence=0.8, max_items=max_items)
    mined = U.mine(given, **settings)
    tokens = [r.t for r in given.select(U.tokens_of(F.col("url")).alias("t")).collect()][:len(urls)]
    want = brute(list(zip(tokens, label)), **settings)
    got = {(tuple(r.tokens), r.verdict, r.support, r.confidence) for r in mined.collect()}
    assert got == want and want
    fresh = made(seed + 10, 40) + [None, "", "http://unseen.example/none"]
    judged = {r.page_id: r for r in U.judge(pages(spark, fresh), mined).collect()}
    for i, r in enumerate(pages(spark, fresh).select(U.tokens_of(F.col("url")).alias("t")).collect()):
        hits = [(c, s, len(t), v == "block", t) for t, v, s, c in want if set(t) <= set(r.t)]
        best = max(hits, default=None)
        rule = plain_rule(fresh[i])
        assert judged[i].verdict == (rule[3] or ("allow" if best is None else "block" if best[3] else "allow"))
        if rule[3] is None:
            assert (judged[i].why and tuple(judged[i].why)) == (best and best[4])


def test_more_rules_than_may_be_broadcast_change_nothing(spark, monkeypatch):
    given = spark.createDataFrame([(u, "block" if "casino" in u else "allow") for u in made(5, 50)], "url string, verdict string")
    df = pages(spark, made(6, 30))
    want = sorted(map(str, U.judge(df, U.mine(given)).collect()))
    monkeypatch.setattr(U, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(U, "COPIES", 3)
    assert sorted(map(str, U.judge(df, U.mine(given)).collect())) == want


def test_long_urls_repeated_rows_empty_table(spark):
    long_url = "http://a.net/" + "/".join(f"w{i}" for i in range(3000))
    urls = [long_url] * 30 + ["http://b.org/" + "/".join(f"v{i}" for i in range(500))] * 30
    got = U.filter_urls(pages(spark, urls)).collect()
    assert [r.verdict for r in got].count("allow") == 60 and len(got) == 60
    assert U.filter_urls(pages(spark, [])).count() == 0


def test_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "http://a.org/", "h", "r", "t", 1), (None, "http://a.org/", "h", "r", "t", 1), (3, None, None, None, None, None),
                                (3, "http://b.com/de/x", "h", "r", "t", 1)], SCHEMA)
    got = sorted(((r.page_id, r.rule, r.verdict) for r in U.filter_urls(df).collect()), key=str)
    assert got == sorted([(None, "org/", "allow")] * 2 + [(3, None, "allow"), (3, "com/de/", "block")], key=str)
