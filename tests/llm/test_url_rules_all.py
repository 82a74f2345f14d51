"""op13: rules below the threshold of FP-growth are found, whatever the number of items in a URL."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from cadence.llm import url_rules as U


def brute(rows, min_support, min_urls, min_confidence):
    """rows: (tokens, label). All combinations of merged tokens, by definition."""
    least = max(1, min_urls, math.ceil(len(rows) * min_support))
    where = {}
    for i, (tokens, _) in enumerate(rows):
        for t in tokens:
            where.setdefault(t, set()).add(i)
    merged = {}
    for t, at in where.items():
        merged.setdefault(frozenset(at), []).append(t)
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


@pytest.mark.parametrize("seed,bound", [(1, 2), (2, 3), (3, 5), (4, 0)])
def test_no_rule_is_lost_to_the_bound_of_fp_growth(spark, monkeypatch, seed, bound):
    monkeypatch.setattr(U, "MAX_ITEMS", bound)
    rng = random.Random(seed)
    urls = [f"http://{rng.choice(['a.net', 'b.net', 'c.info'])}/{rng.choice(['en', 'de'])}/{rng.choice(['buy', 'read'])}{rng.choice(['', '?page=1', '#top'])}"
            for _ in range(80)]
    label = ["block" if ("/de/" in u and "info" in u) or ("a.net" in u and "buy" in u) or rng.random() < 0.15 else "allow" for u in urls]
    given = spark.createDataFrame(list(zip(urls, label)) + [("http://x.net/", None)], "url string, verdict string")
    settings = dict(min_support=0.05, min_urls=2, min_confidence=0.6)
    tokens = [r.t for r in given.select(U.tokens_of(F.col("url")).alias("t")).collect()][:len(urls)]
    want = brute(list(zip(tokens, label)), **settings)
    got = {(tuple(r.tokens), r.verdict, r.support, r.confidence) for r in U.mine(given, **settings).collect()}
    assert got == want and any(len(r[0]) > 1 for r in want)


def test_rules_of_long_urls_are_mined(spark):
    """Twenty words a URL, all of other numbers of URLs, and one of fewer than FP-growth can take beside them."""
    words = [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(f"http://s.net/{'/'.join(words[i % 20:])}", "allow" if i % 3 else "block") for i in range(400)]
    rows += [(f"http://s.net/{'/'.join(words)}/rare", "block") for _ in range(6)]
    given = spark.createDataFrame(rows, "url string, verdict string")
    rare = lambda **kw: [r for r in U.mine(given, min_urls=5, min_support=0.0, **kw).collect() if r.tokens == ["p:rare"]]
    assert [(r.verdict, r.support, r.confidence) for r in rare()] == [("block", 6, 1.0)]
    assert rare(max_items=14) == []  # a caller's own bound
