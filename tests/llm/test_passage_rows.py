"""op2: passages behind partial variants are paired with one text of a round."""

import random

from cadence.llm import compact_windows as C


def test_copies_behind_partial_variants_have_few_rows(spark):
    texts, variants, copies = [], 8, 24
    for g in range(variants):
        rng = random.Random(300 + g)
        new = lambda n: [f"g{g}v{rng.randrange(10 ** 9)}" for _ in range(n)]
        passage = new(60)
        early = [[f"z{rng.randrange(10 ** 9)}" if (j + k) % 11 == 0 else w for j, w in enumerate(passage)] for k in range(11)]
        texts += [(100 * g + k, new(40) + w + new(40)) for k, w in enumerate(early)]
        texts += [(100 * g + 20 + k, new(30) + passage + new(50)) for k in range(copies)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id long, text string")
    rows = C.repeated_passages(docs).collect()
    whole = {r.doc_id for r in rows if r.start_word <= 32 and r.end_word >= 88 and r.similarity >= 0.8}
    assert {100 * g + 20 + k for g in range(variants) for k in range(1, copies)} <= whole
    assert len({(r.doc_id, r.other_id) for r in rows}) <= len(texts)
