"""op11: alignment against the two libraries on whole texts, fragments at every cut, pair counts by brute force."""

import hashlib
import random

import numpy as np
import pytest

from cadence.llm import token_align as A

SCHEMA = "doc_id long, text string, row long, a string, n_a string, closed string"  # clashing extra columns


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    files = A.default_files()
    hf = Tokenizer.from_file(files[0])
    hf.encode_special_tokens = True
    return hf, sentencepiece.SentencePieceProcessor(model_file=files[1]), A.Coder(*files)


def plain(libraries, text):
    """(a ids, b ids, groups as lists of ids) by the definition."""
    hf, sp, coder = libraries
    if not text:
        return [], [], []
    body = (" " + text).encode()
    a, b = hf.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
    if b"".join(coder.bytes_a[i] for i in a) != body or b"".join(coder.bytes_b[i] for i in b) != body:
        return [], [], []
    ends = [np.cumsum([len(t[i]) for i in ids]).tolist() for ids, t in ((a, coder.bytes_a), (b, coder.bytes_b))]
    groups, i, j = [], 0, 0
    for e in sorted(set(ends[0]) & set(ends[1])):
        i2, j2 = ends[0].index(e) + 1, ends[1].index(e) + 1
        groups.append((a[i:i2], b[j:j2]))
        i, j = i2, j2
    return a, b, groups


def expected(libraries, rows):
    found = [(d, plain(libraries, t)) for d, t in rows]
    held = [{(x, y) for ga, gb in g for x in ga for y in gb} for _, (_, _, g) in found]
    count = {}
    for pairs in held:
        for p in pairs:
            count[p] = count.get(p, 0) + 1
    top = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for d, (a, b, groups) in found:
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        told = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((d, len(a), len(b), len(groups), len(links), sum(count[p] == top[p[0]] for p in links),
                    sum(count[p] for p in links), hashlib.sha256(told.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


TEXTS = ["the cat sat on the mat", "the cat sat on the mat", "", None, " ", "  two  spaces  ", "tabs\tand\nlines\r\n\r\nmore", "Größe 東京タワー 🙂🙂 naïve",
         "a▁b", "▁", "<s> </s> <unk> <|endoftext|> <0x41>", "x" * 700, "ab12cd34ef56" * 60, "don't we'll 'tis I'm", "é" * 300, " nbsp   em　",
         "\x00\x1c\x1d \x1e \x85 control", "a  b   c    d", "9" * 300 + " end", "word " * 200, "=" * 257 + "\n" * 50 + " " * 90 + "z",
         "́combining क्ष مرحبا", "مرحبا بالعالم 12 ١٢", "﻿bom", "ﬁ ligature ½ ²"]


def table(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x", "y", "z") for d, t in rows], SCHEMA)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("chunk,head", [(A.CHUNK, A.HEAD), (24, A.HEAD), (97, 40), (400, 0)])
def test_equal_to_libraries(spark, libraries, monkeypatch, chunk, head):
    monkeypatch.setattr(A, "FAN", 3)
    rows = list(enumerate(TEXTS)) + [(None, "the cat"), (3, "the cat"), (3, "the cat")]
    assert result(A.align_corpus(table(spark, rows), chunk=chunk, head=head)) == expected(libraries, rows)


def test_given_documents(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = expected(libraries, rows)
    assert result(A.align_corpus(docs)) == want
    assert result(A.align_corpus(docs, chunk=2000)) == want


def test_empty_table(spark):
    df = A.align_corpus(table(spark, []))
    assert df.count() == 0 and df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_composition_is_associative():
    """Any bracketing of any cut of two token streams closes the same groups."""
    rng = random.Random(3)
    for trial in range(200):
        length = rng.randint(1, 40)
        streams = []
        for _ in range(2):
            ends = sorted(rng.sample(range(1, length), rng.randint(0, length - 1))) + [length]
            streams.append(A.Side(range(len(ends)), ends))
        parts = rng.randint(1, 6)
        at = [[0, *sorted(rng.choices(range(length + 1), k=parts - 1)), length] for _ in range(2)]
        leaves = []
        for p in range(parts):
            f = A.align(*(s.part(c[p], c[p + 1]) for s, c in zip(streams, at)))
            leaves.append((f, [f.closed] if f.any else []))

        def tree(nodes):
            if len(nodes) == 1:
                return nodes[0]
            cut = rng.randint(1, len(nodes) - 1)
            (lf, lc), (rf, rc) = tree(nodes[:cut]), tree(nodes[cut:])
            f, met = A.compose(lf, rf)
            return f, lc + ([met] if met is not None else []) + rc

        want = np.intersect1d(streams[0].ends, streams[1].ends).tolist()
        for _ in range(4):
            f, closed = tree(leaves)
            ends = [int(f.prefix[0].ends[-1])] + [int(e) for c in closed for e in c[2]]
            assert ends == want and f.any
            assert not len(f.suffix[0].ids) and not len(f.suffix[1].ids)
            for side in (0, 1):
                ids = f.prefix[side].ids.tolist() + [i for c in closed for i in c[side].ids.tolist()]
                assert ids == streams[side].ids.tolist()
