"""Text operators of the training-data subpackage against brute force, round trips and held-out accuracy."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from cadence.llm import compact_windows, curriculum, html_extract, language_id, pii, piece_bpe
from cadence.llm.minhash_dedup import minhash_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, texts, **extra):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def brute_components(texts, width, percent=80):
    sets, first = {}, {}
    for i, t in texts:
        x = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(x[j:j + width]) for j in range(len(x) - width + 1)} if len(x) >= width else ({tuple(x)} if x else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(120)] for _ in range(12)]
    texts = []
    for k in range(150):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8, 15])):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append((k, (" " if k % 2 else "\n").join(t).upper() if k % 3 == 0 else " ".join(t)))
    return texts + [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one"), (1004, "ONE"), (1005, "one two"), (1006, "x" * 30000)]


@pytest.mark.parametrize("width", [2, 5])
def test_minhash_matches_all_pairs(spark, width):
    texts = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup(frame(spark, texts), width=width).collect()}
    want = brute_components(texts, width)
    assert {i: v[:2] for i, v in got.items()} == want
    assert all(v[2] == (i == v[1]) for i, v in got.items())


def test_minhash_edges(spark):
    assert minhash_dedup(spark.createDataFrame([], DOCS)).count() == 0
    rows = minhash_dedup(frame(spark, [(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (3, "A B C D E F")])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in rows) == [(-1, -1, False), (3, 3, True), (7, 3, False), (7, 3, False)]


def test_piece_bpe_matches_library(spark):
    import sentencepiece

    model = piece_bpe.default_model()
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    table = piece_bpe.PieceTable(model)
    rng = random.Random(3)
    alphabet = ["a", "e", "th", "▁", " ", "  ", "\n", "é", "🙂", "日", "0", "==", "the", "ing", "\t", "́", "д", "\x00", "'"]
    texts = ["", " ", "   a", "\n", "▁▁x", "<s> hi", "ab" * 3000, " " * 200 + "x", "\x7f\x85"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 50))) for _ in range(1500)]
    for t in texts:
        ids = sp.encode(t)
        joined, n, decoded = table.encode(t)
        assert (joined, n, decoded) == (",".join(map(str, ids)), len(ids), sp.decode(ids)), t
        assert table.decode(ids) == sp.decode(ids)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: sp.encode(r.text) for r in docs.collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in piece_bpe.encode_texts(docs, model, digest=True).collect():
        assert r.ids_sha256 == sha(",".join(map(str, want[r.doc_id]))) and r.decoded_sha256 == sha(sp.decode(want[r.doc_id]))
    rows = piece_bpe.encode_texts(frame(spark, [(1, None), (2, "Hi you")]), model)
    assert {r.doc_id: r.ids for r in rows.collect()} == {1: [], 2: sp.encode("Hi you")}
    assert {r.doc_id: r.decoded for r in piece_bpe.decode_ids(rows, model).collect()} == {1: "", 2: "Hi you"}


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    rows = language_id.language_id(frame(spark, [(1, None), (2, ""), (3, "12 34 !!"), (4, "hello there"), (6, "good day")])).collect()
    got = {r.doc_id: r.lang_pred for r in rows}
    assert [got[i] for i in (1, 2, 3)] == ["und"] * 3 and got[4] == "en"
    assert language_id.language_id(spark.createDataFrame([], DOCS)).count() == 0
    none = spark.createDataFrame([(1, "abc", None, None, 3)], DOCS)
    assert language_id.language_id(none).first().lang_pred == "und"


def plain_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_pii_base_spans_match_patterns(spark):
    rng = random.Random(8)
    parts = ["a", "b_", "@", ".", "x.y", "1", "23", "255", "256", "4539 1488 0343 6467", "-", " ", "+", "+1 (555) 010-9999", "\n", "é",
             "10.0.0.1", "a@b.co", "%", "4012-8888-8888-1881", "００"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))
        assert pii.base_spans(t) == plain_spans(t), t
    long = "1" * 100_000 + "a" * 100_000 + "@" + "b" * 100_000
    assert pii.base_spans(long) == []


def test_pii_field_learns_and_keeps_base(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(frame(spark, [(90001, None), (90002, ""), (90003, "mail x@y.org now")]))
    field = pii.train(docs)
    rows = pii.find_pii(docs, field, redact=True).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        base = [f"{k}:{a}:{b}" for k, a, b in plain_spans(texts[r.doc_id] or "")]
        assert set(base) <= set(filter(None, r.spans.split(",")))
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len(base)
    got = {r.doc_id: r.redacted for r in rows}
    assert got[90001] is None and got[90002] == "" and got[90003] == "mail <EMAIL> now"
    # the field alone finds most of the labelled words of chains that it was not trained on
    held = [t for t in (r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect())]
    hit = total = 0
    for t in held:
        spans = pii.base_spans(t)
        if spans:
            ch = [c for c in pii.chains(t) if len(c) <= 60]
            words = [[t[a:b] for a, b in c] for c in ch]
            found = field.decode(words, 0.0) if words else []
            for c, f in zip(ch, found):
                lab = pii.label_words(t, c, spans)
                marked = {j for _, a, b in f for j in range(a, b)}
                total += sum(map(bool, lab))
                hit += sum(1 for j, y in enumerate(lab) if y and j in marked)
    assert total > 30 and hit / total >= 0.8
    # a shape that the patterns miss
    extra = pii.all_spans(["call 0049 mail someone@example,org end"], pii.ChainField(), 4.0)
    assert extra[0] == ([], [])
    assert pii.find_pii(spark.createDataFrame([], DOCS), field).count() == 0


def test_html_extract(spark):
    page = ("<html><head><title>t</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><a href=x>Menu</a></nav>"
            "<div class='ad'>Buy now</div><article><header><h1>Head &amp; more</h1></header><p><b>One\n  two<br><p>Three<!-- c --> four</p>"
            "<aside>side</aside><form><input>f</form><div class='comments'>nice post</div><p>Five &eacute;</p></article><footer>&copy; me</footer></body></html>")
    assert html_extract.extract(page) == "Head & more\nOne two\nThree four\nFive é"
    body = "".join(f"<p>{'long sentence of real content number ' * 4}{i}</p>" for i in range(6))
    free = f"<html><body><ul><li><a href=1>Home</a></li><li><a href=2>About</a></li></ul><div>{body}</div><div id='footer'>c</div></body></html>"
    assert html_extract.extract(free).count("\n") == 5 and "Home" not in html_extract.extract(free)
    for bad in (None, "", "<script>x</script>", "<!-- -->", "<p", "</div></p>"):
        assert html_extract.extract(bad) in ("", "<p")
    deep = "<article>" + "<div>" * 3000 + "word " * 20000 + "</div>" * 3000
    assert len(html_extract.extract(deep)) == 5 * 20000 - 1
    pages = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, None, None)], "page_id long, url string, html string")
    rows = html_extract.extract_text(pages).collect()
    assert sorted((r.page_id, r.n_chars) for r in rows) == [(1, 37), (1, 37), (2, 0)]
    assert html_extract.extract_text(pages.limit(0)).count() == 0


def test_html_article_is_no_switch():
    body = "".join(f"<div>{'long sentence of real content number ' * 8}{i}</div>" for i in range(5))
    cards = "".join(f"<article><h3><a href={i}>Card {i}</a></h3><p>Teaser {i}</p></article>" for i in range(4))
    assert html_extract.extract(f"<body>{body}<div>{cards}</div></body>").count("long sentence") == 8 * 5
    assert "Teaser 3" not in html_extract.extract(f"<body>{body}<div>{cards}</div></body>")
    story = "<h1>Head</h1>" + "".join(f"<p>{'words of the story go on ' * 6}{i}</p>" for i in range(4)) + "<p>End.</p>"
    told = html_extract.extract(f"<article class='post has-sidebar'>{story}<p class='advert'>Buy the {'thing ' * 30}</p></article>"
                                f"<article class='comment'><p>{'I liked this ' * 20}</p></article>")
    assert told.startswith("Head\n") and told.endswith("End.") and "Buy" not in told and "liked" not in told
    short = "<article>" + "<p>A short line.</p>" * 30 + "</article>"
    assert html_extract.extract(f"{short}<div>{'one long disclaimer ' * 10}</div>").count("A short line.") == 30


def test_html_pages_keep_whole_article(spark):
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S).group(1)
        import html
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", b))).strip() for b in re.split(r"</?(?:p|h1|br|div)[^>]*>", body)]
        assert html_extract.extract(r.html) == "\n".join(b for b in blocks if b)


def test_curriculum(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 60))), "en", rng.choice(["a", "b", None, "z"] + ["hot"] * 5), 0) for i in range(600)]
    rows += [(5000, None, "en", "a", 0), (5001, "x " * 20, "en", "tiny", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    plan = curriculum.plan(docs).collect()
    size = collections.Counter()
    src = {r[0]: r[3] for r in rows}
    for i, t, _, s, _ in rows:
        size[s] += len((t or "").split())
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full, total = set(), 1.5 * sum(size.values())
    while True:  # reshare until no source is above its cap
        rest = total - sum(2 * size[s] for s in full)
        open_ = [s for s in names if s not in full]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    target = {s: 2.0 * size[s] if s in full else share[s] for s in names}
    taken = collections.Counter()
    for r in plan:
        assert r.source_size == size[src[r.doc_id]] and r.target == pytest.approx(target[src[r.doc_id]])
        assert 0 <= r.taken <= 2 * r.size and len(r.positions) * r.size == r.taken
        taken[src[r.doc_id]] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= 60
    order = curriculum.mix(docs).collect()
    assert [r.position for r in order] == sorted(r.position for r in order) and all(0 <= r.position <= 1 for r in order)
    assert curriculum.plan(docs.limit(0)).count() == 0
    assert sorted(map(tuple, curriculum.plan(docs.repartition(7)).drop("positions").collect())) == sorted(
        tuple(r)[:-1] for r in plan)
    whole = curriculum.training_order(docs.withColumn("position", F.lit("x")))  # an extra column with a clashing name
    got = whole.select("doc.doc_id", "doc.position", "copy", F.col("position").alias("at")).collect()
    assert sorted((r.doc_id, r.copy) for r in got) == sorted((r.doc_id, r.copy) for r in order)
    assert [r["at"] for r in got] == sorted(r["at"] for r in got) and all(r.position == "x" for r in got)
    near = {(r.doc_id, r.copy): r.position for r in order}
    assert all(abs(near[r.doc_id, r.copy] - r["at"]) <= 60 * 2 / target[src[r.doc_id]] for r in got if src[r.doc_id] == "hot")
    assert curriculum.training_order(docs.limit(0)).count() == 0


def test_compact_windows_definition():
    import numpy as np

    rng = np.random.default_rng(0)
    for n, t in ((5, 8), (40, 6), (200, 13), (64, 64), (100, 1)):
        v = rng.integers(0, 50, n).astype(np.uint64)
        got = sorted(zip(*(x.tolist() for x in compact_windows.windows(v, t))))
        want = []
        for c in range(n):
            lo = c
            while lo > 0 and v[lo - 1] > v[c]:
                lo -= 1
            hi = c
            while hi < n - 1 and v[hi + 1] >= v[c]:
                hi += 1
            if hi - lo + 1 >= t:
                want.append((lo, c, hi))
        assert got == sorted(want)


def test_repeated_passages_found(spark):
    rng = random.Random(4)
    new = lambda n: [f"v{rng.randrange(10 ** 9)}" for _ in range(n)]
    exact, near = new(70), new(120)
    edited = list(near)
    for i in range(10, 120, 40):
        edited[i] = "changed"
    short = new(20)
    texts = [(1, new(200) + exact + new(90)), (2, new(10) + exact + new(400)), (3, exact), (4, new(100) + near + new(50)),
             (5, near[:0] + edited + new(60)), (6, new(300) + short), (7, short + new(200)), (8, new(500)), (9, []), (11, new(30))]
    docs = frame(spark, [(i, " ".join(w)) for i, w in texts] + [(10, None), (12, "x" * 50000)])
    rows = compact_windows.repeated_passages(docs).collect()
    pairs = {frozenset((r.doc_id, r.other_id)) for r in rows}
    assert {frozenset(p) for p in ((1, 2), (1, 3), (4, 5))} <= pairs | {frozenset((2, 3))}
    assert all(i not in p for p in pairs for i in (6, 7, 8, 9, 10, 11, 12))
    two = next(r for r in rows if r.doc_id == 2)
    assert (two.start_word, two.end_word) == (10, 80)
    five = next(r for r in rows if 5 in (r.doc_id, r.other_id))
    assert five.n_words >= 100 and five.similarity >= 0.8
    assert compact_windows.repeated_passages(docs.limit(0)).count() == 0


def test_repeated_passages_behind_partial_variants(spark):
    texts, variants = [], 12
    for g in range(variants):
        rng = random.Random(100 + g)
        new = lambda n: [f"g{g}v{rng.randrange(10 ** 9)}" for _ in range(n)]
        passage = new(60)
        edited = list(passage)
        for i in (9, 27, 45):
            edited[i] = "changed"
        early = [edited, passage[:38] + new(30), new(30) + passage[24:]]
        texts += [(10 * g + k, new(40) + w + new(40)) for k, w in enumerate(early)]
        texts += [(10 * g + k, new(30) + passage + new(50)) for k in (8, 9)]
    rows = compact_windows.repeated_passages(frame(spark, [(i, " ".join(w)) for i, w in texts])).collect()
    whole = {r.doc_id for r in rows if r.start_word <= 32 and r.end_word >= 88 and r.similarity >= 0.8}
    assert {10 * g + 9 for g in range(variants)} <= whole


def test_shapes_read_whole_words():
    """A word is judged by all of its characters, however long it is."""
    long = "a" * 300 + "@" + "7" * 40
    assert pii._shape(long) == "x5@d5"
    assert pii._shape("漢" * 500 + "+1") == "x5+d1"


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGS", 3)
    rows = spark.createDataFrame([(i, f"some words {i}", f"l{i % 4}") for i in range(8)], "key long, text string, lang string")
    with pytest.raises(ValueError):
        language_id.train(rows)
    assert language_id.train(rows.filter("lang <> 'l3'")).langs == ["l0", "l1", "l2"]


def test_piece_bpe_keeps_segments_in_use(monkeypatch):
    """A full cache keeps the segments in use, and a word before a full stop is the word's own entry."""
    import sentencepiece

    model = piece_bpe.default_model()
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    monkeypatch.setattr(piece_bpe, "CACHE_SEGMENTS", 8)
    table = piece_bpe.PieceTable(model)
    seen, tokens = [], table.tokens
    monkeypatch.setattr(table, "tokens", lambda s: seen.append(s) or tokens(s))
    for i in range(40):
        for text in (f"often w{i}q often. é{i}, ▁. often,!", "often."):
            ids = sp.encode(text)
            assert table.encode(text) == (",".join(map(str, ids)), len(ids), sp.decode(ids))
    assert seen.count("▁often") == 1 and "▁often." not in seen
