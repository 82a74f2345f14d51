"""Cross-tokenizer alignment: token groups that end at the same bytes, composed as an associative monoid.

Two tokenizers cover the same bytes (a space and the text). Byte offsets where tokens of both end
cut them into groups; every pair of an A and a B token of one group is a link.

A stretch of bytes yields a fragment: an open prefix (tokens up to its first common end), closed
groups, and an open suffix (tokens after its last common end); without a common end all its tokens
are open. Two neighbours compose: the left one's suffix and the right one's prefix are aligned
together, which may close further groups. Composition is associative, so the fragments of a very
long document are made in many tasks and reduced in a tree of FAN children a node. The nodes carry
open tokens only; closed groups stay in stored rows, under the place where they were closed, and one
pass over a document's rows in order gives its digest.

A document of up to CHUNK bytes is one fragment. A longer one is cut near every CHUNK bytes, for each
tokenizer where none of its tokens can cross: A before a single space between two non-spaces and
between an ASCII letter and digit, B before a space that follows a non-space. A stretch without
such a place is not cut.

Within a fragment, segments between single spaces are encoded once for each task (a bounded memory).
Latin segments of A take the rank file of the same vocabulary, others the vocabulary's own library.

An id pair's count is the number of documents that hold it linked. The HEAD most frequent pairs at
most are broadcast (below 100 MB), all other pairs are joined by shuffle.

Defined results: texts that are null, empty, or whose joined token bytes of A or B differ from a
space and the text (U+2581 in a text) have no tokens: zeros and an empty digest. Repeated rows
are documents each, null ids are ids like others, other columns are ignored, an empty table gives
an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm.store import stored
from cadence.llm.wordhash import slices

CHUNK = 1 << 15
FAN = 16
HEAD = 1_000_000
MEMO = 300_000  # segments of a tokenizer that a task remembers
MEMO_CHARS = 48
BATCH_BYTES = 1 << 19
#: Between segments: a single space between two characters that no tokenizer counts as white space.
CUT = re.compile(r"(?<=[^\s\x1c-\x1f\x85])(?= [^\s\x1c-\x1f\x85])")
CUT_A = re.compile(CUT.pattern + r"|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
CUT_B = re.compile(r"(?<=[^ ])(?= )")

ADJACENT = re.compile(r"\s\s")
#: Segments that both byte-level encoders split alike: ASCII and Latin letters, no space at either end but the first.
PLAIN = re.compile(r" [!-~\xa1-\u017f](?:[\x00-\x7f\xa1-\u017f]*[!-~\xa1-\u017f])?")

PAIRS = "a array<int>, b array<int>, m array<bigint>"
FRAGMENT = ("row long, doc_id long, place long, ok boolean, n_a long, n_b long, n_groups long, n_links long, closed binary, " + PAIRS)
OPEN = ("row long, lo long, hi long, any boolean, pa array<int>, pae array<long>, pb array<int>, pbe array<long>, "
        "sa array<int>, sae array<long>, sb array<int>, sbe array<long>")


def _alphabet() -> dict[str, int]:
    """Byte of each character of byte-level vocabularies: printable ones stand for themselves, the rest follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Coder:
    """Ids and token bytes of both tokenizers for segments of text."""

    def __init__(self, byte_json: str, piece_model: str, ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.hf = Tokenizer.from_file(byte_json)
        self.hf.encode_special_tokens = True
        with open(byte_json, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        byte = _alphabet()
        spell = {i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, i in vocab.items()}
        self.bytes_a = [spell.get(i, b"") for i in range(max(spell) + 1)]
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            if all(spell.get(i) == t for t, i in table.items()):
                self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.sp = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.bytes_b = [bytes((int(p[3:5], 16),)) if self.sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size = tuple(np.array([len(t) for t in b], dtype=np.int64) for b in (self.bytes_a, self.bytes_b))
        # decimal ids with what follows them: a comma, a bar (last A of a group), a semicolon (last B of a group)
        most = max(len(self.bytes_a), len(self.bytes_b))
        self.told = np.array([f"{i}{c}".encode() for c in ",|;" for i in range(most)], dtype=object)
        self.most = most
        self.memo: tuple[dict, dict] = {}, {}

    def encode(self, side: int, segments: list[str]) -> list[bytes]:
        """Ids of each segment as packed 32-bit integers, empty where its token bytes differ from it.

        A segment of B starts with a space.
        """
        memo = self.memo[side]
        got = list(map(memo.get, segments))
        missing = [i for i, g in enumerate(got) if g is None]
        if missing:
            new = list(dict.fromkeys([segments[i] for i in missing]))
            fresh = dict(zip(new, self._pieces(new) if side else self._byte_tokens(new)))
            for i in missing:
                got[i] = fresh[segments[i]]
            if len(memo) + len(fresh) > MEMO:
                memo.clear()
            memo.update((s, v) for s, v in fresh.items() if len(s) <= MEMO_CHARS)
        return got

    def _checked(self, side: int, segment: str, ids) -> bytes:
        table = (self.bytes_a, self.bytes_b)[side]
        if b"".join([table[i] for i in ids]) != segment.encode():
            return b""
        return np.array(ids, dtype=np.int32).tobytes()

    def _pieces(self, segments: list[str]) -> list[bytes]:
        got = self.sp.encode([s[1:] for s in segments], num_threads=1)
        return [self._checked(1, s, ids) for s, ids in zip(segments, got)]

    def _byte_tokens(self, segments: list[str]) -> list[bytes]:
        """Plain segments are encoded as one text: no token crosses from one to the next."""
        plain = [i for i, s in enumerate(segments) if PLAIN.fullmatch(s)] if self.fast is not None else []
        got: list[bytes | None] = [None] * len(segments)
        if plain:
            text = "".join([segments[i] for i in plain])
            ids = np.array(self.fast.encode_ordinary(text), dtype=np.int32)
            ends = np.cumsum(self.size[0][ids])
            upto = np.cumsum([len(segments[i].encode()) for i in plain])
            at = np.searchsorted(ends, upto, side="right")
            if (ends[at - 1] == upto).all() and b"".join([self.bytes_a[i] for i in ids.tolist()]) == text.encode():
                packed = ids.tobytes()
                at = [0, *at.tolist()]
                for i, j, k in zip(plain, at, at[1:]):
                    got[i] = packed[4 * j:4 * k]
        hard = [i for i, g in enumerate(got) if g is None]
        for i, e in zip(hard, self.hf.encode_batch([segments[i] for i in hard], add_special_tokens=False)):
            got[i] = self._checked(0, segments[i], e.ids)
        return got

    def tokens(self, side: int, pieces: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For texts given as segments: (ids of all texts in order, ids per text, whether the joined bytes are the text's)."""
        parts = self.encode(side, [s for p in pieces for s in p])
        ids = np.frombuffer(b"".join(parts), dtype=np.int32)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        bounds = np.concatenate(([0], np.cumsum([len(p) for p in pieces], dtype=np.int64)))
        total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[bounds])
        return ids, total(sizes), total(sizes == 0) == 0


def segments(text: str) -> list[str]:
    """A text cut before every single space between two non-spaces."""
    if not text:
        return []
    if text[0] == " " and not ADJACENT.search(text) and not text[-1].isspace():  # every space is such a place
        return [" " + w for w in text[1:].split(" ")]
    return CUT.split(text)


class Side:
    """Tokens of one tokenizer in order: ids and absolute byte ends."""

    __slots__ = ("ids", "ends")

    def __init__(self, ids=(), ends=()):
        self.ids, self.ends = np.asarray(ids, dtype=np.int32), np.asarray(ends, dtype=np.int64)

    def __add__(self, other):
        return Side(np.concatenate((self.ids, other.ids)), np.concatenate((self.ends, other.ends)))

    def part(self, after: int, upto: int) -> "Side":
        """Tokens whose end lies in (after, upto]."""
        i, j = np.searchsorted(self.ends, (after, upto), side="right")
        return Side(self.ids[i:j], self.ends[i:j])


class Fragment:
    """Open prefix, closed stretch (its tokens and common ends), open suffix."""

    __slots__ = ("prefix", "suffix", "any", "closed")

    def __init__(self, prefix, suffix, any_end, closed):
        self.prefix, self.suffix, self.any, self.closed = prefix, suffix, any_end, closed


def align(a: Side, b: Side) -> Fragment:
    """The fragment of a stretch's tokens; ``closed`` holds (A, B, common ends) after the first common end."""
    common = np.intersect1d(a.ends, b.ends, assume_unique=True)
    if not len(common):
        return Fragment((a, b), (Side(), Side()), False, None)
    first, last, end = common[0], common[-1], np.iinfo(np.int64).max
    closed = (a.part(first, last), b.part(first, last), common[1:])
    return Fragment((a.part(-1, first), b.part(-1, first)), (a.part(last, end), b.part(last, end)), True, closed)


def compose(left: Fragment, right: Fragment) -> tuple[Fragment, tuple | None]:
    """(open ends of both stretches together, groups closed by meeting).

    A fragment without a common end keeps all its tokens in ``prefix``.
    """
    tail = left.suffix if left.any else left.prefix
    mid = align(tail[0] + right.prefix[0], tail[1] + right.prefix[1])
    if left.any and not right.any:  # all of mid follows the left one's last common end
        if not mid.any:
            return Fragment(left.prefix, mid.prefix, True, None), None
        a, b = mid.prefix[0] + mid.closed[0], mid.prefix[1] + mid.closed[1]
        first = mid.prefix[0].ends[-1:]
        return Fragment(left.prefix, mid.suffix, True, None), (a, b, np.concatenate((first, mid.closed[2])))
    if left.any:  # the right one's first common end closes mid whole
        a, b = mid.prefix[0] + mid.closed[0], mid.prefix[1] + mid.closed[1]
        first = mid.prefix[0].ends[-1:]
        return Fragment(left.prefix, right.suffix, True, None), (a, b, np.concatenate((first, mid.closed[2])))
    if not mid.any:
        return Fragment(mid.prefix, (Side(), Side()), False, None), None
    return Fragment(mid.prefix, right.suffix if right.any else mid.suffix, True, None), mid.closed if len(mid.closed[2]) else None


class Groups:
    """Statistics of groups of many stretches at once: per stretch texts, counts, links and id pairs."""

    def __init__(self, coder: Coder, a_ids, a_group, b_ids, b_group, groups_per: np.ndarray):
        """Groups are numbered through; ``groups_per`` of them belong to each stretch."""
        n = int(groups_per.sum())
        na, nb = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
        bounds = np.concatenate(([0], np.cumsum(groups_per)))
        total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[bounds])
        self.n_groups, self.n_a, self.n_b, self.n_links = groups_per, total(na), total(nb), total(na * nb)
        # decimal ids in order: A tokens of a group, then its B tokens
        a_upto, b_upto = np.cumsum(na), np.cumsum(nb)
        order = np.empty(len(a_ids) + len(b_ids), dtype=np.int64)
        codes_a, codes_b = a_ids.astype(np.int64), b_ids.astype(np.int64)
        codes_a[a_upto - 1] += coder.most
        codes_b[b_upto - 1] += 2 * coder.most
        order[np.arange(len(a_ids)) + (b_upto - nb)[a_group]] = codes_a
        order[np.arange(len(b_ids)) + a_upto[b_group]] = codes_b
        told = coder.told[order].tolist()
        at = np.concatenate(([0], np.cumsum(na + nb)))[bounds]
        self.texts = [b"".join(told[i:j]) for i, j in zip(at, at[1:])]  # every group ends in a semicolon
        self._pairs(a_ids, a_group, b_ids, na, nb, a_upto, b_upto, np.repeat(np.arange(len(groups_per)), groups_per), len(groups_per))

    def _pairs(self, a_ids, a_group, b_ids, na, nb, a_upto, b_upto, owner, stretches):
        large = na * nb > 1024  # such groups go through their distinct ids
        keys, times = [], []
        small = ~large[a_group]
        reps = np.where(small, nb[a_group], 0)
        first = (b_upto - nb)[a_group]
        total = int(reps.sum())
        if total:
            within = np.arange(total) - np.repeat(np.cumsum(reps) - reps, reps)
            b = b_ids[np.repeat(first, reps) + within]
            keys.append((np.repeat(owner[a_group], reps).astype(np.int64) << 34) | (np.repeat(a_ids, reps).astype(np.int64) << 17) | b)
            times.append(np.ones(total, dtype=np.int64))
        for g in np.flatnonzero(large):
            ua, ca = np.unique(a_ids[a_upto[g] - na[g]:a_upto[g]], return_counts=True)
            ub, cb = np.unique(b_ids[b_upto[g] - nb[g]:b_upto[g]], return_counts=True)
            keys.append((np.int64(owner[g]) << np.int64(34)) | (np.repeat(ua, len(ub)).astype(np.int64) << 17) | np.tile(ub, len(ua)))
            times.append(np.outer(ca, cb).ravel())
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        m = np.concatenate(times) if times else np.zeros(0, np.int64)
        order = np.argsort(key, kind="stable")
        key, m = key[order], m[order]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        self.times = np.add.reduceat(m, start) if len(start) else m
        key = key[start]
        self.at = np.searchsorted(key >> 34, np.arange(stretches + 1)).astype(np.int32)
        self.a = ((key >> 17) & 0x1FFFF).astype(np.int32)
        self.b = (key & 0x1FFFF).astype(np.int32)

    def columns(self) -> list[pa.Array]:
        """n_groups, n_links, closed, a, b, m of each stretch."""
        lists = [pa.ListArray.from_arrays(pa.array(self.at), pa.array(x)) for x in (self.a, self.b, self.times)]
        return [pa.array(self.n_groups.astype(np.int64)), pa.array(self.n_links.astype(np.int64)), pa.array(self.texts, pa.binary()), *lists]


def closed_groups(coder: Coder, closed: list[tuple]) -> Groups:
    """Groups of several stretches, each (A, B, common ends)."""
    a_ids, a_g, b_ids, b_g, per, base = [], [], [], [], [], 0
    for a, b, common in closed:
        a_ids.append(a.ids), b_ids.append(b.ids)
        a_g.append(base + np.searchsorted(common, a.ends)), b_g.append(base + np.searchsorted(common, b.ends))
        per.append(len(common))
        base += len(common)
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return Groups(coder, cat(a_ids).astype(np.int32), cat(a_g).astype(np.int64), cat(b_ids).astype(np.int32),
                  cat(b_g).astype(np.int64), np.array(per, dtype=np.int64))


_CODERS: dict[tuple, Coder] = {}


def coder(files: tuple) -> Coder:
    """One for each worker process."""
    if files not in _CODERS:
        _CODERS[files] = Coder(*files)
    return _CODERS[files]


def default_files() -> tuple:
    """Paths of the public tokenizer files installed beside the library: A, B, and A's rank file."""
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.tiktoken")


def _short(files: tuple):
    """Documents of one fragment: rows of FRAGMENT, whole documents."""
    def run(batches):
        c = coder(files)
        for batch in (p for whole in batches for p in slices(whole, 2, BATCH_BYTES)):
            texts = [" " + t if t else "" for t in batch.column(2).to_pylist()]
            pieces = [segments(t) for t in texts]
            (a, na, oka), (b, nb, okb) = c.tokens(0, pieces), c.tokens(1, pieces)
            ok = oka & okb & (na > 0)
            a, b = a[np.repeat(ok, na)], b[np.repeat(ok, nb)]
            na, nb = np.where(ok, na, 0), np.where(ok, nb, 0)
            # documents lie one after the other: their last ends are common, so no group crosses them
            a_end, b_end = np.cumsum(c.size[0][a]), np.cumsum(c.size[1][b])
            common = np.intersect1d(a_end, b_end, assume_unique=True)
            last = np.concatenate(([0], a_end))[np.cumsum(na)]
            upto = np.searchsorted(common, last, side="right")
            g = Groups(c, a, np.searchsorted(common, a_end), b, np.searchsorted(common, b_end), np.diff(np.concatenate(([0], upto))))
            n = batch.num_rows
            sha = [hashlib.sha256(t[:-1]).hexdigest().encode() if t else b"" for t in g.texts]
            cols = g.columns()
            cols[2] = pa.array(sha, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.zeros(n, np.int64)), pa.array(ok), pa.array(na.astype(np.int64)),
                 pa.array(nb.astype(np.int64)), *cols], names=["row", "doc_id", "place", "ok", "n_a", "n_b", "n_groups", "n_links", "closed", "a", "b", "m"])
    return run


def places(text: str, cut: re.Pattern, chunk: int = CHUNK) -> list[int]:
    """Character offsets of the cuts: for each multiple of ``chunk`` bytes (about) the first place at or after it."""
    wide = len(text.encode("utf-8", "surrogatepass")) / max(1, len(text))
    step = max(1, int(chunk / wide))
    out = [0]
    for nominal in range(step, len(text), step):
        m = cut.search(text, max(nominal, out[-1]))
        out.append(m.start() if m else len(text))
    return [*out, len(text)]


def _split(chunk: int):
    """Chunk rows of long documents: both tokenizers' stretches and the byte offsets where they start."""
    def run(batches):
        for batch in (p for whole in batches for p in slices(whole, 2, BATCH_BYTES)):
            for row, doc, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                body = " " + text
                at, bt = places(body, CUT_A, chunk), places(body, CUT_B, chunk)
                oa = ob = 0
                for i in range(len(at) - 1):
                    a, b = body[at[i]:at[i + 1]], body[bt[i]:bt[i + 1]]
                    yield pa.RecordBatch.from_pydict(
                        {"row": [row], "doc_id": [doc], "i": [i], "a": [a], "b": [b], "oa": [oa], "ob": [ob]},
                        schema=pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("i", pa.int64()), ("a", pa.string()),
                                          ("b", pa.string()), ("oa", pa.int64()), ("ob", pa.int64())]))
                    oa += len(a.encode())
                    ob += len(b.encode())
    return run


def _sides(x: Fragment) -> list:
    return [v for s in (*x.prefix, *x.suffix) for v in (s.ids, s.ends)]


def _fragments(files: tuple):
    """Chunk rows to closed groups (FRAGMENT) with the open ends (OPEN) beside them."""
    def run(batches):
        c = coder(files)
        for batch in (p for whole in batches for p in slices(whole, 3, BATCH_BYTES)):
            row, doc, i, a, b, oa, ob = (batch.column(k).to_pylist() for k in range(7))
            (ia, na, oka), (ib, nb, okb) = (c.tokens(side, [CUT.split(t) if t else [] for t in x]) for side, x in enumerate((a, b)))
            ea, eb = np.concatenate(([0], np.cumsum(na))), np.concatenate(([0], np.cumsum(nb)))
            ends = lambda ids, side, start: Side(ids, start + np.cumsum(c.size[side][ids]))
            parts = [align(ends(ia[ea[k]:ea[k + 1]], 0, oa[k]), ends(ib[eb[k]:eb[k + 1]], 1, ob[k])) for k in range(len(row))]
            none = (Side(), Side(), np.zeros(0, np.int64))
            g = closed_groups(c, [p.closed if p.any else none for p in parts])
            sides = list(zip(*map(_sides, parts)))
            kinds = [pa.list_(pa.int32()), pa.list_(pa.int64())] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(row, pa.int64()), pa.array(doc, pa.int64()), pa.array([2 * k + 1 for k in i], pa.int64()), pa.array(oka & okb),
                 pa.array(na.astype(np.int64)), pa.array(nb.astype(np.int64)), *g.columns(), pa.array(i, pa.int64()), pa.array(i, pa.int64()),
                 pa.array([p.any for p in parts]), *(pa.array([list(v) for v in s], k) for s, k in zip(sides, kinds))],
                names=["row", "doc_id", "place", "ok", "n_a", "n_b", "n_groups", "n_links", "closed", "a", "b", "m", "lo", "hi", "any",
                       "pa", "pae", "pb", "pbe", "sa", "sae", "sb", "sbe"])
    return run


def _reduce(files: tuple, root: bool):
    """Composes the up to FAN neighbours of one tree node; rows: the node's open ends, and the groups closed by meeting.

    At the root the prefix is a closed group as well, since a document starts at a common end.
    """
    import pandas as pd

    names = ["row", "lo", "hi", "any", "pa", "pae", "pb", "pbe", "sa", "sae", "sb", "sbe",
             "place", "n_groups", "n_links", "closed", "a", "b", "m"]

    def run(pdf):
        pdf = pdf.sort_values("lo")
        whole, out = None, []

        def emit(place, closed):
            g = closed_groups(coder(files), [closed])
            out.append([row, None, None, None, *[None] * 8, place, int(g.n_groups[0]), int(g.n_links[0]), g.texts[0],
                        g.a.tolist(), g.b.tolist(), g.times.tolist()])

        for r in pdf.itertuples(index=False):
            row = int(r.row)
            f = Fragment((Side(r.pa, r.pae), Side(r.pb, r.pbe)), (Side(r.sa, r.sae), Side(r.sb, r.sbe)), bool(r.any), None)
            if whole is None:
                whole, lo = f, int(r.lo)
            else:
                whole, closed = compose(whole, f)
                if closed is not None:
                    emit(2 * int(r.lo), closed)
            hi = int(r.hi)
        if root:
            if whole.any:
                emit(-1, (*whole.prefix, whole.prefix[0].ends[-1:]))
        else:
            out.append([row, lo, hi, whole.any, *(list(map(int, v)) for v in _sides(whole)), *[None] * 7])
        return pd.DataFrame(out, columns=names)
    return run


def _finish(batches):
    """Rows of FRAGMENT in order of (row, place): one row a document, its digest taken along the way."""
    now, state = None, None

    def done():
        row, doc, ok, na, nb, ng, nl, sha, empty = state
        told = sha.hexdigest().encode() if ok and not empty else b""
        keep = lambda v: v if ok else 0
        return [row, doc, 0, ok, keep(na), keep(nb), keep(ng), keep(nl), told]

    names = ["row", "doc_id", "place", "ok", "n_a", "n_b", "n_groups", "n_links", "closed"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 4, pa.binary()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

    for b in batches:
        cols = {n: b.column(i).to_pylist() for i, n in enumerate(names)}
        for i in range(b.num_rows):
            if state is None or cols["row"][i] != now:
                if state is not None:
                    yield batch([done()])
                now = cols["row"][i]
                state = [now, None, True, 0, 0, 0, 0, hashlib.sha256(), True]
            if cols["doc_id"][i] is not None:
                state[1] = cols["doc_id"][i]
            state[2] = state[2] and cols["ok"][i] is not False
            for j, n in ((3, "n_a"), (4, "n_b"), (5, "n_groups"), (6, "n_links")):
                state[j] += cols[n][i] or 0
            text = cols["closed"][i]
            if text:
                state[7].update(text[:-1] if state[8] else b";" + text[:-1])
                state[8] = False
    if state is not None:
        yield batch([done()])


def _long(docs: DataFrame, files: tuple, chunk: int) -> tuple[DataFrame, DataFrame]:
    """(documents, pair rows) of documents longer than one chunk."""
    spark = docs.sparkSession
    chunks = docs.mapInArrow(_split(chunk), "row long, doc_id long, i long, a string, b string, oa long, ob long")
    made = stored(chunks.repartition("row", "i").mapInArrow(_fragments(files), FRAGMENT + ", " + OPEN.split(", ", 1)[1]), "fragments")
    closed = made.select(*(c.split()[0] for c in FRAGMENT.split(", ")))
    level = made.select(*(c.split()[0] for c in OPEN.split(", ")))
    most = made.agg(F.max("hi")).first()[0]
    schema = OPEN + ", place long, n_groups long, n_links long, closed binary, " + PAIRS
    width, parts = 1, [closed]
    while most is not None:
        width *= FAN
        root = most < width
        node = (level.withColumn("node", F.floor(F.col("lo") / width)).groupBy("row", "node")
                .applyInPandas(_reduce(files, root), schema))
        out = stored(node, "nodes")
        parts.append(out.filter("place IS NOT NULL").select(
            "row", F.lit(None).cast("long").alias("doc_id"), "place", F.lit(None).cast("boolean").alias("ok"),
            F.lit(0).cast("long").alias("n_a"), F.lit(0).cast("long").alias("n_b"), "n_groups", "n_links", "closed", "a", "b", "m"))
        if root:
            break
        level = out.filter("place IS NULL").select(*(c.split()[0] for c in OPEN.split(", ")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = stored(rows, "closed")
    documents = stored(rows.drop("a", "b", "m").repartition("row").sortWithinPartitions("row", "place")
                       .mapInArrow(_finish, "row long, doc_id long, place long, ok boolean, n_a long, n_b long, n_groups long, n_links long, closed binary"),
                       "long")
    bad = documents.filter("NOT ok").select("row")
    pairs = (rows.select("row", F.explode(F.arrays_zip("a", "b", "m")).alias("p")).select("row", "p.*")
             .groupBy("row", "a", "b").agg(F.sum("m").alias("m")).join(bad, "row", "left_anti"))
    return documents, stored(pairs, "pairs")


def align_texts(docs: DataFrame, files: tuple | None = None, id_col: str = "doc_id", text_col: str = "text",
                chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(documents, links): row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256; and row, a, b, m.

    A link row is an id pair of a document and how often it is linked there. ``row`` numbers the
    documents of the table, as ids may repeat.
    """
    files = files or default_files()
    base = docs.select((F.monotonically_increasing_id() * 2).alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))
    big = F.coalesce(F.octet_length("text"), F.lit(0)) > chunk
    short = stored(base.filter(~big).mapInArrow(_short(files), FRAGMENT), "aligned")
    long, long_pairs = _long(base.filter(big).withColumn("row", F.col("row") + 1), files, chunk)
    named = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", F.col("closed").cast("string").alias("groups_sha256")]
    links = short.select("row", F.explode(F.arrays_zip("a", "b", "m")).alias("p")).select("row", "p.*")
    return short.select(*named).unionByName(long.select(*named)), links.unionByName(long_pairs)


def pair_counts(links: DataFrame) -> DataFrame:
    """a, b, n (documents that hold the pair linked), best (n is the highest of its a)."""
    n = stored(links.groupBy("a", "b").agg(F.count("*").alias("n")), "counts")
    top = n.groupBy("a").agg(F.max("n").alias("top"))
    return stored(n.join(top, "a").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best")), "pairs")


def _common(counts: DataFrame, head: int) -> int:
    """Smallest power of two of documents that at most ``head`` pairs reach."""
    sizes = counts.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count("*").alias("pairs")).collect()  # at most 63 rows
    least, total = 0, 0
    for p, pairs in sorted(((r.p, r.pairs) for r in sizes), reverse=True):
        total += pairs
        if total > head:
            return 1 << (p + 1)
        least = 1 << p
    return 0 if total <= head else least


def align_corpus(docs: DataFrame, files: tuple | None = None, head: int = HEAD, **columns) -> DataFrame:
    """Return doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    documents, links = align_texts(docs, files, **columns)
    pair = (F.shiftleft(F.col("a").cast("long"), 17) + F.col("b")).alias("pair")
    counts = pair_counts(links).select(pair, "n", "best")
    least = _common(counts, head)
    # pairs of many documents, at most ``head``, go to every task; the rest is joined
    links = links.select("row", pair, "m")
    common = F.broadcast(counts.filter(F.col("n") >= least))
    scored = links.join(common, "pair")
    if least:
        rest = links.join(F.broadcast(counts.filter(F.col("n") >= least).select("pair")), "pair", "left_anti")
        scored = scored.unionByName(rest.join(counts.filter(F.col("n") < least), "pair"))
    sums = scored.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("n_best"),
                                     F.sum(F.col("m") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return (documents.join(sums, "row", "left")
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"))
