"""SentencePiece BPE encoding by a merge-type prefix table, and decoding.

BPE applied to a string has a local test: a sequence of tokens is its encoding exactly when every
adjacent pair is, by itself, encoded as that pair. So every prefix of a string has one last token,
and a token that ends at position i is that token exactly when it is compatible with the last
token of the prefix before it. The table of last tokens is filled left to right, with candidates
from an automaton over the vocabulary; the ids are read backwards from it. The cost is linear in
the text, whatever its length.

No piece holds anything before a space mark, and characters outside the vocabulary never merge, so
texts are cut there first, and each distinct segment is encoded once per task as long as the bounded
cache keeps it: a full cache becomes the older of two generations, from which segments in use come
back. A mark that follows a letter in no piece is cut off as well, so a word before a full stop or a
comma is not encoded again.
Vocabularies that would break this (pieces with a space mark inside, unused or user-defined
pieces, a normaliser other than identity, no byte fallback) are refused.

Defined results: a null text is the empty text; empty texts have no tokens, the digest of the
empty string and decode to the empty text. Repeated rows give repeated rows, other columns are
ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import string

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm.wordhash import slices

MARK = "▁"
CACHE_SEGMENTS = 200_000  # of each of two generations
CACHE_PAIRS = 300_000
LEAN_SEGMENTS, LEAN_PAIRS = 60_000, 150_000
CACHE_CHARS = 64


class PieceTable:
    """Encoder and decoder over a SentencePiece BPE model file."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(pieces) if sp.is_byte(i)}
        special = {i for i in range(n) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)}
        self.ids = {p: i for i, p in enumerate(pieces) if i not in special}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        probe = "  ÅÅ ﬁ  "
        if (len(self.byte_ids) < 256 or any(sp.is_unused(i) for i in range(n))
                or any(MARK in p.lstrip(MARK) for p in self.ids) or sp.decode(sp.encode(probe)) != probe):
            raise ValueError("only BPE models with byte fallback, identity normaliser and leading space marks")
        byte_of = {i: bytes((b,)) for b, i in self.byte_ids.items()}
        self.out = [byte_of.get(i, b"" if i in special else p.replace(MARK, " ").encode())
                    for i, p in enumerate(pieces)]
        self.matcher = ahocorasick.Automaton()
        for p in self.ids:
            if len(p) > 1:
                self.matcher.add_word(p, p)
        self.matcher.make_automaton()
        self.known = frozenset(p for p in self.ids if len(p) == 1)
        outside = "".join(sorted(c for c in map(chr, range(128)) if c not in self.known and c != " "))
        self.cut = re.compile(f"[{re.escape(outside)}]")
        self.told = {p: (str(i), self.out[i]) for p, i in self.ids.items()}
        after_letter = {b for p in self.ids for a, b in zip(p, p[1:]) if a.isalpha()}
        self.tails = frozenset(string.punctuation) - after_letter
        self.forget()

    def forget(self, segments: int | None = None, pairs: int | None = None) -> None:
        """Empty caches, of at most so many entries a generation from now on."""
        self.most, self.most_pairs = segments or CACHE_SEGMENTS, pairs or CACHE_PAIRS
        self.pair: dict[tuple[str, str], bool] = {}
        self.old_pair: dict[tuple[str, str], bool] = {}
        self.cache: dict[str, tuple[str, bytes]] = {}
        self.old: dict[str, tuple[str, bytes]] = {}

    def merged(self, text: str) -> list[str]:
        """BPE by definition: merge the best-scored adjacent pair, the leftmost first. For short strings."""
        parts = list(text)
        while True:
            best = None
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best[0]):
                    best = s, i
            if best is None:
                return parts
            i = best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    def compatible(self, left: str, right: str) -> bool:
        key = left, right
        ok = self.pair.get(key)
        if ok is None:
            ok = self.old_pair.get(key)
            if ok is None:
                ok = self.merged(left + right) == ([left, right] if left else [right])
            if len(self.pair) >= self.most_pairs:
                self.old_pair, self.pair = self.pair, {}
            self.pair[key] = ok
        return ok

    def tokens(self, text: str) -> list[str]:
        """Pieces of one segment; characters outside the vocabulary stand alone."""
        last = ["", *text]  # of the prefix of each length; its last character where no longer piece fits
        pair = self.pair
        done = -1
        for end, piece in self.matcher.iter(text):  # at one end the longest piece comes first
            if end == done:
                continue
            start = end + 1 - len(piece)
            if start:
                ok = pair.get((last[start], piece))
                if ok is None:
                    ok = self.compatible(last[start], piece)
            else:
                ok = self.stable(piece)
            if ok:
                last[end + 1] = piece
                done = end
        out, i = [], len(text)
        while i:
            piece = last[i]
            out.append(piece)
            i -= len(piece)
        out.reverse()
        return out

    def stable(self, piece: str) -> bool:
        return self.compatible("", piece)

    def segment(self, text: str) -> tuple[str, bytes]:
        """(ids joined by commas, bytes that they decode to, space marks as spaces)."""
        got = self.cache.get(text) or self.old.get(text)
        if got is None:
            if text[-1] in self.tails and text[-2:-1].isalpha():  # no piece crosses
                word, tail = self.segment(text[:-1]), self.segment(text[-1])
                got = f"{word[0]},{tail[0]}", word[1] + tail[1]
            else:
                told = self.told
                parts = [told.get(p) or self.by_bytes(p) for p in self.tokens(text)]
                got = ",".join([p[0] for p in parts]), b"".join([p[1] for p in parts])
        if len(text) <= CACHE_CHARS:
            if len(self.cache) >= self.most:
                self.old, self.cache = self.cache, {}
            self.cache[text] = got
        return got

    def by_bytes(self, char: str) -> tuple[str, bytes]:
        """The byte pieces of a character outside the vocabulary, as a segment."""
        ids = [self.byte_ids[b] for b in char.encode()]
        return ",".join(map(str, ids)), self.raw(ids)

    def raw(self, ids: list[int]) -> bytes:
        """Bytes of the pieces, space marks as spaces; byte pieces give their byte."""
        out = self.out
        return b"".join([out[i] for i in ids])

    def segments(self, text: str) -> list[str]:
        """Cuts a whole text, dummy space in front, where no piece can cross."""
        body = " " + text.replace(MARK, " ")
        out: list[str] = []
        pos = 0
        for m in self.cut.finditer(body):
            if m.start() > pos:
                out.extend(self._words(body[pos:m.start()]))
            out.append(m.group())
            pos = m.end()
        if pos < len(body):
            out.extend(self._words(body[pos:]))
        return out

    @staticmethod
    def _words(part: str) -> list[str]:
        """Runs of space marks with the word that follows."""
        words = part.split(" ")
        if "" not in words:
            return [words[0], *[MARK + w for w in words[1:]]]
        out = [words[0]] if words[0] else []
        marks = 0
        for w in words[1:]:
            marks += 1
            if w:
                out.append(MARK * marks + w)
                marks = 0
        if marks:
            out.append(MARK * marks)
        return out

    def encode(self, text: str | None) -> tuple[str, int, str]:
        """(ids joined by commas, number of ids, decoded text) of a whole text."""
        if not text:
            return "", 0, ""
        cache = self.cache
        got = [cache.get(s) or self.segment(s) for s in self.segments(text)]
        ids = ",".join([g[0] for g in got])
        return ids, ids.count(",") + 1, b"".join([g[1] for g in got])[1:].decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        """Text of ids: byte runs as UTF-8 (invalid bytes replaced), without the space put in front."""
        raw = self.raw(ids)
        return (raw[1:] if raw.startswith(b" ") else raw).decode("utf-8", "replace")


def default_model() -> str:
    """Path of the public tokenizer file that is installed beside the library."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


_TABLES: dict[str, PieceTable] = {}


def piece_table(model_file: str) -> PieceTable:
    """One table per worker process."""
    if model_file not in _TABLES:
        _TABLES[model_file] = PieceTable(model_file)
    return _TABLES[model_file]


def _each(model_file: str, digest: bool, lean: bool):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def run(it):
        table = piece_table(model_file)
        if lean:
            table.forget(LEAN_SEGMENTS, LEAN_PAIRS)
        for batch in (part for whole in it for part in slices(whole, 1, 1 << 21)):
            ids, counts, texts = [], [], []
            for t in batch.column(1).to_pylist():
                joined, n, text = table.encode(t)
                ids.append(sha(joined) if digest else joined)
                counts.append(n)
                texts.append(sha(text) if digest else text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.string()),
                 pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])
        if lean:
            table.forget()
    return run


def encode_texts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text",
                 digest: bool = False, lean: bool = False) -> DataFrame:
    """Return doc_id, n_tokens, ids (array<int>), decoded for every whole text.

    With ``digest`` the ids and the decoded text come as SHA-256 digests (ids_sha256 over the
    decimal ids joined by commas, decoded_sha256 over UTF-8), computed in the same pass.
    ``lean``: smaller caches that are emptied after each task, for workers that other steps go on using.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = base.mapInArrow(_each(model_file, digest, lean), "doc_id long, n_tokens long, ids string, decoded string")
    if digest:
        return out.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})
    empty = F.array().cast("array<int>")
    return out.withColumn("ids", F.when(F.col("n_tokens") == 0, empty)
                          .otherwise(F.split("ids", ",").cast("array<int>")))


def decode_ids(rows: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Return doc_id, decoded for rows of ids (null: empty)."""
    def run(it):
        table = piece_table(model_file)
        for batch in it:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([table.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())],
                names=["doc_id", "decoded"])
    base = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return base.mapInArrow(run, "doc_id long, decoded string")
