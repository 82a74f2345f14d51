"""Personal data: base patterns, and a linear-chain conditional random field that adds spans.

Base spans of the four kinds are the leftmost non-overlapping matches of fixed patterns. The field
labels words (white-space tokens) as begin, inside or outside of a kind from word-shape features of
the word and its neighbours. Only words near a digit, an at sign or a plus can be labelled: a chain is
a run of words of one line that lie within ``REACH`` words of such a word; all other words are
outside by definition. It is trained by gradient steps on the log-likelihood over a small labelled
table (at most ``train_chains`` chains, labelled by the base patterns), and decoded by Viterbi in
numpy batches. A decoded span is added when it beats the all-outside labelling by ``margin`` nats and
overlaps no base span.

Defined results: a null text is the empty text, without spans. Repeated rows give repeated rows, other
columns are ignored, an empty table gives an empty result. Without any labelled chain nothing is added.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.llm.wordhash import slices

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
REACH = 2
DIMS = 4096
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a match that starts inside a run of digits would have started at the run's first digit
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HOT = re.compile(r"[0-9@+]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum((2 * int(c)) // 10 + (2 * int(c)) % 10 for c in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in the order of KINDS, then by start; code points, end exclusive."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text) is None:
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


def chains(text: str) -> list[list[tuple[int, int]]]:
    """Runs of words (start, end) around words that hold a digit, an at sign or a plus."""
    out = []
    if _HOT.search(text) is None:
        return out
    pos = 0
    for line in text.split("\n"):
        if _HOT.search(line):
            words = [(m.start() + pos, m.end() + pos) for m in _WORD.finditer(line)]
            last = -1  # words below are in a chain already
            for i, (a, b) in enumerate(words):
                if _HOT.search(text, a, b):
                    lo, hi = max(0, i - REACH), min(len(words), i + REACH + 1)
                    if lo <= last and out and last > 0:
                        out[-1].extend(words[max(lo, last):hi])
                    else:
                        out.append(words[lo:hi])
                    last = max(last, hi)
        pos += len(line) + 1
    return out


_SHAPES: dict[str, tuple[int, ...]] = {}


def _shape(word: str) -> str:
    """Letters as x or X, digits as d, runs as run lengths 1, 2, 3, 4 or 5 for more, other characters as they are."""
    out, prev, n = [], "", 0
    for c in word + "\0":
        k = "d" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c
        if k == prev:
            n += 1
        else:
            if prev:
                out.append(prev + (str(min(n, 5)) if prev in "dXx" else ""))
            prev, n = k, 1
    return "".join(out)


def _features(word: str) -> tuple[int, ...]:
    shape = _shape(word)
    got = _SHAPES.get(shape)
    digits = sum("0" <= c <= "9" for c in word)
    if got is None:
        coarse = re.sub(r"[0-9]", "", shape)
        parts = [f"s:{shape}", f"c:{coarse}", f"f:{shape[:2]}", f"e:{shape[-2:]}", f"@:{'@' in shape}", f"+:{shape[:1] == '+'}",
                 f".:{min(shape.count('.'), 4)}", f"-:{min(shape.count('-'), 4)}"]
        got = tuple(zlib.crc32(p.encode()) % DIMS for p in parts)
        if len(_SHAPES) < 50_000 and len(shape) <= 64:
            _SHAPES[shape] = got
    return (*got, zlib.crc32(f"n:{min(digits, 20)}".encode()) % DIMS)


_EDGE = (DIMS - 1,) * 9


class ChainField:
    """Weights (neighbour place x feature x label), transitions, and the numpy batches over chains."""

    def __init__(self):
        k = len(LABELS)
        self.emit = np.zeros((3 * DIMS, k))
        self.trans = np.zeros((k, k))
        self.first = np.zeros(k)
        for j, name in enumerate(LABELS):
            if name[0] == "I":  # an inside label only follows its own kind
                self.first[j] = -1e4
                for i, before in enumerate(LABELS):
                    if before[2:] != name[2:]:
                        self.trans[i, j] = -1e4
        self.trained = False

    @staticmethod
    def batch(chain_words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Feature ids (chains x length x 27) and the mask of real words."""
        n, longest = len(chain_words), max(map(len, chain_words))
        ids = np.full((n, longest, 27), DIMS - 1, np.int32)
        mask = np.zeros((n, longest), bool)
        for r, words in enumerate(chain_words):
            f = np.array([_EDGE, *map(_features, words), _EDGE], np.int32)
            ids[r, :len(words)] = np.concatenate((f[1:-1], f[:-2] + DIMS, f[2:] + 2 * DIMS), axis=1)
            mask[r, :len(words)] = True
        return ids, mask

    def scores(self, ids: np.ndarray) -> np.ndarray:
        return self.emit[ids].sum(axis=2)

    def _gradient(self, ids, mask, labels):
        """Log-likelihood and its gradient by forward-backward."""
        e, k = self.scores(ids), len(LABELS)
        n, length = mask.shape
        lse = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
        alpha = np.zeros((n, length, k))
        alpha[:, 0] = self.first + e[:, 0]
        for t in range(1, length):
            step = lse(alpha[:, t - 1, :, None] + self.trans, 1) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], step, alpha[:, t - 1])
        log_z = lse(alpha[:, -1], 1)
        beta = np.zeros((n, length, k))
        trans = np.zeros((k, k))
        onehot = np.eye(k)[labels] * mask[..., None]
        for t in range(length - 2, -1, -1):
            on = mask[:, t + 1, None]
            ahead = e[:, t + 1] + beta[:, t + 1]
            beta[:, t] = np.where(on, lse(self.trans + ahead[:, None, :], 2), beta[:, t + 1])
            pair = np.exp(alpha[:, t, :, None] + self.trans + ahead[:, None, :] - log_z[:, None, None]) * on[..., None]
            trans += np.einsum("ni,nj->ij", onehot[:, t], onehot[:, t + 1]) - pair.sum(axis=0)
        post = np.exp(alpha + beta - log_z[:, None, None]) * mask[..., None]
        emit = np.zeros_like(self.emit)
        np.add.at(emit, ids[mask], (onehot - post)[mask][:, None, :])
        return emit, trans

    def fit(self, chain_words: list[list[str]], labels: list[list[int]], steps: int = 120, reg: float = 1.0) -> "ChainField":
        """Adagrad ascent on the penalised log-likelihood of all chains."""
        if not chain_words:
            return self
        ids, mask = self.batch(chain_words)
        y = np.zeros(mask.shape, int)
        for r, lab in enumerate(labels):
            y[r, :len(lab)] = lab
        sum_e, sum_t = np.full_like(self.emit, 1e-6), np.full_like(self.trans, 1e-6)
        free = self.trans > -1e3
        for _ in range(steps):
            ge, gt = self._gradient(ids, mask, y)
            ge -= reg * self.emit
            gt = np.where(free, gt - reg * self.trans, 0)
            sum_e += ge ** 2
            sum_t += gt ** 2
            self.emit += 0.3 * ge / np.sqrt(sum_e)
            self.trans += 0.3 * gt / np.sqrt(sum_t)
        self.trained = True
        return self

    def decode(self, chain_words: list[list[str]], margin: float) -> list[list[tuple[int, int, int]]]:
        """Per chain (kind, first word, last word + 1) of spans that beat the all-outside labels by ``margin``."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in chain_words]
        order = sorted(range(len(chain_words)), key=lambda r: len(chain_words[r]))
        for lo in range(0, len(order), 512):
            rows = order[lo:lo + 512]
            ids, mask = self.batch([chain_words[r] for r in rows])
            e = self.scores(ids)
            n, length = mask.shape
            best = self.first + e[:, 0]
            back = np.zeros((n, length, len(LABELS)), np.int8)
            for t in range(1, length):
                total = best[:, :, None] + self.trans
                arg = total.argmax(axis=1)
                step = np.take_along_axis(total, arg[:, None, :], 1)[:, 0] + e[:, t]
                on = mask[:, t, None]
                back[:, t] = np.where(on, arg, np.arange(len(LABELS)))
                best = np.where(on, step, best)
            path = np.zeros((n, length), np.int8)
            path[:, -1] = best.argmax(axis=1)
            for t in range(length - 1, 0, -1):
                path[:, t - 1] = back[np.arange(n), t, path[:, t]]
            path[~mask] = 0
            for i in np.flatnonzero(path.any(axis=1)):
                t = 0
                while t < length:
                    lab = int(path[i, t])
                    if lab == 0:
                        t += 1
                        continue
                    stop = t + 1
                    inside = lab if lab % 2 == 0 else lab + 1
                    while stop < length and path[i, stop] == inside:
                        stop += 1
                    gain = (e[i, np.arange(t, stop), path[i, t:stop]] - e[i, t:stop, 0]).sum()
                    if gain >= margin:
                        out[rows[i]].append(((lab - 1) // 2, t, stop))
                    t = stop
        return out


def label_words(text: str, chain: list[tuple[int, int]], spans: list[tuple[str, int, int]]) -> list[int]:
    out, before = [], None
    for a, b in chain:
        hit = next((s for s in spans if s[1] < b and s[2] > a), None)
        out.append(0 if hit is None else 1 + 2 * KINDS.index(hit[0]) + (hit == before))
        before = hit
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_chains: int = 1500) -> ChainField:
    """Fit on a bounded labelled table: up to ``train_chains`` chains of at most 40 words, smallest hashes first."""
    def run(it):
        for batch in (part for whole in it for part in slices(whole, 0, 1 << 21)):
            key, words, labels = [], [], []
            for t in batch.column(0).to_pylist():
                spans = base_spans(t)
                for c in chains(t):
                    if len(c) <= 40:
                        w = [t[a:b] for a, b in c]
                        h = zlib.crc32("\x1f".join(w).encode("utf-8", "replace"))
                        lab = label_words(t, c, spans)
                        if any(lab) or h % 4 == 0:
                            key.append(h)
                            words.append(w)
                            labels.append(lab)
            # a task passes on its smallest hashes only: no other can be among the smallest of all
            keep = np.argsort(np.array(key, np.int64), kind="stable")[:train_chains]
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[i] for i in keep], pa.int64()), pa.array([words[i] for i in keep], pa.list_(pa.string())),
                 pa.array([labels[i] for i in keep], pa.list_(pa.int32()))], names=["h", "words", "labels"])

    rows = (docs.select(F.col(text_col).cast("string").alias("text")).filter("text rlike '[0-9@+]'")
            .mapInArrow(run, "h long, words array<string>, labels array<int>")
            .orderBy("h", "words").limit(train_chains).toArrow())
    return ChainField().fit(rows.column("words").to_pylist(), rows.column("labels").to_pylist())


def all_spans(texts: list[str], field: ChainField, margin: float):
    """Per text (base spans, all spans)."""
    base = [base_spans(t) for t in texts]
    added: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if field.trained:
        where, words = [], []
        for i, t in enumerate(texts):
            for c in chains(t):
                where.append((i, c))
                words.append([t[a:b] for a, b in c])
        if words:
            for (i, c), found in zip(where, field.decode(words, margin)):
                for kind, a, b in found:
                    lo, hi = c[a][0], c[b - 1][1]
                    while hi > lo and texts[i][hi - 1] in ".,;:!?)\"'":
                        hi -= 1
                    if hi > lo and not any(s < hi and e > lo for _, s, e in base[i]):
                        added[i].append((KINDS[kind], lo, hi))
    rank = {k: j for j, k in enumerate(KINDS)}
    return [(b, sorted(b + a, key=lambda s: (rank[s[0]], s[1], s[2]))) for b, a in zip(base, added)]


def find_pii(docs: DataFrame, field: ChainField, id_col: str = "doc_id", text_col: str = "text",
             margin: float = 4.0, redact: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Return doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans, after ``carry`` (as c_<name>).

    With ``redact`` also ``redacted``: the text with each span (overlaps joined) replaced by <KIND>, null for null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)  # 3 x 4096 x 9 numbers
    joined = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    base = docs.select(*(F.col(c).alias(f"c_{c}") for c in carry), F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))
    kept = base.drop("text").schema.fields
    more = [*(f"n_{k} long" for k in KINDS), "base_sha256 string", "spans string", *["redacted string"] * redact]
    names = [*(f.name for f in kept), *(m.split()[0] for m in more)]

    def run(it):
        for batch in (part for whole in it for part in slices(whole, len(carry) + 1, 1 << 21)):
            raw = batch.column(len(carry) + 1).to_pylist()
            texts = [t or "" for t in raw]
            found = all_spans(texts, shared.value, margin)
            cols = list(batch.columns[:len(carry) + 1])
            cols += [pa.array([sum(s[0] == k for s in b) for b, _ in found], pa.int64()) for k in KINDS]
            cols.append(pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], pa.string()))
            cols.append(pa.array([joined(s) for _, s in found], pa.string()))
            if redact:
                cols.append(pa.array([r and redacted(t, s) for r, t, (_, s) in zip(raw, texts, found)], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return base.mapInArrow(run, T.StructType([*kept, *T.StructType.fromDDL(", ".join(more)).fields]))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, pos = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= pos:
            out += [text[pos:a], f"<{kind.upper()}>"]
        pos = max(pos, b)
    return "".join(out) + text[pos:]
