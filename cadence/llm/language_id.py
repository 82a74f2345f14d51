"""Language identification by hierarchical discrimination.

A first linear model picks the language family, then one-versus-one linear support vector machines
inside the family pick the language by votes, ties by summed margins. Features are frequencies of
character n-grams (1 to 4 bytes of lower-cased text, hashed), taken from every whole text.

Training: about ``per_class`` labelled texts of each language (all, if there are fewer), those with the
smallest hashes, so the same rows whatever the partitioning; repeated rows count once. Their features, a bounded matrix, are the
only rows that reach the driver. Families are a fixed table; other languages form families of
their own under "other". Only text and label are learned from.

Defined results: null texts and texts without a letter are ``und`` with score 0. With no labelled
rows every text is ``und``. With one language all other texts get it. Repeated rows give repeated
rows, other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.llm.wordhash import slices

# fixed values: ISO 639-1 codes by family
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"],
    "baltic": ["lt", "lv"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
    "indo-aryan": ["hi", "bn", "ur", "mr", "gu", "pa", "ne"],
    "semitic": ["ar", "he", "mt", "am"],
}
FAMILY_OF = {lang: f for f, langs in FAMILIES.items() for lang in langs}
UNDETERMINED = "und"
BINS = 4096


def _lower(text: str | None) -> bytes:
    return b" " + (text or "").lower().encode() + b" "


def _grams(data: np.ndarray) -> np.ndarray:
    """Hashed bins of the 1 to 4 byte grams that start at each byte, (4 x bytes)."""
    padded = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.uint32)
    out = np.empty((4, len(data)), np.uint16)
    code = np.zeros(len(data), np.uint32)
    for j in range(4):
        code = code * np.uint32(257) + padded[j:j + len(data)] + np.uint32(1)
        x = code * np.uint32(0x9E3779B1)
        out[j] = (x >> np.uint32(20)) ^ np.uint32(j * 1021 % BINS)
    return out


def _frequencies(texts: list[str | None]) -> np.ndarray:
    """(texts x BINS) gram frequencies."""
    rows = []
    for t in texts:
        data = np.frombuffer(_lower(t), np.uint8)
        rows.append((np.bincount(_grams(data).ravel(), minlength=BINS) / (4 * len(data))).astype(np.float32))
    return np.array(rows, np.float32).reshape(-1, BINS)


def _fit_svm(x: np.ndarray, y: np.ndarray, reg: float = 1e-4, steps: int = 200) -> tuple[np.ndarray, float]:
    """Linear SVM (squared hinge, y = +-1, both sides weighted equally) by accelerated gradient steps."""
    y = y.astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    xb = np.concatenate((x, np.ones((len(x), 1), np.float32)), axis=1)
    step = np.float32(1 / (2 * float(weight @ (xb * xb).sum(axis=1)) + reg))
    w = np.zeros(xb.shape[1], np.float32)
    prev, t = w, 1.0
    for _ in range(steps):
        ahead = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z = w + np.float32((t - 1) / ahead) * (w - prev)
        slack = np.maximum(0, 1 - y * (xb @ z))
        prev, t = w, ahead
        w = z - step * (np.float32(reg) * z - 2 * ((weight * y * slack) @ xb))
    return w[:-1].astype(np.float64), float(w[-1])


class HierarchicalModel:
    """Families, their one-versus-rest SVMs, and the one-versus-one SVMs inside each family."""

    def __init__(self, langs: list[str], x: np.ndarray, labels: np.ndarray):
        self.langs = langs
        fam = [FAMILY_OF.get(lang, "other") for lang in langs]
        self.families = sorted(set(fam))
        self.members = [[i for i, f in enumerate(fam) if f == g] for g in self.families]
        # hellinger scaling spreads the few frequent grams
        z = self._scale(x)
        family_of = np.array([self.families.index(f) for f in fam], int)[labels] if len(labels) else labels
        cols, bias, self.duels = [], [], []
        for g in range(len(self.families)):
            w, b = _fit_svm(z, np.where(family_of == g, 1.0, -1.0)) if len(self.families) > 1 else (np.zeros(BINS), 0.0)
            cols.append(w)
            bias.append(b)
        for g, members in enumerate(self.members):
            for a, b in combinations(members, 2):
                rows = (labels == a) | (labels == b)
                w, c = _fit_svm(z[rows], np.where(labels[rows] == a, 1.0, -1.0))
                self.duels.append((a, b))
                cols.append(w)
                bias.append(c)
        self.weights = np.array(cols, np.float32).reshape(-1, BINS)
        self.bias = np.array(bias)

    def _scale(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(x).astype(np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(languages, scores 0 to 1); the score is the product of the steps' logistic margins."""
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        margin = self._scale(_frequencies(texts)) @ self.weights.T + self.bias
        nf = len(self.families)
        logistic = lambda m: 1 / (1 + np.exp(-4 * np.clip(m, -20, 20)))
        family = margin[:, :nf].argmax(axis=1)
        score = logistic(margin[np.arange(len(texts)), family]) if nf > 1 else np.ones(len(texts))
        votes = np.zeros((len(texts), len(self.langs)))
        total = np.zeros_like(votes)
        least = np.full_like(votes, np.inf)
        for k, (a, b) in enumerate(self.duels):
            m = margin[:, nf + k]
            for lang, v in ((a, m), (b, -m)):
                votes[:, lang] += v > 0
                total[:, lang] += np.clip(v, -20, 20)
                least[:, lang] = np.minimum(least[:, lang], v)
        out = np.zeros(len(texts), int)
        for g, members in enumerate(self.members):
            rows = np.flatnonzero(family == g)
            if len(rows):
                rank = votes[np.ix_(rows, members)] * 1e6 + total[np.ix_(rows, members)]
                out[rows] = np.array(members)[rank.argmax(axis=1)]
        weakest = least[np.arange(len(texts)), out]
        score = score * np.where(np.isinf(weakest), 1.0, logistic(np.where(np.isinf(weakest), 0, weakest)))
        return [self.langs[i] for i in out], score


MAX_LANGS = 1000


def _has_letter(text: str | None) -> bool:
    return bool(text) and (text.isalpha() or any(c.isalpha() for c in text))


def train(labelled: DataFrame, per_class: int = 400) -> HierarchicalModel:
    """Fit on about ``per_class`` texts of each language (columns key, text, lang).

    Kept are the rows whose hash lies below per_class / (rows of the language). More than MAX_LANGS languages
    raise ValueError: the model's tables are languages x BINS, and one machine stands for each pair of a family.
    """
    usable = labelled.filter("text is not null and lang is not null")
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n"))
    if sizes.limit(MAX_LANGS + 1).count() > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages among the labels")
    picked = (usable.join(F.broadcast(sizes), "lang")  # MAX_LANGS rows at most
              .filter(F.pmod(F.xxhash64("key", "text"), F.lit(1 << 30)) < F.lit(per_class * float(1 << 30)) / F.col("n"))
              .select("lang", "key", "text").distinct())

    def run(it):
        for batch in (part for whole in it for part in slices(whole, 1, 1 << 20, BINS)):
            langs, texts = (batch.column(i).to_pylist() for i in (0, 1))
            keep = [i for i, t in enumerate(texts) if _has_letter(t)]
            x = _frequencies([texts[i] for i in keep]).astype(np.float16)
            yield pa.RecordBatch.from_arrays([pa.array([langs[i] for i in keep], pa.string()),
                                              pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])

    rows = picked.select("lang", "text").mapInArrow(run, "lang string, x binary").orderBy("lang", "x").toArrow()
    langs = sorted(set(rows.column("lang").to_pylist()))
    labels = np.array([langs.index(v) for v in rows.column("lang").to_pylist()], int)
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float16).reshape(-1, BINS).astype(np.float32)
    return HierarchicalModel(langs, x, labels)


def identify(docs: DataFrame, model: HierarchicalModel, id_col: str = "doc_id", text_col: str = "text",
             carry: tuple[str, ...] = ()) -> DataFrame:
    """Return doc_id, lang_pred, score for every whole text, after the ``carry`` columns (as c_<name>)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # langs x BINS floats
    base = docs.select(*(F.col(c).alias(f"c_{c}") for c in carry), F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))
    kept = base.drop("text").schema.fields
    names = [*(f.name for f in kept), "lang_pred", "score"]

    def run(it):
        m = shared.value
        # a text costs one row of BINS frequencies besides its own bytes
        for batch in (part for whole in it for part in slices(whole, len(carry) + 1, 1 << 20, BINS)):
            texts = batch.column(len(carry) + 1).to_pylist()
            found, s = m.predict(texts)
            letters = [_has_letter(t) for t in texts]
            langs = [p if ok else UNDETERMINED for p, ok in zip(found, letters)]
            scores = [float(v) if ok and p != UNDETERMINED else 0.0 for v, p, ok in zip(s, found, letters)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(carry) + 1], pa.array(langs, pa.string()),
                                              pa.array(scores, pa.float64())],
                                             names=names)

    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return base.mapInArrow(run, schema)


def held_out(doc_id) -> F.Column:
    """Documents that no training sees: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def language_id(docs: DataFrame, per_class: int = 400) -> DataFrame:
    """Return doc_id, held_out, lang_pred, score; learned from the rows that are not held out."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("lang"))
    fit = base.filter(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("key"), "text", "lang")
    out = identify(base, train(fit, per_class))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
