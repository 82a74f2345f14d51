"""Text column expressions: cleaning, keywords, n-grams, display helpers.

All are JVM-side Column expressions (regexp_replace, split, higher-order
array functions), so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference: stopwords dropped by the lexical detector.
STOPWORDS = [
    "pos", "debit", "credit", "purchase", "payment", "transfer",
    "check", "withdrawal", "deposit", "atm", "fee", "charge",
    "bill", "pay", "online", "mobile", "transaction", "authorized",
]

# Ordered noise patterns removed by the pairwise text cleaner.
NOISE_PATTERNS = [
    r"pos purchase", r"purchase", r"recurring", r"terminal",
    r"authorized transfer", r"check card", r"debit card",
    r"payment", r"ach", r"wd", r"withdrawal", r"deposit",
    r"transaction", r"\d{2}/\d{2}", r"\d{3}-\d{3}-\d{4}",
    r"\*+", r"\b\d+\b",
]

# Words that flag a recurring description.
RECURRENCE_KEYWORDS = ["recurring", "monthly", "annual", "fee", "subscription", "autopay"]


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_ws(col) -> Column:
    """Strip leading/trailing whitespace of any kind (not only spaces)."""
    return F.regexp_replace(F.regexp_replace(_c(col), r"^\s+", ""), r"\s+$", "")


def squeeze(col) -> Column:
    """Collapse whitespace runs to one space and trim."""
    return F.trim(F.regexp_replace(_c(col), r"\s+", " "))


def clean_text(col, hide_digits: bool = False, trunc_repeating: bool = True, lower: bool = True) -> Column:
    """strip, lower, optional 3+ digits -> ###, runs of 3+ identical chars -> 3.

    A NULL input becomes the string 'nan' (the reference casts missing values to str).
    """
    c = strip_ws(F.coalesce(_c(col).cast("string"), F.lit("nan")))
    if lower:
        c = F.lower(c)
    if hide_digits:
        c = F.regexp_replace(c, r"\d{3,}", "###")
    if trunc_repeating:
        c = F.regexp_replace(c, r"(.)\1{2,}", "$1$1$1")
    return c


def clean_text_stop(col) -> Column:
    """Lower, non-letters -> space, squeeze, drop stopwords. NULL -> ''."""
    c = F.lower(F.coalesce(_c(col), F.lit("")))
    c = squeeze(F.regexp_replace(c, r"[^a-z\s]", " "))
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    words = F.filter(F.split(c, " "), lambda w: ~F.array_contains(stop, w))
    return F.array_join(words, " ")


def detector_text(col) -> Column:
    """Cleaned text, or the raw text when cleaning leaves 2 chars or fewer."""
    cleaned = clean_text_stop(col)
    return F.when(F.length(cleaned) > 2, cleaned).otherwise(F.coalesce(_c(col), F.lit("")))


def clean_description(col) -> Column:
    """Lower, ordered noise-pattern removal, squeeze. NULL -> ''."""
    c = F.lower(F.coalesce(_c(col), F.lit("")))
    for pat in NOISE_PATTERNS:
        c = F.regexp_replace(c, pat, " ")
    return squeeze(c)


def recurrence_keyword(col) -> Column:
    """1 when a word-bounded recurrence keyword occurs (case-insensitive)."""
    pat = r"\b(" + "|".join(RECURRENCE_KEYWORDS) + r")\b"
    return F.coalesce(F.lower(_c(col)).rlike(pat).cast("int"), F.lit(0))


def words(col) -> Column:
    """Whitespace tokens (no empty tokens)."""
    return F.filter(F.split(_c(col), r"\s+"), lambda w: F.length(w) > 0)


def token_sorted(col) -> Column:
    """Tokens sorted and re-joined with single spaces (for token-sort similarity)."""
    return F.array_join(F.array_sort(words(F.coalesce(_c(col), F.lit("")))), " ")


def char_wb_ngrams(col, n_min: int = 2, n_max: int = 4) -> Column:
    """Character n-grams inside space-padded words, lower-cased.

    For a padded word of length L, n runs from n_min to least(n_max, L): a word
    shorter than n is emitted once as a whole and larger n are skipped.
    """
    w = words(F.lower(F.coalesce(_c(col), F.lit(""))))

    def per_word(x):
        p = F.concat(F.lit(" "), x, F.lit(" "))
        L = F.length(p)
        return F.flatten(F.transform(
            F.sequence(F.lit(n_min), F.least(F.lit(n_max), L)),
            lambda n: F.transform(F.sequence(F.lit(1), L - n + 1), lambda i: F.substring(p, i, n))))

    return F.flatten(F.transform(w, per_word))


def word_ngrams(word: str, n_min: int = 2, n_max: int = 4) -> list[str]:
    """The n-grams of ``char_wb_ngrams`` for a word at hand, inside Arrow groups (one slice a gram)."""
    p = f" {word} "
    return [p[i:i + n] for n in range(n_min, min(n_max, len(p)) + 1) for i in range(len(p) - n + 1)]


def truncate_text(col, n: int = 40) -> Column:
    """Display truncation: first n chars + '..' when longer."""
    c = _c(col)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(".."))).otherwise(c)


def fixed2(x) -> Column:
    """Format a double with 2 decimals, rounding its exact binary value (half-even on
    exact ties), as C printf / Python do. Java's %.2f rounds the shortest decimal text
    half-up instead (10286.175 -> 10286.18 although the double is just below .175).

    100·|x| is split exactly into h + lo (Dekker's product: 100 fits in 26 bits, |x| is
    split into two 26-bit halves), so the distance of the exact product to the tie
    ``floor(h) + 0.5`` has the sign of ``(h - floor(h) - 0.5) + lo``: each step is exact
    below 2^46 and a rounded sum keeps the sign of the exact one. Small expression
    tree, no repeated sub-trees, so it stays cheap in generated code.
    """
    v = _c(x).cast("double")
    ax = F.abs(v)
    h = ax * 100.0
    t = ax * 134217729.0                      # 2^27 + 1
    a_hi = t - (t - ax)
    lo = (a_hi * 100.0 - h) + (ax - a_hi) * 100.0
    q = F.floor(h)
    d = (h - q - 0.5) + lo
    cents = q + F.when(d > 0, 1).when(d < 0, 0).otherwise(q % 2)
    body = F.format_string("%d.%02d", F.floor(cents / 100).cast("long"), (cents % 100).cast("int"))
    # a negative zero prints as -0.00; its text form is the cheap tell (zeros only)
    neg = (v < 0) | ((v == 0) & v.cast("string").startswith("-"))
    exact = F.concat(F.when(neg, F.lit("-")).otherwise(F.lit("")), body)
    # beyond 2^46 every double is a multiple of 1/64: the plain formatter is exact there
    return F.when(v.isNull(), F.lit(None)).when(ax >= 2.0 ** 46, F.format_string("%.2f", v)).otherwise(exact)


def group_key(account, amount) -> Column:
    """'{account}_amt_{amount:.2f}'."""
    return F.concat(_c(account), F.lit("_amt_"), fixed2(amount))


def account_of_group_key(col) -> Column:
    return F.split(_c(col), "_amt_").getItem(0)
