"""DuckDB SQL fragments shared by oracle texts (oracle side only)."""

from cadence.functions.text import NOISE_PATTERNS, RECURRENCE_KEYWORDS, STOPWORDS

_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def clean_stop(x: str) -> str:
    c = (f"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^a-z\\s]', ' ', 'g'), "
         f"'\\s+', ' ', 'g'))")
    return f"array_to_string(list_filter(string_split({c}, ' '), lambda w: NOT list_contains({_STOP}, w)), ' ')"


def detector_text(x: str) -> str:
    c = clean_stop(x)
    return f"(CASE WHEN length({c}) > 2 THEN {c} ELSE coalesce({x}, '') END)"


def clean_description(x: str) -> str:
    c = f"lower(coalesce({x}, ''))"
    for p in NOISE_PATTERNS:
        c = f"regexp_replace({c}, '{p}', ' ', 'g')"
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def keyword(x: str) -> str:
    pat = "\\b(" + "|".join(RECURRENCE_KEYWORDS) + ")\\b"
    return f"coalesce(CAST(regexp_matches(lower({x}), '{pat}') AS INTEGER), 0)"


def days(a: str, b: str) -> str:
    """Whole elapsed days from a to b (b >= a)."""
    return f"((epoch_us({b}) - epoch_us({a})) // 86400000000)"


def windows_cte(src: str = "txn", size: int = 200, min_rows: int = 2) -> str:
    return f"""
wpos AS (
  SELECT *, CAST(floor((row_number() OVER (PARTITION BY accountId ORDER BY amount, date, trId) - 1) / {size}) AS INTEGER) AS win
  FROM {src}
),
wcnt AS (SELECT *, count(*) OVER (PARTITION BY accountId, win) AS win_rows FROM wpos),
wins AS (SELECT * FROM wcnt WHERE win_rows >= {min_rows})"""


def candidate_features_select(grp: str, src: str) -> str:
    """Aggregates of candidate_features over `src` (with column _ival), grouped by `grp`."""
    return f"""
SELECT {grp},
  coalesce(stddev_samp(_ival), 0.0) AS interval_std,
  median(_ival) AS interval_median,
  coalesce(stddev_samp(dayofmonth(date)), 0.0) AS dom_std,
  coalesce(stddev_samp(isodow(date) - 1), 0.0) AS dow_std,
  stddev_samp(amount) AS amount_std,
  CASE WHEN avg(abs(amount)) > 0 THEN stddev_samp(amount) / avg(abs(amount)) ELSE 0.0 END AS amount_cv,
  count(*) AS count,
  {days('min(date)', 'max(date)')} AS days_span,
  max(_win_text_len) AS description_length,
  count(DISTINCT bankRawDescription) AS unique_descriptions,
  avg(CAST(isRecurring AS DOUBLE)) > 0.5 AS label,
  min(trId) AS group_id
FROM {src} GROUP BY {grp}"""


HEURISTIC = """(CASE WHEN count < 3 THEN round(interval_std, 9) < 10 AND round(amount_cv, 9) < 0.2
      ELSE (round(interval_std, 9) < 10 OR round(dom_std, 9) < 1.5 OR round(dow_std, 9) < 1.0)
           AND round(amount_cv, 9) < 0.2 END)"""


def char_wb_grams(w: str) -> str:
    """Character 2-4 grams of one word (padded with spaces), as a DuckDB list."""
    return (f"flatten(list_transform(generate_series(2, least(4, length({w}) + 2)), "
            f"lambda n: list_transform(generate_series(1, length({w}) + 3 - n), "
            f"lambda i: substr(' ' || {w} || ' ', i, n))))")


def tfidf_cluster_ctes(src: str = "tl", keys: str = "accountId, win", text: str = "_text",
                       raw: str = "bankRawDescription", eps: float = 0.29, min_samples: int = 2) -> str:
    """CTEs docs .. clus: per-window TF-IDF, cosine edges, components (recursive), labels.

    Needs WITH RECURSIVE. Output CTE `clus` = src rows + column `cluster` (NULL = noise).
    """
    kj = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    on = lambda a, b: " AND ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in keys.split(","))
    of = lambda a: ", ".join(f"{a}.{k.strip()}" for k in keys.split(","))
    parts = f"""
reach AS (
  SELECT {keys}, ua AS t, ua AS l FROM und
  UNION
  SELECT {of("r")}, u.ub, r.l FROM reach r JOIN und u ON {on("r", "u")} AND r.t = u.ua),
comp AS (SELECT {keys}, t, min(l) AS cc FROM reach GROUP BY ALL),"""
    if min_samples != 2:
        parts = f"""
core AS (SELECT {of("d")}, d.{text} AS t FROM docs d
         JOIN (SELECT DISTINCT {keys}, {text} FROM post) v ON {on("d", "v")} AND d.{text} = v.{text}
         LEFT JOIN und u ON {on("d", "u")} AND u.ua = d.{text}
         LEFT JOIN docs n ON {on("n", "u")} AND n.{text} = u.ub
         GROUP BY {of("d")}, d.{text}, d.m HAVING d.m + coalesce(sum(n.m), 0) >= {min_samples}),
cund AS (SELECT u.* FROM und u JOIN core a ON {on("u", "a")} AND u.ua = a.t JOIN core b ON {on("u", "b")} AND u.ub = b.t),
reach AS (
  SELECT {keys}, t, t AS l FROM core
  UNION
  SELECT {of("r")}, u.ub, r.l FROM reach r JOIN cund u ON {on("r", "u")} AND r.t = u.ua),
kern AS (SELECT {keys}, t, min(l) AS cc FROM reach GROUP BY ALL),
comp AS (SELECT * FROM kern
         UNION ALL
         SELECT {of("u")}, u.ua, min(k.cc) FROM und u JOIN kern k ON {on("u", "k")} AND k.t = u.ub
         LEFT JOIN core c ON {on("c", "u")} AND c.t = u.ua WHERE c.t IS NULL GROUP BY {of("u")}, u.ua),"""
    return f"""
docs AS (SELECT {keys}, {text}, count(*) AS m, sum(count(*)) OVER (PARTITION BY {keys}) AS n_docs
         FROM {src} GROUP BY {keys}, {text}),
dwords AS (SELECT *, unnest(list_filter(regexp_split_to_array(lower({text}), '\\s+'), lambda x: length(x) > 0)) AS wd
           FROM docs),
grams AS (SELECT {keys}, {text}, m, n_docs, unnest({char_wb_grams('wd')}) AS gram FROM dwords),
tf AS (SELECT {keys}, {text}, m, n_docs, gram, count(*) AS tf FROM grams GROUP BY ALL),
dfq AS (SELECT *, sum(m) OVER (PARTITION BY {keys}, gram) AS dfreq FROM tf),
wt AS (SELECT *, tf * (ln((1 + n_docs) / (1 + dfreq)) + 1) AS w0 FROM dfq),
post AS (SELECT {keys}, {text}, gram, w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY {keys}, {text})) AS w FROM wt),
edges AS (SELECT {", ".join("a." + k.strip() for k in keys.split(","))}, a.{text} AS t1, b.{text} AS t2
          FROM post a JOIN post b ON {kj} AND a.gram = b.gram AND a.{text} < b.{text}
          GROUP BY ALL HAVING round(1 - sum(a.w * b.w), 9) <= {eps}),
und AS (SELECT {keys}, t1 AS ua, t2 AS ub FROM edges UNION ALL SELECT {keys}, t2, t1 FROM edges),{parts}
vec AS (SELECT DISTINCT {keys}, {text} FROM post),
lab AS (
  SELECT d.*, CASE WHEN c.cc IS NOT NULL THEN c.cc WHEN v.{text} IS NOT NULL AND d.m >= {min_samples} THEN d.{text} END AS _label,
         bool_or(v.{text} IS NOT NULL) OVER (PARTITION BY {", ".join("d." + k.strip() for k in keys.split(","))}) AS _any_vec
  FROM docs d
  LEFT JOIN vec v ON {" AND ".join(f"d.{k.strip()} = v.{k.strip()}" for k in keys.split(","))} AND d.{text} = v.{text}
  LEFT JOIN comp c ON {" AND ".join(f"d.{k.strip()} = c.{k.strip()}" for k in keys.split(","))} AND d.{text} = c.t),
clus AS (
  SELECT s.*, CASE WHEN lab._any_vec THEN lab._label ELSE 'raw:' || s.{raw} END AS cluster
  FROM {src} s JOIN lab USING ({keys}, {text}))"""


def token_sorted(x: str) -> str:
    return f"array_to_string(list_sort(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')), ' ')"


def lcs_ctes(texts: str) -> str:
    """CTE ``ratio`` (s, t, score) for the distinct pairs (s, t) of ``texts``; needs WITH RECURSIVE.

    ``lcs`` goes through s character by character; ``line`` is the row of the dynamic programme over t,
    whose next value is the running maximum of "one more than the diagonal" at equal characters and
    the value above elsewhere.
    """
    step = ("CASE WHEN j = 0 THEN 0 WHEN substr(t, j::INTEGER, 1) = substr(s, i + 1, 1) THEN line[j] + 1 ELSE line[j + 1] END")
    return f"""
lcs AS (
  SELECT DISTINCT s, t, 0 AS i, list_transform(range(length(t) + 1), lambda j: 0) AS line FROM {texts}
  UNION ALL
  SELECT s, t, i + 1, list_transform(range(length(t) + 1), lambda k: list_max(cand[1:k + 1])) FROM (
    SELECT s, t, i, list_transform(range(length(t) + 1), lambda j: {step}) AS cand FROM lcs WHERE i < length(s))),
ratio AS (SELECT s, t, CASE WHEN length(s) + length(t) = 0 THEN 100.0
                            ELSE 200.0 * line[length(t) + 1] / (length(s) + length(t)) END AS score FROM lcs WHERE i = length(s))"""


def amount_vocab_ctes(src: str, top: int = 20, bins: int = 20) -> str:
    """CTEs counts, top, toptok, rest, q, edges, bins: the amount vocabulary learned from ``src``."""
    return f"""
counts AS (SELECT amount, count(*) AS n FROM {src} GROUP BY amount),
top AS (SELECT amount FROM counts ORDER BY n DESC, amount LIMIT {top}),
toptok AS (SELECT amount, CAST(row_number() OVER (ORDER BY amount) + 1 AS INTEGER) AS token FROM top),
rest AS (SELECT ln(1 + abs(amount)) AS la FROM {src} WHERE amount NOT IN (SELECT amount FROM top)),
q AS (SELECT list_sort(list_distinct(quantile_cont(la, [{", ".join(str(i / bins) for i in range(bins + 1))}]))) AS u FROM rest),
edges AS (SELECT CASE WHEN u IS NULL OR len(u) < 2 THEN [CAST('-inf' AS DOUBLE), CAST('inf' AS DOUBLE)] ELSE u END AS edges FROM q),
bins AS (SELECT CAST(i - 1 AS INTEGER) AS bin, edges[i] AS edge_lo,
                CAST((SELECT count(*) FROM top) + 2 + i - 1 AS INTEGER) AS token
         FROM edges, range(1, len(edges)) t(i))"""
