"""Filters, cleaning, casting, dedup and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions.text import clean_description, recurrence_keyword
from cadence.operators.ordered import global_positions
from cadence.schema import CYCLE_LABELS, MISSING_ID_SENTINELS, Cols

REQUIRED = ["trId", "accountId", "date", "amount", "bankRawDescription", "isRecurring"]
OPTIONAL = ["counter_party", "patternId", "p_categoryGroupId", "p_subCategoryId"]

# Raw bank-file column names -> engine names.
RENAMES = {
    "id": "trId",
    "deviceId": "counter_party",
    "personeticsCategoryGroupId": "p_categoryGroupId",
    "personeticsSubCategoryId": "p_subCategoryId",
}


def drop_required_nulls(df: DataFrame, subset: list[str] | None = None, cols: Cols = Cols()) -> DataFrame:
    """Drop rows with NULL in any required column (NaN amount counts as missing)."""
    subset = subset or [c for c in REQUIRED if c in df.columns]
    out = df.na.drop(subset=subset)
    if cols.amount in subset:
        out = out.filter(~F.isnan(cols.amount))
    return out


def cleared_domestic(df: DataFrame, cols: Cols = Cols()) -> DataFrame:
    """Keep rows not in foreign currency (string compare, case-insensitive) and status 'Cleared'."""
    foreign = F.lower(F.col(cols.foreign).cast("string")) == "true"
    return df.filter(~F.coalesce(foreign, F.lit(False)) & (F.col(cols.status) == "Cleared"))


def cleared_or_all(df: DataFrame, cols: Cols = Cols()) -> DataFrame:
    """``cleared_domestic`` where the table has both columns, else all rows."""
    return cleared_domestic(df, cols) if cols.foreign in df.columns and cols.status in df.columns else df


def sign_violations(df: DataFrame, cols: Cols = Cols()) -> DataFrame:
    """One row: zero amounts and sign/direction mismatches (both must be 0)."""
    a, d = F.col(cols.amount), F.col(cols.direction)
    return df.agg(
        F.count_if(a == 0).alias("zero_amount"),
        F.count_if(((a > 0) & (d != "D")) | ((a < 0) & (d != "C"))).alias("sign_mismatch"))


def filter_direction(df: DataFrame, direction: int, cols: Cols = Cols()) -> DataFrame:
    """+1 keeps amount > 0, -1 keeps amount < 0, 0 keeps all."""
    if direction == 0:
        return df
    return df.filter(F.col(cols.amount) * direction > 0)


def _account_counts(df: DataFrame, cols: Cols) -> DataFrame:
    # partial aggregation: one row per account leaves each map task
    return df.groupBy(cols.accountId).agg(F.count(F.lit(1)).alias("_n"),
                                          F.min(cols.date).alias("_dmin"), F.max(cols.date).alias("_dmax"))


def min_account_rows(df: DataFrame, n: int = 5, cols: Cols = Cols()) -> DataFrame:
    """Keep accounts with at least n rows (aggregate + semi join; no account-wide window)."""
    ok = _account_counts(df, cols).filter(F.col("_n") >= n).select(cols.accountId)
    return df.join(ok, cols.accountId, "left_semi")


def recent_window(df: DataFrame, days: int = 150, cols: Cols = Cols()) -> DataFrame:
    """Keep rows with date >= account max date - days (inclusive)."""
    mx = df.groupBy(cols.accountId).agg(F.max(cols.date).alias("_dmax"))
    return (df.join(mx, cols.accountId)
              .filter(F.col(cols.date) >= F.col("_dmax") - F.make_dt_interval(F.lit(days)))
              .drop("_dmax"))


def min_account_span(df: DataFrame, days: int = 35, cols: Cols = Cols()) -> DataFrame:
    """Keep accounts whose (max - min) whole days >= days."""
    st = _account_counts(df, cols)
    ok = st.filter(F.timestamp_diff("DAY", F.col("_dmin"), F.col("_dmax")) >= days).select(cols.accountId)
    return df.join(ok, cols.accountId, "left_semi")


def lex_preprocess(df: DataFrame, days: int = 150, min_days: int = 35, cols: Cols = Cols()) -> DataFrame:
    """recent_window then min_account_span (the lexical loader's preprocessing)."""
    return min_account_span(recent_window(df, days, cols), min_days, cols)


def counterparty_coverage(df: DataFrame, cols: Cols = Cols(), min_share: float = 0.5) -> DataFrame:
    """One row: share of non-empty counter parties and whether the feature stays enabled."""
    if cols.counter_party not in df.columns:
        return df.sparkSession.createDataFrame([(0.0, False)], "coverage double, enabled boolean")
    cp = F.col(cols.counter_party)
    share = F.avg(F.when(cp.isNotNull() & (F.trim(cp) != ""), 1.0).otherwise(0.0))
    return df.agg(F.coalesce(share, F.lit(0.0)).alias("coverage")).withColumn(
        "enabled", F.col("coverage") >= min_share)


def valid_ground_truth(df: DataFrame, cols: Cols = Cols()) -> DataFrame:
    """Drop rows whose pattern id is NULL or a missing-id sentinel."""
    p = F.col(cols.patternId).cast("string")
    return df.filter(p.isNotNull() & ~p.isin(*MISSING_ID_SENTINELS))


def noise_pattern_ids(df: DataFrame, cols: Cols = Cols()) -> DataFrame:
    """Training: rows without a pattern get the unique id 'NOISE_<trId>'."""
    p = F.col(cols.patternId)
    noise = p.isNull() | (p == "") | (p.cast("string") == "-1")
    return df.withColumn(cols.patternId, F.when(noise, F.concat(F.lit("NOISE_"), F.col(cols.trId))).otherwise(p))


def encode_patterns(df: DataFrame, cols: Cols = Cols(), out: str = "pattern_code") -> DataFrame:
    """Dense int code per pattern in pattern-id order (0-based); noise -> -1.

    The code table is built from the distinct patterns with range-partitioned
    positions, so no single task sorts all patterns; it joins back on patternId.
    """
    p = F.col(cols.patternId).cast("string")
    valid = p.isNotNull() & ~p.isin(*MISSING_ID_SENTINELS)
    pats = df.filter(valid).select(p.alias("_pat")).distinct()
    codes = global_positions(pats, ["_pat"], "_code")
    out_df = df.withColumn("_pat", F.when(valid, p)).join(codes, "_pat", "left")
    return out_df.withColumn(out, F.coalesce(F.col("_code"), F.lit(-1)).cast("int")).drop("_pat", "_code")


def cycle_code(df: DataFrame, cols: Cols = Cols(), out: str = "cycle_code") -> DataFrame:
    """Cycle label -> 0..7; unknown or NULL -> 0."""
    m = F.create_map(*[x for i, c in enumerate(CYCLE_LABELS) for x in (F.lit(c), F.lit(i))])
    return df.withColumn(out, F.coalesce(m[F.col(cols.patternCycle)], F.lit(0)))


def fill_text(df: DataFrame, cols: Cols = Cols()) -> DataFrame:
    return df.withColumn(cols.text, F.coalesce(F.col(cols.text), F.lit("")))


def rename_columns(df: DataFrame, mapping: dict | None = None) -> DataFrame:
    m = {k: v for k, v in (mapping or RENAMES).items() if k in df.columns}
    return df.withColumnsRenamed(m)


def bool_label(col) -> "F.Column":
    """bool / 'true' strings / ints -> 0/1 (NULL -> 0)."""
    s = F.lower(F.col(col).cast("string"))
    return F.when(s.isin("true", "1", "1.0"), 1).otherwise(0)


def cast_ids_labels(df: DataFrame, cols: Cols = Cols()) -> DataFrame:
    """Ids to string, label to 0/1 int."""
    out = df
    for c in (cols.trId, cols.accountId, cols.patternId):
        if c in out.columns:
            out = out.withColumn(c, F.col(c).cast("string"))
    if cols.label in out.columns:
        out = out.withColumn(cols.label, bool_label(cols.label))
    return out


def schema_gate(frames: list[DataFrame], required: list[str] | None = None,
                optional: list[str] | None = None) -> list[DataFrame]:
    """Drop inputs missing a required column; keep required + present optional + bank_name (and the ingest order)."""
    required = required or REQUIRED
    optional = optional if optional is not None else OPTIONAL
    kept = []
    for f in frames:
        if all(c in f.columns for c in required):
            keep = required + [c for c in optional if c in f.columns] + [c for c in ("bank_name", "_ingest") if c in f.columns]
            kept.append(f.select(*keep))
    return kept


def union_files(frames: list[DataFrame]) -> DataFrame:
    """Concatenate frames by column name (missing columns become NULL)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def tag_union_splits(named: dict[str, DataFrame]) -> DataFrame:
    return union_files([d.withColumn("split", F.lit(k)) for k, d in named.items()])


def dedup_first(df: DataFrame, key: str, order: list) -> DataFrame:
    """Keep the first row per key under ``order``.

    A ``min_by`` aggregate, not a window: map tasks collapse their copies before the
    shuffle, so a key with a third of all rows never lands whole on one task.
    """
    # key and order travel once: the key is the same in a group, the order columns of its first row are their minimum
    by = [c for c in order if c != key]
    rest = [c for c in df.columns if c != key and c not in by]
    of = {key: "_k", **{c: f"_o.`{c}`" for c in by}, **{c: f"_r.`{c}`" for c in rest}}
    packed = df.select(F.col(key).alias("_k"), F.struct(F.lit(0).alias("_"), *by).alias("_o"), F.struct(F.lit(0).alias("_"), *rest).alias("_r"))
    first = packed.groupBy("_k").agg(F.min("_o").alias("_o"), F.min_by("_r", "_o").alias("_r"))
    return first.select(*(F.col(of[c]).alias(c) for c in df.columns))


def dedup_transactions(df: DataFrame, cols: Cols = Cols(), order: list | None = None) -> DataFrame:
    """First row per trId by ingest order (``_ingest`` when present, else bank then id)."""
    if order is None:
        order = ["_ingest"] if "_ingest" in df.columns else [cols.bank_name, cols.trId]
    return dedup_first(df, cols.trId, order)


def dedup_patterns(df: DataFrame, cols: Cols = Cols(), order: list | None = None) -> DataFrame:
    return dedup_first(df, cols.patternId, order or [cols.bank_name, cols.patternCycle])


def bank_variants(df: DataFrame, cols: Cols = Cols()) -> DataFrame:
    """Per base name (digits removed) keep only the variant with most rows (tie: name)."""
    stats = (df.groupBy(cols.bank_name).agg(F.count(F.lit(1)).alias("_rows"))
               .withColumn("_base", F.regexp_replace(cols.bank_name, r"\d+", "")))
    w = Window.partitionBy("_base").orderBy(F.desc("_rows"), F.col(cols.bank_name))
    allowed = stats.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(cols.bank_name)
    # one row per bank name: AQE broadcasts it when its runtime size is small
    return df.join(allowed, cols.bank_name, "left_semi")


def deduplicate(df: DataFrame, cols: Cols = Cols(), order: list | None = None) -> DataFrame:
    """bank variants, then first row per trId, then the cleared/domestic filter."""
    return cleared_domestic(dedup_transactions(bank_variants(df, cols), cols, order), cols)


def consolidate(frames: list[DataFrame], cols: Cols = Cols()) -> DataFrame:
    """Raw bank frames -> one clean transactions table (filter, rename, gate, drop, union, dedup)."""
    prepared = []
    for f in frames:
        prepared.append(rename_columns(cleared_or_all(f, cols)))
    gated = schema_gate(prepared)
    unioned = drop_required_nulls(union_files(gated), REQUIRED, cols)
    order = ["_ingest"] if "_ingest" in unioned.columns else [cols.bank_name, cols.trId]
    return dedup_first(unioned, cols.trId, order)


def with_pair_text(df: DataFrame, cols: Cols = Cols()) -> DataFrame:
    """Keyword flag and cleaned description used by the extended pair generator."""
    return (df.withColumn("has_keyword", recurrence_keyword(F.col(cols.text)))
              .withColumn("clean_text", clean_description(F.col(cols.text))))
