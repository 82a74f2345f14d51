"""Sources, cleaning, dedup queries."""

import uuid

from pyspark.sql import functions as F

from cadence.functions import text as T
from cadence.operators import clean as C
from cadence.plans.catalog import register
from cadence.plans.sqlfrag import clean_description, clean_stop, days, detector_text, keyword
from cadence.schema import CYCLE_LABELS, MISSING_ID_SENTINELS
from cadence.session import checkpoint_dir, materialize, store
from cadence.sources import io
from cadence.sources.fixtures import txn

_SENT = ", ".join(f"'{s}'" for s in MISSING_ID_SENTINELS)


@register("scan_transactions", "SELECT * FROM txn")
def q_scan(spark, sf):
    return C.cast_ids_labels(txn(spark, sf))


@register("pruned_scan", "SELECT trId, accountId, amount FROM txn")
def q_pruned(spark, sf):
    return io.pruned(txn(spark, sf), ["trId", "accountId", "amount"])


def _bank_folder(spark) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/banks-{uuid.uuid4().hex}"


def _write_csv(df, folder: str, name: str) -> None:
    df.write.option("header", True).option("compression", "gzip").csv(f"{folder}/{name}.csv")


_SIDE = "CAST(accountId AS INTEGER) % 3"
_TAKEN = "lower(CAST(isForeignCurrency AS VARCHAR)) <> 'true' AND status = 'Cleared'"


@register("consolidate_transactions", f"""
SELECT trId, accountId, date, amount, bankRawDescription, isRecurring, nullif(counter_party, '') AS counter_party, patternId, 'North' AS bank_name
FROM txn WHERE {_SIDE} = 0 AND {_TAKEN}
UNION ALL
SELECT trId, accountId, date, amount, bankRawDescription, isRecurring, NULL, NULL, 'South' FROM txn WHERE {_SIDE} = 1""")
def q_consolidate(spark, sf):
    """Bank files that the query writes from the transactions and reads back through the consolidation.

    North comes in two files of other column orders, of which the second repeats rows under another text;
    South has only the required columns; an empty field is a missing value; East holds wrong signs and West lacks a column: both are left out.
    """
    t = txn(spark, sf)
    raw = io.raw_bank_frame(t.select("trId", "accountId", "date", "amount", "bankRawDescription", "isRecurring", "direction",
                                     "status", "isForeignCurrency", "counter_party", "patternId"))
    raw = store(raw)  # five files are written from it: the transactions are joined once
    side = F.col("accountId").cast("int") % 3
    folder = _bank_folder(spark)
    north, south, east = (raw.filter(side == k) for k in range(3))
    _write_csv(north, folder, "North_DTransaction_1")
    again = north.withColumn("bankRawDescription", F.lit("SEEN BEFORE"))
    _write_csv(again.select(*reversed(again.columns)), folder, "North_DTransaction_2")
    _write_csv(south.select("id", "accountId", "date", "amount", "bankRawDescription", "isRecurring", "direction"), folder, "South_DTransaction")
    flipped = F.when(F.col("status") == "Cleared", F.lit("D")).otherwise(F.col("direction"))
    _write_csv(east.withColumn("direction", flipped), folder, "East_DTransaction")
    _write_csv(south.drop("bankRawDescription"), folder, "West_DTransaction")
    return io.consolidate_transactions(spark, folder)


@register("consolidate_patterns", """
WITH d AS (SELECT patternId, min(patternCycle) AS patternCycle, CAST(split_part(patternId, '-', 2) AS INTEGER) < 8 AS first
           FROM txn WHERE patternId IS NOT NULL GROUP BY patternId)
SELECT patternId, CASE WHEN first THEN patternCycle ELSE upper(patternCycle) END AS patternCycle,
       CASE WHEN first THEN 'A' ELSE 'B' END AS bank_name FROM d""")
def q_consolidate_patterns(spark, sf):
    """Pattern files: the first file's row of a pattern wins, a file without the columns is skipped."""
    p = io.pattern_table(txn(spark, sf)).select("patternId", "patternCycle")
    folder = _bank_folder(spark)
    _write_csv(p.filter(F.split("patternId", "-")[1].cast("int") < 8), folder, "A_DRecurringPattern")
    _write_csv(p.select(F.upper("patternCycle").alias("patternCycle"), "patternId"), folder, "B_DRecurringPattern")
    _write_csv(p.select("patternId"), folder, "0_DRecurringPattern")
    return io.consolidate_patterns(spark, folder)


@register("schema_gate", """
SELECT trId, accountId, date, amount, bankRawDescription, isRecurring, counter_party, patternId, bank_name
FROM txn WHERE amount >= 0
UNION ALL
SELECT trId, accountId, date, amount, bankRawDescription, isRecurring,
       NULL AS counter_party, NULL AS patternId, NULL AS bank_name
FROM txn WHERE amount < 0""")
def q_schema_gate(spark, sf):
    t = txn(spark, sf)
    full = t.filter("amount >= 0")                   # required + optional + bank kept
    bare = t.filter("amount < 0").select(*C.REQUIRED)  # required only: optional become NULL
    broken = t.drop("date")                          # lacks a required column: skipped
    return C.union_files(C.schema_gate([full, bare, broken]))


@register("bank_from_path", """
SELECT DISTINCT bank_name || '_DTransaction_2024.csv' AS file_name, bank_name AS bank FROM txn""")
def q_bank_from_path(spark, sf):
    names = txn(spark, sf).select(F.concat("bank_name", F.lit("_DTransaction_2024.csv")).alias("file_name")).distinct()
    return names.withColumn("bank", io.bank_from_file_name(F.col("file_name"), "_DTransaction"))


@register("rename_columns", """
SELECT trId, counter_party FROM txn""")
def q_rename(spark, sf):
    return C.rename_columns(io.raw_bank_frame(txn(spark, sf))).select("trId", "counter_party")


@register("cast_ids_labels", """
SELECT trId, accountId, CASE WHEN lower(CAST(isForeignCurrency AS VARCHAR)) = 'true' THEN 1 ELSE 0 END AS lbl FROM txn""")
def q_cast(spark, sf):
    t = txn(spark, sf)
    return t.select("trId", "accountId", C.bool_label("isForeignCurrency").alias("lbl"))


@register("drop_required_nulls", """
SELECT trId FROM txn WHERE patternId IS NOT NULL AND date IS NOT NULL AND amount IS NOT NULL""")
def q_drop_nulls(spark, sf):
    return C.drop_required_nulls(txn(spark, sf), ["patternId", "date", "amount"]).select("trId")


@register("cleared_domestic", """
SELECT trId FROM txn WHERE NOT coalesce(lower(CAST(isForeignCurrency AS VARCHAR)) = 'true', false) AND status = 'Cleared'""")
def q_cleared(spark, sf):
    return C.cleared_domestic(txn(spark, sf)).select("trId")


@register("sign_violations", """
SELECT count(*) FILTER (WHERE amount = 0) AS zero_amount,
       count(*) FILTER (WHERE (amount > 0 AND direction <> 'D') OR (amount < 0 AND direction <> 'C')) AS sign_mismatch
FROM txn""")
def q_sign(spark, sf):
    return C.sign_violations(txn(spark, sf))


@register("filter_direction", "SELECT trId, amount FROM txn WHERE amount < 0")
def q_dir(spark, sf):
    return C.filter_direction(txn(spark, sf), -1).select("trId", "amount")


@register("min_account_rows", """
SELECT trId FROM txn_orders WHERE accountId IN (SELECT accountId FROM txn_orders GROUP BY accountId HAVING count(*) >= 5)""",
          views=("txn_orders",))
def q_min_rows(spark, sf):
    from cadence.sources.fixtures import txn_orders
    return C.min_account_rows(txn_orders(spark, sf), 5).select("trId")


@register("recent_window", """
SELECT trId FROM (SELECT trId, date, max(date) OVER (PARTITION BY accountId) AS mx FROM txn)
WHERE date >= mx - INTERVAL 150 DAY""")
def q_recent(spark, sf):
    return C.recent_window(txn(spark, sf), 150).select("trId")


@register("min_account_span", f"""
WITH r AS (SELECT * FROM (SELECT *, max(date) OVER (PARTITION BY accountId) AS mx FROM txn_events)
           WHERE date >= mx - INTERVAL 20 DAY),
ok AS (SELECT accountId FROM r GROUP BY accountId HAVING {days('min(date)', 'max(date)')} >= 18)
SELECT trId FROM r WHERE accountId IN (SELECT accountId FROM ok)""", views=("txn_events",))
def q_min_span(spark, sf):
    from cadence.sources.fixtures import txn_events
    return C.lex_preprocess(txn_events(spark, sf), days=20, min_days=18).select("trId")


def _runs3(x: str) -> str:
    for ch in "abcdefghijklmnopqrstuvwxyz0123456789# ":
        x = f"regexp_replace({x}, '{ch}{{3,}}', '{ch * 3}', 'g')"
    return x


@register("clean_text", "SELECT trId, " + _runs3(
    "regexp_replace(lower(trim(bankRawDescription)), '\\d{3,}', '###', 'g')") + " AS txt FROM txn")
def q_clean_text(spark, sf):
    return txn(spark, sf).select("trId", T.clean_text(F.col("bankRawDescription"), hide_digits=True).alias("txt"))


@register("clean_text_stop", f"SELECT trId, {clean_stop('bankRawDescription')} AS txt, {detector_text('bankRawDescription')} AS final_text FROM txn")
def q_clean_stop(spark, sf):
    t = txn(spark, sf)
    return t.select("trId", T.clean_text_stop(F.col("bankRawDescription")).alias("txt"),
                    T.detector_text(F.col("bankRawDescription")).alias("final_text"))


@register("clean_description", f"SELECT trId, {clean_description('bankRawDescription')} AS txt FROM txn")
def q_clean_desc(spark, sf):
    return txn(spark, sf).select("trId", T.clean_description(F.col("bankRawDescription")).alias("txt"))


@register("recurrence_keyword", f"""
SELECT trId, {keyword("CASE WHEN length(bankRawDescription) % 3 = 0 THEN bankRawDescription || ' monthly' ELSE bankRawDescription || ' fees' END")} AS kw FROM txn""")
def q_keyword(spark, sf):
    t = txn(spark, sf)
    d = F.when(F.length("bankRawDescription") % 3 == 0, F.concat("bankRawDescription", F.lit(" monthly"))) \
         .otherwise(F.concat("bankRawDescription", F.lit(" fees")))
    return t.select("trId", T.recurrence_keyword(d).alias("kw"))


@register("counterparty_coverage", """
SELECT coalesce(avg(CASE WHEN counter_party IS NOT NULL AND trim(counter_party) <> '' THEN 1.0 ELSE 0.0 END), 0.0) AS coverage,
       coalesce(avg(CASE WHEN counter_party IS NOT NULL AND trim(counter_party) <> '' THEN 1.0 ELSE 0.0 END), 0.0) >= 0.5 AS enabled
FROM txn""")
def q_cp(spark, sf):
    return C.counterparty_coverage(txn(spark, sf)).select(F.round("coverage", 6).alias("coverage"), "enabled")


@register("valid_ground_truth", f"SELECT trId FROM txn WHERE patternId IS NOT NULL AND patternId NOT IN ({_SENT})")
def q_valid_gt(spark, sf):
    return C.valid_ground_truth(txn(spark, sf)).select("trId")


@register("noise_pattern_ids", """
SELECT trId, CASE WHEN patternId IS NULL OR patternId = '' OR patternId = '-1' THEN 'NOISE_' || trId ELSE patternId END AS patternId FROM txn""")
def q_noise(spark, sf):
    return C.noise_pattern_ids(txn(spark, sf)).select("trId", "patternId")


@register("encode_patterns", f"""
SELECT t.trId, coalesce(c.code, -1) AS pattern_code FROM txn t LEFT JOIN
 (SELECT p, CAST(row_number() OVER (ORDER BY p) - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT patternId AS p FROM txn WHERE patternId IS NOT NULL AND patternId NOT IN ({_SENT}))) c
 ON t.patternId = c.p""")
def q_encode(spark, sf):
    return C.encode_patterns(txn(spark, sf)).select("trId", "pattern_code")


_CYC = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CYCLE_LABELS))


@register("cycle_code", f"SELECT trId, CASE patternCycle {_CYC} ELSE 0 END AS cycle_code FROM txn")
def q_cycle(spark, sf):
    return C.cycle_code(txn(spark, sf)).select("trId", "cycle_code")


@register("fill_text", """
SELECT trId, coalesce(CASE WHEN amount < 0 THEN NULL ELSE bankRawDescription END, '') AS bankRawDescription FROM txn""")
def q_fill(spark, sf):
    t = txn(spark, sf).withColumn("bankRawDescription",
                                  F.when(F.col("amount") < 0, F.lit(None)).otherwise(F.col("bankRawDescription")))
    return C.fill_text(t).select("trId", "bankRawDescription")


@register("truncate_text", """
SELECT trId, CASE WHEN length(s) > 12 THEN substr(s, 1, 12) || '..' ELSE s END AS short_text
FROM (SELECT trId, bankRawDescription AS s FROM txn)""")
def q_trunc(spark, sf):
    return txn(spark, sf).select("trId", T.truncate_text(F.col("bankRawDescription"), 12).alias("short_text"))


@register("group_key", """
SELECT trId, accountId || '_amt_' || printf('%.2f', amount) AS gkey, accountId AS acc_back FROM txn""")
def q_group_key(spark, sf):
    t = txn(spark, sf).select("trId", T.group_key(F.col("accountId"), F.col("amount")).alias("gkey"))
    return t.withColumn("acc_back", T.account_of_group_key(F.col("gkey")))


@register("dedup_transactions", "SELECT DISTINCT trId, accountId FROM txn")
def q_dedup(spark, sf):
    t = txn(spark, sf).select("trId", "accountId", "bank_name")  # of the rest, nothing is returned
    doubled = t.unionByName(t)  # every id twice: the first copy must survive once
    return C.dedup_transactions(doubled).select("trId", "accountId")


@register("dedup_patterns", """
SELECT patternId, min(bank_name) AS bank_name FROM txn WHERE patternId IS NOT NULL GROUP BY patternId""")
def q_dedup_pat(spark, sf):
    p = txn(spark, sf).filter(F.col("patternId").isNotNull()).select("patternId", "bank_name", "patternCycle")
    return C.dedup_first(p, "patternId", ["bank_name"]).select("patternId", "bank_name")


_BANKS = """
banks AS (SELECT bank_name, count(*) AS n, regexp_replace(bank_name, '\\d+', '', 'g') AS base FROM txn GROUP BY bank_name),
allowed AS (SELECT bank_name FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY n DESC, bank_name) AS r FROM banks) WHERE r = 1)"""


@register("bank_variants", "WITH " + _BANKS + "\nSELECT trId, bank_name FROM txn WHERE bank_name IN (SELECT bank_name FROM allowed)")
def q_bank_variants(spark, sf):
    return C.bank_variants(txn(spark, sf)).select("trId", "bank_name")


@register("deduplicate", "WITH " + _BANKS + """
SELECT trId FROM txn WHERE bank_name IN (SELECT bank_name FROM allowed)
  AND NOT coalesce(lower(CAST(isForeignCurrency AS VARCHAR)) = 'true', false) AND status = 'Cleared'""")
def q_deduplicate(spark, sf):
    return C.deduplicate(txn(spark, sf)).select("trId")


@register("union_files", """
SELECT trId, bank_name, counter_party FROM txn WHERE amount > 0
UNION ALL SELECT trId, bank_name, NULL FROM txn WHERE amount <= 0""")
def q_union(spark, sf):
    t = txn(spark, sf)
    a = t.filter("amount > 0").select("trId", "bank_name", "counter_party")
    b = t.filter("amount <= 0").select("trId", "bank_name")
    return C.union_files([a, b])


@register("tag_union_splits", """
SELECT trId, CASE WHEN amount > 0 THEN 'val' ELSE 'test' END AS split FROM txn""")
def q_tag_union(spark, sf):
    t = txn(spark, sf).select("trId", "amount")
    return C.tag_union_splits({"val": t.filter("amount > 0"), "test": t.filter("amount <= 0")}).select("trId", "split")
