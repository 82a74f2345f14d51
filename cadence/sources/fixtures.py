"""Fixture views over the driver tables (FIXTURES.md §3).

Each view exists twice: as a Spark DataFrame plan (used by the engine) and as
DuckDB SQL text (used only by the oracle). The two are written independently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.schema import CYCLE_LABELS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def txn(spark: SparkSession, sf_dir: str, **extra) -> DataFrame:
    """V1: line items as account transactions (account = supplier); ``extra``: more columns over lineitem's."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    # nation and region are fixed-size dimensions (25 / 5 rows): broadcast is bounded.
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = F.broadcast(nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", F.concat(F.col("r_name"), F.col("n_nationkey").cast("string")).alias("bank_name")))
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    # supplier and part grow with the scale factor: no hint, Spark picks the join. Supplier is met as a plain
    # scan, whose size is known before its rows are read: a small one moves no line item.
    j = (li.join(sup, F.col("l_suppkey") == F.col("s_suppkey")).join(geo, F.col("s_nationkey") == F.col("n_nationkey"))
           .join(part, F.col("l_partkey") == F.col("p_partkey")))
    rec = F.col("l_linestatus") == F.lit("F")
    amount = F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))
    cycles = F.array(*[F.lit(c) for c in CYCLE_LABELS])
    return j.select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                    F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("trId"),
        F.col("l_suppkey").cast("string").alias("accountId"),
        F.col("l_shipdate").alias("date"),
        amount.alias("amount"),
        F.concat(F.upper("p_name"), F.lit(" "), (F.col("l_orderkey") % 1000).cast("string"))
         .alias("bankRawDescription"),
        rec.cast("int").alias("isRecurring"),
        F.when(rec, F.concat_ws("-", F.col("l_suppkey"), F.col("l_partkey") % 16)).alias("patternId"),
        F.when(rec, F.element_at(cycles, (F.col("p_size") % 8 + 1).cast("int")))
         .otherwise(F.lit("None")).alias("patternCycle"),
        F.when(F.col("l_quantity") < 10, F.lit("")).otherwise(F.col("p_brand")).alias("counter_party"),
        F.col("bank_name"),
        F.when(F.col("l_tax") == F.lit(0.08), F.lit("Pending")).otherwise(F.lit("Cleared")).alias("status"),
        (F.col("l_discount") == F.lit(0.1)).alias("isForeignCurrency"),
        F.when(amount > 0, F.lit("D")).otherwise(F.lit("C")).alias("direction"),
        *(col.alias(name) for name, col in extra.items()),
    )


def txn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: events as transactions (sub-day timestamps, 30-day span)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").cast("string").alias("trId"),
        F.col("user_id").cast("string").alias("accountId"),
        F.col("ts").alias("date"),
        F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(-F.col("value")).alias("amount"),
        F.col("event_type").alias("bankRawDescription"),
        (F.col("event_type") == "signup").cast("int").alias("isRecurring"),
    )


def txn_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: orders as transactions (short histories, ~10 rows per account)."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("trId"),
        F.col("o_custkey").cast("string").alias("accountId"),
        F.col("o_orderdate").alias("date"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("bankRawDescription"),
        (F.col("o_orderstatus") == "F").cast("int").alias("isRecurring"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: V1 plus a deterministic probability for the metric operators (one scan of lineitem)."""
    return txn(spark, sf_dir, prob=(F.col("l_quantity") * 2 + F.col("l_linenumber")) / 110.0)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: ready-made text vectors; label plays the account."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id"), F.col("label").cast("string").alias("accountId"),
        F.col("embedding"))


# ---------------------------------------------------------------------------
# DuckDB text of the same views, for the oracle only.
# ---------------------------------------------------------------------------

_CYCLE_SQL = "[" + ", ".join(f"'{c}'" for c in CYCLE_LABELS) + "]"

TXN_SQL = f"""
txn AS (
  SELECT
    concat_ws('-', l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber,
              CAST(round(l.l_extendedprice * 100) AS BIGINT)) AS trId,
    CAST(l.l_suppkey AS VARCHAR) AS accountId,
    l.l_shipdate AS date,
    CASE WHEN l.l_returnflag = 'R' THEN -l.l_extendedprice ELSE l.l_extendedprice END AS amount,
    upper(p.p_name) || ' ' || CAST(l.l_orderkey % 1000 AS VARCHAR) AS bankRawDescription,
    CAST(l.l_linestatus = 'F' AS INTEGER) AS isRecurring,
    CASE WHEN l.l_linestatus = 'F' THEN CAST(l.l_suppkey AS VARCHAR) || '-' || CAST(l.l_partkey % 16 AS VARCHAR) END AS patternId,
    CASE WHEN l.l_linestatus = 'F' THEN {_CYCLE_SQL}[p.p_size % 8 + 1] ELSE 'None' END AS patternCycle,
    CASE WHEN l.l_quantity < 10 THEN '' ELSE p.p_brand END AS counter_party,
    r.r_name || CAST(n.n_nationkey AS VARCHAR) AS bank_name,
    CASE WHEN l.l_tax = CAST(0.08 AS DOUBLE) THEN 'Pending' ELSE 'Cleared' END AS status,
    l.l_discount = CAST(0.1 AS DOUBLE) AS isForeignCurrency,
    CASE WHEN (CASE WHEN l.l_returnflag = 'R' THEN -l.l_extendedprice ELSE l.l_extendedprice END) > 0
         THEN 'D' ELSE 'C' END AS direction
  FROM lineitem l
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
)"""

TXN_EVENTS_SQL = """
txn_events AS (
  SELECT CAST(event_id AS VARCHAR) AS trId, CAST(user_id AS VARCHAR) AS accountId, ts AS date,
         CASE WHEN event_type = 'purchase' THEN value ELSE -value END AS amount,
         event_type AS bankRawDescription, CAST(event_type = 'signup' AS INTEGER) AS isRecurring
  FROM events
)"""

TXN_ORDERS_SQL = """
txn_orders AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS trId, CAST(o_custkey AS VARCHAR) AS accountId,
         o_orderdate AS date, o_totalprice AS amount, o_orderpriority AS bankRawDescription,
         CAST(o_orderstatus = 'F' AS INTEGER) AS isRecurring
  FROM orders
)"""

SCORED_SQL = TXN_SQL + """,
scored AS (
  SELECT t.*, (l.l_quantity * 2 + l.l_linenumber) / 110.0 AS prob
  FROM txn t JOIN lineitem l
    ON t.trId = concat_ws('-', l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber,
                          CAST(round(l.l_extendedprice * 100) AS BIGINT))
)"""

VECTORS_SQL = """
vectors AS (
  SELECT vec_id, CAST(label AS VARCHAR) AS accountId, embedding FROM embeddings
)"""


def with_views(body: str, *views: str) -> str:
    """Prefix a query body with the named fixture views as CTEs."""
    ctes = []
    for v in views:
        ctes.append({"txn": TXN_SQL, "txn_events": TXN_EVENTS_SQL, "txn_orders": TXN_ORDERS_SQL,
                     "scored": SCORED_SQL, "vectors": VECTORS_SQL}[v].strip())
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[15:]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body
