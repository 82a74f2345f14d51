"""Sort / limit / top-k reports. A limit here is the feature itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_mistakes(df: DataFrame, n: int = 5, prob: str = "prob", result_type: str = "result_type",
                 row_id: str = "trId") -> DataFrame:
    """Top-n false positives by probability (desc) and false negatives (asc)."""
    m = df.filter(F.col(result_type).isin("FP", "FN"))
    key = F.when(F.col(result_type) == "FP", -F.col(prob)).otherwise(F.col(prob))
    w = Window.partitionBy(result_type).orderBy(key, row_id)
    # the filter on rank <= n becomes a per-partition top-n (WindowGroupLimit)
    return m.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def top_group_mistakes(groups: DataFrame, n: int = 5, prob: str = "prob", result_type: str = "result_type",
                       group: str = "group_id") -> DataFrame:
    """Groups: one row per group, FP by prob desc, FN by prob asc."""
    g = groups.groupBy(group, result_type).agg(F.max(prob).alias(prob))
    return top_mistakes(g, n, prob, result_type, group)


def largest_group_sample(rows: DataFrame, group: str, date: str = "date", row_id: str = "trId") -> DataFrame:
    """Members of the largest group (ties: smallest group id), ordered by date."""
    sizes = rows.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    top = sizes.orderBy(F.desc("_n"), F.asc(group)).limit(1).select(group)
    return rows.join(F.broadcast(top), group, "left_semi").orderBy(date, row_id)


def extreme_texts(df: DataFrame, text: str, value: str, k: int = 5) -> DataFrame:
    """Distinct texts with the highest and lowest values (max per text), k each end."""
    per = df.groupBy(text).agg(F.max(value).alias("value"))
    hi = per.orderBy(F.desc("value"), F.asc(text)).limit(k).withColumn("end", F.lit("high"))
    lo = per.orderBy(F.asc("value"), F.asc(text)).limit(k).withColumn("end", F.lit("low"))
    return hi.unionByName(lo)


def ordered_report(df: DataFrame, account: str = "accountId", date: str = "date", row_id: str = "trId") -> DataFrame:
    """Report rows ordered by account then date (range-partitioned global sort)."""
    return df.orderBy(account, date, row_id)
