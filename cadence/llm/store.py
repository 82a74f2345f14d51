"""Intermediate tables in the cluster's shared folder, and connected components on them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.session import checkpoint_dir


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def stored(df: DataFrame, name: str = "part", batch_bytes: int | None = None) -> DataFrame:
    """Write ``df`` once as Parquet under ``spark.checkpoint.dir`` and read it back.

    Lineage ends there: a lost executor's tasks read the files again. ``batch_bytes``: Arrow batches of the
    write's Python steps hold about that many bytes (one row at least), for rows of unequal size.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH)
    if batch_bytes:
        spark.conf.set(_BATCH, batch_bytes)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, component) for every node of an edge table; component = smallest node reachable.

    Each round every node takes the smallest label among its own and its neighbours', then
    the label of that label. Rounds go on until no label changes; each is a stored table.
    An empty edge table gives an empty result.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a <> b")
    e = stored(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    if e.isEmpty():
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    lab = stored(e.groupBy("a").agg(F.min("b").alias("m"))
                 .select(F.col("a").alias("n"), F.least("a", "m").alias("l")), "labels")
    while True:
        near = (e.join(lab.select(F.col("n").alias("b"), "l"), "b")
                .groupBy("a").agg(F.min("l").alias("m")).withColumnRenamed("a", "n"))
        step = lab.join(near, "n").select("n", F.col("l").alias("old"), F.least("l", "m").alias("l"))
        jump = lab.select(F.col("n").alias("l"), F.col("l").alias("ll"))
        new = stored(step.join(jump, "l", "left")
                     .select("n", "old", F.least("l", F.coalesce("ll", "l")).alias("l")), "labels")
        if new.filter("l <> old").isEmpty():
            return new.select(F.col("n").alias("node"), F.col("l").alias("component"))
        lab = new.drop("old")
