"""Text vectors, vector cache and PCA.

The default encoder is JVM-side: hashed character n-grams (the detector's 2-4
grams inside padded words) counted into ``dim`` buckets and L2-normalised, computed
once per distinct text. A frozen model can be plugged in through ``pandas_encoder``
(an Arrow-batched pandas UDF) — the only other Python UDF besides token-sort ratio.
"""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.functions.text import char_wb_ngrams


def hashed_ngram_vectors(texts: DataFrame, text: str = "text", dim: int = 64, out: str = "vec", hashing: str = "xxhash64") -> DataFrame:
    """(text, vec) for the distinct texts: bucket counts of the grams' hashes mod ``dim``, L2-normalised.

    ``hashing``: xxhash64, or md5 (its first 32 bits), which other engines have as well.
    """
    if hashing == "md5":
        bucket = (F.conv(F.substring(F.md5("_g"), 1, 8), 16, 10).cast("long") % dim).cast("int")
    else:
        bucket = F.pmod(F.xxhash64("_g"), F.lit(dim)).cast("int")
    d = texts.select(text).distinct()
    g = d.select(text, F.explode(char_wb_ngrams(F.col(text))).alias("_g")) \
         .select(text, bucket.alias("_b"))
    c = g.groupBy(text, "_b").agg(F.count(F.lit(1)).cast("double").alias("_c"))
    m = c.groupBy(text).agg(F.map_from_entries(F.collect_list(F.struct("_b", "_c"))).alias("_m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.col("_m")[i], F.lit(0.0)))
    v = m.select(text, dense.alias("_v"))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
    v = v.select(text, F.transform("_v", lambda x: F.when(norm > 0, x / norm).otherwise(x)).alias(out))
    # texts without any gram get the zero vector
    return d.join(v, text, "left").select(
        text, F.coalesce(F.col(out), F.array_repeat(F.lit(0.0), dim)).alias(out))


def pandas_encoder(fn, dim: int):
    """Wrap ``fn(list[str]) -> 2-D array`` as a pandas UDF returning array<double>."""
    import numpy as np
    import pandas as pd

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def enc(s: pd.Series) -> pd.Series:
        arr = np.asarray(fn(s.fillna("").tolist()), dtype="float64").reshape(len(s), dim)
        return pd.Series(list(arr))

    def encoder(df: DataFrame, text: str = "text", out: str = "vec") -> DataFrame:
        d = df.select(text).distinct()
        return d.select(text, enc(F.col(text)).alias(out))

    return encoder


def text_vectors(df: DataFrame, text: str, dim: int = 64, encoder=None, out: str = "vec") -> DataFrame:
    """Rows joined with the vector of their text (computed on distinct texts only)."""
    enc = encoder or (lambda d: hashed_ngram_vectors(d, text, dim, out))
    return df.join(enc(df.select(text)), text, "left")


def pca_fit(train: DataFrame, col: str, k: int = 16):
    """Centre on the train mean, then fit Spark ML PCA (its projection does not centre)."""
    n = len(train.select(col).first()[0])
    mean = train.select(F.posexplode(col).alias("_d", "_x")).groupBy("_d").agg(F.avg("_x").alias("_m"))
    mean_vec = mean.agg(F.array_sort(F.collect_list(F.struct("_d", "_m"))).alias("_s")) \
                   .select(F.transform("_s", lambda s: s["_m"]).alias("_mean"))
    centred = _centre(train, col, mean_vec)
    model = PCA(k=min(k, n), inputCol="_cv", outputCol="_pca").fit(centred)
    return model, mean_vec


def _centre(df: DataFrame, col: str, mean_vec: DataFrame) -> DataFrame:
    j = df.crossJoin(F.broadcast(mean_vec))  # one row: the mean vector
    return j.withColumn("_cv", array_to_vector(F.zip_with(col, "_mean", lambda x, m: x - m))).drop("_mean")


def pca_transform(df: DataFrame, col: str, fitted, n_out: int = 16, prefix: str = "pca_") -> DataFrame:
    """Project and always emit ``n_out`` columns (zeros past the fitted components). Signs are arbitrary."""
    model, mean_vec = fitted
    p = model.transform(_centre(df, col, mean_vec)).withColumn("_a", vector_to_array("_pca"))
    k = model.getK()
    cols = [(F.col("_a")[i] if i < k else F.lit(0.0)).alias(f"{prefix}{i}") for i in range(n_out)]
    return p.select(*df.columns, *cols)
