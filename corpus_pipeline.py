"""Corpus pipeline: language ID, MinHash near-dedup, personal data, source mix, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the
last return the columns of documents. ``run`` writes every stage's rows and reads them again. Rows
with a null doc_id take part in every stage. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.llm import curriculum, language_id, pii, piece_bpe
from cadence.llm.minhash_dedup import minhash_dedup
from cadence.llm.store import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
BATCH = 4 << 20  # bytes of an Arrow batch of a stage: texts are of very unequal size, and worker and executor hold a batch more than once
MIN_LANGUAGE_SCORE = 0.2  # a text below it fits none of the learned languages


def _documents(rows: DataFrame, **changed) -> DataFrame:
    return rows.select(*(changed.get(c, F.col(f"c_{c}")).alias(c) for c in COLUMNS))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a determined language; ``lang`` becomes the predicted one."""
    model = language_id.train(docs.select(F.col("doc_id").alias("key"), "text", "lang"))
    found = language_id.identify(docs, model, carry=COLUMNS)
    fits = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return _documents(found.filter(fits), lang=F.col("lang_pred"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, 0.8) the row with the smallest id stays, null ids last."""
    rows = stored(docs.select(*COLUMNS).dropDuplicates().withColumn("row", F.monotonically_increasing_id()), "rows")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    kept = (minhash_dedup(rows, id_col="row").select(F.col("doc_id").alias("row"), "component_id")
            .join(rows.select("row", "doc_id"), "row").groupBy("component_id").agg(F.min(place).alias("first")).select("first.row"))
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by <KIND>; n_chars follows the text."""
    found = pii.find_pii(docs, pii.train(docs), redact=True, carry=COLUMNS)
    return _documents(found, text=F.col("redacted"),
                      n_chars=F.when(F.col("spans") == "", F.col("c_n_chars")).otherwise(F.char_length("redacted").cast("long")))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy that the mix takes, in training order."""
    return curriculum.training_order(docs.select(*COLUMNS)).select("doc.*")


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every copy, and the digest of the text that they decode to."""
    rows = piece_bpe.encode_texts(docs, piece_bpe.default_model(), lean=True)
    return rows.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


def _bounded(stage):
    """The stage in a session whose Arrow batches hold about BATCH bytes; its rows are written by the caller, so the setting stays."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
        return stage(spark, docs, sf_dir)
    return run


STAGES = [
    ("language_id", _bounded(language_stage)),
    ("minhash_dedup", _bounded(dedup_stage)),
    ("pii", _bounded(pii_stage)),
    ("mix", _bounded(mix_stage)),
    ("tokens", _bounded(tokens_stage)),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
