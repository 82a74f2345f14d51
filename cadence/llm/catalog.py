"""Named queries of the subpackage and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cadence.llm import (compact_windows, curriculum, grid_codes, html_extract, language_id, mtree_topk, pii, piece_bpe,
                         pivot_dedup, token_align, url_rules, warc_audit)
from cadence.llm.minhash_dedup import minhash_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op6_minhash_dedup")
def op6(spark, sf_dir):
    return minhash_dedup(table(spark, sf_dir, "documents"), width=2)


@query("op3_curriculum_mix", curriculum.ORACLE)
def op3(spark, sf_dir):
    return curriculum.plan(table(spark, sf_dir, "documents")).drop("positions")


@query("op5_language_id")
def op5(spark, sf_dir):
    return language_id.language_id(table(spark, sf_dir, "documents"))


@query("op7_pii_crf")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return pii.find_pii(docs, pii.train(docs))


@query("op8_piece_bpe")
def op8(spark, sf_dir):
    return piece_bpe.encode_texts(table(spark, sf_dir, "documents"), piece_bpe.default_model(), digest=True)


@query("op9_html_extract")
def op9(spark, sf_dir):
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


@query("op1_pivot_dedup", pivot_dedup.ORACLE)
def op1(spark, sf_dir):
    return pivot_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op2_compact_windows")
def op2(spark, sf_dir):
    return compact_windows.repeated_passages(table(spark, sf_dir, "documents"))


@query("op4_merkle_audit", warc_audit.ORACLE)
def op4(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return warc_audit.audit(warc_audit.tree(warc_audit.leaves(pages)),
                            warc_audit.tree(warc_audit.leaves(warc_audit.damaged(pages))))


@query("op10_mtree_topk", mtree_topk.ORACLE)
def op10(spark, sf_dir):
    return mtree_topk.top_k(table(spark, sf_dir, "embeddings"))


@query("op12_grid_codes", grid_codes.oracle())
def op12(spark, sf_dir):
    return grid_codes.compress(table(spark, sf_dir, "embeddings"))


@query("op13_url_rules")
def op13(spark, sf_dir):
    return url_rules.filter_urls(table(spark, sf_dir, "pages")).drop("why", "confidence")


@query("op11_token_align")
def op11(spark, sf_dir):
    return token_align.align_corpus(table(spark, sf_dir, "documents"))
