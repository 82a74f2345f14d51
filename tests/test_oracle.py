"""Spark queries against their DuckDB oracle texts on the smallest scale factor."""

import hashlib
import math

import pytest

import __spark_entry__ as E

from conftest import SF_SMALL

FAST = [
    "detect_recurring", "detect_recurring_min3", "candidate_features_exact", "scan_transactions", "consolidate_transactions",
    "clean_text", "clean_text_stop", "clean_description", "recurrence_keyword", "encode_patterns",
    "deduplicate", "bank_variants", "dedup_transactions", "parse_dates", "cyclical_dates", "amount_vocab_fit",
    "amount_tokenize", "account_behavior", "time_encoding", "interval_stats", "group_candidate_features",
    "group_summary", "amount_windows", "direction_windows", "amount_islands", "amount_seed_overlap",
    "widest_gaps", "row_prf", "group_prf", "average_precision", "roc_auc", "best_f1", "calibration",
    "class_report", "macro_ap", "bcubed", "candidate_pairs", "candidate_pairs_ext", "pairwise_groups",
    "connected_components", "logic_gates", "refine_by_cycle", "density_groups", "recover_missed",
    "group_split", "ratio_split", "learning_curve", "top_mistakes", "run_trends", "feature_pipeline",
    "schema_gate", "tfidf_char_wb", "text_cluster", "row_functions", "group_functions", "pipeline_hooks",
    "split_by_widest_gap", "tune_split", "broken_patterns", "sequence_windows_predict", "max_prob_per_row", "label_error_pairs",
    "embedding_cache", "consolidate_patterns", "pair_holdout", "top_group_mistakes", "edge_prf", "before_after", "assemble_features",
]


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NULL" if math.isnan(v) else f"{round(v, 6):.6f}"
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    cur = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert _digest(sdf.columns, srows) == _digest(dcols, drows)


def test_registry_contract():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 150


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["trId", "recurring_group_id"]
    assert df.count() > 0
