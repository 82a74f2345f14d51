"""Caller-chosen prepare / build steps, applied with ``DataFrame.transform``.

A pipeline is ``prepare`` (row filters and cleaning) followed by ``build`` (the
grouping or dataset strategy). Either may be a registered name or any callable
``DataFrame -> DataFrame``; the result stays one lazy plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.operators import clean as C
from cadence.schema import Cols

Step = Callable[[DataFrame], DataFrame]


def _account_summary(df: DataFrame, cols: Cols = Cols()) -> DataFrame:
    return df.groupBy(cols.accountId).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum(cols.amount), 6).alias("amount_sum"),
        F.min(cols.date).alias("first_date"),
        F.max(cols.date).alias("last_date"))


PREPARE: dict[str, Step] = {
    "none": lambda df: df,
    "cleared_domestic": C.cleared_domestic,
    "drop_required_nulls": C.drop_required_nulls,
}

BUILD: dict[str, Step] = {
    "rows": lambda df: df,
    "account_summary": _account_summary,
}


def _pick(reg: dict[str, Step], step: str | Step) -> Step:
    if callable(step):
        return step
    if step not in reg:
        raise KeyError(f"unknown step {step!r}; known: {sorted(reg)}")
    return reg[step]


def run_pipeline(df: DataFrame, prepare: str | Step = "none", build: str | Step = "rows") -> DataFrame:
    return df.transform(_pick(PREPARE, prepare)).transform(_pick(BUILD, build))
