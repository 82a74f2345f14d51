"""Account-disjoint splits and samples.

numpy random streams cannot be reproduced, so accounts are ordered by
md5('{seed}|{account}') — also available in SQL engines — and the reference's
size rules (ceil / floor cuts) and disjointness are kept. Account ranks come from
range-partitioned positions, never a single-task sort of all accounts.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.operators.ordered import global_positions


def account_order(df: DataFrame, seed: int, account: str = "accountId") -> DataFrame:
    """(account, _rank, _n): 0-based rank by md5(seed|account) and the account count."""
    acc = df.select(account).distinct().withColumn("_h", F.md5(F.concat(F.lit(f"{seed}|"), F.col(account))))
    ranked = global_positions(acc, ["_h", account], "_rank")
    n = acc.agg(F.count(F.lit(1)).alias("_n"))
    return ranked.crossJoin(F.broadcast(n)).select(account, "_rank", "_n")  # n: one row


def _assign(df: DataFrame, order: DataFrame, split_col, account: str) -> DataFrame:
    lab = order.select(account, split_col.alias("split"))
    return df.join(lab, account)


def group_split(df: DataFrame, test_size: float = 0.2, val_size: float = 0.2, seed: int = 42,
                account: str = "accountId") -> DataFrame:
    """Adds ``split``: test = ceil(test*n) accounts, val = ceil(val/(1-test) * rest), rest train."""
    o = account_order(df, seed, account)
    n_test = F.ceil(F.lit(test_size) * F.col("_n"))
    rest = F.col("_n") - n_test
    n_val = F.ceil(F.lit(val_size / (1.0 - test_size)) * rest)
    s = F.when(F.col("_rank") < n_test, "test").when(F.col("_rank") < n_test + n_val, "val").otherwise("train")
    return _assign(df, o, s, account)


def group_split_two(df: DataFrame, test_size: float = 0.2, seed: int = 42, account: str = "accountId") -> DataFrame:
    o = account_order(df, seed, account)
    s = F.when(F.col("_rank") < F.ceil(F.lit(test_size) * F.col("_n")), "test").otherwise("train")
    return _assign(df, o, s, account)


def ratio_split(df: DataFrame, val_ratio: float = 0.1, test_ratio: float = 0.1, seed: int = 42,
                account: str = "accountId") -> DataFrame:
    """floor(n*test) test accounts first, then floor(n*val) val, the rest train."""
    o = account_order(df, seed, account)
    n_test = F.floor(F.lit(test_ratio) * F.col("_n"))
    n_val = F.floor(F.lit(val_ratio) * F.col("_n"))
    s = F.when(F.col("_rank") < n_test, "test").when(F.col("_rank") < n_test + n_val, "val").otherwise("train")
    return _assign(df, o, s, account)


def downsample_accounts(df: DataFrame, frac: float, seed: int = 42, account: str = "accountId") -> DataFrame:
    """Keep floor(frac*n) accounts (at least one)."""
    o = account_order(df, seed, account)
    keep = o.filter(F.col("_rank") < F.greatest(F.floor(F.lit(frac) * F.col("_n")), F.lit(1))).select(account)
    return df.join(keep, account, "left_semi")


def learning_curve(df: DataFrame, fractions: list[float], seed: int = 42, account: str = "accountId") -> DataFrame:
    """(fraction, account) for nested account subsets; 1.0 keeps every account."""
    o = account_order(df, seed, account)
    fr = df.sparkSession.createDataFrame([(float(f),) for f in fractions], "fraction double")  # few rows
    j = o.crossJoin(F.broadcast(fr))
    keep = (F.col("fraction") >= 1.0) | (F.col("_rank") < F.floor(F.col("fraction") * F.col("_n")))
    return j.filter(keep).select("fraction", account)


def per_bank_sample(df: DataFrame, min_accounts: int = 850, n_train: int = 750, n_test: int = 100, seed: int = 42,
                    account: str = "accountId", bank: str = "bank_name") -> DataFrame:
    """Banks with >= min_accounts accounts: the first n_train accounts train, the next n_test test."""
    acc = df.select(bank, account).distinct().withColumn("_h", F.md5(F.concat(F.lit(f"{seed}|"), F.col(account))))
    from cadence.operators.ordered import ordered_positions

    r = ordered_positions(acc, [bank], ["_h", account], "_r")
    banks = acc.groupBy(bank).agg(F.count(F.lit(1)).alias("_nb")).filter(F.col("_nb") >= min_accounts)
    # a bank keeps n_train + n_test accounts before its size is joined
    r = r.filter(F.col("_r") < n_train + n_test).join(banks, bank)
    return r.select(bank, account, F.when(F.col("_r") < n_train, "train").otherwise("test").alias("split"))


def balanced_window_sample(windows: DataFrame, label: str, order: list[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` windows drawn with replacement, the same number from each class (the first classes
    in order get one more where n does not divide).

    Draw d of a class takes the window at position hash(seed, class, d) mod n_class in ``order``:
    as many draws as asked for, whatever the class size, and the same ones on every run. Adds ``draw``.
    """
    from cadence.operators.ordered import ordered_positions
    from pyspark.sql import Window

    place = ordered_positions(windows, [label], order, "_at")
    classes = windows.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    # one row per class
    classes = (classes.withColumn("_c", F.row_number().over(Window.orderBy(label)))
               .withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy())))
    want = F.floor(F.lit(n) / F.col("_k")) + (F.col("_c") <= n % F.col("_k")).cast("long")
    draws = (classes.withColumn("_n", want).filter("_n > 0")
             .withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))))
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(label).cast("string"), F.col("draw").cast("string"))), 1, 8), 16, 10)
    draws = draws.select(F.col(label), "draw", F.pmod(h.cast("long"), F.col("_nc")).alias("_at"))
    return place.join(draws, [label, "_at"]).drop("_at")


def pair_holdout(pairs: DataFrame, test_frac: float = 0.2, seed: int = 42, by_account: str | None = None) -> DataFrame:
    """Adds ``holdout``: hash of (trId_1, trId_2) (or of the account when by_account) < test_frac."""
    key = F.col(by_account) if by_account else F.concat_ws("|", "trId_1", "trId_2")
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key)), 1, 8), 16, 10).cast("double") / float(16 ** 8)
    return pairs.withColumn("holdout", h < test_frac)


def group_kfold(df: DataFrame, k: int = 3, seed: int = 42, account: str = "accountId") -> DataFrame:
    """Adds ``fold`` = rank mod k over the hashed account order."""
    o = account_order(df, seed, account)
    return _assign(df, o, (F.col("_rank") % k).cast("int"), account).withColumnRenamed("split", "fold")
