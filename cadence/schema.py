"""Column-name indirection and the declared transaction schema."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Cols:
    """Column names used by every operator (override per input table)."""

    trId: str = "trId"
    accountId: str = "accountId"
    date: str = "date"
    amount: str = "amount"
    text: str = "bankRawDescription"
    label: str = "isRecurring"
    counter_party: str = "counter_party"
    patternId: str = "patternId"
    patternCycle: str = "patternCycle"
    bank_name: str = "bank_name"
    status: str = "status"
    foreign: str = "isForeignCurrency"
    direction: str = "direction"


TRANSACTIONS = T.StructType(
    [
        T.StructField("trId", T.StringType(), False),
        T.StructField("accountId", T.StringType(), False),
        T.StructField("date", T.TimestampNTZType(), False),
        T.StructField("amount", T.DoubleType(), False),
        T.StructField("bankRawDescription", T.StringType(), False),
        T.StructField("isRecurring", T.IntegerType(), True),
        T.StructField("counter_party", T.StringType(), True),
        T.StructField("patternId", T.StringType(), True),
        T.StructField("patternCycle", T.StringType(), True),
        T.StructField("p_categoryGroupId", T.StringType(), True),
        T.StructField("p_subCategoryId", T.StringType(), True),
        T.StructField("bank_name", T.StringType(), True),
        T.StructField("status", T.StringType(), True),
        T.StructField("isForeignCurrency", T.BooleanType(), True),
        T.StructField("direction", T.StringType(), True),
    ]
)

# Fixed values that must equal the reference: cycle label -> class code.
CYCLE_LABELS = [
    "None",
    "monthly",
    "onceAWeek",
    "onceEvery2Weeks",
    "twiceAMonth",
    "onceEvery4Weeks",
    "weekBasedOther",
    "every4_5Weeks",
]

# Missing-id sentinels mapped to NULL on ingest.
MISSING_ID_SENTINELS = ["-1", "-1.0", "None", "nan", "<NA>", ""]
