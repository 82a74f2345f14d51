"""Sources and sinks: transaction files, bank files, split cache, vector cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.operators import clean as C
from cadence.schema import TRANSACTIONS, Cols


def read_transactions(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    """Read a transactions table; CSV uses a declared schema (no inference, ids stay strings)."""
    if fmt == "csv":
        return spark.read.schema(schema or TRANSACTIONS).option("header", True).csv(path)
    return C.cast_ids_labels(spark.read.format(fmt).load(path))


def pruned(df: DataFrame, columns: list[str]) -> DataFrame:
    """Project the named columns; Catalyst prunes the scan to them (ReadSchema)."""
    return df.select(*columns)


def bank_from_file_name(name: Column, marker: str) -> Column:
    """Bank = file name before the marker; without the marker, text before the first '_'."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    return F.when(F.instr(base, marker) > 0, F.substring_index(base, marker, 1)) \
            .otherwise(F.substring_index(base, "_", 1))


def bank_from_path(path: Column, marker: str) -> Column:
    """Bank of a file or of a folder of part files: the innermost path part that holds the marker."""
    return bank_from_file_name(F.regexp_extract(path, f"([^/]*{marker}[^/]*)(/[^/]*)?$", 1), marker)


def bank_headers(spark: SparkSession, directory: str, marker: str) -> list[tuple[list[str], list[str]]]:
    """(column names, paths) of every distinct header line of the '*<marker>*.csv' files.

    One job for all files: tasks read the lines, the first line of a file by its place wins. The
    driver holds the file names, as any file listing does.
    """
    import csv

    lines = (spark.read.text(f"{directory.rstrip('/')}/*{marker}*.csv")
             .select("value", F.col("_metadata.file_path").alias("path"),
                     F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at")))
    first = lines.groupBy("path").agg(F.min_by("value", "at").alias("header"))
    per = first.groupBy("header").agg(F.array_sort(F.collect_list("path")).alias("paths")).orderBy("header").collect()
    return [(next(csv.reader([r.header]), []), r.paths) for r in per]


def read_bank_files(spark: SparkSession, directory: str, marker: str = "_DTransaction") -> list[DataFrame]:
    """One DataFrame per distinct header of the bank files, whatever their number; all columns strings.

    Adds bank_name (from the file name), ``_file`` and ``_ingest``, the order of files and rows for dedup.
    """
    from pyspark.errors import AnalysisException

    try:
        headers = bank_headers(spark, directory, marker)
    except AnalysisException as e:  # no file matches
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []
    frames = []
    for names, paths in headers:
        if len(set(names)) != len(names) or not all(names):
            continue  # no table: unnamed or repeated columns
        schema = ", ".join(f"`{n}` string" for n in names)
        df = spark.read.schema(schema).option("header", True).csv(paths)
        path = F.col("_metadata.file_path")
        frames.append(df.withColumns({
            "bank_name": bank_from_path(path, marker), "_file": path,
            "_ingest": F.struct(path, F.col("_metadata.file_block_start"), F.monotonically_increasing_id())}))
    return frames


class BadBankFile(ValueError):
    """Bank files with zero amounts or with signs that contradict the direction."""


def _typed(f: DataFrame) -> DataFrame:
    types = {"amount": "double", "date": "timestamp_ntz"}
    return f.withColumns({c: F.col(c).try_cast(t) for c, t in types.items() if c in f.columns})


def file_violations(frames: list[DataFrame], cols: Cols = Cols()) -> DataFrame:
    """(_file, zero_amount, sign_mismatch) of cleared domestic rows, for files with a violation; one row a file."""
    a, d = F.col(cols.amount), F.col(cols.direction)
    wrong = ((a > 0) & ~d.eqNullSafe("D")) | ((a < 0) & ~d.eqNullSafe("C"))
    checked = [C.cleared_or_all(f, cols).select("_file", a.alias(cols.amount), d.alias(cols.direction))
               for f in frames if cols.amount in f.columns and cols.direction in f.columns]
    if not checked:
        return frames[0].sparkSession.createDataFrame([], "_file string, zero_amount long, sign_mismatch long")
    return (C.union_files(checked).groupBy("_file").agg(F.count_if(a == 0).alias("zero_amount"), F.count_if(wrong).alias("sign_mismatch"))
            .filter("zero_amount + sign_mismatch > 0"))


def consolidate_transactions(spark: SparkSession, directory: str, on_bad: str = "skip") -> DataFrame:
    """Glob bank transaction files -> filtered, gated, renamed, deduplicated table.

    The gate: a file whose cleared domestic rows hold a zero amount or a sign that contradicts the
    direction, or that has no amount or direction, is left out whole (``on_bad="skip"``), or raises
    ``BadBankFile`` (``"fail"``). Files without status or foreign-currency columns are not filtered.
    """
    if on_bad not in ("skip", "fail"):
        raise ValueError(f"on_bad is 'skip' or 'fail', not {on_bad!r}")
    frames = [_typed(f) for f in read_bank_files(spark, directory, "_DTransaction")]
    if on_bad == "skip":
        frames = [f for f in frames if {"amount", "direction"} <= set(f.columns)]
    if not frames:
        raise FileNotFoundError(f"no bank transaction files with amount and direction in {directory}")
    bad = file_violations(frames)
    if on_bad == "fail":
        missing = [f.columns for f in frames if not {"amount", "direction"} <= set(f.columns)]
        found = bad.orderBy("_file").limit(20).collect()  # the message names 20 files at most
        if missing or found:
            raise BadBankFile(f"bank files without amount or direction: {len(missing)} headers; with wrong signs or zero amounts: "
                              + ", ".join(f"{r._file} ({r.zero_amount} zero, {r.sign_mismatch} signs)" for r in found))
    else:
        frames = [f.join(bad.select("_file"), "_file", "left_anti") for f in frames]  # a row a bad file
    out = C.consolidate([f.drop("_file") for f in frames])
    return out.withColumn("isRecurring", C.bool_label("isRecurring")).drop("_ingest")


def write_consolidated(spark: SparkSession, directory: str, path: str, fmt: str = "parquet") -> dict:
    """Consolidate and write in one pass; the gate is a metric observed by the write itself.

    The rows go to a folder beside ``path``; a zero amount or wrong sign among the rows raises ``BadBankFile``
    and nothing appears under ``path``. Returns the metrics (rows, zero_amount, sign_mismatch).
    """
    from pyspark.sql import Observation

    frames = [_typed(f) for f in read_bank_files(spark, directory, "_DTransaction")]
    seen, watched = [], []
    for k, f in enumerate(frames):
        if not {"amount", "direction"} <= set(f.columns):
            continue
        a, d = F.col("amount"), F.col("direction")
        wrong = ((a > 0) & ~d.eqNullSafe("D")) | ((a < 0) & ~d.eqNullSafe("C"))
        o = Observation(f"gate{k}")
        watched.append(C.cleared_or_all(f).observe(o, F.count(F.lit(1)).alias("rows"), F.count_if(a == 0).alias("zero_amount"),
                                                   F.count_if(wrong).alias("sign_mismatch")))
        seen.append(o)
    if not watched:
        raise FileNotFoundError(f"no bank transaction files with amount and direction in {directory}")
    out = C.consolidate([f.drop("_file") for f in watched]).withColumn("isRecurring", C.bool_label("isRecurring")).drop("_ingest")
    draft = f"{path.rstrip('/')}.draft"
    write_table(out, draft, fmt)
    total = {k: sum(o.get[k] for o in seen) for k in ("rows", "zero_amount", "sign_mismatch")}
    if total["zero_amount"] or total["sign_mismatch"]:
        raise BadBankFile(f"{total['zero_amount']} zero amounts and {total['sign_mismatch']} wrong signs; rows stay in {draft}")
    write_table(spark.read.format(fmt).load(draft) if fmt != "csv" else spark.read.option("header", True).csv(draft), path, fmt)
    return total


def consolidate_patterns(spark: SparkSession, directory: str) -> DataFrame:
    """Glob pattern files -> (patternId, patternCycle, bank_name), first row per patternId.

    Files lacking the two columns are skipped.
    """
    frames = [f for f in read_bank_files(spark, directory, "_DRecurringPattern")
              if "patternId" in f.columns and "patternCycle" in f.columns]
    if not frames:
        return spark.createDataFrame([], "patternId string, patternCycle string, bank_name string")
    u = C.union_files([f.select("patternId", "patternCycle", "bank_name", "_ingest") for f in frames])
    return C.dedup_first(u, "patternId", ["_ingest"]).drop("_ingest")


def raw_bank_frame(df: DataFrame) -> DataFrame:
    """Engine columns renamed back to the raw bank-file names (inverse of the rename map)."""
    inv = {v: k for k, v in C.RENAMES.items()}
    return df.withColumnsRenamed({k: v for k, v in inv.items() if k in df.columns})


def pattern_table(df: DataFrame, cols: Cols = Cols()) -> DataFrame:
    """Pattern dimension derived from transactions, first row per pattern."""
    p = df.filter(F.col(cols.patternId).isNotNull()).select(cols.patternId, cols.patternCycle, cols.bank_name)
    return C.dedup_first(p, cols.patternId, [cols.bank_name, cols.patternCycle])


def write_table(df: DataFrame, path: str, fmt: str = "csv", partition_by: list[str] | None = None) -> None:
    """Sink for results and reports."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def split_cache_path(base: str, seed: int, frac: float) -> str:
    return f"{base.rstrip('/')}/{seed}__{frac}"


def save_splits(splits: DataFrame, base: str, seed: int, frac: float) -> str:
    """Persist a table with a ``split`` column, partitioned by split."""
    path = split_cache_path(base, seed, frac)
    splits.write.mode("overwrite").partitionBy("split").parquet(path)
    return path


def load_split(spark: SparkSession, base: str, seed: int, frac: float, split: str) -> DataFrame:
    """Reload one split (partition pruning); a missing cache raises."""
    path = split_cache_path(base, seed, frac)
    return spark.read.parquet(path).filter(F.col("split") == split)


CACHE_BUCKETS = 64


class VectorCache:
    """Vectors on storage, in buckets of the text's hash: <path>/<encoder>/<max_len>/bucket=<k>.

    ``vectors`` encodes only texts that no earlier run stored: it reads the buckets that the texts fall
    into (other folders are pruned), encodes the missing texts and appends them. Equal texts are stored
    once a run; if two runs stored the same text at once, one of its (equal) vectors is used.
    """

    def __init__(self, spark: SparkSession, path: str, encoder_name: str, max_len: int = 0):
        self.spark = spark
        self.path = f"{path.rstrip('/')}/{encoder_name.replace('/', '__')}/{max_len}"

    def _bucket(self, text: str) -> Column:
        return F.pmod(F.xxhash64(F.col(text)), F.lit(CACHE_BUCKETS)).cast("int").alias("bucket")

    def stored(self, buckets: list[int] | None = None, text: str = "text") -> DataFrame:
        """(text, vec) of the named buckets, all by default; no rows before the first run."""
        from pyspark.errors import AnalysisException

        try:
            df = self.spark.read.schema(f"`{text}` string, vec array<double>, bucket int").parquet(self.path)
        except AnalysisException as e:  # no run yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], f"`{text}` string, vec array<double>")
        if buckets is not None:
            df = df.filter(F.col("bucket").isin(buckets))
        return df.groupBy(text).agg(F.first("vec").alias("vec"))

    def vectors(self, texts: DataFrame, encoder, text: str = "text") -> tuple[DataFrame, int]:
        """(rows with ``vec``, number of texts encoded now). ``encoder(df of texts) -> (text, vec)``; null texts get no vector."""
        from cadence.session import materialize

        distinct = materialize(texts.select(text, self._bucket(text)).filter(F.col(text).isNotNull()).distinct())
        touched = [r.bucket for r in distinct.select("bucket").distinct().collect()]  # CACHE_BUCKETS at most
        todo = materialize(distinct.join(self.stored(touched, text), text, "left_anti"))
        n = todo.count()
        if n:
            fresh = encoder(todo.select(text)).select(text, "vec").withColumn("bucket", self._bucket(text))
            fresh.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self.path)
        return texts.join(self.stored(touched, text), text, "left"), n
