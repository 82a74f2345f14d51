"""File sources and sinks: bank files, split cache, vector cache, model store."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from cadence.operators.vectors import hashed_ngram_vectors
from cadence.sources import io


def test_consolidate_bank_files(spark):
    d = tempfile.mkdtemp(prefix="cadence-banks-")
    with open(os.path.join(d, "Chase_DTransaction_2024.csv"), "w") as f:
        f.write("id,accountId,date,amount,bankRawDescription,isRecurring,direction,status,isForeignCurrency,deviceId\n")
        f.write("1,a,2024-01-01 00:00:00,-5.0,NETFLIX,true,C,Cleared,false,dev\n")
        f.write("2,a,2024-02-01 00:00:00,-5.0,NETFLIX,true,C,Pending,false,dev\n")
        f.write("3,a,2024-03-01 00:00:00,-5.0,NETFLIX,false,C,Cleared,TRUE,dev\n")
    with open(os.path.join(d, "Wells_Fargo_DTransaction.csv"), "w") as f:
        f.write("id,accountId,date,amount,bankRawDescription,isRecurring,direction,status,isForeignCurrency\n")
        f.write("1,b,2024-01-05 00:00:00,7.0,PAY,False,D,Cleared,False\n")
        f.write("4,b,2024-01-06 00:00:00,,PAY,False,D,Cleared,False\n")
    with open(os.path.join(d, "Broken_DTransaction.csv"), "w") as f:
        f.write("id,accountId\n9,z\n")
    out = io.consolidate_transactions(spark, d)
    rows = sorted((r.trId, r.bank_name, r.isRecurring) for r in out.collect())
    assert rows == [("1", "Chase", 1)]  # the first file's row
    assert "counter_party" in out.columns


def test_split_cache_roundtrip(spark):
    base = tempfile.mkdtemp(prefix="cadence-split-")
    df = spark.range(10).select(F.col("id").cast("string").alias("accountId"),
                                F.when(F.col("id") < 3, "test").otherwise("train").alias("split"))
    io.save_splits(df, base, 42, 0.3)
    assert io.load_split(spark, base, 42, 0.3, "test").count() == 3


def test_vector_cache_computes_only_new_texts(spark):
    calls = []

    def enc(d):
        calls.append(sorted(r.text for r in d.collect()))
        return hashed_ngram_vectors(d, "text", 8)

    path = tempfile.mkdtemp(prefix="cadence-vectors-")
    t = spark.createDataFrame([("hello",), ("world",), ("hello",), (None,)], "text string")
    rows, n = io.VectorCache(spark, path, "model/a", 32).vectors(t, enc)
    assert n == 2 and rows.count() == 4 and rows.filter("vec IS NULL").count() == 1
    want = {r.text: r.vec for r in hashed_ngram_vectors(t.dropna(), "text", 8).collect()}
    again, n = io.VectorCache(spark, path, "model/a", 32).vectors(t, enc)  # another run, same storage
    assert n == 0 and len(calls) == 1
    assert all(r.vec == want[r.text] for r in again.collect() if r.text)
    more, n = io.VectorCache(spark, path, "model/a", 32).vectors(t.union(spark.createDataFrame([("new",)], "text string")), enc)
    assert n == 1 and calls[-1] == ["new"] and more.filter("vec IS NOT NULL").count() == 4
    _, n = io.VectorCache(spark, path, "model/a", 64).vectors(t, enc)  # another length is another cache
    assert n == 2
    empty, n = io.VectorCache(spark, path, "model/a", 32).vectors(t.limit(0), enc)
    assert n == 0 and empty.count() == 0


def test_vector_cache_reads_only_touched_buckets(spark):
    path = tempfile.mkdtemp(prefix="cadence-vectors-")
    cache = io.VectorCache(spark, path, "m")
    t = spark.createDataFrame([(f"text {i}",) for i in range(200)], "text string")
    cache.vectors(t, lambda d: hashed_ngram_vectors(d, "text", 4))
    folders = [f for f in os.listdir(cache.path) if f.startswith("bucket=")]
    assert len(folders) > 40
    one = t.limit(1).select(cache._bucket("text")).first()[0]
    files = cache.stored([one])
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and files.count() < 30


def _bank(path, name, header, *lines):
    with open(os.path.join(path, name), "w") as f:
        f.write("\n".join([header, *lines]) + "\n")


HEAD = "id,accountId,date,amount,bankRawDescription,isRecurring,direction,status,isForeignCurrency,deviceId"


def test_many_headers_one_scan_each_and_the_gate(spark):
    d = tempfile.mkdtemp(prefix="cadence-banks-")
    for i in range(6):
        _bank(d, f"Bank{i}_DTransaction.csv", HEAD, f"{i},a,2024-01-0{i + 1} 00:00:00,-5.0,\"SHOP, {i}\",true,C,Cleared,false,dev", f"same,a,2024-01-01 00:00:00,{i + 1}.5,X,false,D,Cleared,false,")
    order = HEAD.split(",")[::-1]
    _bank(d, "Bank9_DTransaction.csv", ",".join(order), ",".join(["dev9", "false", "Cleared", "D", "true", "TEXT", "9.5", "2024-02-01 00:00:00", "b", "99"]))
    _bank(d, "Zero_DTransaction.csv", HEAD, "z1,a,2024-01-01 00:00:00,0.0,ZERO,true,D,Cleared,false,dev", "z2,a,2024-01-01 00:00:00,1.0,FINE,true,D,Cleared,false,dev")
    _bank(d, "Sign_DTransaction.csv", HEAD, "s1,a,2024-01-01 00:00:00,5.0,WRONG,true,C,Cleared,false,dev")
    _bank(d, "Away_DTransaction.csv", HEAD, "w1,a,2024-01-01 00:00:00,5.0,WRONG,true,C,Pending,false,dev", "w2,a,2024-01-01 00:00:00,5.0,RIGHT,true,D,Cleared,false,dev")
    frames = io.read_bank_files(spark, d)
    assert len(frames) == 2  # two headers, ten files
    out = {r.trId: r for r in io.consolidate_transactions(spark, d).collect()}
    assert set(out) == {"0", "1", "2", "3", "4", "5", "same", "99", "w2"}  # Zero and Sign are left out whole
    assert out["same"].bank_name == "Bank0" and out["same"].amount == 1.5 and out["99"].counter_party == "dev9"
    assert out["1"].bankRawDescription == "SHOP, 1"
    with pytest.raises(io.BadBankFile, match="Sign_DTransaction"):
        io.consolidate_transactions(spark, d, on_bad="fail")
    target = os.path.join(tempfile.mkdtemp(prefix="cadence-out-"), "all")
    with pytest.raises(io.BadBankFile, match="1 zero amounts and 1 wrong signs"):
        io.write_consolidated(spark, d, target)
    assert not os.path.exists(target)
    os.remove(os.path.join(d, "Zero_DTransaction.csv"))
    os.remove(os.path.join(d, "Sign_DTransaction.csv"))
    seen = io.write_consolidated(spark, d, target)
    assert seen == {"rows": 14, "zero_amount": 0, "sign_mismatch": 0} and spark.read.parquet(target).count() == 9


def test_no_bank_files(spark):
    d = tempfile.mkdtemp(prefix="cadence-banks-")
    with pytest.raises(FileNotFoundError):
        io.consolidate_transactions(spark, d)
    assert io.consolidate_patterns(spark, d).count() == 0


def test_write_table(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="cadence-out-"), "report")
    io.write_table(spark.range(3), d, "csv")
    assert spark.read.option("header", True).csv(d).count() == 3
