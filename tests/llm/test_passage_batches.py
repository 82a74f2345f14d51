"""op2: batches of bounded bytes, texts joined for one look, passages verified at their first text in parts."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cadence.llm import compact_windows as C
from cadence.llm.store import stored


def test_stored_bounds_the_bytes_of_a_batch(spark):
    def size(it):
        for batch in it:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(conf)
    rows = spark.range(0, 200, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("t")).mapInArrow(size, "n long, size long")
    got = stored(rows, "sizes", 1 << 20).agg(F.max("size"), F.sum("n")).first()
    assert got[0] < 2 << 20 and got[1] == 200
    assert spark.conf.get(conf) == before


def test_windows_of_joined_texts_equal_those_of_each():
    rng = np.random.default_rng(3)
    per = np.array([9, 60, 3, 0, 46, 120, 8])
    v = rng.integers(0, 40, per.sum()).astype(np.uint64)
    got = sorted(zip(*(x.tolist() for x in C.windows(v, 8, per))))
    want, at = [], 0
    for n in per.tolist():
        want += [(at + l, at + c, at + r) for l, c, r in zip(*C.windows(v[at:at + n], 8))]
        at += n
    assert got == sorted(want) and want


def test_a_first_text_of_many_passages_is_verified_in_parts(spark, monkeypatch):
    passage = " ".join(f"w{i}" for i in range(70))
    docs = spark.createDataFrame([(i, f"{' '.join(f'd{i}n{k}' for k in range(i))} {passage}") for i in range(12)]
                                 + [(3, "another text of one id"), (5, "q " * 60)], "doc_id long, text string")
    found = lambda: sorted(map(tuple, C.repeated_passages(docs).collect()))
    want = found()
    assert [r[:4] for r in want if r[0] != 5 or r[1] != 5] == [(i, 0, i, i + 70) for i in range(1, 12)]
    monkeypatch.setattr(C, "GROUP", 2)
    assert found() == want
