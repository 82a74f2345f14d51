"""The pairs of a text score are built once; both areas of a score table come from one scan."""

from pyspark.sql import functions as F

from cadence.operators import metrics as M
from cadence.operators import pairs as P


def test_scored_pairs_are_built_once(spark):
    built = spark.sparkContext.accumulator(0)

    def seen(it):
        for b in it:
            built.add(b.num_rows)
            yield b
    rows = [("a", "x", "one two"), ("b", "two one", "one two"), ("c", None, "x"), ("d", "two one", "one two")]
    pairs = spark.createDataFrame(rows, "k string, t1 string, t2 string").mapInArrow(seen, "k string, t1 string, t2 string")
    got = P.scored_text_pairs(pairs, "t1", "t2", 60.0).select("k", "str_score").collect()
    assert sorted(map(tuple, got)) == [("b", 100.0), ("d", 100.0)]
    assert built.value == len(rows)


def test_areas_equal_the_single_metrics(spark):
    rows = [(i % 37 / 37.0, int(i * 7919 % 11 < i % 37 / 8)) for i in range(900)] + [(0.5, None), (None, 1)]
    df = spark.createDataFrame(rows, "p double, y int")
    st = M.score_table(df.filter(F.col("p").isNotNull()), "p", "y")
    got = M.areas(st).first()
    assert abs(got.average_precision - M.average_precision(None, None, None, table=st).first()[0]) < 1e-12
    assert abs(got.roc_auc - M.roc_auc(None, None, None, table=st).first()[0]) < 1e-12
    assert M.areas(st.filter("false")).count() == M.roc_auc(None, None, None, table=st.filter("false")).count() == 0
