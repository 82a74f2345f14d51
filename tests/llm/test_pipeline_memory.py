"""pipeline: its token caches are small and emptied after a task, its stages' Arrow batches bounded."""

import pyarrow as pa

import corpus_pipeline
from cadence.llm import piece_bpe


def test_lean_caches_are_emptied_and_give_the_same_ids(monkeypatch):
    model = piece_bpe.default_model()
    monkeypatch.setattr(piece_bpe, "LEAN_SEGMENTS", 5)
    monkeypatch.setattr(piece_bpe, "LEAN_PAIRS", 7)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["one two, three two", None, "seven words and a few of them again"])],
                                       names=["doc_id", "text"])
    table = piece_bpe.piece_table(model)
    got = {lean: [b.to_pylist() for b in piece_bpe._each(model, False, lean)(iter([batch]))] for lean in (False, True)}
    assert got[False] == got[True]
    assert not (table.cache or table.old or table.pair or table.old_pair)
    lean = piece_bpe._each(model, False, True)(iter([batch]))
    next(lean)
    assert 0 < len(table.cache) <= 5 and len(table.pair) <= 7


def test_stages_bound_the_bytes_of_a_batch(spark, monkeypatch):
    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(conf)
    try:
        for name, stage in corpus_pipeline.STAGES:
            spark.conf.set(conf, 64 << 20)
            docs = spark.createDataFrame([(1, "some words of a text", "en", "a", 20)], "doc_id long, text string, lang string, source string, n_chars long")
            stage(spark, docs, "")
            assert int(spark.conf.get(conf)) == corpus_pipeline.BATCH, name
    finally:
        spark.conf.set(conf, before)
