"""The bank files are written from transactions that are built once."""

from cadence.plans import catalog_clean
from cadence.sources.fixtures import txn

SF_SMALL = "/root/testdata/sf0.001"


def test_bank_files_read_the_transactions_once(spark, monkeypatch):
    built = spark.sparkContext.accumulator(0)

    def seen(it):
        for b in it:
            built.add(b.num_rows)
            yield b
    rows = txn(spark, SF_SMALL).limit(500).localCheckpoint()
    monkeypatch.setattr(catalog_clean, "txn", lambda *_: rows.mapInArrow(seen, rows.schema))
    assert catalog_clean.q_consolidate(spark, SF_SMALL).count() > 0
    assert built.value == 500
