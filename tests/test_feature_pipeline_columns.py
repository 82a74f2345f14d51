"""feature_pipeline: only the columns that its steps read are stored."""

from cadence.plans import catalog_ml
from tests.conftest import SF_SMALL


def test_only_columns_in_use_are_stored(spark, monkeypatch):
    seen = []
    store = catalog_ml.materialize
    monkeypatch.setattr(catalog_ml, "materialize", lambda df: seen.append(df.columns) or store(df))
    assert catalog_ml.q_feature_pipeline(spark, SF_SMALL).columns[0] == "trId"
    assert seen == [["trId", "accountId", "date", "amount"]]
