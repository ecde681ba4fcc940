"""Rows that models pass over many times come from shared storage, not from their derivation."""

from tallybrook.plans import simulated as SP

from .conftest import SF


def test_features_are_derived_once(spark):
    for df in SP.features(spark, SF):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "FileScan parquet" in plan
        assert df.count() and "ml_attr" in df.schema["features"].metadata
