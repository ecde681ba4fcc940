"""Grading figures on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybrook.operators import evaluate as V


def test_correlation_of_a_constant_is_null(spark):
    """constant odds have no correlation with errors, and that's no error; rows with a null take no part."""
    rows = [("flat", 0.1, 1.0), ("flat", 0.1, 5.0), ("flat", 0.1, 2.0), ("some", 1.0, 2.0), ("some", 2.0, 1.0), ("some", 4.0, 7.0), ("some", 9.0, None), ("some", None, 3.0), ("one", 1.0, 1.0), ("none", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, a double, b double")
    got = {r["g"]: r["c"] for r in df.groupBy("g").agg(V.correlation(F.col("a"), F.col("b")).alias("c")).collect()}
    assert got["flat"] is None and got["one"] is None and got["none"] is None
    assert got["some"] == pytest.approx(np.corrcoef([1, 2, 4], [2, 1, 7])[0, 1], rel=1e-12)
