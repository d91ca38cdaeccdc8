import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.functions.quantiles import order_statistics

PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


def _table(spark):
    rng = np.random.default_rng(7)
    n = 20_000
    heavy = np.where(rng.random(n) < 0.4, 3.0, rng.normal(size=n))
    return pd.DataFrame(
        {
            "spread": rng.lognormal(0, 9, n),
            "heavy": heavy,
            "few": rng.integers(0, 3, n).astype(float),
            "constant": np.full(n, 5.0),
            "tail": np.where(rng.random(n) < 0.003, rng.random(n), 9.0),
        }
    )


@pytest.mark.parametrize("small_bracket", [1, 50, 5000])
def test_narrowing_gives_exact_quantiles(spark, small_bracket):
    pdf = _table(spark)
    df = spark.createDataFrame(pdf).repartition(7)
    got = order_statistics(df, list(pdf), PROBS, small_bracket=small_bracket)
    for c in pdf:
        assert np.allclose(got[c], pdf[c].quantile(PROBS)), c


def test_rank_without_interpolation(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 11)], "v double")
    assert order_statistics(df, ["v"], [0.25, 0.75], interpolate=False) == {"v": [3.0, 8.0]}


def test_small_table_and_missing_values(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, None), (4.0, None), (None, None)], "v double, e double")
    df = df.union(spark.createDataFrame([(float("nan"), None), (float("inf"), None)], df.schema))
    got = order_statistics(df, ["v", "e"], [0.25])
    assert got == {"v": [1.75], "e": [None]}
    assert order_statistics(df, ["v", "e"], [0.25], small_bracket=1) == got
