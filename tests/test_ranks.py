"""Percentiles by ranges against sorted lists."""

import random

import numpy as np
import pytest

from seaway.operators.ranks import percentiles


@pytest.mark.parametrize("limit", [1_000_000, 1])
def test_percentiles_equal_sorted_lists(spark, limit):
    rnd = random.Random(3)
    for values in ([rnd.gauss(0, 1e3) for _ in range(600)], [1.0] * 900 + [2.0] * 100 + [rnd.random() for _ in range(50)], [1.0, 1.5] + [2.0] * 3000, [3.0, 1.0]):
        d = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        got = percentiles(d, "v", [0.0, 0.5, 0.9, 1.0], limit)
        assert np.allclose(got, np.quantile(values, [0.0, 0.5, 0.9, 1.0]), rtol=1e-12, atol=0)
    assert percentiles(spark.createDataFrame([(None,)], "v double"), "v", [0.5]) == [None]
