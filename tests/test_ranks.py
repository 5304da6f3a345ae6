"""Ranks by counting against sorting."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import metrics

SHARES = {"low": 0.0, "p50": 0.5, "p95": 0.95, "top": 1.0}


@pytest.mark.parametrize("bins", [2, 256])
def test_ranks_are_those_of_sorting(spark, bins):
    rng = random.Random(2)
    rows = [(1, rng.gauss(0, 1)) for _ in range(301)] + [(2, float(rng.randint(0, 3))) for _ in range(40)] + [(3, 5.0)] + [(4, 10.0 ** rng.randint(-300, 300)) for _ in range(50)] + [(5, None)] + [(None, x) for x in (3.0, 1.0, 2.0)]
    found = {r.k: tuple(r[1:]) for r in metrics.nearest_ranks(spark.createDataFrame(rows, "k long, value double"), ["k"], "value", SHARES, bins).collect()}
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    assert found == {k: tuple(sorted(v)[round(s * (len(v) - 1))] for s in SHARES.values()) for k, v in groups.items()}


def test_ranks_without_groups_and_of_nothing(spark):
    df = spark.range(1001).select(F.col("id").cast("decimal(18,4)").alias("value"))
    assert tuple(map(float, metrics.nearest_ranks(df, [], "value", SHARES).first())) == (0.0, 500.0, 950.0, 1000.0)
    assert metrics.nearest_ranks(df.limit(0).withColumn("k", F.lit(1)), ["k"], "value", SHARES).count() == 0
