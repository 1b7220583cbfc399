"""Positions under several keys against sorting, with hot values and nulls."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stayline.operators.positions import positions_under


@pytest.mark.parametrize("bucket_rows", [10 ** 6, 200, 7])
def test_positions_equal_a_sort(spark, bucket_rows):
    rng = random.Random(3)
    rows = [(i, rng.choice([1.0, 1.0, None, float(rng.randint(0, 9)), rng.random(), float("inf"), float("-inf")]), rng.randint(0, 3)) for i in range(900)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, x double, y int").repartition(3)
    got = positions_under(df, {"up": F.col("x"), "down": -F.col("y"), "same": F.lit(5.0)}, "id", bucket_rows=bucket_rows)
    at = {(r.sort_key, r.id): r.position for r in got.collect()}
    assert len(at) == 3 * len(rows)
    for name, value in (("up", lambda r: (r[1] is not None, r[1] if r[1] is not None else 0.0)), ("down", lambda r: -r[2]), ("same", lambda r: 0)):
        for k, r in enumerate(sorted(rows, key=lambda r: (value(r), r[0]))):
            assert at[name, r[0]] == k, (name, r)


def test_hot_values_are_spread(spark):
    """Half of the rows share a value: its rows are cut by key, none of the buckets is large."""
    df = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, F.lit(7.0)).otherwise(F.rand(1) * 100).alias("x"))
    got = positions_under(df, {"x": F.col("x")}, "id", bucket_rows=100)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "RDDScan" not in plan and "ExistingRDD" not in plan          # nothing is checkpointed
    assert got.select("position").distinct().count() == 4000


def test_empty(spark):
    df = spark.createDataFrame([], "id long, x double")
    assert positions_under(df, {"x": F.col("x")}, "id").count() == 0
