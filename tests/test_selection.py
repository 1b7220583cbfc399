"""Distributed selection against NumPy, and what its plans contain."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayline.operators import selection

PROBS = [0.0, 0.25, 0.5, 0.9, 1.0]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def bits(x):
    if x != x:
        return 2 ** 63 - 1
    b = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return -b if x < 0 else b


def test_ordered_bits_are_the_doubles_bits(spark):
    rng = np.random.default_rng(1)
    tiny, huge = 5e-324, 1.7976931348623157e308
    xs = [0.0, -0.0, 1.0, -1.0, tiny, -tiny, 2.2250738585072014e-308, 2.225073858507201e-308, huge, -huge, float("inf"), float("-inf"), float("nan")]
    xs += [float(2.0 ** e) for e in range(-1074, 1024)] + [float(np.nextafter(2.0 ** e, d)) for e in range(-1022, 1023, 7) for d in (0, np.inf)]
    xs += rng.integers(-2 ** 62, 2 ** 62, 5000).view(np.float64).tolist()
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", selection.ordered_bits("x").alias("k")).collect()
    for r in got:
        assert r.k == bits(r.x), r.x
    assert spark.createDataFrame([(None,)], "x double").select(selection.ordered_bits("x")).first()[0] is None


@pytest.mark.parametrize("direct", [0, 50, 1 << 16])
def test_quantiles_by_group(spark, direct):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(4000):
        g = ["a", "b", None][int(rng.integers(0, 3))]
        x = float(rng.choice([rng.normal() * 10.0 ** int(rng.integers(-300, 300)), round(rng.normal(), 1), -3.0, 0.0]))
        rows.append((g, x if rng.random() > 0.1 else None, int(rng.integers(-5, 5))))
    rows += [("one", 7.5, 1), ("none", None, 3), ("none", None, 4)]
    df = spark.createDataFrame(rows, "g string, x double, y int")
    got = selection.quantiles(df, ["x", "y"], PROBS, ["g"], direct=direct)
    for g in {r[0] for r in rows}:
        for c, k in (("x", 1), ("y", 2)):
            vals = [row[k] for row in rows if row[0] == g and row[k] is not None]
            assert ((g,), c) in got if vals else ((g,), c) not in got
            if vals:
                assert got[(g,), c] == pytest.approx(np.quantile(vals, PROBS).tolist(), rel=1e-12)
    wide = {r.g: r for r in selection.order_statistics(df, ["x", "y"], [0.5], ["g"]).collect()}
    assert set(wide) == {"a", "b", None, "one", "none"} and wide["none"].x__0 is None and wide["none"].y__0 == 3.5


def test_a_million_distinct_doubles(spark):
    n = 1_000_000
    df = spark.range(n).select((F.xxhash64("id") / F.lit(2.0 ** 40)).alias("x"))      # distinct, of many magnitudes
    xs = df.toPandas()["x"].to_numpy()
    assert len(np.unique(xs)) > 0.999 * n
    got = selection.quantiles(df, ["x"], PROBS)
    assert got[(), "x"] == pytest.approx(np.quantile(xs, PROBS).tolist(), rel=1e-12)
    # what a level holds is bounded: bins of the first digit, then rows of the wanted bins
    counted = selection._counted(df, ["x"], [])
    first = selection._first_bins(counted, [], PROBS)
    text = plan(first)
    assert "percentile" not in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert first.count() <= 2 * len(PROBS) and sum(r.n for r in first.collect()) < n / 50


def test_histograms_are_bounded(spark):
    """The first level has at most 2**22 rows, whatever the values are."""
    df = spark.range(200_000).select((F.rand(3) * 1e9 - 5e8).alias("x"))
    d = df.select(F.shiftright(selection.ordered_bits("x"), selection.SHIFTS[0]).alias("d"))
    assert d.agg(F.max(F.abs("d"))).first()[0] < 2 ** 21
    assert d.distinct().count() < 60_000


def test_no_percentile_in_the_plans(spark):
    import __spark_entry__ as entry
    from tests.conftest import SF
    for name in ("describe_numeric", "segment_summary", "segment_profile", "box_stats", "is_high_value", "engineer_features", "score_batch"):
        assert "percentile" not in plan(entry.queries()[name](spark, SF)), name


def test_summaries(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(1e6, 3, 2000)
    df = spark.createDataFrame([(float(v), int(k)) for v, k in zip(x, rng.integers(0, 4, 2000))], "x double, k int").withColumn("none", F.lit(None).cast("double"))
    got = selection.summaries(df, ["x", "k", "none"], [0.25, 0.9])
    n, mean, std, lo, hi, q = got["x"]
    assert (n, lo, hi) == (2000, x.min(), x.max()) and mean == pytest.approx(x.mean(), rel=1e-14) and std == pytest.approx(x.std(ddof=1), rel=1e-9)
    assert q == pytest.approx(np.quantile(x, [0.25, 0.9]).tolist(), rel=1e-12) and "none" not in got and got["k"][0] == 2000
    one = selection.summaries(df.limit(1), ["x"], [0.5])["x"]
    assert one[0] == 1 and one[2] is None


def test_empty_null_and_many_groups(spark):
    df = spark.createDataFrame([], "x double, g int")
    assert selection.quantiles(df, ["x"], [0.5]) == {} and selection.summaries(df, ["x"], [0.5]) == {}
    assert selection.order_statistics(df, ["x"], [0.5], ["g"]).count() == 0
    nulls = spark.createDataFrame([(None, 1)], "x double, g int")
    assert selection.order_statistics(nulls, ["x"], [0.5]).count() == 0
    with pytest.raises(ValueError):
        selection.quantiles(spark.range(50).select("id", F.col("id").alias("g")), ["id"], [0.5], ["g"], max_bins=20)
