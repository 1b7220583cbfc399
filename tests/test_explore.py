"""Correlations, codes, distinct counts and kernel densities against pandas and NumPy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stayline.operators import clean, explore


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    n = 1500
    pdf = pd.DataFrame({"customerID": rng.permutation(n), "x": rng.normal(50, 12, n).round(1), "z": rng.gamma(2, 900, n).round(2),
                        "k": rng.choice(["a", "b", "c", None], n), "Churn": rng.integers(0, 2, n), "same": 4.0})
    pdf.loc[rng.random(n) < 0.1, "z"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("z", F.when(F.isnan("z"), None).otherwise(F.col("z")))
    return pdf, df.repartition(4)


@pytest.mark.parametrize("max_inline", [1000, 2])
def test_codes_by_first_appearance_and_by_value(table, max_inline):
    pdf, df = table
    cols = ["x", "k", "Churn"]
    first = explore.coded_columns(df, cols, max_inline=max_inline).toPandas().sort_values("customerID")
    pdf = pdf.sort_values("customerID")
    for c in cols:
        assert first[f"{c}_code"].tolist() == pd.factorize(pdf[c])[0].tolist()
    value = explore.coded_columns(df, ["k"], by="value", max_inline=max_inline).toPandas().sort_values("customerID")
    assert value["k_code"].tolist() == pdf["k"].map({"a": 0, "b": 1, "c": 2}).fillna(-1).astype(int).tolist()


def test_correlations_of_present_pairs(table):
    pdf, df = table
    cols = ["x", "z", "Churn", "same"]
    want = pdf[cols].corr()
    got = {(r.a, r.b): r["corr"] for r in explore.corr_matrix(df, cols).collect()}
    assert len(got) == 16
    for a in cols:
        for b in cols:
            w = want.loc[a, b]
            assert got[a, b] == (1.0 if a == b else None if np.isnan(w) else pytest.approx(w, abs=1e-9)), (a, b)
    target = {r.feature: r["corr"] for r in explore.corr_with_target(df, ["x", "z"]).collect()}
    assert target["z"] == pytest.approx(want.loc["z", "Churn"], abs=1e-9)


def test_far_from_zero(spark):
    """Values with a large offset keep their correlation."""
    rng = np.random.default_rng(1)
    a = rng.normal(size=500)
    b = a * 0.5 + rng.normal(size=500)
    df = spark.createDataFrame([(float(x) + 1e9, float(y) - 1e9) for x, y in zip(a, b)], "a double, b double")
    got = {(r.a, r.b): r["corr"] for r in explore.corr_matrix(df, ["a", "b"]).collect()}
    assert got["a", "b"] == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-6)


@pytest.mark.parametrize("small", [1000, 5])
def test_distinct_counts_without_row_copies(table, small):
    pdf, df = table
    got = clean.null_dtype_profile(df, small=small)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    for r in got.collect():
        col = pdf[r.column_name]
        assert (r.rows, r.nulls, r.distinct_values) == (len(pdf), int(col.isna().sum()), col.nunique()), r.column_name


@pytest.mark.parametrize("cells", [64, 4096])
def test_kernel_density_within_its_bound(table, cells):
    pdf, df = table
    got = explore.kernel_density(df, ["x", "z"], points=23, cells=cells).collect()
    assert len(got) == 2 * 2 * 23
    for r in got:
        x = pdf.loc[pdf["Churn"] == r.Churn, r.feature].dropna().to_numpy()
        h = x.std(ddof=1) * len(x) ** -0.2
        exact = np.exp(-(((r["at"] - x) / h) ** 2) / 2).sum() / (len(x) * h * np.sqrt(2 * np.pi))
        width = pdf[r.feature].max() - pdf[r.feature].min()
        assert abs(r.density - exact) <= explore.kernel_error(width, h, cells) + 1e-12, r
