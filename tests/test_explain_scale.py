"""Explanations by tables of passed tests, and hybrids that are not exchanged."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayline.operators import boosting as B
from stayline.operators import explain as X


def forest(depth: int, seed: int = 5):
    """A model of random trees on four numeric slots, and rows."""
    rng = np.random.default_rng(seed)
    model, inner = B.Boosted(list("abcd"), [np.array([-0.5, 0.0, 0.5])] * 4, 0.25), (1 << depth) - 1
    for _ in range(6):
        n = 2 * inner + 1
        rows = np.zeros(n)
        rows[0] = 1 << 2 * depth + 4
        for i in range(inner):
            rows[2 * i + 1] = rows[i] // rng.integers(2, 4)
            rows[2 * i + 2] = rows[i] - rows[2 * i + 1]
        feat = np.where(np.arange(n) < inner, rng.integers(0, 4, n), -1)
        model.trees.append({"feat": feat, "bin": rng.integers(0, 3, n), "value": rng.normal(size=n), "rows": rows, "gain": np.ones(n)})
    return model, rng.normal(size=(40, 4)).round(1)


@pytest.mark.parametrize("depth", [3, 4, 9])
def test_tables_give_the_contributions_of_the_paths(spark, depth):
    model, x = forest(depth)
    trees, weights = model.node_tables()
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "customerID long, v array<double>")
    from pyspark.ml.functions import array_to_vector
    got = {r.customerID: r for r in X.tree_shap(df.select("customerID", array_to_vector("v").alias("features")), trees, weights, 4, model_prior=model.prior).collect()}
    want = sum(2 * w * X.tree_shap_batch(x, t, X.leaf_paths(t)) for t, w in zip(trees, weights))
    assert np.array([got[i].contributions for i in range(len(x))]) == pytest.approx(want, abs=1e-9)
    assert [got[i].margin for i in range(len(x))] == pytest.approx(model.margins(x).tolist(), abs=1e-9)
    assert all(len(n) <= X.MOST_TESTS or len(leaves) == 1 for t in trees for n, leaves in X.pieces(X.leaf_paths(t)))


@pytest.mark.parametrize("samples", [14, 6])
def test_tabulated_coalitions_equal_predicted_hybrids(spark, samples):
    model, x = forest(4)
    rows = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "customerID long, x array<double>")
    bg, groups, seen = rows.where("customerID < 9"), {"ab": [0, 1], "c": [2], "d": [3]}, []
    plain = {r.customerID: r for r in X.kernel_shapley(rows, bg, groups, model.margins, samples=samples).collect()}
    quick = {r.customerID: r for r in X.kernel_shapley(rows, bg, groups, model.margins, samples=samples, trees=model.node_tables(), prior=model.prior).collect()}
    for i in plain:
        assert quick[i].contributions == pytest.approx(plain[i].contributions, abs=1e-9)
        assert (quick[i].base_value, quick[i].margin) == pytest.approx((plain[i].base_value, plain[i].margin))


def test_sampled_hybrids_are_not_exchanged(spark):
    """The rows of the last exchange are sums by customer and feature."""
    df = spark.createDataFrame([(i, float(i), float(i % 3)) for i in range(20)], "customerID long, a double, b double")
    predict = lambda d: d.withColumn("value", F.col("a") * F.col("b") + F.col("a"))
    got = X.sampled_shapley(df, df.where("customerID < 4"), ["a", "b"], predict)
    total = {r.customerID: r.s for r in got.groupBy("customerID").agg(F.sum("contribution").alias("s")).collect()}
    base = np.mean([i * (i % 3) + i for i in range(4)])
    assert all(total[i] == pytest.approx(i * (i % 3) + i - base) for i in range(20))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "partial_avg" in plan
