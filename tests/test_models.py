"""Segmentation, explanation, what-if and streaming properties on sf0.001."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayline import config as C
from tests.conftest import SF


def test_kprototypes_cost_never_rises_and_is_deterministic(spark):
    from stayline.operators import segments
    from stayline.plans.score import features_view
    feat = features_view(spark, SF)
    m1 = segments.kprototypes_fit(feat, n_init=1, max_iter=8)
    h = m1["history"]
    assert all(b <= a + 1e-9 for a, b in zip(h, h[1:]))
    m2 = segments.kprototypes_fit(feat, n_init=1, max_iter=8)
    assert m1["prototypes"] == m2["prototypes"]
    a = segments.assign_segments(feat, m1)
    assert a.filter(F.col("segment").isNull()).count() == 0
    assert a.select("segment").distinct().count() <= 4


def test_kprototypes_starts_differ_and_cost_is_the_models(spark):
    from stayline.operators import segments
    from stayline.plans.score import features_view
    feat = features_view(spark, SF)
    _, prep, levels = segments._fit_input(feat, C.SEG_NUMERIC, C.SEG_CATEGORICAL, None)
    first = segments.cao_init(prep, 4, len(C.SEG_NUMERIC), len(C.SEG_CATEGORICAL), C.SEED, levels)
    starts = segments.seeded_starts(first, 4, C.SEED)
    assert len({str(s) for s in starts}) == 4
    m = segments.kprototypes_fit(feat, n_init=2, max_iter=2)          # stopped early: the cost must still match
    cost = segments.assign_segments(feat, m).agg(F.sum("segment_cost")).first()[0]
    assert abs(cost - m["cost"]) < 1e-6 * cost


def test_kprototypes_reseeds_an_empty_cluster(spark):
    from stayline.operators import segments
    df = spark.createDataFrame([(i, float(i % 3), "a" if i % 2 else "b") for i in range(30)] + [(99, 50.0, "z")], "customerID long, x double, c string")
    scaler, prep, levels = segments._fit_input(df, ["x"], ["c"], None)
    far = ([1000.0], ["b"])                                            # nothing is near this one
    runs = segments.fit_starts(prep, [[([0.0], ["a"]), ([0.1], ["b"]), far]], 0.5, 1, levels, 20)
    used = segments._partial_sums(prep, [runs[0]["prototypes"]], 0.5, 1, levels)
    assert {r["seg"] for r in used} == {0, 1, 2}


def test_kprototypes_rejects_null_numerics(spark):
    from stayline.operators import segments
    df = spark.createDataFrame([(1, None, "a"), (2, 1.0, "b")], "customerID long, x double, c string")
    with pytest.raises(ValueError, match="x"):
        segments.kprototypes_fit(df, k=1, numeric=["x"], categorical=["c"])


def test_linear_shap_additivity_and_sampled_shapley(spark):
    """For a linear score the credit of a feature doesn't depend on the
    order, so with every background row used the sampled values are exact."""
    from stayline.operators import explain, model
    from stayline.plans.score import scored_view
    scored = scored_view(spark, SF)
    assert explain.additivity_check(explain.linear_shap(scored)).count() == 0
    d = model.linear_design()
    rows = scored.select("customerID", *[F.coalesce(d[f], F.lit(0.0)).alias(f) for f in explain.FEATURES])
    bg = rows.orderBy("customerID").limit(7).drop("customerID")
    got = {(r.customerID, r.feature): r.contribution for r in explain.sampled_shapley(rows, bg, explain.FEATURES, explain.linear_predict, n_perm=2).collect()}
    x, mean = rows.toPandas().set_index("customerID"), bg.toPandas().mean()
    assert len(got) == len(x) * len(explain.FEATURES)
    for (i, f), v in got.items():
        assert abs(v - explain.WEIGHTS[f] * (x.at[i, f] - mean[f])) < 1e-9
    with pytest.raises(ValueError):
        explain.sampled_shapley(rows, bg, explain.FEATURES, explain.linear_predict, max_background=3)


def test_tree_contributions_equal_brute_force():
    """All subsets of features, with the tree's own cover for the missing ones."""
    from itertools import combinations
    from math import factorial
    from stayline.operators import explain
    rng = np.random.default_rng(3)
    #        0: f0<=.5 -> 1, 2;  1: f1 in {1} -> 3, 4;  2: f0<=.8 -> 5, 6
    t = {"left": np.array([1, 3, 5, -1, -1, -1, -1]), "right": np.array([2, 4, 6, -1, -1, -1, -1]), "feat": np.array([0, 1, 0, 0, 0, 0, 0]),
         "thr": np.array([.5, 0, .8, 0, 0, 0, 0]), "cats": [None, {1.0}, None, None, None, None, None],
         "val": np.array([0, 0, 0, 3., -1., 2., 7.]), "cover": np.array([100., 60, 40, 20, 40, 30, 10])}
    x = np.column_stack([rng.random(12), rng.integers(0, 3, 12), rng.random(12)]).astype(float)

    def value(row, known, n=0):
        if t["left"][n] < 0:
            return t["val"][n]
        f, l, r = t["feat"][n], t["left"][n], t["right"][n]
        if f in known:
            left = row[f] in t["cats"][n] if t["cats"][n] is not None else row[f] <= t["thr"][n]
            return value(row, known, l if left else r)
        return (t["cover"][l] * value(row, known, l) + t["cover"][r] * value(row, known, r)) / t["cover"][n]

    got = explain.tree_shap_batch(x, t, explain.leaf_paths(t))
    for row, phi in zip(x, got):
        for i in range(3):
            rest = [j for j in range(3) if j != i]
            want = sum(factorial(len(s)) * factorial(2 - len(s)) / 6 * (value(row, {*s, i}) - value(row, set(s)))
                       for k in range(3) for s in combinations(rest, k))
            assert abs(phi[i] - want) < 1e-12


def test_kernel_shapley_equals_brute_force(spark):
    """All coalitions of a small model that isn't additive, one feature of two slots."""
    from itertools import combinations
    from math import factorial
    from stayline.operators import explain
    rng = np.random.default_rng(5)
    x, bg = rng.normal(size=(7, 5)), rng.normal(size=(11, 5))
    f = lambda a: a[:, 0] * a[:, 1] + np.maximum(a[:, 2], a[:, 3]) + a[:, 4] ** 2
    groups = {"a": [0], "b": [1], "both": [2, 4], "d": [3]}
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "customerID long, x array<double>").repartition(2)
    back = spark.createDataFrame([(r.tolist(),) for r in bg], "x array<double>")
    got = {r.customerID: r for r in explain.kernel_shapley(rows, back, groups, f).collect()}
    slots = list(groups.values())

    def value(row, s):
        h = bg.copy()
        for g in s:
            h[:, slots[g]] = row[slots[g]]
        return f(h).mean()

    for i, row in enumerate(x):
        for j in range(4):
            rest = [k for k in range(4) if k != j]
            want = sum(factorial(len(s)) * factorial(3 - len(s)) / 24 * (value(row, [*s, j]) - value(row, s)) for k in range(4) for s in combinations(rest, k))
            assert got[i].contributions[j] == pytest.approx(want, abs=1e-9)
        assert got[i].base_value + sum(got[i].contributions) == pytest.approx(got[i].margin, abs=1e-9)
    few = explain.kernel_shapley(rows, back, groups, f, samples=9).collect()          # sampled: still additive
    assert all(r.base_value + sum(r.contributions) == pytest.approx(r.margin, abs=1e-9) for r in few)
    with pytest.raises(ValueError):
        explain.kernel_shapley(rows, back, groups, f, max_background=3)
    assert explain.kernel_shapley(rows.limit(0), back, groups, f).count() == 0
    one = explain.kernel_shapley(rows, back, {"all": [0, 1, 2, 3, 4]}, f).collect()
    assert all(r.contributions[0] == pytest.approx(r.margin - r.base_value) for r in one)


def test_sampled_coalitions_come_close():
    from stayline.operators import explain
    rng = np.random.default_rng(6)
    m, w = 12, rng.normal(size=12)
    f = lambda z: np.tanh(z @ w) + z[:, 0] * z[:, 1]
    zero = float(f(np.zeros((1, m)))[0])
    phi = {}
    for samples in (4094, 400):
        z, k = explain.kernel_coalitions(m, samples)
        a, c = explain.kernel_solution(z, k)
        phi[samples] = a @ (f(z) - zero) + c * (float(f(np.ones((1, m)))[0]) - zero)
        assert len(np.unique(z, axis=0)) == len(z) and k.sum() == pytest.approx(sum((m - 1) / (j * (m - j)) for j in range(1, m)))
    assert len(explain.kernel_coalitions(m, 4094)[0]) == 4094
    assert np.abs(phi[400] - phi[4094]).max() < 0.1


def test_slots_fold_to_source_features(spark):
    from stayline.operators import explain, model
    names = ["tenure", "Contract__ohe_One year", "Contract__ohe_Two year", "gender__ohe_Male"]
    shap = spark.createDataFrame([(1, 0.5, 1.5, [0.5, -1.0, 0.25, 1.25])], "customerID long, base_value double, margin double, contributions array<double>")
    folded, own = explain.fold_slots(shap, names, lambda n: model.source_feature(n, ["Contract", "gender"]))
    assert own == ["tenure", "Contract", "gender"] and folded.first().contributions == [0.5, -0.75, 1.25]
    top = explain.model_drivers(folded, own, n=2).first().top_features
    assert [(t.feature, t.contribution, t.direction) for t in top] == [("gender", 1.25, "increases_churn"), ("Contract", -0.75, "decreases_churn")]
    imp = explain.model_importance(folded, own).collect()
    assert [r.feature for r in imp] == ["gender", "Contract", "tenure"]


def test_stored_model_scores_as_before(spark):
    import __spark_entry__ as E
    assert E.queries()["predict_proba"](spark, SF).first().asDict() == {"customers": 148, "nulls": 0, "out_of_range": 0, "moved": 0}


def test_encoder_drops_first_level_and_rejects_unseen(spark):
    from pyspark.ml import Pipeline
    from stayline.operators import model
    df = spark.createDataFrame([(1.0, "a", 0), (2.0, "b", 1), (3.0, "c", 0)], "x double, c string, Churn int")
    enc = Pipeline(stages=model.encoder_stages(["x"], ["c"])).fit(model.prepare_model_input(df, ["x"], ["c"]))
    assert len(enc.transform(model.prepare_model_input(df, ["x"], ["c"])).first()["features"]) == 3
    new = spark.createDataFrame([(1.0, "new", 0)], df.schema)
    with pytest.raises(Exception, match="new|unseen|Unseen"):
        enc.transform(model.prepare_model_input(new, ["x"], ["c"])).collect()


def test_customers_without_orders_are_reported(spark):
    from stayline.plans import score
    from stayline.sources.tables import customer_view_from
    orders = spark.sql("select 1L o_orderkey, 1L o_custkey, 'O' o_orderstatus, 100.0D o_totalprice, timestamp'2024-01-01' o_orderdate, '1-URGENT' o_orderpriority")
    cust = spark.sql("select id c_custkey, 1 c_nationkey, 0.0D c_acctbal, 'MACHINERY' c_mktsegment from values (1L), (2L) t(id)")
    raw = customer_view_from(orders, cust)
    lost = {r.customerID: (r.tenure, r.TotalCharges, r.Churn) for r in raw.collect()}[2]
    assert lost == (0, " ", "No")
    scored = score.score_batch(raw, high_value_threshold=1.0)
    assert {r.customerID for r in score.failed_rows(raw, scored).collect()} == {1, 2}


def test_file_batch_replay_leaves_the_same_rows(spark, tmp_path):
    """A micro-batch seen again (its commit is lost) overwrites its own folders."""
    import os
    import shutil
    from stayline.sources.tables import customer_view
    from stayline.streaming import scoring
    src, out, ck, ck2 = (str(tmp_path / x) for x in ("in", "out", "ck", "ck2"))
    customer_view(spark, SF).repartition(2).write.parquet(src)
    scoring.stream_file_batches(spark, src, out, ck, 50.0).awaitTermination()
    before = sorted(map(str, spark.read.parquet(f"{out}/predictions").collect()))
    shutil.copytree(ck, ck2, ignore=lambda d, names: [n for n in names if os.path.basename(d) == "commits" and n.lstrip(".").startswith("1")])
    scoring.stream_file_batches(spark, src, out, ck2, 50.0).awaitTermination()
    assert sorted(map(str, spark.read.parquet(f"{out}/predictions").collect())) == before
    status = spark.read.parquet(f"{out}/status")
    assert status.count() == 2 and status.agg(F.sum("rows_processed")).first()[0] == len(before)


def test_plans_of_features_are_pruned(spark):
    """A one-column feature query reads only what it needs."""
    from stayline.plans.score import features_view
    plan = features_view(spark, SF).select("customerID", "streaming_count")._jdf.queryExecution().executedPlan().toString()
    assert "o_orderpriority" not in plan and "c_acctbal" not in plan


def test_what_if_empty_modifications_give_zero_delta(spark):
    import __spark_entry__ as E
    d = E.queries()["what_if_delta"](spark, SF).filter("scenario = 'No Change'")
    assert d.count() > 0
    assert d.filter((F.col("churn_prob_delta") != 0) | F.col("segment_changed") | F.col("action_changed")).count() == 0


def test_stream_equals_batch(spark):
    import __spark_entry__ as E
    q = E.queries()
    s = q["stream_score"](spark, SF)
    b = q["score_batch"](spark, SF)
    assert s.count() == b.count()
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def test_output_constraints_hold(spark):
    import __spark_entry__ as E
    rows = E.queries()["output_constraints"](spark, SF).collect()
    assert len(rows) == 4 and all(r["violations"] == 0 for r in rows)


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert "risk_share" in df.columns
