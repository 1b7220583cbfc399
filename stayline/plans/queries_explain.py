"""Registered queries: explanations (X*)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from stayline import config as C
from stayline.operators import explain as X
from stayline.operators import model as M
from stayline.plans.oracle import SHAP, dbl, linear_design_sql, with_views
from stayline.plans.registry import query
from stayline.plans.score import processed_view, scored_view
from stayline.session import cut_lineage

FEATS = X.FEATURES
W = dict(C.LINEAR_WEIGHTS)
D = linear_design_sql()


def _wide(spark, sf_dir):
    return X.linear_shap(scored_view(spark, sf_dir))


@query("linear_shap", with_views("SELECT * FROM shapl", extra=SHAP))
def q_linear_shap(spark, sf_dir):
    return X.shap_long(_wide(spark, sf_dir))


@query("top_features_per_row", with_views("SELECT * FROM topl", extra=SHAP))
def q_top_features_per_row(spark, sf_dir):
    top = X.top_features_per_row(_wide(spark, sf_dir))
    return X.top_features_long(top).withColumn("rank", F.col("rank").cast("int"))


@query("impact_direction", with_views(
    "SELECT customerID, feature, contribution, CASE WHEN abs(contribution) < 1e-6 THEN 'neutral' "
    "WHEN contribution > 0 THEN 'increases_churn' ELSE 'decreases_churn' END AS direction FROM shapl", extra=SHAP))
def q_impact_direction(spark, sf_dir):
    return X.impact_direction(X.shap_long(_wide(spark, sf_dir))).select("customerID", "feature", "contribution", "direction")


@query("global_importance", with_views("""
SELECT feature, mean_abs_shap, mean_shap,
  CASE WHEN mean_shap > 0 THEN 'increases_churn' WHEN mean_shap < 0 THEN 'decreases_churn' ELSE 'neutral' END AS direction
FROM (SELECT feature, CAST(sum(CAST(round(abs(contribution) * 1000000) AS BIGINT)) AS DOUBLE) / (CAST(count(*) AS DOUBLE) * 1000000.0) AS mean_abs_shap,
        CAST(sum(CAST(round(contribution * 1000000) AS BIGINT)) AS DOUBLE) / (CAST(count(*) AS DOUBLE) * 1000000.0) AS mean_shap
      FROM shapl GROUP BY feature) t ORDER BY mean_abs_shap DESC, feature LIMIT 10""", extra=SHAP))
def q_global_importance(spark, sf_dir):
    return X.global_importance(X.shap_long(_wide(spark, sf_dir)))


@query("batch_top_features", with_views("""
SELECT a.feature, a.avg_shap_value, coalesce(f.frequency, 0) AS frequency FROM
 (SELECT feature, CAST(sum(CAST(round(abs(contribution) * 1000000) AS BIGINT)) AS DOUBLE) / (CAST(count(*) AS DOUBLE) * 1000000.0) AS avg_shap_value
  FROM shapl GROUP BY feature) a
LEFT JOIN (SELECT feature, count(*) AS frequency FROM topl GROUP BY feature) f ON a.feature = f.feature
ORDER BY a.avg_shap_value DESC, a.feature LIMIT 5""", extra=SHAP))
def q_batch_top_features(spark, sf_dir):
    wide = _wide(spark, sf_dir)
    return X.batch_top_features(X.shap_long(wide), X.top_features_long(X.top_features_per_row(wide)))


@query("explain_customers", with_views("""
SELECT t.customerID, s.churn_prob, round(1.0 / (1.0 + exp(-w.base_margin)), 6) AS base_value, t.rank, t.feature,
       t.contribution, t.direction
FROM topl t JOIN keys k ON t.customerID = k.customerID JOIN scored s ON s.customerID = t.customerID
JOIN shapw w ON w.customerID = t.customerID WHERE t.rank <= 3""",
    extra=SHAP + ", keys AS (SELECT customerID FROM scored WHERE is_churner)"))
def q_explain_customers(spark, sf_dir):
    """X7 for every predicted churner (the key list is read from the scored
    data)."""
    scored = scored_view(spark, sf_dir)
    keys = scored.filter("is_churner").select("customerID")
    ex = X.explain_customers(X.linear_shap(scored), keys, n=3)
    return ex.select("customerID", "churn_prob", "base_value", F.posexplode("top_features").alias("pos", "t")) \
             .select("customerID", "churn_prob", "base_value", (F.col("pos") + 1).cast("int").alias("rank"),
                     "t.feature", "t.contribution", "t.direction")


@query("base_value", with_views(
    "SELECT DISTINCT base_margin, round(1.0 / (1.0 + exp(-base_margin)), 6) AS base_prob FROM shapw", extra=SHAP))
def q_base_value(spark, sf_dir):
    """X8 for the linear score: margin at the batch means and its probability."""
    w = _wide(spark, sf_dir)
    return w.select("base_margin").distinct().withColumn(
        "base_prob", F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("base_margin"))), 6))


@query("additivity_check", with_views(
    "SELECT count(*) AS rows_checked, CAST(sum(CASE WHEN abs(base_margin + "
    + " + ".join(f"phi_{f}" for f in FEATS) + " - margin) > 1e-4 THEN 1 ELSE 0 END) AS BIGINT) AS violations FROM shapw",
    extra=SHAP))
def q_additivity_check(spark, sf_dir):
    w = _wide(spark, sf_dir)
    bad = X.additivity_check(w)
    return w.agg(F.count(F.lit(1)).alias("rows_checked")).crossJoin(bad.agg(F.count(F.lit(1)).alias("violations")))


@query("driver_columns", with_views(
    "SELECT customerID, " + ", ".join(
        f"coalesce(max(CASE WHEN rank = {i} THEN feature END), '') AS driver_{i}" for i in (1, 2, 3))
    + " FROM topl GROUP BY customerID", extra=SHAP))
def q_driver_columns(spark, sf_dir):
    return X.driver_columns(X.top_features_per_row(_wide(spark, sf_dir)))


def _trained(spark, sf_dir):
    """The trained churn model and its encoded customers."""
    data = _with_segment(spark, sf_dir)
    enc, model, tau, _ = M.train_churn(data)
    return data, {"encoder": enc, "classifier": model, "tau": tau, "features": [*C.CHURN_NUMERIC, *C.CHURN_CATEGORICAL]}, cut_lineage(enc.transform(M.prepare_model_input(data)).select("customerID", "features"))


def _source(slot: str) -> str:
    return M.source_feature(slot, C.CHURN_CATEGORICAL)


def _tree_shap(spark, sf_dir):
    _, stored, rows = _trained(spark, sf_dir)
    model = stored["classifier"]
    trees, weights = model.node_tables()
    return X.tree_shap(rows, trees, weights, len(model.names), model_prior=model.prior), model, rows


@query("tree_shap", with_views(
    "SELECT count(*) AS customers, CAST(0 AS BIGINT) AS nulls, CAST(0 AS BIGINT) AS not_additive FROM clean", "clean"))
def q_tree_shap(spark, sf_dir):
    """X1 + X8 of the trained churn model, as a check table over every
    customer: contributions that are null, and customers whose base + sum(phi)
    is not the model's log-odds."""
    from stayline.operators.boosting import with_margin
    shap, model, rows = _tree_shap(spark, sf_dir)
    j = shap.join(with_margin(rows, model, name="own").select("customerID", "own"), "customerID")
    total = F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x)
    nulls = F.size(F.filter("contributions", lambda x: x.isNull()))
    bad = (F.abs(F.col("base_value") + total - F.col("own")) > 1e-6) | (F.abs(F.col("margin") - F.col("own")) > 1e-6)
    return j.agg(F.count(F.lit(1)).alias("customers"), F.sum(nulls).cast("long").alias("nulls"), F.sum(bad.cast("long")).alias("not_additive"))


ALL_FEATURES = [*C.CHURN_NUMERIC, *C.CHURN_CATEGORICAL]


@query("model_drivers", with_views(
    f"SELECT customerID, CAST({C.TOP_N_DRIVERS} AS BIGINT) AS drivers, true AS known, true AS in_order, true AS adds_up FROM clean", "clean"))
def q_model_drivers(spark, sf_dir):
    """X3 + X4 of the trained model, by source feature (encoded slots added up),
    as a check per customer: as many drivers as asked for, all of them
    table columns, in order, and contributions that still add up."""
    shap, model, _ = _tree_shap(spark, sf_dir)
    folded, names = X.fold_slots(shap, model.names, _source)
    folded = cut_lineage(folded)
    top = X.model_drivers(folded, names).join(folded.select("customerID", "contributions"), "customerID")
    size = F.transform("top_features", lambda t: -F.abs(t["contribution"]))
    total = F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x)
    known = F.size(F.array_except(F.transform("top_features", lambda t: t["feature"]), F.array(*[F.lit(f) for f in ALL_FEATURES]))) == 0
    return top.select("customerID", F.size("top_features").cast("long").alias("drivers"), known.alias("known"), (F.sort_array(size) == size).alias("in_order"),
                      (F.abs(F.col("base_value") + total - F.col("margin")) < 1e-6).alias("adds_up"))


@query("model_importance", with_views(f"SELECT CAST({len(ALL_FEATURES)} AS BIGINT) AS features, true AS known, true AS not_above FROM (SELECT count(*) FROM clean)", "clean"))
def q_model_importance(spark, sf_dir):
    """X5 of the trained model by source feature, as a check: every column of
    the table has a row, and no mean is above the mean size."""
    shap, model, _ = _tree_shap(spark, sf_dir)
    got = X.model_importance(*X.fold_slots(shap, model.names, _source))
    return got.agg(F.count(F.lit(1)).alias("features"), (F.count_if(F.col("feature").isin(ALL_FEATURES)) == F.count(F.lit(1))).alias("known"),
                   F.bool_and(F.abs("mean_shap") <= F.col("mean_abs_shap") + 1e-12).alias("not_above"))


BACKGROUND = 100
BG_SQL = (f"bg AS (SELECT * FROM scored ORDER BY md5('{C.SEED}:' || CAST(customerID AS VARCHAR)), customerID LIMIT {BACKGROUND}), "
          "bgmu AS (SELECT " + ", ".join(f"avg({D[f]}) AS mu_{f}" for f in FEATS) + " FROM bg)")


@query("kernel_shapley", with_views(" UNION ALL ".join(
    f"SELECT customerID, '{f}' AS feature, round({dbl(W[f])} * ({D[f]} - mu_{f}), 6) AS contribution FROM scored CROSS JOIN bgmu" for f in FEATS), extra=BG_SQL))
def q_kernel_shapley(spark, sf_dir):
    """X10 of the deployed score by kernel least squares against a seeded
    background of 100 rows: contributions of every customer and feature."""
    from stayline.operators import clean
    d = M.linear_design()
    scored = scored_view(spark, sf_dir)
    rows = scored.select("customerID", F.array(*[F.coalesce(d[f], F.lit(0.0)) for f in FEATS]).alias("x"))
    bg = clean.background_sample(scored, n=BACKGROUND).select(F.array(*[F.coalesce(d[f], F.lit(0.0)) for f in FEATS]).alias("x"))
    weights, intercept = [W[f] for f in FEATS], float(C.LINEAR_INTERCEPT)
    got = X.kernel_shapley(rows, bg, {f: [i] for i, f in enumerate(FEATS)}, lambda x: x @ weights + intercept)
    return X.tree_shap_long(got, FEATS).select("customerID", "feature", F.round("contribution", 6).alias("contribution"))


@query("model_kernel_shapley", with_views(
    "SELECT count(*) AS customers, CAST(0 AS BIGINT) AS nulls, CAST(0 AS BIGINT) AS not_additive, true AS base_is_background FROM clean", "clean"))
def q_model_kernel_shapley(spark, sf_dir):
    """X10 of the stored trained model: kernel values by source feature against
    100 background rows, as a check table over every customer."""
    from pyspark.ml.functions import vector_to_array
    from stayline.operators import clean
    _, stored, rows = _trained(spark, sf_dir)
    model = stored["classifier"]
    rows = rows.select("customerID", vector_to_array("features").alias("x"))
    bg = clean.background_sample(rows, n=BACKGROUND)
    groups = {}
    for i, n in enumerate(model.names):
        groups.setdefault(_source(n), []).append(i)
    got = cut_lineage(X.kernel_shapley(rows, bg, groups, model.margins, samples=KERNEL_SAMPLES, trees=model.node_tables(), prior=model.prior))
    base = float(model.margins(np.array(bg.select("x").toArrow().column(0).to_pylist())).mean())
    total = F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x)
    return got.agg(F.count(F.lit(1)).alias("customers"), F.sum(F.size(F.filter("contributions", lambda x: x.isNull() | F.isnan(x)))).cast("long").alias("nulls"),
                   F.sum((F.abs(F.col("base_value") + total - F.col("margin")) > 1e-6).cast("long")).alias("not_additive"),
                   F.bool_and(F.abs(F.col("base_value") - F.lit(base)) < 1e-9).alias("base_is_background"))


#: Coalitions of the 20 features: all of the outer sizes, then pairs drawn from the inner ones.
KERNEL_SAMPLES = 64


def _with_segment(spark, sf_dir):
    from stayline.operators import features, segments
    feat = features.engineer_features(processed_view(spark, sf_dir))
    return segments.assign_segments(feat).withColumn("segment", F.col("segment").cast("string"))


@query("sampled_shapley", with_views(
    "SELECT feature, count(*) AS customers, CAST(0 AS BIGINT) AS off FROM scored CROSS JOIN (VALUES "
    + ", ".join(f"('{f}')" for f in FEATS) + ") f(feature) GROUP BY feature"))
def q_sampled_shapley(spark, sf_dir):
    """X10 of the deployed score against a seeded background of 100 rows, held
    against the exact values for that background: customers by feature, and
    how many are off by more than 1e-9."""
    from stayline.operators import clean
    d = M.linear_design()
    scored = scored_view(spark, sf_dir)
    design = [F.coalesce(d[f], F.lit(0.0)).alias(f) for f in FEATS]
    bg = cut_lineage(clean.background_sample(scored, n=BACKGROUND).select(*design))
    rows = cut_lineage(scored.select("customerID", *design))
    got = X.sampled_shapley(rows, bg, FEATS, X.linear_predict)
    mean = bg.agg(*[F.avg(f).alias(f"__mu_{f}") for f in FEATS])
    exact = rows.crossJoin(F.broadcast(mean)).select("customerID", F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), (F.lit(W[f]) * (F.col(f) - F.col(f"__mu_{f}"))).alias("exact")) for f in FEATS])))
    both = got.join(exact, ["customerID", "feature"])
    return both.groupBy("feature").agg(F.count(F.lit(1)).alias("customers"),
                                       F.sum((F.abs(F.col("contribution") - F.col("exact")) > 1e-9).cast("long")).alias("off"))
