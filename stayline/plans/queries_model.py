"""Registered queries: segmentation and churn models (G*, M*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayline import config as C
from stayline.operators import evaluate as E
from stayline.operators import features, model as M, segments
from stayline.plans.oracle import dbl, sstr, with_views
from stayline.plans.queries_core import SPLIT_SQL, split_sql
from stayline.plans.queries_business import CM, SCORED_SPLIT, f1_sql, metrics_sql, split_scores
from stayline.plans.registry import query
from stayline.plans.score import features_view, processed_view, scored_view
from stayline.session import cut_lineage, scratch_path

# ---------------------------------------------------------------------------
# G: segmentation
# ---------------------------------------------------------------------------


@query("kprototypes_assign", with_views("SELECT customerID, segment, round(segment_cost, 6) AS segment_cost FROM scored"))
def q_kprototypes_assign(spark, sf_dir):
    s = segments.assign_segments(features_view(spark, sf_dir))
    return s.select("customerID", "segment", F.round("segment_cost", 6).alias("segment_cost"))


@query("cluster_cost", with_views("SELECT round(sum(segment_cost), 4) AS cost FROM scored"))
def q_cluster_cost(spark, sf_dir):
    return segments.cluster_cost(segments.assign_segments(features_view(spark, sf_dir))) \
        .select(F.round("cost", 4).alias("cost"))


@query("segment_confidence", with_views("SELECT customerID, segment_confidence FROM scored"))
def q_segment_confidence(spark, sf_dir):
    return segments.assign_segments(features_view(spark, sf_dir)).select("customerID", "segment_confidence")


@query("segment_sizes", with_views(
    "SELECT segment, segment_label, count(*) AS customers FROM scored GROUP BY segment, segment_label"))
def q_segment_sizes(spark, sf_dir):
    return segments.segment_sizes(segments.assign_segments(features_view(spark, sf_dir)))


@query("segment_summary", with_views(
    "SELECT segment, segment_label, count(*) AS customers, avg(CAST(Churn AS DOUBLE)) AS churn_rate, "
    "quantile_cont(CAST(tenure AS DOUBLE), 0.5) AS median_tenure, quantile_cont(MonthlyCharges, 0.5) AS median_monthly, "
    "quantile_cont(TotalCharges, 0.5) AS median_total FROM scored GROUP BY segment, segment_label"))
def q_segment_summary(spark, sf_dir):
    return segments.segment_summary(segments.assign_segments(features_view(spark, sf_dir)))


@query("segment_naming", with_views("""
SELECT segment, segment_name FROM (
  SELECT segment, 'Low Engagement' AS segment_name FROM prof WHERE segment = (SELECT segment FROM prof ORDER BY m, segment LIMIT 1)
  UNION ALL
  SELECT segment, 'Loyal High-Value' FROM prof WHERE segment = (
     SELECT segment FROM prof WHERE segment <> (SELECT segment FROM prof ORDER BY m, segment LIMIT 1)
     ORDER BY t DESC, segment LIMIT 1)
  UNION ALL
  SELECT segment, 'At risk High-value' FROM prof WHERE segment = (
     SELECT segment FROM prof WHERE segment NOT IN ((SELECT segment FROM prof ORDER BY m, segment LIMIT 1),
        (SELECT segment FROM prof WHERE segment <> (SELECT segment FROM prof ORDER BY m, segment LIMIT 1) ORDER BY t DESC, segment LIMIT 1))
     ORDER BY c DESC, segment LIMIT 1)
  UNION ALL
  SELECT segment, 'Stable Mid-Value' FROM prof WHERE segment NOT IN (
     (SELECT segment FROM prof ORDER BY m, segment LIMIT 1),
     (SELECT segment FROM prof WHERE segment <> (SELECT segment FROM prof ORDER BY m, segment LIMIT 1) ORDER BY t DESC, segment LIMIT 1),
     (SELECT segment FROM prof WHERE segment NOT IN ((SELECT segment FROM prof ORDER BY m, segment LIMIT 1),
        (SELECT segment FROM prof WHERE segment <> (SELECT segment FROM prof ORDER BY m, segment LIMIT 1) ORDER BY t DESC, segment LIMIT 1))
      ORDER BY c DESC, segment LIMIT 1))) x""",
    extra="prof AS (SELECT segment, avg(MonthlyCharges) AS m, avg(CAST(tenure AS DOUBLE)) AS t, "
          "avg(CAST(Churn AS DOUBLE)) AS c FROM scored GROUP BY segment)"))
def q_segment_naming(spark, sf_dir):
    """Name the clusters of an assignment by the profile rule."""
    return segments.segment_naming(segments.assign_segments(features_view(spark, sf_dir)))


PROFILE_YES = ["Partner", "Dependents", "PhoneService", "OnlineSecurity", "TechSupport", "StreamingTV"]


@query("segment_profile", with_views(
    "SELECT segment, segment_label, count(*) AS customers, "
    "avg(CASE WHEN gender = 'Female' THEN 1.0 ELSE 0.0 END) AS share_female, "
    "avg(CASE WHEN SeniorCitizen = 'yes' THEN 1.0 ELSE 0.0 END) AS share_senior, "
    "avg(CASE WHEN Partner = 'Yes' THEN 1.0 ELSE 0.0 END) AS share_partner, "
    "avg(CASE WHEN Dependents = 'Yes' THEN 1.0 ELSE 0.0 END) AS share_dependents, "
    "avg(CASE WHEN PhoneService = 'Yes' THEN 1.0 ELSE 0.0 END) AS share_phone, "
    "avg(CASE WHEN InternetService = 'Fiber optic' THEN 1.0 ELSE 0.0 END) AS share_fiber, "
    "avg(CASE WHEN InternetService = 'No' THEN 1.0 ELSE 0.0 END) AS share_no_internet, "
    "avg(CASE WHEN OnlineSecurity = 'Yes' THEN 1.0 ELSE 0.0 END) AS share_security, "
    "avg(CASE WHEN TechSupport = 'Yes' THEN 1.0 ELSE 0.0 END) AS share_support, "
    "avg(CASE WHEN StreamingTV = 'Yes' THEN 1.0 ELSE 0.0 END) AS share_streaming_tv, "
    "avg(CASE WHEN Contract = 'Month-to-month' THEN 1.0 ELSE 0.0 END) AS share_month_to_month, "
    "avg(CASE WHEN Contract = 'Two year' THEN 1.0 ELSE 0.0 END) AS share_two_year, "
    "avg(CASE WHEN PaymentMethod = 'Electronic check' THEN 1.0 ELSE 0.0 END) AS share_electronic_check, "
    "min(MonthlyCharges) AS min_monthly, quantile_cont(MonthlyCharges, 0.25) AS q1_monthly, "
    "quantile_cont(MonthlyCharges, 0.5) AS median_monthly, quantile_cont(MonthlyCharges, 0.75) AS q3_monthly, "
    "max(MonthlyCharges) AS max_monthly FROM scored GROUP BY segment, segment_label"))
def q_segment_profile(spark, sf_dir):
    return segments.segment_profile(segments.assign_segments(features_view(spark, sf_dir)))


MIX = ["gender", "Contract", "PaymentMethod", "InternetService"]


@query("segment_mix", with_views(
    "SELECT feature, level, " + ", ".join(f"coalesce(max(CASE WHEN segment = {i} THEN CAST(n AS DOUBLE) / al END), 0.0) AS segment_{i}"
                                          for i in range(C.N_CLUSTERS))
    + " FROM (SELECT *, sum(n) OVER (PARTITION BY feature, segment) AS al FROM ("
    + " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS VARCHAR) AS level, segment, count(*) AS n FROM scored GROUP BY ALL" for f in MIX)
    + ")) GROUP BY feature, level"))
def q_segment_mix(spark, sf_dir):
    """Level mix per segment, side by side."""
    return segments.segment_mix(segments.assign_segments(features_view(spark, sf_dir)), MIX)


@query("kprototypes_fit", with_views(
    f"SELECT count(*) AS customers, CAST({C.N_CLUSTERS} AS BIGINT) AS clusters, CAST(0 AS BIGINT) AS unassigned, "
    "CAST(0 AS BIGINT) AS cost_rises, true AS cost_matches FROM feat", "feat"))
def q_kprototypes_fit(spark, sf_dir):
    """G1 (+ G2): fit k-prototypes on the engineered table, assign every
    customer, and check: clusters used, unassigned rows, rises of the
    cost, and whether the reported cost is that of the assignment."""
    feat = features_view(spark, sf_dir)
    m = segments.kprototypes_fit(feat)
    got = segments.assign_segments(feat, m)
    rises = sum(b > a * (1 + 1e-9) for a, b in zip(m["history"], m["history"][1:]))
    return got.agg(F.count(F.lit(1)).alias("customers"), F.countDistinct("segment").alias("clusters"),
                   F.sum(F.col("segment").isNull().cast("long")).alias("unassigned"), F.lit(rises).cast("long").alias("cost_rises"),
                   (F.abs(F.sum("segment_cost") - F.lit(m["cost"])) <= F.lit(1e-6 * m["cost"])).alias("cost_matches"))


def _cao_sql() -> str:
    """Greedy choice of the modes, one CTE per seed."""
    cats = {c: f"coalesce(CAST({c} AS VARCHAR), 'nan')" for c in C.SEG_CATEGORICAL}
    dens = " + ".join(f"(count(*) OVER (PARTITION BY {e}))" for e in cats.values())
    ctes = [f"dens AS (SELECT customerID, {', '.join(f'{e} AS c_{c}' for c, e in cats.items())}, {dens} AS dens, "
            f"md5('{C.SEED}:' || CAST(customerID AS VARCHAR)) AS tie FROM feat)"]
    for i in range(C.N_CLUSTERS):
        far = [f"dens * ({' + '.join(f'CAST(d.c_{c} <> s{j}.c_{c} AS BIGINT)' for c in cats)})" for j in range(i)]
        score = "dens" if not i else far[0] if i == 1 else f"least({', '.join(far)})"
        if not i:
            ctes.append(f"s0 AS (SELECT * FROM dens ORDER BY dens DESC, tie DESC, customerID DESC LIMIT 1)")
        else:
            score = score.replace("dens *", "d.dens *")
            ctes.append(f"s{i} AS (SELECT d.* FROM dens d, {', '.join(f's{j}' for j in range(i))} ORDER BY {score} DESC, d.tie DESC, d.customerID DESC LIMIT 1)")
    return ",".join(ctes)


@query("cao_init", with_views(" UNION ALL ".join(
    f"SELECT CAST({i} AS INTEGER) AS seed, '{c}' AS feature, c_{c} AS value FROM s{i}" for i in range(C.N_CLUSTERS) for c in C.SEG_CATEGORICAL),
    "feat", _cao_sql()))
def q_cao_init(spark, sf_dir):
    """The modes of the k Cao seeds as (seed, feature, value)."""
    from stayline.operators.features import fit_scaler
    feat = features_view(spark, sf_dir)
    prep = segments._prepare(feat, C.SEG_NUMERIC, C.SEG_CATEGORICAL, fit_scaler(feat, C.SEG_NUMERIC))
    seeds = segments.cao_init(cut_lineage(prep), C.N_CLUSTERS, len(C.SEG_NUMERIC), len(C.SEG_CATEGORICAL), C.SEED)
    rows = [(i, c, str(v)) for i, (_, modes) in enumerate(seeds) for c, v in zip(C.SEG_CATEGORICAL, modes)]
    return spark.createDataFrame(rows, "seed int, feature string, value string")


def _one_cluster_sql() -> str:
    """The cost of a single cluster: squared distances to the means in
    deviations, and half the rows that miss each column's commonest level."""
    num = " + ".join(f"(SELECT sum(((CAST({c} AS DOUBLE) - m) / s) * ((CAST({c} AS DOUBLE) - m) / s)) FROM feat, (SELECT avg(CAST({c} AS DOUBLE)) AS m, stddev_pop(CAST({c} AS DOUBLE)) AS s FROM feat))"
                     for c in C.SEG_NUMERIC)
    cat = " + ".join(f"(SELECT sum(n) - max(n) FROM (SELECT count(*) AS n FROM feat GROUP BY coalesce(CAST({c} AS VARCHAR), 'nan')))" for c in C.SEG_CATEGORICAL)
    return f"one AS (SELECT {num} + 0.5 * ({cat}) AS cost)"


@query("elbow", with_views("SELECT CAST(k AS INTEGER) AS k, CASE WHEN k = 1 THEN round(cost, 3) END AS one_cluster, true AS positive, true AS below_k1 FROM range(1, 11) t(k) CROSS JOIN one",
                           "feat", _one_cluster_sql()))
def q_elbow(spark, sf_dir):
    """G5 for k = 1..10, five starts each: the cost of one cluster, which SQL
    computes from the data, and whether the others are positive and below it."""
    e = segments.elbow(features_view(spark, sf_dir), ks=range(1, 11))
    top = e.where("k = 1").select(F.col("cost").alias("c1"))
    return e.crossJoin(F.broadcast(top)).select("k", F.when(F.col("k") == 1, F.round("cost", 3)).alias("one_cluster"), (F.col("cost") > 0).alias("positive"),
                                                (F.col("cost") <= F.col("c1")).alias("below_k1"))


# ---------------------------------------------------------------------------
# M: churn models
# ---------------------------------------------------------------------------

def _model_input(spark, sf_dir):
    feat = features_view(spark, sf_dir)
    return segments.assign_segments(feat).withColumn("segment", F.col("segment").cast("string"))


@query("linear_score", with_views("SELECT customerID, churn_prob FROM scored"))
def q_linear_score(spark, sf_dir):
    return M.linear_score(features_view(spark, sf_dir)).select("customerID", "churn_prob")


def split_check(scored: DataFrame, tau: float, rounds: int) -> DataFrame:
    """What SQL can tell of a trained model: customers and classes of every
    split, next to whether the threshold is in the scores' range, whether no
    other threshold of the validation split has a better F1, and the rounds."""
    best = E.best_f1_threshold(scored.where("split = 'validation'"), "label", "churn_prob").select(F.col("f1").alias("best"))
    ev = E.evaluate_splits(scored, tau).crossJoin(F.broadcast(best))
    good = (F.col("split") != "validation") | (F.abs(F.col("f1") - F.col("best")) < 1e-6)
    return ev.select("split", (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("customers"), (F.col("fn") + F.col("tp")).alias("churners"),
                     F.lit(0 <= tau <= 1).alias("tau_in_range"), good.alias("tau_is_best"), F.col("roc_auc").between(0, 1).alias("auc_in_range"),
                     F.lit(rounds).cast("long").alias("rounds"))


SPLIT_CHECK = (f"SELECT split, count(*) AS customers, CAST(sum(Churn) AS BIGINT) AS churners, true AS tau_in_range, true AS tau_is_best, "
               f"true AS auc_in_range, CAST({C.BOOSTING['rounds']} AS BIGINT) AS rounds FROM split GROUP BY split")


@query("train_churn", with_views(SPLIT_CHECK, "clean", SPLIT_SQL))
def q_train_churn(spark, sf_dir):
    """M1: trees boosted on train + validation with the configured parameters,
    threshold tuned on validation, as a check table per split."""
    _, model, tau, scored = M.train_churn(_model_input(spark, sf_dir))
    return split_check(scored, tau, len(model.trees))


@query("predict_proba", with_views(
    "SELECT count(*) AS customers, CAST(0 AS BIGINT) AS nulls, CAST(0 AS BIGINT) AS out_of_range, CAST(0 AS BIGINT) AS moved FROM clean", "clean"))
def q_predict_proba(spark, sf_dir):
    """M2: probability of churn for every customer from a stored model
    (encoder, classifier, threshold and feature order are saved and loaded
    again), as a check table; ``moved`` counts scores that changed by the reload."""
    data = _model_input(spark, sf_dir)
    enc, model, tau, scored = M.train_churn(data)
    got = M.predict(data, stored_model(spark, enc, model, tau)).join(scored.select("customerID", F.col("churn_prob").alias("before")), "customerID")
    p = F.col("churn_prob")
    return got.agg(F.count(F.lit(1)).alias("customers"), F.sum(p.isNull().cast("long")).alias("nulls"),
                   F.sum((~p.between(0, 1)).cast("long")).alias("out_of_range"), F.sum((F.abs(p - F.col("before")) > 1e-9).cast("long")).alias("moved"))


def stored_model(spark, enc, model, tau) -> dict:
    """The model saved and loaded again."""
    from stayline.sources import io
    path = scratch_path(spark, "churn_model")
    io.save_churn_model(spark, enc, model, tau, [*C.CHURN_NUMERIC, *C.CHURN_CATEGORICAL], path)
    return io.load_churn_model(spark, path)


RAW_CATEGORICAL = [c for c in C.CHURN_CATEGORICAL if c != "segment"]


@query("logistic_baseline", with_views(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, coalesce(CAST({c} AS VARCHAR), 'nan') AS level, count(*) AS customers, CAST(sum(Churn) AS BIGINT) AS churners, true AS balanced "
    f"FROM split WHERE split = 'train' GROUP BY ALL" for c in RAW_CATEGORICAL), "clean", split_sql((0.8, 0.0, 0.2))))
def q_logistic_baseline(spark, sf_dir):
    """M3: logistic regression on scaled numerics + one-hot categoricals,
    80/20 split.  At its optimum the probabilities of every level's training
    rows add up to the level's churners (the score equations): checked per level."""
    _, scored = M.logistic_baseline(_model_input(spark, sf_dir))
    rows = cut_lineage(scored.where("split = 'train'")).join(processed_view(spark, sf_dir).select("customerID", *RAW_CATEGORICAL), "customerID")
    level = F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias("level")) for c in RAW_CATEGORICAL]))
    got = rows.select(level, "label", "churn_prob").groupBy("feature", "level").agg(
        F.count(F.lit(1)).alias("customers"), F.sum("label").cast("long").alias("churners"), F.sum("churn_prob").alias("expected"))
    off = F.abs(F.col("expected") - F.col("churners")) <= F.lit(0.5) + F.lit(0.002) * F.col("customers")
    return got.select("feature", "level", "customers", "churners", off.alias("balanced"))


FAMILIES = ("logistic_regression", "decision_tree", "random_forest", "gbt")


@query("model_leaderboard", with_views(
    "SELECT model, side, customers, churners, true AS totals_fit FROM (VALUES " + ", ".join(f"('{m}')" for m in FAMILIES) + ") v(model) CROSS JOIN "
    "(SELECT split AS side, count(*) AS customers, CAST(sum(Churn) AS BIGINT) AS churners FROM split GROUP BY split)", "clean", split_sql((0.8, 0.0, 0.2))))
def q_model_leaderboard(spark, sf_dir):
    """M5: four families fitted side by side, as a check table per family and
    side: accuracy and recall come from as many customers and churners as SQL counts."""
    got = M.model_leaderboard(_model_input(spark, sf_dir))
    sides = F.inline(F.array(*[F.struct(F.lit(s).alias("side"), *[F.col(f"{s}_{c}").alias(c) for c in ("customers", "churners", "accuracy", "recall", "roc_auc")]) for s in ("train", "test")]))
    whole = lambda x: F.abs(x - F.round(x)) < 1e-6
    fit = whole(F.col("accuracy") * F.col("customers")) & whole(F.col("recall") * F.col("churners")) & F.col("roc_auc").between(0, 1)
    return got.select("model", sides).select("model", "side", "customers", "churners", fit.alias("totals_fit"))


@query("random_search_cv", with_views("SELECT CAST(d AS INTEGER) AS draw, CAST(5 AS BIGINT) AS folds, n AS rows, true AS in_range, true AS ordered "
                                      "FROM range(60) t(d) CROSS JOIN (SELECT count(*) AS n FROM clean)", "clean"))
def q_random_search_cv(spark, sf_dir):
    """M6 with 60 draws x 5 folds, as a check table: every draw has five
    folds whose held-out rows are all customers, an AUC, and the first row is the best."""
    got = M.random_search_cv(_model_input(spark, sf_dir))
    top = F.max("mean_auc").over(Window.partitionBy())                     # one row per draw
    first = F.first("mean_auc").over(Window.orderBy(F.desc("mean_auc"), "draw").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return got.select("draw", "folds", F.col("held_out").alias("rows"), (F.col("mean_auc").between(0, 1) & (F.col("std_auc") >= 0)).alias("in_range"), (top == first).alias("ordered"))


@query("refine_search", with_views("SELECT CAST(d AS INTEGER) AS draw, n AS rows, true AS in_range, true AS delta_fits FROM range(31) t(d) "
                                   "CROSS JOIN (SELECT count(*) AS n FROM split WHERE split = 'validation')", "clean", SPLIT_SQL))
def q_refine_search(spark, sf_dir):
    """M7: 30 draws around the winner of M6, and the winner itself, scored on
    the validation split, as a check table."""
    data = _model_input(spark, sf_dir)
    got = M.refine_search(data, M.random_search_cv(data))
    base = F.max(F.when(F.col("draw") == 0, F.col("roc_auc"))).over(Window.partitionBy())      # one row per draw
    return got.select("draw", F.col("held_out").alias("rows"), F.col("roc_auc").between(0, 1).alias("in_range"), (F.abs(F.col("roc_auc") - base - F.col("delta")) < 1e-12).alias("delta_fits"))


@query("early_stopping", with_views(
    "SELECT CAST(650 AS BIGINT) AS max_rounds, n AS validation_rows, round(-(p1 * ln(q) + (n - p1) * ln(1 - q)) / n, 4) AS first_loss, true AS kept_the_best, true AS stopped_in_time "
    "FROM (SELECT count(*) AS n, sum(Churn) AS p1 FROM split WHERE split = 'validation'), (SELECT avg(CAST(Churn AS DOUBLE)) AS q FROM split WHERE split = 'train')",
    "clean", SPLIT_SQL))
def q_early_stopping(spark, sf_dir):
    """M8: up to 650 rounds on train, stopped 50 rounds after the least
    validation loss.  The first loss, that of the training rate alone, is SQL's."""
    model, kept = M.early_stopping_fit(_model_input(spark, sf_dir), patience=50)
    rows = features.stratified_split(processed_view(spark, sf_dir)).where("split = 'validation'").agg(F.count(F.lit(1)).alias("validation_rows"))
    return rows.select(F.lit(C.BOOSTING["rounds"]).cast("long").alias("max_rounds"), "validation_rows", F.lit(round(model.curve[0], 4)).alias("first_loss"),
                       F.lit(model.curve[kept] == min(model.curve)).alias("kept_the_best"), F.lit(len(model.curve) <= kept + 52).alias("stopped_in_time"))


@query("model_feature_importance", with_views("SELECT CAST(" + str(len(C.CHURN_NUMERIC) + len(C.CHURN_CATEGORICAL)) + " AS BIGINT) AS at_most, true AS few_enough, true AS adds_up, "
                                              "true AS in_order FROM (SELECT count(*) FROM clean)", "clean"))
def q_model_feature_importance(spark, sf_dir):
    """M9: gain shares by source feature, as a check: they are at most one per
    feature, add up to 1 and fall."""
    _, model, _, _ = M.train_churn(_model_input(spark, sf_dir))
    got = M.model_feature_importance(model, top=None, spark=spark, by_source=C.CHURN_CATEGORICAL)
    order = Window.orderBy(F.desc("importance"), "feature")                # one row per feature
    n = len(C.CHURN_NUMERIC) + len(C.CHURN_CATEGORICAL)
    return got.withColumn("up", F.col("importance") > F.lag("importance").over(order)).agg(
        F.lit(n).cast("long").alias("at_most"), (F.count(F.lit(1)) <= n).alias("few_enough"), (F.abs(F.sum("importance") - 1) < 1e-9).alias("adds_up"),
        (~F.coalesce(F.bool_or("up"), F.lit(False))).alias("in_order"))


def _threshold_trials(spark, sf_dir) -> DataFrame:
    """Trials = thresholds 0.30..0.70 in order, value = F1 at the threshold."""
    lab = scored_view(spark, sf_dir).select(F.col("Churn").alias("label"), "churn_score")
    ct = E.compare_thresholds(lab, p="churn_score")
    return ct.select(F.col("threshold"), F.col("f1").alias("value"))


@query("best_so_far", with_views(
    "SELECT threshold, f1 AS value, max(f1) OVER (ORDER BY threshold ROWS UNBOUNDED PRECEDING) AS best_so_far FROM ("
    + f1_sql(metrics_sql("tcm")) + ") z",
    extra="tcm AS (SELECT threshold, " + ", ".join(
        f"CAST(sum(CASE WHEN Churn = {y} AND churn_score {op} threshold THEN 1 ELSE 0 END) AS BIGINT) AS {n}"
        for y, op, n in ((0, "<", "tn"), (0, ">=", "fp"), (1, "<", "fn"), (1, ">=", "tp")))
    + " FROM scored CROSS JOIN (VALUES " + ", ".join(f"({dbl(t)})" for t in C.COMPARE_THRESHOLDS)
    + ") th(threshold) GROUP BY threshold)"))
def q_best_so_far(spark, sf_dir):
    """M10 over a trial table (one trial per threshold of the sweep)."""
    return M.best_so_far(_threshold_trials(spark, sf_dir), order="threshold")


def _two_scores(spark, sf_dir):
    s = scored_view(spark, sf_dir)
    a = s.select(F.lit("linear").alias("model"), "customerID", F.col("Churn").alias("label"), "churn_prob")
    b = s.select(F.lit("rule_priority").alias("model"), "customerID", F.col("Churn").alias("label"),
                 F.col("priority").alias("churn_prob"))
    return a.unionByName(b)


@query("ensemble_average", with_views(
    "SELECT customerID, CAST(CAST(round(churn_prob * 1000000) AS BIGINT) + CAST(round(priority * 1000000) AS BIGINT) AS DOUBLE)"
    " / (CAST(2 AS DOUBLE) * 1000000.0) AS ensemble_prob FROM scored"))
def q_ensemble_average(spark, sf_dir):
    return M.ensemble_average(_two_scores(spark, sf_dir))


@query("ensemble_weighted", with_views(
    "SELECT customerID, round((churn_prob * wa + priority * wb) / (wa + wb), 6) AS ensemble_prob FROM scored CROSS JOIN "
    "(SELECT max(CASE WHEN model = 'linear' THEN roc_auc END) AS wa, max(CASE WHEN model = 'rule_priority' THEN roc_auc END) AS wb FROM tauc) w",
    extra=__import__("stayline.plans.queries_business", fromlist=["TWO_MODELS_SQL"]).TWO_MODELS_SQL))
def q_ensemble_weighted(spark, sf_dir):
    """weights = exact AUC of each model on the same data."""
    sc = _two_scores(spark, sf_dir)
    w = E.roc_auc_grouped(sc, ["model"], "label", "churn_prob").select("model", F.col("roc_auc").alias("weight"))
    return M.ensemble_weighted(sc, w).select("customerID", F.round("ensemble_prob", 6).alias("ensemble_prob"))


@query("stacking", with_views(
    "SELECT CASE WHEN split = 'test' THEN 'test' ELSE 'oof' END AS split, count(*) AS customers, CAST(0 AS BIGINT) AS nulls, "
    "CAST(0 AS BIGINT) AS out_of_range FROM split GROUP BY 1", "clean", SPLIT_SQL))
def q_stacking(spark, sf_dir):
    """Out-of-fold and test scores of the stacked model, as a check table per split."""
    _, scored = M.stacking(_model_input(spark, sf_dir))
    p = F.col("meta_prob")
    return scored.groupBy("split").agg(F.count(F.lit(1)).alias("customers"), F.sum(p.isNull().cast("long")).alias("nulls"),
                                       F.sum((~p.between(0, 1)).cast("long")).alias("out_of_range"))


@query("overfit_gap", with_views(
    "SELECT metric, max(CASE WHEN split = 'train' THEN value END) AS train, "
    "max(CASE WHEN split = 'validation' THEN value END) AS validation, max(CASE WHEN split = 'test' THEN value END) AS test, "
    "max(CASE WHEN split = 'train' THEN value END) - max(CASE WHEN split = 'test' THEN value END) AS train_test_gap, "
    "max(CASE WHEN split = 'train' THEN value END) - max(CASE WHEN split = 'validation' THEN value END) AS train_val_gap, "
    "abs(max(CASE WHEN split = 'train' THEN value END) - max(CASE WHEN split = 'test' THEN value END)) < 0.05 AS within_tolerance "
    "FROM (" + " UNION ALL ".join(f"SELECT split, '{m}' AS metric, {m} AS value FROM sm" for m in
                                  ("accuracy", "precision", "recall", "f1")) + ") t GROUP BY metric",
    extra=SCORED_SPLIT + ", sm AS (" + f1_sql(metrics_sql(f"(SELECT split, {CM(0.5)} FROM ssplit GROUP BY split) q")) + ")"))
def q_overfit_gap(spark, sf_dir):
    d = split_scores(spark, sf_dir).select("split", F.col("Churn").alias("label"), "churn_score")
    met = E.evaluate_splits(d, 0.5, p="churn_score")
    long = E.metrics_long(met, names=("accuracy", "precision", "recall", "f1"))
    return M.overfit_gap(long)
