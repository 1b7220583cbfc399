"""Churn models.

* ``linear_score`` (M4) is column arithmetic over literal coefficients.
* ``train_churn`` (M1) encodes with Spark ML (StringIndexer -> OneHotEncoder ->
  VectorAssembler, fitted on train only) and boosts trees on train +
  validation in stages (``operators.boosting``); a run that was lost goes on
  from its last stage, and equal runs find the finished model.
* The searches (M6, M7) bin the training table once and fit all draws and folds
  over the same blocks.
* Leaderboard and stacking fit Spark ML estimators side by side over one
  written table; the driver only holds parameters and metrics.
"""

from __future__ import annotations

import hashlib
import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import reduce
from typing import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier,
                                       LogisticRegression, RandomForestClassifier)
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayline import config as C
from stayline.operators import boosting as B


# ---------------------------------------------------------------------------
# M4 linear score (the deployed deterministic model)
# ---------------------------------------------------------------------------

def linear_design() -> dict:
    """Design columns of the linear churn score as native expressions."""
    return {
        "tenure": F.coalesce(F.col("tenure").cast("double"), F.lit(0.0)),
        "MonthlyCharges": F.coalesce(F.col("MonthlyCharges"), F.lit(0.0)),
        "contract_month_to_month": (F.col("Contract") == "Month-to-month").cast("double"),
        "contract_two_year": (F.col("Contract") == "Two year").cast("double"),
        "payment_electronic_check": (F.col("PaymentMethod") == "Electronic check").cast("double"),
        "fiber_optic": (F.col("InternetService") == "Fiber optic").cast("double"),
        "no_support_services": ((F.col("TechSupport") == "No") & (F.col("OnlineSecurity") == "No")).cast("double"),
        "month_to_month_paperless": ((F.col("Contract") == "Month-to-month") &
                                     (F.col("PaperlessBilling") == "Yes")).cast("double"),
        "is_isolated": ((F.col("Partner") == "No") & (F.col("Dependents") == "No")).cast("double"),
        "senior": (F.col("SeniorCitizen") == "yes").cast("double"),
    }


def linear_margin(intercept: float = C.LINEAR_INTERCEPT, weights=C.LINEAR_WEIGHTS) -> F.Column:
    design = linear_design()
    z = F.lit(float(intercept))
    for name, w in weights:
        z = z + F.coalesce(design[name], F.lit(0.0)) * F.lit(float(w))
    return z


def linear_score(df: DataFrame, intercept: float = C.LINEAR_INTERCEPT, weights=C.LINEAR_WEIGHTS,
                 name: str = "churn_prob") -> DataFrame:
    """M4: ``churn_margin`` (z) and ``churn_score`` = 1 / (1 + exp(-z)) at
    full precision, which all decisions use, and ``churn_prob``, the score
    as reported (6 decimals)."""
    z = linear_margin(intercept, weights)
    out = df.withColumn("churn_margin", z)
    out = out.withColumn("churn_score", probability(F.col("churn_margin")))
    return out.withColumn(name, F.round("churn_score", 6))


def probability(margin: F.Column) -> F.Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def design_columns(df: DataFrame, prefix: str = "x_") -> DataFrame:
    """The linear design as columns (used by linear SHAP)."""
    return df.withColumns({f"{prefix}{k}": F.coalesce(v, F.lit(0.0)) for k, v in linear_design().items()})


# ---------------------------------------------------------------------------
# M1-M3 Spark ML models
# ---------------------------------------------------------------------------

def encoder_stages(numeric: Sequence[str], categorical: Sequence[str], handle_invalid: str = "error"):
    """Drop-first one-hot: indices in descending alphabetical order so the
    alphabetically first level gets the last index, which dropLast removes."""
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}__idx", stringOrderType="alphabetDesc",
                         handleInvalid=handle_invalid) for c in categorical]
    ohe = OneHotEncoder(inputCols=[f"{c}__idx" for c in categorical],
                        outputCols=[f"{c}__ohe" for c in categorical], dropLast=True,
                        handleInvalid="error" if handle_invalid == "error" else "keep")
    asm = VectorAssembler(inputCols=list(numeric) + [f"{c}__ohe" for c in categorical],
                          outputCol="features", handleInvalid="keep")
    return idx + [ohe, asm]


def prepare_model_input(df: DataFrame, numeric=C.CHURN_NUMERIC, categorical=C.CHURN_CATEGORICAL,
                        label: str = "Churn") -> DataFrame:
    """Cast categoricals to string ('nan' for missing) and numerics to double."""
    cols = {c: F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in categorical if c in df.columns}
    cols.update({c: F.col(c).cast("double") for c in numeric})
    if label in df.columns:
        cols["label"] = F.col(label).cast("double")
    return df.withColumns(cols)


def training_input(*args) -> DataFrame:
    """``prepare_model_input`` written once: indexers, fits and scoring read it
    many times, so the split and the features must not be computed again."""
    from stayline.session import cut_lineage
    return cut_lineage(prepare_model_input(*args))


def positive_probability(df: DataFrame, name: str = "churn_prob") -> DataFrame:
    """M2: P(class 1) from the probability vector."""
    return df.withColumn(name, vector_to_array("probability")[1])


def without_summary(model, spark):
    """The fitted model for scoring: one that keeps a training summary is
    stored and loaded again without it.  A summary holds the session, which no
    task can carry once anything was observed (``DataFrame.observe``) in it."""
    if isinstance(model, PipelineModel):
        return PipelineModel([without_summary(m, spark) for m in model.stages])
    if not getattr(model, "hasSummary", False):
        return model
    from stayline.session import scratch_path
    path = scratch_path(spark, "fitted")
    model.write().session(spark).save(path)
    return type(model).read().session(spark).load(path)


def model_path(spark, blocks: DataFrame, specs: Sequence[B.Spec]) -> str:
    """The folder of the runs over these rows with these parameters."""
    from stayline.session import ensure_checkpoint_dir
    key = hashlib.sha256((B.fingerprint(blocks) + repr(list(specs))).encode()).hexdigest()[:32]
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stayline-models/{key}"


def boosting_input(data: DataFrame, fit_on: str, part: str, numeric: Sequence[str], categorical: Sequence[str], weight: str | None = None):
    """Encoder fitted on the rows where ``fit_on`` holds, feature names, cut
    points of the rows that are learnt from, and the training blocks."""
    enc = Pipeline(stages=encoder_stages(numeric, categorical)).fit(data.where(fit_on))
    encoded = enc.transform(data)
    names = vector_slot_names(encoded)
    cuts = B.cut_points(data.where(fit_on), names, numeric)
    return enc, names, cuts, B.training_blocks(encoded, part, weight=weight, cuts=cuts)


def train_churn(df: DataFrame, numeric=C.CHURN_NUMERIC, categorical=C.CHURN_CATEGORICAL,
                label: str = "Churn", pos_weight: float = C.POS_WEIGHT, tune_on: str = "validation",
                path: str | None = None, **params):
    """M1: split -> encode (fit on train) -> boosted trees on train+val -> tau -> metrics.

    Returns (encoder PipelineModel, ``Boosted`` model, tau, scored frame with
    ``split``, ``label``, ``churn_prob``) - the scored frame feeds E9.
    ``params`` override the configured ones (``C.BOOSTING``).
    """
    from stayline.operators.evaluate import best_f1_threshold_value
    from stayline.operators.features import stratified_split
    data = training_input(stratified_split(df, label=label), numeric, categorical, label)
    data = data.withColumns({"weight": F.when(F.col("label") == 1, F.lit(float(pos_weight))).otherwise(F.lit(1.0)),
                             "part": F.expr(_part_code(C.SPLIT_NAMES))})
    enc, names, cuts, blocks = boosting_input(data, "split = 'train'", "part", numeric, categorical, "weight")
    spec = B.Spec(train=(0, 1), **{**C.BOOSTING, **params})
    model, = B.boost(blocks, names, cuts, [spec], path or model_path(df.sparkSession, blocks, [spec]))
    scored = B.block_scores(blocks, [model]).select("customerID", F.element_at(F.array(*[F.lit(n) for n in C.SPLIT_NAMES]), F.col("part") + 1).alias("split"), "label", "churn_prob")
    tau = best_f1_threshold_value(scored.filter(F.col("split") == tune_on), "label", "churn_prob")
    return enc, model, tau, scored


def _part_code(names: Sequence[str], c: str = "split") -> str:
    return "CASE " + " ".join(f"WHEN {c} = '{n}' THEN {i}" for i, n in enumerate(names)) + " END"


def score_with_model(df: DataFrame, model: dict, name: str = "churn_score") -> DataFrame:
    """Engineered rows (with ``segment``) with a stored model's probability in
    ``name``, its log-odds in ``churn_margin`` and the reported ``churn_prob``."""
    kept = df.columns
    data = model["encoder"].transform(prepare_model_input(df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row"), *model["features"])))
    data = B.with_margin(data, model["classifier"], name="__margin")
    out = data.select(*[F.col(f"__row.`{c}`") for c in kept if c not in (name, "churn_margin", "churn_prob")], F.col("__margin").alias("churn_margin"))
    return out.withColumn(name, probability(F.col("churn_margin"))).withColumn("churn_prob", F.round(name, 6) if name != "churn_prob" else F.col(name))


def predict(df: DataFrame, model: dict) -> DataFrame:
    """M2 with a stored model (``sources.io.load_churn_model``): probability
    and decision of every row."""
    out = score_with_model(df, model, "churn_prob").withColumn("is_churner", F.col("churn_prob") >= model["tau"])
    return out.select("customerID", "churn_prob", "is_churner")


def logistic_baseline(df: DataFrame, numeric=C.CHURN_NUMERIC, categorical=C.CHURN_CATEGORICAL,
                      label: str = "Churn", reg: float = 0.0):
    """M3: population-scaled numerics + drop-first one-hot -> logistic regression.
    Returns (pipeline model, scored frame)."""
    from stayline.operators.features import fit_scaler, standard_scale, stratified_split
    data = training_input(stratified_split(df, label=label, fractions=(0.8, 0.0, 0.2)),
                               numeric, categorical, label)
    stats = fit_scaler(data.filter("split = 'train'"), numeric)
    data = standard_scale(data, stats)
    pipe = Pipeline(stages=encoder_stages(numeric, categorical) +
                    [LogisticRegression(labelCol="label", featuresCol="features", regParam=reg, maxIter=100)])
    model = pipe.fit(data.filter("split = 'train'"))
    scored = positive_probability(without_summary(model, df.sparkSession).transform(data)).select(
        *[c for c in ("customerID",) if c in df.columns], "split", "label", "churn_prob")
    return model, scored


def model_families(seed: int = C.SEED) -> dict:
    return {
        "logistic_regression": LogisticRegression(labelCol="label", featuresCol="features", maxIter=100),
        "decision_tree": DecisionTreeClassifier(labelCol="label", featuresCol="features", maxDepth=5, seed=seed),
        "random_forest": RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=50,
                                                maxDepth=6, seed=seed),
        "gbt": GBTClassifier(labelCol="label", featuresCol="features", maxIter=30, maxDepth=4, seed=seed),
    }


def model_leaderboard(df: DataFrame, numeric=C.CHURN_NUMERIC, categorical=C.CHURN_CATEGORICAL,
                      label: str = "Churn", families: dict | None = None) -> DataFrame:
    """M5: fit each family on train, side by side; one row per family with its
    train and test metrics, by test recall, then AUC.  Scored frames of all
    families are unioned and evaluated in one grouped aggregation."""
    from stayline.session import cut_lineage
    from stayline.operators.evaluate import evaluate_grouped
    from stayline.operators.features import stratified_split
    data = training_input(stratified_split(df, label=label, fractions=(0.8, 0.0, 0.2)),
                               numeric, categorical, label)
    enc = Pipeline(stages=encoder_stages(numeric, categorical)).fit(data.filter("split = 'train'"))
    data = cut_lineage(enc.transform(data).select("customerID", "split", "label", "features"))
    families = families or model_families()

    def score(name: str) -> DataFrame:
        model = without_summary(families[name].fit(data.filter("split = 'train'")), df.sparkSession)
        return positive_probability(model.transform(data)).select(F.lit(name).alias("model"), "split", "label", "churn_prob")

    with ThreadPoolExecutor(len(families)) as pool:
        scored = list(pool.map(score, families))
    allsc = reduce(DataFrame.unionByName, scored)
    metrics = evaluate_grouped(allsc.withColumn("pred", (F.col("churn_prob") >= 0.5).cast("int")),
                               ["model", "split"], "label", "pred", "churn_prob")
    metrics = metrics.withColumns({"customers": F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"), "churners": F.col("fn") + F.col("tp")})
    names = ("accuracy", "precision", "recall", "f1", "roc_auc", "customers", "churners")
    side = lambda s: metrics.where(F.col("split") == s).select("model", *[F.col(c).alias(f"{s}_{c}") for c in names])
    return side("train").join(side("test"), "model").orderBy(F.desc("test_recall"), F.desc("test_roc_auc"), "model")


SPACE = {"depth": [2, 3, 4, 5], "rate": [0.05, 0.1, 0.2], "rounds": [10, 20, 30], "rows": [0.6, 0.8, 1.0]}


def random_search_cv(df: DataFrame, n_iter: int = 60, k: int = 5, seed: int = C.SEED,
                     numeric=C.CHURN_NUMERIC, categorical=C.CHURN_CATEGORICAL, label: str = "Churn",
                     space: dict | None = None, parallelism: int = 8) -> DataFrame:
    """M6: seeded random parameter draws x stratified k folds -> mean AUC.

    The table is encoded and binned once; all draws x folds are fitted over
    the same blocks, in batches side by side.  Returns one row per draw with its
    parameters, mean and deviation of the fold AUCs and held-out rows, best first.
    """
    from stayline.operators.evaluate import roc_auc_of_counts
    from stayline.operators.features import stratified_kfold
    space = space or SPACE
    rng = random.Random(seed)
    draws = [{p: rng.choice(v) for p, v in space.items()} for _ in range(n_iter)]
    data = training_input(stratified_kfold(df, k=k, label=label), numeric, categorical, label)
    _, names, cuts, blocks = boosting_input(data, "true", "fold", numeric, categorical)
    pairs = [(i, f) for i in range(n_iter) for f in range(k)]
    specs = [B.Spec(train=tuple(x for x in range(k) if x != f), seed=seed, **draws[i]) for i, f in pairs]
    models = B.boost_batches(blocks, names, cuts, specs, parallelism=parallelism)
    counts, place = B.block_counts(blocks, models, [(f,) for _, f in pairs])
    by_model = roc_auc_of_counts(counts, ["model"], ["rows"]).withColumnRenamed("rows", "held_out")
    table = df.sparkSession.createDataFrame([(m, i, *[float(draws[i][p]) for p in space]) for m, (i, _) in zip(place, pairs)], "model int, draw int, " + ", ".join(f"{p} double" for p in space))
    return (by_model.join(F.broadcast(table), "model").groupBy("draw", *space)
            .agg(F.avg("roc_auc").alias("mean_auc"), F.coalesce(F.stddev_samp("roc_auc"), F.lit(0.0)).alias("std_auc"), F.count(F.lit(1)).alias("folds"), F.sum("held_out").alias("held_out"))
            .select("draw", "mean_auc", "std_auc", "folds", "held_out", *space).orderBy(F.desc("mean_auc"), "draw"))


def refine_search(df: DataFrame, phase1: DataFrame, n_iter: int = 30, seed: int = C.SEED,
                  numeric=C.CHURN_NUMERIC, categorical=C.CHURN_CATEGORICAL, label: str = "Churn", parallelism: int = 8) -> DataFrame:
    """M7: seeded draws in a narrowed range around the winner of phase 1
    (``random_search_cv``'s table), scored on the validation split next to the
    winner itself (draw 0); ``delta`` is the gain over the winner's score.  All
    draws are fitted side by side over the same blocks."""
    from stayline.operators.evaluate import roc_auc_of_counts
    from stayline.operators.features import stratified_split
    best = phase1.orderBy(F.desc("mean_auc"), "draw").first().asDict()
    best = {"depth": int(best.get("depth", 4)), "rate": float(best.get("rate", 0.1)), "rounds": int(best.get("rounds", 20))}
    rng = random.Random(seed + 1)
    draws = [best] + [{
        "depth": max(2, best["depth"] + rng.choice([-1, 0, 1])),
        "rate": best["rate"] * rng.choice([0.5, 0.75, 1.0, 1.5]),
        "rounds": max(5, best["rounds"] + rng.choice([-10, 0, 10])),
    } for _ in range(n_iter)]
    data = training_input(stratified_split(df, label=label), numeric, categorical, label).withColumn("part", F.expr(_part_code(C.SPLIT_NAMES)))
    _, names, cuts, blocks = boosting_input(data, "split = 'train'", "part", numeric, categorical)
    specs = [B.Spec(train=(0,), valid=(1,), seed=seed, **d) for d in draws]
    models = B.boost_batches(blocks, names, cuts, specs, parallelism=parallelism)
    counts, place = B.block_counts(blocks, models, [(1,)] * len(models))
    auc = roc_auc_of_counts(counts, ["model"], ["rows"]).withColumnRenamed("rows", "held_out")
    table = df.sparkSession.createDataFrame([(place[i], i, d["depth"], d["rate"], d["rounds"]) for i, d in enumerate(draws)], "model int, draw int, depth int, rate double, rounds int")
    out = auc.join(F.broadcast(table), "model")
    first = F.max(F.when(F.col("draw") == 0, F.col("roc_auc"))).over(Window.partitionBy())        # one row per draw
    return out.withColumn("delta", F.col("roc_auc") - first).select("draw", "roc_auc", "delta", "held_out", "depth", "rate", "rounds").orderBy(F.desc("roc_auc"), "draw")


def early_stopping_fit(df: DataFrame, numeric=C.CHURN_NUMERIC, categorical=C.CHURN_CATEGORICAL,
                       label: str = "Churn", patience: int = 50, **params):
    """M8: boosted trees on train, watched on the validation split: stopped
    ``patience`` rounds after the least validation loss, trees after it dropped.
    Returns (model, number of trees kept); ``model.curve[t]`` is the loss after t trees."""
    from stayline.operators.features import stratified_split
    data = training_input(stratified_split(df, label=label), numeric, categorical, label).withColumn("part", F.expr(_part_code(C.SPLIT_NAMES)))
    _, names, cuts, blocks = boosting_input(data, "split = 'train'", "part", numeric, categorical)
    spec = B.Spec(train=(0,), valid=(1,), patience=patience, **{**C.BOOSTING, **params})
    model, = B.boost(blocks, names, cuts, [spec], model_path(df.sparkSession, blocks, [spec]))
    return model, len(model.trees)


def source_feature(slot: str, categorical: Sequence[str]) -> str:
    """The table column behind an encoded slot (``Contract__ohe_One year``)."""
    return next((c for c in categorical if slot.startswith(f"{c}__ohe_")), slot)


def model_feature_importance(model: B.Boosted, top: int | None = 20, spark=None, by_source: Sequence[str] | None = None) -> DataFrame:
    """M9: share of the model's total gain per feature, top n; ``by_source``
    (the categorical columns) adds the slots of a column up."""
    shares = {}
    for name, v in model.importance().items():
        name = source_feature(name, by_source) if by_source else name
        shares[name] = shares.get(name, 0.0) + float(v)
    rows = sorted(shares.items(), key=lambda r: (-r[1], r[0]))[:top]
    return spark.createDataFrame(rows, "feature string, importance double")


def best_so_far(trials: DataFrame, order: str = "trial", value: str = "value") -> DataFrame:
    """Running maximum over trials (trial tables are small: one row
    per fitted model)."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return trials.withColumn("best_so_far", F.max(value).over(w))


def ensemble_average(scores: DataFrame, key: str = "customerID", model: str = "model",
                     p: str = "churn_prob") -> DataFrame:
    """Mean probability over models per key (long input); summed in
    exact 1e-6 units so the mean does not depend on summation order."""
    micro = F.round(F.col(p) * 1_000_000).cast("long")
    return scores.groupBy(key).agg(
        (F.sum(micro).cast("double") / (F.count(F.lit(1)).cast("double") * 1_000_000.0)).alias("ensemble_prob"))


def ensemble_weighted(scores: DataFrame, weights: DataFrame, key: str = "customerID",
                      model: str = "model", p: str = "churn_prob") -> DataFrame:
    """Weighted mean with per-model weights (e.g. CV AUC)."""
    j = scores.join(F.broadcast(weights), model)
    return j.groupBy(key).agg((F.sum(F.col(p) * F.col("weight")) / F.sum("weight")).alias("ensemble_prob"))


def stacking(df: DataFrame, k: int = 5, numeric=C.CHURN_NUMERIC, categorical=C.CHURN_CATEGORICAL,
             label: str = "Churn", reg: float = 0.01, seed: int = C.SEED, bases: dict | None = None, parallelism: int = 6):
    """Out-of-fold base probabilities on train + validation (k folds) ->
    logistic meta-learner; the base models, fitted again on all of it, and
    the meta-learner score the test split.  Returns (meta model, scored frame
    with ``split`` ('oof' or 'test'), label, p_<base> and meta_prob)."""
    from stayline.operators.features import stratified_kfold, stratified_split
    from stayline.session import cut_lineage
    data = training_input(stratified_split(df, label=label), numeric, categorical, label)
    enc = Pipeline(stages=encoder_stages(numeric, categorical)).fit(data.where("split <> 'test'"))
    data = enc.transform(data).select("customerID", "split", F.col(label).alias("__y"), "label", "features")
    rest = cut_lineage(stratified_kfold(data.where("split <> 'test'"), k=k, label="__y"))
    test = cut_lineage(data.where("split = 'test'"))
    bases = bases or {
        "gbt": GBTClassifier(labelCol="label", featuresCol="features", maxIter=20, maxDepth=3, seed=seed),
        "rf": RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=30, maxDepth=5, seed=seed),
        "lr": LogisticRegression(labelCol="label", featuresCol="features", maxIter=50)}

    def scores(est, train: DataFrame, on: DataFrame, name: str) -> DataFrame:
        return positive_probability(without_summary(est.fit(train), df.sparkSession).transform(on), f"p_{name}").select("customerID", "label", f"p_{name}")

    jobs = [(name, f) for name in bases for f in [*range(k), None]]      # all fits are independent

    def fit_and_score(job: tuple) -> DataFrame:
        name, f = job
        if f is None:
            return scores(bases[name], rest, test, name)
        return scores(bases[name], rest.where(F.col("fold") != f), rest.where(F.col("fold") == f), name)

    with ThreadPoolExecutor(parallelism) as pool:
        parts = dict(zip(jobs, pool.map(fit_and_score, jobs)))
    sides = {}
    for name in bases:
        for split, part in (("oof", reduce(DataFrame.unionByName, [parts[name, f] for f in range(k)])), ("test", parts[name, None])):
            sides[split] = part if split not in sides else sides[split].join(part.drop("label"), "customerID")
    both = reduce(DataFrame.unionByName, [d.withColumn("split", F.lit(s)) for s, d in sides.items()])
    both = VectorAssembler(inputCols=[f"p_{n}" for n in bases], outputCol="meta_features").transform(both)
    meta = LogisticRegression(labelCol="label", featuresCol="meta_features", regParam=reg).fit(both.where("split = 'oof'"))
    out = positive_probability(without_summary(meta, df.sparkSession).transform(both), "meta_prob").drop("meta_features", "rawPrediction", "probability", "prediction")
    return meta, out


def overfit_gap(metrics: DataFrame, metric_col: str = "value", tolerance: float = 0.05) -> DataFrame:
    """Train / validation / test side by side per metric, gaps and a
    flag when |train - test| < tolerance."""
    piv = metrics.groupBy("metric").pivot("split", ["train", "validation", "test"]).agg(F.first(metric_col))
    return (piv.withColumn("train_test_gap", F.col("train") - F.col("test"))
               .withColumn("train_val_gap", F.col("train") - F.col("validation"))
               .withColumn("within_tolerance", F.abs(F.col("train") - F.col("test")) < tolerance))


def vector_slot_names(df: DataFrame, vec: str = "features") -> list:
    """Slot names of an assembled vector, read from the column's ML
    attribute metadata (exact for any encoder settings)."""
    meta = df.schema[vec].metadata.get("ml_attr", {})
    n = int(meta.get("num_attrs", 0))
    names = [f"f{i}" for i in range(n)]
    for group in meta.get("attrs", {}).values():
        for a in group:
            names[int(a["idx"])] = a.get("name", names[int(a["idx"])])
    return names
