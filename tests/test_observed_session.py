"""Scores of models that keep a training summary, in a session where something was observed."""

from __future__ import annotations

import pytest
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.sql import Observation
from pyspark.sql import functions as F

from stayline.operators import model as M

COLS = {"numeric": ["x"], "categorical": ["g"]}


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(120).select(F.col("id").alias("customerID"), (F.col("id") * 37 % 11).cast("double").alias("x"),
                                 F.concat(F.lit("g"), (F.col("id") % 3).cast("string")).alias("g"), (F.col("id") * 7 % 10 < 4).cast("int").alias("Churn"))
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 120
    return df


def test_logistic_baseline_scores_in_an_observed_session(rows):
    model, scored = M.logistic_baseline(rows, **COLS)
    got = scored.toPandas()
    assert len(got) == 120 and got["churn_prob"].between(0, 1).all()
    assert model.stages[-1].hasSummary                                      # the caller's model is whole
    train = got[got["split"] == "train"]
    assert abs(train["churn_prob"].sum() - train["label"].sum()) < 1e-3     # the score equation of the intercept


def test_leaderboard_scores_in_an_observed_session(rows):
    families = {"lr": LogisticRegression(labelCol="label", featuresCol="features", maxIter=5),
                "rf": RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=2, maxDepth=2, seed=1)}
    got = M.model_leaderboard(rows, **COLS, families=families).collect()
    assert {r["model"] for r in got} == {"lr", "rf"}
    assert all(r["train_customers"] + r["test_customers"] == 120 for r in got)


def test_stacking_scores_in_an_observed_session(rows):
    bases = {"rf": RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=2, maxDepth=2, seed=1),
             "lr": LogisticRegression(labelCol="label", featuresCol="features", maxIter=5)}
    meta, scored = M.stacking(rows, k=2, **COLS, bases=bases)
    got = scored.toPandas()
    assert sorted(got["customerID"]) == list(range(120)) and set(got["split"]) == {"oof", "test"}
    assert got["meta_prob"].between(0, 1).all() and meta.hasSummary
