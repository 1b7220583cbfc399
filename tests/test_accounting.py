"""Appends of parallel writers, accounting while writing, scoring with a trained model."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from stayline import config as C
from stayline.plans import score
from stayline.sources import io
from stayline.sources.tables import customer_view
from tests.conftest import SF


def test_parallel_writers_get_different_ids_and_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "log")

    def write(i):
        run = spark.createDataFrame([(k, f"m{i}-{k}") for k in range(3)], "run_order int, model string")
        io.experiment_log(spark, path, run)

    with ThreadPoolExecutor(6) as pool:
        list(pool.map(write, range(6)))
    rows = io.read_appended(spark, path).collect()
    assert sorted(r.exp_no for r in rows) == list(range(1, 19))
    assert len({r.model for r in rows}) == 18 and {r.experiment_id for r in rows} == {f"exp_{n:03d}" for n in range(1, 19)}
    hist = str(tmp_path / "history")
    metrics = spark.createDataFrame([("train", "f1", 0.5)], "split string, metric string, value double")
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda i: io.metrics_history_append(metrics, hist, "2024-01-01 00:00:00", f"run {i}"), range(6)))
    assert {r.model_config for r in io.read_history(spark, hist).collect()} == {f"run {i}" for i in range(6)}


def test_accounting_equals_separate_aggregates(spark, tmp_path):
    raw = customer_view(spark, SF)
    status = score.score_and_account(raw, str(tmp_path / "out"))
    scored = score.score_batch(raw)
    assert spark.read.parquet(str(tmp_path / "out")).exceptAll(scored).count() == 0
    want = score.batch_summary(scored, raw).first().asDict()
    assert {k: status[k] for k in want} == pytest.approx(want)
    assert status["failed"] == score.failed_rows(raw, scored).count() == score.failed_rows(raw).count()
    assert status["action_counts"] == {r.action_label: r["count"] for r in scored.groupBy("action_label").count().collect()}
    assert status["segment_counts"] == {r.segment: r["count"] for r in scored.groupBy("segment").count().collect()}
    empty = score.score_and_account(raw.limit(0), str(tmp_path / "none"), high_value_threshold=1.0)
    assert empty["rows_input"] == 0 and empty["churn_rate"] is None and empty["action_counts"] == {}


def test_trained_model_scores_batches(spark, tmp_path):
    from stayline.operators import model as M, segments
    from stayline.plans.score import features_view
    feat = features_view(spark, SF)
    data = segments.assign_segments(feat).withColumn("segment", F.col("segment").cast("string"))
    enc, trained, tau, own = M.train_churn(data, rounds=12, rate=0.2)
    path = str(tmp_path / "model")
    io.save_churn_model(spark, enc, trained, tau, [*C.CHURN_NUMERIC, *C.CHURN_CATEGORICAL], path)
    stored = io.load_churn_model(spark, path)
    got = {r.customerID: r for r in score.score_frame(feat, churn_model=stored).collect()}
    want = {r.customerID: r.churn_prob for r in own.collect()}
    assert set(got) == set(want)
    for k, r in got.items():
        assert r.churn_score == pytest.approx(want[k], abs=1e-9) and r.is_churner == (r.churn_score >= tau) and r.action_key in C.ACTIONS
    batch = score.score_batch(customer_view(spark, SF), churn_model=stored)
    assert batch.columns == score.SCORE_COLS and batch.count() == len(want)


def test_one_hot_bound_holds_per_column(spark):
    from stayline.operators import features
    df = spark.createDataFrame([(str(i), "x") for i in range(12)], "many string, one string")
    with pytest.raises(ValueError, match="many"):
        features.one_hot_drop_first(df, ["many", "one"], max_levels=10)
    assert len(features.one_hot_drop_first(df, ["many", "one"], max_levels=12).columns) == 13
