"""Registered queries: persisted tables, metrics history, streaming and the
end-to-end training job (I9-I12, E15, S1, S2, B7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stayline import config as C
from stayline.operators import evaluate as E
from stayline.operators import features
from stayline.plans.oracle import with_views
from stayline.plans.queries_business import CM, PLAN_SQL, SCORED_SPLIT, _split_auc_sql, f1_sql, metrics_sql, plan_view, split_scores
from stayline.plans.queries_core import SPLIT_SQL
from stayline.plans.queries_model import SPLIT_CHECK, split_check
from stayline.plans.registry import query
from stayline.plans.score import features_view, processed_view, scored_view
from stayline.session import scratch_path
from stayline.sources import io
from stayline.sources.tables import customer_view
from stayline.streaming import scoring as S

RUNS = [(1, "2024-01-01 00:00:00", 0.5), (2, "2024-01-02 00:00:00", 0.4)]
METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc")


def _split_metrics(spark, sf_dir, tau):
    d = split_scores(spark, sf_dir).select("split", F.col("Churn").alias("label"), "churn_score", "churn_margin")
    return E.metrics_long(E.evaluate_splits(d, tau, p="churn_score", rank="churn_margin"), names=METRICS)


def _history(spark, sf_dir):
    path = scratch_path(spark, "metrics_history")
    for run_id, ts, tau in RUNS:
        io.metrics_history_append(_split_metrics(spark, sf_dir, tau).withColumn("run_id", F.lit(run_id)),
                                  path, ts, model_config=f"linear tau={tau}")
    return io.read_history(spark, path)


def _hist_sql() -> str:
    parts = []
    for run_id, ts, tau in RUNS:
        cm = (f"(SELECT split, " + ", ".join(
            f"CAST(sum(CASE WHEN Churn = {y} AND churn_score {op} {tau} THEN 1 ELSE 0 END) AS BIGINT) AS {n}"
            for y, op, n in ((0, "<", "tn"), (0, ">=", "fp"), (1, "<", "fn"), (1, ">=", "tp")))
            + " FROM ssplit GROUP BY split) q")
        m = f"SELECT m.*, a.roc_auc FROM ({f1_sql(metrics_sql(cm))}) m JOIN sauc a ON m.split = a.split"
        parts += [f"SELECT {run_id} AS run_id, TIMESTAMP '{ts}' AS ts, 'linear tau={tau}' AS model_config, split, "
                  f"'{k}' AS metric, CAST({k} AS DOUBLE) AS value FROM ({m}) r{run_id}{k}" for k in METRICS]
    return "hist AS (" + " UNION ALL ".join(parts) + ")"


HIST = SCORED_SPLIT + "," + _split_auc_sql() + "," + _hist_sql()


@query("metrics_history_append", with_views(
    "SELECT run_id, split, metric, value, model_config FROM hist", extra=HIST))
def q_metrics_history_append(spark, sf_dir):
    """Two runs appended to a Parquet history table, read back."""
    return _history(spark, sf_dir).select("run_id", "split", "metric", "value", "model_config")


@query("metrics_diff", with_views(
    "SELECT run_id, split, metric, value, lag(value) OVER (PARTITION BY split, metric ORDER BY ts) AS previous, "
    "value - lag(value) OVER (PARTITION BY split, metric ORDER BY ts) AS delta FROM hist", extra=HIST))
def q_metrics_diff(spark, sf_dir):
    """Change of every metric against the previous run."""
    return io.metrics_diff(_history(spark, sf_dir)).select("run_id", "split", "metric", "value", "previous", "delta")


@query("latest_metrics", with_views(
    "SELECT run_id, split, metric, value FROM hist QUALIFY row_number() OVER (PARTITION BY split, metric ORDER BY ts DESC) = 1",
    extra=HIST))
def q_latest_metrics(spark, sf_dir):
    """Latest value per (split, metric)."""
    return E.latest_metrics(_history(spark, sf_dir)).select("run_id", "split", "metric", "value")


EXP_CLASS = {"0": ("tn", "fn", "fp"), "1": ("tp", "fp", "fn")}


def _exp_sql() -> str:
    rows = []
    n = 0
    for tau in (0.5, 0.4):
        for i, (model, col) in enumerate((("linear", "churn_score"), ("rule_priority", "priority"))):
            n += 1
            cm = ("(SELECT " + ", ".join(
                f"CAST(sum(CASE WHEN Churn = {y} AND {col} {op} {tau} THEN 1 ELSE 0 END) AS BIGINT) AS {k}"
                for y, op, k in ((0, "<", "tn"), (0, ">=", "fp"), (1, "<", "fn"), (1, ">=", "tp"))) + " FROM scored) q")
            per = ", ".join(
                f"CASE WHEN {hit} + {wrong} = 0 THEN 0.0 ELSE CAST({hit} AS DOUBLE) / ({hit} + {wrong}) END AS precision_{c}, "
                f"CASE WHEN {hit} + {lost} = 0 THEN 0.0 ELSE CAST({hit} AS DOUBLE) / ({hit} + {lost}) END AS recall_{c}"
                for c, (hit, wrong, lost) in EXP_CLASS.items())
            f1 = ", ".join(f"CASE WHEN precision_{c} + recall_{c} = 0 THEN 0.0 ELSE CAST(2.0 AS DOUBLE) * precision_{c} * recall_{c} / "
                           f"(precision_{c} + recall_{c}) END AS f1_{c}" for c in EXP_CLASS)
            rows.append(f"SELECT printf('exp_%03d', {n}) AS experiment_id, CAST({n} AS INTEGER) AS exp_no, '{model}' AS model, "
                        f"TIMESTAMP '2024-01-0{n} 00:00:00' AS ts, CAST({tau} AS DOUBLE) AS threshold, accuracy, precision, recall, f1, roc_auc, "
                        f"precision_0, recall_0, f1_0, precision_1, recall_1, f1_1, CAST({len(C.LINEAR_WEIGHTS)} AS INTEGER) AS feature_count, "
                        f"'none' AS imbalance, 'tau={tau}' AS hyperparameters, 'fixed {model}' AS notes "
                        f"FROM (SELECT *, {f1} FROM (SELECT *, {per} FROM ({f1_sql(metrics_sql(cm))}) a{n}) b{n}) e{n} "
                        f"CROSS JOIN (SELECT roc_auc FROM xauc WHERE model = '{model}') x{n}")
    return " UNION ALL ".join(rows)


EXP_AUC = """
xm AS (SELECT 'linear' AS model, Churn, churn_margin AS score FROM scored UNION ALL SELECT 'rule_priority', Churn, priority FROM scored),
xs AS (SELECT model, score, sum(CASE WHEN Churn = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN Churn = 0 THEN 1 ELSE 0 END) AS neg FROM xm GROUP BY ALL),
xc AS (SELECT *, sum(neg) OVER (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS neg_cum,
  sum(pos) OVER (PARTITION BY model) AS P, sum(neg) OVER (PARTITION BY model) AS N FROM xs),
xauc AS (SELECT model, CAST(sum(pos * (2 * (N - neg_cum) + neg)) AS DOUBLE) / (CAST(2.0 AS DOUBLE) * CAST(max(P) AS DOUBLE) * CAST(max(N) AS DOUBLE)) AS roc_auc
  FROM xc GROUP BY model)"""


@query("experiment_log", with_views(_exp_sql(), extra=EXP_AUC))
def q_experiment_log(spark, sf_dir):
    """Two experiment runs (two models each) appended to a log with
    sequential ids exp_001.. ."""
    s = scored_view(spark, sf_dir).select(F.col("Churn").alias("label"), "churn_score", "churn_margin", "priority")
    path = scratch_path(spark, "experiment_log")
    log, n = None, 0
    for tau in (0.5, 0.4):
        parts = []
        for order, (model, col, rank) in enumerate((("linear", "churn_score", "churn_margin"), ("rule_priority", "priority", "priority"))):
            n += 1
            m = E.evaluate_model(s, tau, p=col, rank=rank)
            for c, (hit, wrong, lost) in EXP_CLASS.items():
                m = m.withColumns({f"precision_{c}": E._div0(F.col(hit), F.col(hit) + F.col(wrong)),
                                   f"recall_{c}": E._div0(F.col(hit), F.col(hit) + F.col(lost))})
                p, r = F.col(f"precision_{c}"), F.col(f"recall_{c}")
                m = m.withColumn(f"f1_{c}", F.when(p + r == 0, F.lit(0.0)).otherwise(F.lit(2.0) * p * r / (p + r)))
            parts.append(m.withColumns({
                "run_order": F.lit(order), "model": F.lit(model), "ts": F.lit(f"2024-01-0{n} 00:00:00").cast("timestamp"),
                "feature_count": F.lit(len(C.LINEAR_WEIGHTS)), "imbalance": F.lit("none"), "hyperparameters": F.lit(f"tau={tau}"),
                "notes": F.lit(f"fixed {model}")}).drop("tn", "fp", "fn", "tp"))
        log = io.experiment_log(spark, path, parts[0].unionByName(parts[1]))
    return log.select(*io.LOG_FIELDS)


EXPORT_COLS = ["customerID", "segment_name", "priority_pct", "priority_level", "risk_level", "churn_prob",
               "is_churner", "action_label", "MonthlyCharges", "mrr_at_risk", "tenure", "Contract"]


@query("export_views", with_views(
    "SELECT " + ", ".join(EXPORT_COLS) + " FROM plan WHERE priority_level = 'High'", extra=PLAN_SQL))
def q_export_views(spark, sf_dir):
    """High-priority rows of the action plan exported as CSV."""
    view = plan_view(spark, sf_dir).filter("priority_level = 'High'").select(*EXPORT_COLS)
    return io.export_view(view, scratch_path(spark, "export_high_priority"))


SCORE_SQL = ("SELECT customerID, segment, segment_label, segment_confidence, churn_prob, is_churner, action_key, "
             "action_label, priority, reason FROM scored")


def _drop_files(spark, sf_dir, n_files: int = 4) -> str:
    """Write the raw subscriber view as a few Parquet files, as batches would
    arrive from upstream."""
    path = scratch_path(spark, "incoming")
    customer_view(spark, sf_dir).repartition(n_files).write.mode("overwrite").parquet(path)
    return path


@query("stream_score", with_views(SCORE_SQL))
def q_stream_score(spark, sf_dir):
    """The streaming scorer over dropped files equals the batch scorer
    (same fitted threshold), so it shares the batch oracle."""
    thr = features.high_value_threshold(processed_view(spark, sf_dir))
    src = _drop_files(spark, sf_dir)
    sink, ckpt = scratch_path(spark, "stream_sink"), scratch_path(spark, "stream_ckpt")
    q = S.stream_score(spark, src, sink, ckpt, thr, max_files_per_trigger=1)
    q.awaitTermination()
    return spark.read.parquet(sink).select(*S.SCORE_COLS)


@query("stream_file_batches", with_views(
    SCORE_SQL.replace(" FROM scored", ", rows_input, rows_processed, failed, churners, action_customers FROM scored") + """ CROSS JOIN (
  SELECT (SELECT count(*) FROM raw) AS rows_input, count(*) AS rows_processed, (SELECT count(*) FROM raw) - count(*) AS failed,
    CAST(sum(CAST(is_churner AS INTEGER)) AS BIGINT) AS churners FROM scored) t
JOIN (SELECT action_label, count(*) AS action_customers FROM scored GROUP BY ALL) c USING (action_label)"""))
def q_stream_file_batches(spark, sf_dir):
    """One micro-batch per dropped file; predictions next to the totals of
    the status rows and of their action counts (batch ids depend on the order
    in which files are found, so they are summed away)."""
    thr = features.high_value_threshold(processed_view(spark, sf_dir))
    src = _drop_files(spark, sf_dir)
    out, ckpt = scratch_path(spark, "batches_out"), scratch_path(spark, "batches_ckpt")
    q = S.stream_file_batches(spark, src, out, ckpt, thr)
    q.awaitTermination()
    status = spark.read.parquet(f"{out}/status")
    total = status.agg(*[F.sum(c).alias(c) for c in ("rows_input", "rows_processed", "failed", "churners")])
    acts = (status.select(F.explode("action_counts").alias("action_label", "n"))
            .groupBy("action_label").agg(F.sum("n").alias("action_customers")))
    return (spark.read.parquet(f"{out}/predictions").select(*S.SCORE_COLS).crossJoin(F.broadcast(total))
            .join(F.broadcast(acts), "action_label"))


@query("train_job", with_views(SPLIT_CHECK, "clean", SPLIT_SQL))
def q_train_job(spark, sf_dir):
    """Clean -> features -> fit segments -> assign -> train churn ->
    evaluate, with every stage's table written to the job's folder; returns
    the check table of the trained model per split."""
    from stayline.operators import model as M, segments
    base = scratch_path(spark, "train_job")
    proc = processed_view(spark, sf_dir)
    proc.write.mode("overwrite").parquet(f"{base}/processed")
    feat = features.engineer_features(spark.read.parquet(f"{base}/processed"))
    feat.write.mode("overwrite").parquet(f"{base}/features")
    feat = spark.read.parquet(f"{base}/features")
    seg_model = segments.kprototypes_fit(feat)
    io.save_segment_model(spark, seg_model, f"{base}/segment_model")
    assigned = segments.assign_segments(feat, io.load_segment_model(spark, f"{base}/segment_model"))
    assigned = assigned.withColumn("segment", F.col("segment").cast("string"))
    enc, model, tau, scored = M.train_churn(assigned, path=f"{base}/boosting")
    io.save_churn_model(spark, enc, model, tau, [*C.CHURN_NUMERIC, *C.CHURN_CATEGORICAL], f"{base}/churn_model")
    E.evaluate_splits(scored, tau).write.mode("overwrite").parquet(f"{base}/metrics")
    split_check(scored, tau, len(model.trees)).write.mode("overwrite").parquet(f"{base}/check")
    return spark.read.parquet(f"{base}/check")


@query("validate_metrics", with_views(
    "SELECT s.split, r.metric, CAST(NULL AS DOUBLE) AS value, 'missing' AS problem FROM (SELECT DISTINCT split FROM hist) s "
    "CROSS JOIN (VALUES ('accuracy'), ('precision'), ('recall'), ('f1'), ('roc_auc'), ('log_loss')) r(metric) "
    "WHERE NOT EXISTS (SELECT 1 FROM hist h WHERE h.split = s.split AND h.metric = r.metric) "
    "UNION ALL SELECT split, metric, value, 'out_of_range' FROM hist WHERE NOT coalesce(value BETWEEN 0 AND 1, false)",
    extra=HIST))
def q_validate_metrics(spark, sf_dir):
    """C12 on the metrics history: required metrics per split (log_loss is
    required but never produced, so it is reported) and values in [0, 1]."""
    from stayline.operators import clean
    hist = _history(spark, sf_dir).select("split", "metric", "value")
    return clean.validate_metrics(hist, required=("accuracy", "precision", "recall", "f1", "roc_auc", "log_loss"))
