"""Scoring plans (B1-B7, J6): raw subscribers -> scored, explained,
actioned rows, as one lazily built DataFrame plan.

``scored_view`` is the deterministic deployed pipeline (literal
segmentation prototypes + literal linear churn score).  It is what the
portfolio, rules, evaluation and what-if operators run on, and what every
oracle query reproduces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stayline import config as C
from stayline.functions import exprs as X
from stayline.operators import clean, features, model, rules, segments
from stayline.sources.tables import customer_view


def processed_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw view -> C7 (key kept)."""
    return clean.preprocess(customer_view(spark, sf_dir))


def features_view(spark: SparkSession, sf_dir: str, high_value_threshold: float | None = None) -> DataFrame:
    """C7 -> F14, lazily.  The MonthlyCharges median is a scalar subquery over
    its own pruned plan, so a query that needs two columns reads two."""
    return features.engineer_features(processed_view(spark, sf_dir), high_value_threshold)


def score_frame(feat: DataFrame, tau: float | None = None, inclusive: bool = True,
                seg_model: dict | None = None, churn_model: dict | None = None) -> DataFrame:
    """B1 on an engineered frame: segment -> churn probability -> decision
    -> rule action.  One projection chain, no shuffle.  ``churn_model`` is a
    stored trained model (``sources.io.load_churn_model``), with its own
    threshold unless ``tau`` is given; without it the deployed score is used."""
    s = segments.assign_segments(feat, seg_model)
    s = model.score_with_model(s, churn_model) if churn_model else model.linear_score(s)
    if tau is None:
        tau = churn_model["tau"] if churn_model else C.DEFAULT_THRESHOLD
    s = s.withColumn("is_churner", X.decide("churn_score", tau, inclusive))
    return rules.decide_action(s, p="churn_score")


def scored_view(spark: SparkSession, sf_dir: str, tau: float = C.DEFAULT_THRESHOLD) -> DataFrame:
    return score_frame(features_view(spark, sf_dir), tau)


SCORE_COLS = ["customerID", "segment", "segment_label", "segment_confidence", "churn_prob",
              "is_churner", "action_key", "action_label", "priority", "reason"]


def score_batch(raw: DataFrame, tau: float | None = None, inclusive: bool = True,
                high_value_threshold: float | None = None, return_intermediate: bool = False,
                churn_model: dict | None = None) -> DataFrame:
    """B1: a raw batch (any source) -> scored rows keyed by customerID."""
    feat = features.engineer_features(clean.preprocess(raw), high_value_threshold)
    out = score_frame(feat, tau, inclusive, churn_model=churn_model)
    return out if return_intermediate else out.select(*SCORE_COLS)


def score_and_account(raw: DataFrame, path: str, tau: float | None = None, high_value_threshold: float | None = None,
                      churn_model: dict | None = None, seg_labels: dict = C.SEGMENT_LABELS) -> dict:
    """B1, B4 and B5 in one pass: the scored rows are written to ``path``, and
    what went in and came out is observed on the way, in the writing stage
    itself.  Returns the batch's totals with the counts by action and segment."""
    if high_value_threshold is None:
        high_value_threshold = features.high_value_threshold(clean.preprocess(raw))
    came, went = Observation(), Observation()
    raw = raw.observe(came, F.count(F.lit(1)).alias("rows_input"))
    out = score_batch(raw, tau, high_value_threshold=high_value_threshold, churn_model=churn_model)
    labels, segs = [label for label, _ in C.ACTIONS.values()], list(seg_labels)
    out = out.observe(went, F.count(F.lit(1)).alias("rows_processed"), F.count_if("is_churner").alias("churners"),
                      F.sum(X.micro("churn_prob")).alias("p"), F.sum(X.micro("segment_confidence")).alias("c"),
                      *[F.count_if(F.col("action_label") == a).alias(f"a{i}") for i, a in enumerate(labels)],
                      *[F.count_if(F.col("segment") == k).alias(f"s{k}") for k in segs])
    out.write.mode("overwrite").parquet(path)
    n, got = came.get["rows_input"], went.get
    m = got["rows_processed"]
    mean = lambda x: x / (m * 1_000_000.0) if m else None
    return {"rows_input": n, "rows_processed": m, "churners": got["churners"], "churn_rate": got["churners"] / m if m else None,
            "churn_rate_input": got["churners"] / n if n else None, "avg_churn_probability": mean(got["p"]), "avg_segment_confidence": mean(got["c"]),
            "failed": n - m, "action_counts": {a: got[f"a{i}"] for i, a in enumerate(labels) if got[f"a{i}"]},
            "segment_counts": {k: got[f"s{k}"] for k in segs if got[f"s{k}"]}}


STATUS = ("rows_input long, rows_processed long, churners long, churn_rate double, churn_rate_input double, avg_churn_probability double, "
          "avg_segment_confidence double, failed long, action_counts map<string,long>, segment_counts map<int,long>")


def status_frame(spark: SparkSession, status: dict) -> DataFrame:
    """The totals of ``score_and_account`` as one row."""
    return spark.createDataFrame([tuple(status.values())], STATUS)


def failed_rows(raw: DataFrame, scored: DataFrame | None = None, key: str = "customerID") -> DataFrame:
    """Input rows that produced no prediction: those that cleaning drops,
    told by its own rules, or those whose key isn't in ``scored``."""
    if scored is not None:
        return raw.join(scored.select(key), key, "left_anti")
    return raw.where(X.coerce_numeric("TotalCharges").isNull() | F.coalesce(F.col("tenure") == 0, F.lit(False)))


def batch_summary(scored: DataFrame, rows_input: DataFrame | None = None) -> DataFrame:
    """Rows, churn rate (over processed rows and, for parity, over input
    rows), mean probability, mean confidence.  One aggregation."""
    agg = scored.agg(
        F.count(F.lit(1)).alias("rows_processed"),
        F.sum(F.col("is_churner").cast("long")).alias("churners"),
        F.sum(X.micro("churn_prob")).alias("__sp"),
        F.sum(X.micro("segment_confidence")).alias("__sc"))
    if rows_input is not None:
        agg = agg.crossJoin(rows_input.agg(F.count(F.lit(1)).alias("rows_input")))
    else:
        agg = agg.withColumn("rows_input", F.col("rows_processed"))
    return agg.select(
        "rows_input", "rows_processed", "churners",
        (F.col("churners") / F.col("rows_processed")).alias("churn_rate"),
        (F.col("churners") / F.col("rows_input")).alias("churn_rate_input"),
        X.mean_from_micro(F.col("__sp"), F.col("rows_processed")).alias("avg_churn_probability"),
        X.mean_from_micro(F.col("__sc"), F.col("rows_processed")).alias("avg_segment_confidence"))


def segment_counts(scored: DataFrame) -> DataFrame:
    """B4 map part: segment -> customers."""
    return scored.groupBy("segment").agg(F.count(F.lit(1)).alias("customers"))


def prediction_record(scored: DataFrame, top: DataFrame | None = None,
                      tau: float = C.DEFAULT_THRESHOLD) -> DataFrame:
    """Nested per-customer record: drivers array, action struct, the
    threshold it was decided at, input echo map."""
    echo = F.create_map(*[x for c in C.INPUT_COLUMNS for x in (F.lit(c), F.col(c).cast("string"))])
    rec = scored.select(
        "customerID", "segment", "segment_label", "churn_prob", "is_churner",
        "segment_confidence", F.lit(float(tau)).alias("threshold"),
        F.struct(F.col("action_key"), F.col("action_label"), F.col("priority").alias("priority_score"),
                 F.col("reason")).alias("recommended_action"),
        echo.alias("input_features"))
    if top is not None:
        rec = rec.join(top.select("customerID", "top_features"), "customerID", "left")
    return rec
