"""Retention rules.

The rule engine is a single projection of native expressions; the small
rule tables (actions, segment risks, segment overrides) are literal
expressions or broadcast dimension frames of a handful of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline import config as C
from stayline.functions import exprs as X


def actions_dim(spark: SparkSession) -> DataFrame:
    """Action key -> label, description (6 rows)."""
    return spark.createDataFrame([(k, lab, desc) for k, (lab, desc) in C.ACTIONS.items()],
                                 "action_key string, action_label string, action_description string")


def segment_risk_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(C.SEGMENT_RISK.items()), "segment_label string, segment_risk double")


def value_tier(df: DataFrame) -> DataFrame:
    """R1"""
    return df.withColumn("value_tier", X.value_tier())


def value_score(df: DataFrame) -> DataFrame:
    """R2"""
    return df.withColumn("value_score", X.value_score("value_tier"))


def segment_risk_lookup(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Label -> risk via broadcast join, unknown -> 0.5."""
    dim = segment_risk_dim(spark or df.sparkSession)
    return (df.join(F.broadcast(dim), "segment_label", "left")
            .withColumn("segment_risk", F.coalesce("segment_risk", F.lit(C.DEFAULT_SEGMENT_RISK))))


def action_lookup(df: DataFrame, key_col: str = "action_key", fallback: str = "do_nothing") -> DataFrame:
    """Key -> label / description via broadcast join; unknown keys keep
    the key as label (as the original does)."""
    dim = actions_dim(df.sparkSession)
    return (df.join(F.broadcast(dim), df[key_col] == dim["action_key"], "left")
            .drop(dim["action_key"])
            .withColumn("action_label", F.coalesce("action_label", F.col(key_col)))
            .withColumn("action_description", F.coalesce("action_description", F.lit(""))))


def action_label_expr(key: F.Column) -> F.Column:
    expr = None
    for k, (lab, _) in C.ACTIONS.items():
        expr = F.when(key == k, lab) if expr is None else expr.when(key == k, lab)
    return expr.otherwise(key)


def decide_action(df: DataFrame, p: str = "churn_prob", label: str = "segment_label",
                  override: bool = False) -> DataFrame:
    """R6 (= R1..R5 + J3 + J4 in one projection).

    Adds value_tier, value_score, segment_risk, priority, action_key,
    action_label, reason.  ``override=True`` applies the per-segment action
    table (R8) instead of the decision tree where one is configured.
    """
    tier = X.value_tier()
    out = df.withColumn("value_tier", tier)
    out = out.withColumns({
        "value_score": X.value_score("value_tier"),
        "segment_risk": X.segment_risk(label),
    })
    key = X.select_action(p, "value_tier", "Contract")
    if override:
        key = F.coalesce(segment_override_expr(F.col(label), F.col(p)), key)
    out = out.withColumns({
        "priority": F.round(X.rule_priority(p, "segment_risk", "value_score"), 6),
        "action_key": key,
    })
    return out.withColumns({
        "action_label": action_label_expr(F.col("action_key")),
        "reason": X.action_reason(label, p, "value_tier"),
    })


def segment_override_expr(label: F.Column, p: F.Column) -> F.Column:
    """Segment x risk-level action table."""
    level = X.risk_level(p, C.RULE_THRESHOLDS["high_churn_prob"], C.RULE_THRESHOLDS["medium_churn_prob"])
    expr = None
    for seg, acts in C.SEGMENT_SPECIFIC_ACTIONS.items():
        for lvl in ("low", "medium", "high"):
            cond = (label == seg) & (level == lvl)
            a = acts[f"{lvl}_churn"]
            expr = F.when(cond, a) if expr is None else expr.when(cond, a)
    return expr


def segment_action_override(df: DataFrame, p: str = "churn_prob", label: str = "segment_label") -> DataFrame:
    """R8 as a broadcast join with the (segment, level) -> action table."""
    spark = df.sparkSession
    rows = [(seg, lvl, a[f"{lvl}_churn"]) for seg, a in C.SEGMENT_SPECIFIC_ACTIONS.items()
            for lvl in ("low", "medium", "high")]
    dim = spark.createDataFrame(rows, "segment_label string, risk_level string, override_action string")
    level = X.risk_level(p, C.RULE_THRESHOLDS["high_churn_prob"], C.RULE_THRESHOLDS["medium_churn_prob"])
    return (df.withColumn("risk_level", level)
            .join(F.broadcast(dim), [label, "risk_level"], "left"))
