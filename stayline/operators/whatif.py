"""What-if simulation.

Every customer is scored once as-is and once per scenario in a single
plan: the scenario dimension (a handful of rows, broadcast) is crossed with
the baseline-scored customers, the modifications are applied as column
overrides, and the same scoring projection runs again.  The baseline
result travels inside each row, so deltas need no self-join and the work is
linear in customers x scenarios.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayline import config as C
from stayline.operators import features
from stayline.plans.score import score_frame

# columns a modification may touch, with the type it is cast to
MODIFIABLE = {c: ("int" if c in ("tenure",) else "double" if c in ("MonthlyCharges", "TotalCharges") else "string")
              for c in C.INPUT_COLUMNS}
CARRY = ["segment", "segment_label", "churn_prob", "is_churner", "action_key", "action_label", "priority"]


def normalize_payment(mods: dict) -> dict:
    """Template payment labels -> data labels."""
    out = dict(mods)
    if "PaymentMethod" in out:
        out["PaymentMethod"] = C.PAYMENT_LABEL_FIX.get(out["PaymentMethod"], out["PaymentMethod"])
    return out


def policy_scenarios(spark: SparkSession, normalize: bool = True, include_empty: bool = False) -> DataFrame:
    """The predefined scenarios as (scenario, description, modifications);
    the description says what is set."""
    told = lambda m: "; ".join(f"{k} = {v}" for k, v in m.items())
    rows = [(n, told(m), normalize_payment(m) if normalize else dict(m)) for n, m in C.POLICY_SCENARIOS]
    if include_empty:
        rows.append(("No Change", "Empty modification set", {}))
    schema = T.StructType([T.StructField("scenario", T.StringType()),
                           T.StructField("description", T.StringType()),
                           T.StructField("modifications", T.MapType(T.StringType(), T.StringType()))])
    return spark.createDataFrame(rows, schema)


def _senior(v: F.Column) -> F.Column:
    return F.when(v.isin("1", "yes"), "yes").when(v.isin("0", "no"), "no").otherwise(v)


def apply_modifications(df: DataFrame, mods_col: str = "modifications") -> DataFrame:
    """Override known fields from the map; unknown keys are ignored
    (only columns in ``MODIFIABLE`` are read from the map)."""
    m = F.col(mods_col)
    new = {}
    for c, typ in MODIFIABLE.items():
        if c not in df.columns:
            continue
        v = F.element_at(m, F.lit(c))
        if c == "SeniorCitizen":
            v = _senior(v)
        new[c] = F.when(F.map_contains_key(m, F.lit(c)), v.cast(typ)).otherwise(F.col(c))
    return df.withColumns(new)


def simulate(processed: DataFrame, scenarios: DataFrame, tau: float = C.DEFAULT_THRESHOLD) -> DataFrame:
    """J7 + W1 + W2: baseline and modified scoring for customers x scenarios.

    The is_high_value threshold is fitted once on the baseline (so a
    modification cannot move it), and both passes use it.  Only the key and the
    modifiable columns travel.
    """
    keep = [c for c in processed.columns if c in MODIFIABLE or c == "customerID"]
    processed = processed.select(*keep)
    thr = features.median_of(processed, "MonthlyCharges")
    base = score_frame(features.engineer_features(processed, thr), tau)
    base = base.select(*processed.columns, *[F.col(c).alias(f"orig_{c}") for c in CARRY])
    crossed = base.crossJoin(F.broadcast(scenarios.select("scenario", "modifications")))
    modified = apply_modifications(crossed)
    feat_cols = ["avg_monthly_spend", "charge_gap", "is_high_value", "tenure_band", "streaming_count",
                 "security_count", "payment_electronic_check", "month_to_month_paperless",
                 "no_support_services", "is_isolated", "fiber_no_security", "no_internet_services"]
    modified = modified.drop(*[c for c in feat_cols if c in modified.columns])
    return score_frame(features.engineer_features(modified, thr), tau)


def what_if_delta(sim: DataFrame) -> DataFrame:
    """W2 + W6: deltas and outcome classes per (customer, scenario)."""
    dp = F.round(F.col("churn_prob") - F.col("orig_churn_prob"), 6)
    return sim.select(
        "customerID", "scenario",
        F.col("orig_churn_prob"), F.col("churn_prob").alias("new_churn_prob"),
        dp.alias("churn_prob_delta"),
        (F.col("segment") != F.col("orig_segment")).alias("segment_changed"),
        F.col("orig_segment"), F.col("segment").alias("new_segment"),
        (F.col("is_churner") != F.col("orig_is_churner")).alias("is_churner_changed"),
        (F.col("action_key") != F.col("orig_action_key")).alias("action_changed"),
        F.col("orig_action_label"), F.col("action_label").alias("new_action_label"),
        outcome_class(dp).alias("outcome"),
        churn_flip(F.col("orig_is_churner"), F.col("is_churner")).alias("churn_outcome"),
        "MonthlyCharges")


def outcome_class(dp: F.Column, eps: float = 1e-6) -> F.Column:
    """Improvement / worsening / no change."""
    return F.when(dp < -eps, "improvement").when(dp > eps, "worsening").otherwise("no change")


def churn_flip(orig: F.Column, new: F.Column) -> F.Column:
    """Saved (churner -> not) / pushed to churn / unchanged."""
    return (F.when(orig & ~new, "saved").when(~orig & new, "pushed to churn").otherwise("unchanged"))


def what_if_batch(delta: DataFrame) -> DataFrame:
    """Per scenario: simulations run and how many changed."""
    return delta.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("simulated"),
        F.sum(F.col("segment_changed").cast("long")).alias("segment_changes"),
        F.sum(F.col("is_churner_changed").cast("long")).alias("churner_changes"),
        F.sum(F.col("action_changed").cast("long")).alias("action_changes"),
        F.sum((F.col("outcome") == "improvement").cast("long")).alias("improved"))


def modification_ledger(sim: DataFrame, processed_cols: Sequence[str] = C.INPUT_COLUMNS) -> DataFrame:
    """(customer, scenario, field, original, modified) for every applied
    modification.  The original values ride along as a map per row; the
    modification map is exploded - no join."""
    return (sim.select("customerID", "scenario", F.explode("modifications").alias("field", "modified"),
                       F.col("__orig"))
            .filter(F.map_contains_key(F.col("__orig"), F.col("field")))
            .select("customerID", "scenario", "field",
                    F.element_at(F.col("__orig"), F.col("field")).alias("original"), "modified"))


def ledger_input(processed: DataFrame, scenarios: DataFrame) -> DataFrame:
    cols = [c for c in C.INPUT_COLUMNS if c in processed.columns]
    orig = F.create_map(*[x for c in cols for x in (F.lit(c), F.col(c).cast("string"))])
    return (processed.select("customerID", orig.alias("__orig"))
            .crossJoin(F.broadcast(scenarios.select("scenario", "modifications"))))


def scenario_ranking(delta: DataFrame) -> DataFrame:
    """Per scenario over the whole base: customers saved, pushed,
    retained MRR (exact cents) and mean probability change, best first."""
    cents = F.round(F.col("MonthlyCharges") * 100).cast("long")
    saved = F.col("churn_outcome") == "saved"
    a = delta.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum(saved.cast("long")).alias("saved"),
        F.sum((F.col("churn_outcome") == "pushed to churn").cast("long")).alias("pushed"),
        F.sum(F.when(saved, cents).otherwise(F.lit(0))).alias("__rev"),
        F.sum(F.round(F.col("churn_prob_delta") * 1_000_000).cast("long")).alias("__dp"))
    return a.select("scenario", "customers", "saved", "pushed",
                    (F.col("__rev") / 100.0).alias("retained_mrr"),
                    (F.col("__dp").cast("double") / (F.col("customers").cast("double") * 1_000_000.0))
                    .alias("avg_prob_delta")).orderBy(F.desc("retained_mrr"), "scenario")
