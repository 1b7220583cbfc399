"""Registered queries: sources, cleaning and features (I*, C*, F*)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from stayline import config as C
from stayline.functions import exprs as X
from stayline.operators import clean, features
from stayline.plans.oracle import dbl, with_views
from stayline.plans.registry import query
from stayline.plans.score import features_view, processed_view, scored_view
from stayline.session import scratch_path
from stayline.sources import io
from stayline.sources.tables import customer_view

FEAT_COLS = [
    "avg_monthly_spend", "charge_gap", "is_high_value", "tenure_band", "streaming_count",
    "security_count", "payment_electronic_check", "month_to_month_paperless",
    "no_support_services", "is_isolated", "fiber_no_security", "no_internet_services",
]

# Split CTE (F22) in SQL: md5 order inside each label, count-based cuts.
def split_sql(fractions=C.SPLIT_FRACTIONS) -> str:
    f_train, f_val, f_test = fractions
    return f"""
sp0 AS (
  SELECT clean.*,
    row_number() OVER (PARTITION BY Churn ORDER BY md5('{C.SEED}:' || CAST(customerID AS VARCHAR)), customerID) - 1 AS pos,
    count(*) OVER (PARTITION BY Churn) AS n_lab
  FROM clean),
sp1 AS (SELECT *, CAST(ceil(CAST(n_lab AS DOUBLE) * {dbl(f_test)} - {dbl(1e-9)}) AS BIGINT) AS n_test FROM sp0),
sp2 AS (SELECT *, n_lab - n_test AS n_rest FROM sp1),
sp3 AS (SELECT *, CAST(ceil(CAST(n_rest AS DOUBLE) * {dbl(f_val / (f_train + f_val))} - {dbl(1e-9)}) AS BIGINT) AS n_val FROM sp2),
split AS (
  SELECT * EXCLUDE (pos, n_lab, n_test, n_rest, n_val),
    CASE WHEN pos < n_rest - n_val THEN 'train' WHEN pos < n_rest THEN 'validation' ELSE 'test' END AS split
  FROM sp3)"""


SPLIT_SQL = split_sql()


def _one_hot_name(c: str, lv: str) -> str:
    return re.sub(r"[^0-9A-Za-z]+", "_", f"{c}_{lv}").strip("_")


# ---------------------------------------------------------------------------
# I: sources and sinks
# ---------------------------------------------------------------------------

@query("csv_scan", with_views("SELECT * FROM raw", "raw"))
def q_csv_scan(spark, sf_dir):
    """I1 (with I2 to produce the file): raw view -> CSV -> scan with schema."""
    path = scratch_path(spark, "raw_csv")
    io.csv_sink(customer_view(spark, sf_dir), path)
    return io.csv_scan(spark, path)


@query("csv_sink", with_views("SELECT * FROM clean", "clean"))
def q_csv_sink(spark, sf_dir):
    """Processed table written as CSV and read back."""
    df = processed_view(spark, sf_dir)
    path = scratch_path(spark, "processed_csv")
    io.csv_sink(df, path)
    return spark.read.option("header", True).schema(df.schema).csv(path)


@query("batch_intake_guard", with_views(
    "SELECT count(*) AS rows, count(*) = 0 AS is_empty, count(*) > 50000 AS over_limit FROM raw", "raw"))
def q_batch_intake_guard(spark, sf_dir):
    return io.batch_intake_guard(customer_view(spark, sf_dir), max_rows=None) \
        .withColumn("over_limit", F.col("rows") > C.MAX_BATCH_ROWS)


def _messy_batch(spark, sf_dir):
    """Raw view as an uploaded file would arrive: lower-case headers,
    shuffled order, an extra column, TotalCharges missing."""
    raw = customer_view(spark, sf_dir)
    cols = [c for c in reversed(C.INPUT_COLUMNS) if c != "TotalCharges"]
    return raw.select(*[F.col(c).alias(c.lower()) for c in cols], F.lit("x").alias("extra_col"))


@query("normalize_columns", with_views(
    "SELECT " + ", ".join(c for c in C.INPUT_COLUMNS if c != "TotalCharges")
    + ", 'TotalCharges' AS missing_columns FROM raw", "raw"))
def q_normalize_columns(spark, sf_dir):
    df, missing = io.normalize_columns(_messy_batch(spark, sf_dir))
    return df.withColumn("missing_columns", F.lit(",".join(missing)))


@query("model_store", with_views(
    "SELECT feature, round(mean, 6) AS mean, round(std, 6) AS std FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, avg(CAST({c} AS DOUBLE)) AS mean, "
        f"CASE WHEN stddev_pop(CAST({c} AS DOUBLE)) = 0 THEN 1.0 ELSE stddev_pop(CAST({c} AS DOUBLE)) END AS std FROM feat"
        for c in C.SEG_NUMERIC) + ")", "feat"))
def q_model_store(spark, sf_dir):
    """Fit the segmentation scaler, save the model tables, load them back."""
    stats = features.fit_scaler(features_view(spark, sf_dir), C.SEG_NUMERIC)
    model = {"scaler": stats, "numeric": C.SEG_NUMERIC, "categorical": C.SEG_CATEGORICAL,
             "gamma": C.SEGMENT_GAMMA, "prototypes": [(z, m) for z, m in C.SEGMENT_PROTOTYPES]}
    path = scratch_path(spark, "segment_model")
    io.save_segment_model(spark, model, path)
    return spark.read.parquet(f"{path}/scaler").select(
        "feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


# ---------------------------------------------------------------------------
# C: cleaning, projection, validation
# ---------------------------------------------------------------------------

@query("drop_columns", with_views("SELECT * EXCLUDE (gender) FROM raw", "raw"))
def q_drop_columns(spark, sf_dir):
    return clean.drop_columns(customer_view(spark, sf_dir), ["gender", "not_a_column", "customerID"])


@query("coerce_numeric", with_views(
    "SELECT customerID, TotalCharges AS TotalCharges_raw, "
    "CASE WHEN isnan(TRY_CAST(trim(TotalCharges) AS DOUBLE)) THEN NULL ELSE TRY_CAST(trim(TotalCharges) AS DOUBLE) END"
    " AS TotalCharges FROM raw", "raw"))
def q_coerce_numeric(spark, sf_dir):
    raw = customer_view(spark, sf_dir)
    return raw.select("customerID", F.col("TotalCharges").alias("TotalCharges_raw"),
                      X.coerce_numeric("TotalCharges").alias("TotalCharges"))


@query("drop_null_rows", with_views(
    "SELECT * FROM clean0 WHERE TotalCharges IS NOT NULL", "clean"))
def q_drop_null_rows(spark, sf_dir):
    return clean.drop_null_rows(clean.coerce_numeric(customer_view(spark, sf_dir)))


@query("drop_zero_tenure", with_views(
    "SELECT * FROM raw WHERE tenure IS NULL OR tenure <> 0", "raw"))
def q_drop_zero_tenure(spark, sf_dir):
    return clean.drop_zero_tenure(customer_view(spark, sf_dir))


@query("map_senior", with_views(
    "SELECT customerID, CASE WHEN SeniorCitizen = 1 THEN 'yes' WHEN SeniorCitizen = 0 THEN 'no' END AS SeniorCitizen"
    " FROM raw", "raw"))
def q_map_senior(spark, sf_dir):
    return clean.map_senior(customer_view(spark, sf_dir)).select("customerID", "SeniorCitizen")


@query("map_churn", with_views(
    "SELECT customerID, CASE WHEN Churn = 'Yes' THEN 1 WHEN Churn = 'No' THEN 0 END AS Churn FROM raw", "raw"))
def q_map_churn(spark, sf_dir):
    return clean.map_churn(customer_view(spark, sf_dir)).select("customerID", "Churn")


@query("preprocess", with_views("SELECT * FROM clean", "clean"))
def q_preprocess(spark, sf_dir):
    return processed_view(spark, sf_dir)


@query("select_ordered", with_views(
    "SELECT customerID, " + ", ".join(C.SEGMENTATION_FEATURES) + " FROM feat", "feat"))
def q_select_ordered(spark, sf_dir):
    return clean.select_ordered(features_view(spark, sf_dir))


@query("cast_categoricals", with_views(
    "SELECT customerID, " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), 'nan') AS {c}" for c in C.SEG_CATEGORICAL)
    + " FROM feat", "feat"))
def q_cast_categoricals(spark, sf_dir):
    return clean.cast_categoricals(features_view(spark, sf_dir)).select("customerID", *C.SEG_CATEGORICAL)


VAL_NUMERIC = ["tenure", "MonthlyCharges", "TotalCharges"]
VAL_CATEGORICAL = [c for c in C.CHURN_CATEGORICAL if c != "segment"]


def _validate_sql() -> str:
    parts = []
    for c in VAL_NUMERIC:
        parts.append(
            f"SELECT '{c}' AS feature, 'numeric' AS kind, count(*) AS rows, "
            f"CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls, "
            f"CAST(sum(CASE WHEN {c} IS NOT NULL AND (TRY_CAST(trim(CAST({c} AS VARCHAR)) AS DOUBLE) IS NULL "
            f"OR isnan(TRY_CAST(trim(CAST({c} AS VARCHAR)) AS DOUBLE))) THEN 1 ELSE 0 END) AS BIGINT) AS uncastable, "
            f"CAST(0 AS BIGINT) AS unseen FROM raw")
    for c in VAL_CATEGORICAL:
        parts.append(
            f"SELECT '{c}' AS feature, 'categorical' AS kind, count(*) AS rows, "
            f"CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls, CAST(0 AS BIGINT) AS uncastable, "
            f"CAST(sum(CASE WHEN CAST({c} AS VARCHAR) NOT IN (SELECT DISTINCT CAST({c} AS VARCHAR) FROM split "
            f"WHERE split = 'train' AND {c} IS NOT NULL) THEN 1 ELSE 0 END) AS BIGINT) AS unseen FROM raw")
    return " UNION ALL ".join(parts)


def _train_levels(spark, sf_dir):
    tr = features.stratified_split(processed_view(spark, sf_dir)).filter("split = 'train'")
    return clean.long_levels(tr, VAL_CATEGORICAL).select("feature", "level").filter("level IS NOT NULL")


@query("validate_features", with_views(_validate_sql(), "clean", SPLIT_SQL))
def q_validate_features(spark, sf_dir):
    """C10 on an incoming raw batch against the levels seen in training."""
    return clean.validate_features(customer_view(spark, sf_dir), VAL_NUMERIC, VAL_CATEGORICAL,
                                   trained_levels=_train_levels(spark, sf_dir))


def _profile_sql(where: str, prefix: str) -> str:
    parts = []
    for c in VAL_NUMERIC:
        parts.append(f"SELECT '{c}' AS feature, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS {prefix}_null_rate, "
                     f"round(avg(CAST({c} AS DOUBLE)), 6) AS {prefix}_mean FROM split WHERE {where}")
    for c in VAL_CATEGORICAL:
        parts.append(f"SELECT '{c}' AS feature, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS {prefix}_null_rate, "
                     f"CAST(NULL AS DOUBLE) AS {prefix}_mean FROM split WHERE {where}")
    return " UNION ALL ".join(parts)


@query("validation_report", with_views(
    "SELECT coalesce(a.feature, b.feature) AS feature, a.train_null_rate, a.train_mean, b.score_null_rate, b.score_mean, "
    "round(b.score_mean - a.train_mean, 6) AS mean_shift FROM ("
    + _profile_sql("split = 'train'", "train") + ") a FULL OUTER JOIN ("
    + _profile_sql("split = 'test'", "score") + ") b ON a.feature = b.feature", "clean", SPLIT_SQL))
def q_validation_report(spark, sf_dir):
    """C11: train split vs test split profile."""
    sp = features.stratified_split(processed_view(spark, sf_dir))
    rep = clean.validation_report(sp.filter("split = 'train'"), sp.filter("split = 'test'"),
                                  VAL_NUMERIC, VAL_CATEGORICAL)
    return rep.select("feature",
                      F.col("train_null_rate").cast("double").alias("train_null_rate"),
                      F.round("train_mean", 6).alias("train_mean"),
                      F.col("score_null_rate").cast("double").alias("score_null_rate"),
                      F.round("score_mean", 6).alias("score_mean"),
                      F.round("mean_shift", 6).alias("mean_shift"))


@query("validation_levels", with_views(
    "SELECT feature, level, coalesce(a.s, 0.0) AS train_share, coalesce(b.s, 0.0) AS score_share, coalesce(b.s, 0.0) - coalesce(a.s, 0.0) AS share_shift FROM "
    + " FULL OUTER JOIN ".join(
        "(SELECT feature, level, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY feature) AS s FROM (" + " UNION ALL ".join(
            f"SELECT '{c}' AS feature, coalesce(CAST({c} AS VARCHAR), 'nan') AS level, count(*) AS n FROM split WHERE split = '{part}' GROUP BY ALL"
            for c in VAL_CATEGORICAL) + f")) {alias}" for part, alias in (("train", "a"), ("test", "b")))
    + " USING (feature, level)", "clean", SPLIT_SQL))
def q_validation_levels(spark, sf_dir):
    """C11: level shares of the train split against the test split."""
    sp = features.stratified_split(processed_view(spark, sf_dir))
    return clean.validation_levels(sp.filter("split = 'train'"), sp.filter("split = 'test'"), VAL_CATEGORICAL)


@query("output_constraints", with_views(
    "SELECT * FROM (SELECT 'segment_in_0_3' AS rule, CAST(sum(CASE WHEN coalesce(segment BETWEEN 0 AND 3, false) THEN 0 ELSE 1 END) AS BIGINT) AS violations FROM scored"
    " UNION ALL SELECT 'probability_in_0_1', CAST(sum(CASE WHEN coalesce(churn_prob BETWEEN 0 AND 1, false) THEN 0 ELSE 1 END) AS BIGINT) FROM scored"
    " UNION ALL SELECT 'confidence_in_0_1', CAST(sum(CASE WHEN coalesce(segment_confidence BETWEEN 0 AND 1, false) THEN 0 ELSE 1 END) AS BIGINT) FROM scored"
    " UNION ALL SELECT 'priority_in_0_1', CAST(sum(CASE WHEN coalesce(priority BETWEEN 0 AND 1, false) THEN 0 ELSE 1 END) AS BIGINT) FROM scored)"))
def q_output_constraints(spark, sf_dir):
    return clean.output_constraints(scored_view(spark, sf_dir))


def _dtype_sql() -> str:
    parts = []
    for c in C.RAW_COLUMNS:
        parts.append(
            f"SELECT (SELECT count(*) FROM raw) AS rows, '{c}' AS column_name, "
            f"(SELECT CASE typeof({c}) WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' "
            f"WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' ELSE typeof({c}) END FROM raw LIMIT 1) AS dtype, "
            f"(SELECT CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) FROM raw) AS nulls, "
            f"(SELECT count(DISTINCT {c}) FROM raw) AS distinct_values")
    return " UNION ALL ".join(parts)


@query("null_dtype_profile", with_views(_dtype_sql(), "raw"))
def q_null_dtype_profile(spark, sf_dir):
    return clean.null_dtype_profile(customer_view(spark, sf_dir))


@query("missing_row_inspection", with_views(
    "SELECT customerID, tenure, TotalCharges, CASE WHEN TRY_CAST(trim(TotalCharges) AS DOUBLE) IS NULL "
    "OR isnan(TRY_CAST(trim(TotalCharges) AS DOUBLE)) THEN 'missing_total' ELSE 'zero_tenure' END AS reason FROM raw "
    "WHERE TRY_CAST(trim(TotalCharges) AS DOUBLE) IS NULL OR isnan(TRY_CAST(trim(TotalCharges) AS DOUBLE)) OR tenure = 0", "raw"))
def q_missing_row_inspection(spark, sf_dir):
    return clean.missing_row_inspection(customer_view(spark, sf_dir))


@query("background_sample", with_views(
    f"SELECT * EXCLUDE (Churn) FROM feat ORDER BY md5('{C.SEED}:' || CAST(customerID AS VARCHAR)), customerID LIMIT 200",
    "feat"))
def q_background_sample(spark, sf_dir):
    return clean.background_sample(features_view(spark, sf_dir), n=200)


@query("row_number_id", with_views(
    "SELECT customerID, segment_label, churn_prob, row_number() OVER (ORDER BY customerID) AS row_no FROM scored"))
def q_row_number_id(spark, sf_dir):
    s = scored_view(spark, sf_dir).select("customerID", "segment_label", "churn_prob")
    return clean.row_number_id(s)


@query("dedupe_first", with_views(
    "SELECT customerID, segment_label, churn_prob FROM scored "
    "QUALIFY row_number() OVER (PARTITION BY segment_label ORDER BY churn_prob DESC, customerID) = 1"))
def q_dedupe_first(spark, sf_dir):
    s = scored_view(spark, sf_dir).select("customerID", "segment_label", "churn_prob")
    return clean.dedupe_first(s, ["segment_label"], [F.desc("churn_prob"), F.asc("customerID")])


# ---------------------------------------------------------------------------
# F: features
# ---------------------------------------------------------------------------

def _feature_query(name: str):
    @query(name, with_views(f"SELECT customerID, {name} FROM feat", "feat"))
    def q(spark, sf_dir):
        return features_view(spark, sf_dir).select("customerID", name)
    q.__name__ = f"q_{name}"
    return q


for _f in FEAT_COLS:
    _feature_query(_f)


@query("num_services", with_views(
    "SELECT customerID, " + " + ".join(f"CAST(coalesce({c} = 'Yes', false) AS INTEGER)" for c in C.ALL_SERVICES)
    + " AS num_services FROM clean", "clean"))
def q_num_services(spark, sf_dir):
    return processed_view(spark, sf_dir).select("customerID", features.num_services().alias("num_services"))


@query("engineer_features", with_views("SELECT * FROM feat", "feat"))
def q_engineer_features(spark, sf_dir):
    return features_view(spark, sf_dir)


@query("build_features", with_views(
    "SELECT customerID, " + ", ".join(C.SEGMENTATION_FEATURES) + " FROM feat", "feat"))
def q_build_features(spark, sf_dir):
    """the feature job writes processed, segmentation and churn tables;
    the segmentation table is read back."""
    base = scratch_path(spark, "features")
    proc = processed_view(spark, sf_dir)
    proc.write.mode("overwrite").parquet(f"{base}/processed")
    feat = features.engineer_features(spark.read.parquet(f"{base}/processed"))
    clean.select_ordered(feat).write.mode("overwrite").parquet(f"{base}/segmentation")
    feat.select("customerID", *C.CHURN_NUMERIC, *[c for c in C.CHURN_CATEGORICAL if c != "segment"], "Churn") \
        .write.mode("overwrite").parquet(f"{base}/churn")
    return spark.read.parquet(f"{base}/segmentation")


@query("standard_scale", with_views(
    "SELECT customerID, " + ", ".join(
        f"round((CAST({c} AS DOUBLE) - avg(CAST({c} AS DOUBLE)) OVER ()) / "
        f"CASE WHEN stddev_pop(CAST({c} AS DOUBLE)) OVER () = 0 THEN 1.0 ELSE stddev_pop(CAST({c} AS DOUBLE)) OVER () END, 6)"
        f" AS {c}_z" for c in C.SEG_NUMERIC) + " FROM feat", "feat"))
def q_standard_scale(spark, sf_dir):
    out = features.standard_scale_batch(features_view(spark, sf_dir), C.SEG_NUMERIC)
    return out.select("customerID", *[F.round(f"{c}_z", 6).alias(f"{c}_z") for c in C.SEG_NUMERIC])


ONE_HOT = {
    "Contract": ["Month-to-month", "One year", "Two year"],
    "PaymentMethod": ["Bank transfer (automatic)", "Credit card (automatic)", "Electronic check", "Mailed check"],
    "InternetService": ["DSL", "Fiber optic", "No"],
}


@query("one_hot_drop_first", with_views(
    "SELECT customerID, " + ", ".join(
        f"CAST(coalesce({c} = '{lv}', false) AS INTEGER) AS {_one_hot_name(c, lv)}"
        for c, lvs in ONE_HOT.items() for lv in sorted(lvs)[1:]) + " FROM clean", "clean"))
def q_one_hot_drop_first(spark, sf_dir):
    df = processed_view(spark, sf_dir)
    out = features.one_hot_drop_first(df, list(ONE_HOT))
    cols = [c for c in out.columns if any(c.startswith(f"{k}_") for k in ONE_HOT)]
    return out.select("customerID", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(re.sub(r"[^0-9A-Za-z]+", "_", c).strip("_"))
                                      for c in cols])


@query("label_encode", with_views(
    "SELECT customerID, PaymentMethod, CAST(dense_rank() OVER (ORDER BY PaymentMethod) - 1 AS INTEGER) AS PaymentMethod_code"
    " FROM clean", "clean"))
def q_label_encode(spark, sf_dir):
    return features.label_encode(processed_view(spark, sf_dir).select("customerID", "PaymentMethod"), "PaymentMethod")


@query("factorize", with_views(
    "SELECT c.customerID, c.InternetService, f.code AS InternetService_code FROM clean c JOIN ("
    "SELECT InternetService, CAST(dense_rank() OVER (ORDER BY min(customerID)) - 1 AS INTEGER) AS code "
    "FROM clean GROUP BY InternetService) f ON c.InternetService = f.InternetService", "clean"))
def q_factorize(spark, sf_dir):
    return features.factorize(processed_view(spark, sf_dir).select("customerID", "InternetService"), "InternetService")


@query("class_weight", with_views(
    "SELECT customerID, Churn, CASE WHEN Churn = 1 THEN (SELECT CAST(sum(1 - Churn) AS DOUBLE) / sum(Churn) FROM clean)"
    " ELSE 1.0 END AS weight FROM clean", "clean"))
def q_class_weight(spark, sf_dir):
    return features.class_weight(processed_view(spark, sf_dir).select("customerID", "Churn"))


@query("stratified_split", with_views("SELECT customerID, Churn, split FROM split", "clean", SPLIT_SQL))
def q_stratified_split(spark, sf_dir):
    return features.stratified_split(processed_view(spark, sf_dir)).select("customerID", "Churn", "split")


@query("stratified_kfold", with_views(
    f"SELECT customerID, Churn, CAST((row_number() OVER (PARTITION BY Churn ORDER BY "
    f"md5('{C.SEED}:' || CAST(customerID AS VARCHAR)), customerID) - 1) % 5 AS INTEGER) AS fold FROM clean", "clean"))
def q_stratified_kfold(spark, sf_dir):
    return features.stratified_kfold(processed_view(spark, sf_dir)).select("customerID", "Churn", "fold")


@query("trainval_union", with_views(
    "SELECT customerID, Churn, split FROM split WHERE split = 'train' UNION ALL "
    "SELECT customerID, Churn, split FROM split WHERE split = 'validation'", "clean", SPLIT_SQL))
def q_trainval_union(spark, sf_dir):
    sp = features.stratified_split(processed_view(spark, sf_dir)).select("customerID", "Churn", "split")
    return features.trainval_union(sp.filter("split = 'train'"), sp.filter("split = 'validation'"))
