"""Scans, sinks and persisted tables.

Paths are whatever the caller passes (object store or shared file
system).  Every append is a folder of its own with a claimed number, so neither
parallel writers nor a lost executor leave a half-written run.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayline import config as C

# Explicit schema of the raw subscriber CSV (every field nullable).
RAW_SCHEMA = T.StructType([
    T.StructField("customerID", T.LongType()),
    T.StructField("gender", T.StringType()),
    T.StructField("SeniorCitizen", T.IntegerType()),
    T.StructField("Partner", T.StringType()),
    T.StructField("Dependents", T.StringType()),
    T.StructField("tenure", T.IntegerType()),
    T.StructField("PhoneService", T.StringType()),
    T.StructField("MultipleLines", T.StringType()),
    T.StructField("InternetService", T.StringType()),
    T.StructField("OnlineSecurity", T.StringType()),
    T.StructField("OnlineBackup", T.StringType()),
    T.StructField("DeviceProtection", T.StringType()),
    T.StructField("TechSupport", T.StringType()),
    T.StructField("StreamingTV", T.StringType()),
    T.StructField("StreamingMovies", T.StringType()),
    T.StructField("Contract", T.StringType()),
    T.StructField("PaperlessBilling", T.StringType()),
    T.StructField("PaymentMethod", T.StringType()),
    T.StructField("MonthlyCharges", T.DoubleType()),
    T.StructField("TotalCharges", T.StringType()),
    T.StructField("Churn", T.StringType()),
])


def csv_scan(spark: SparkSession, path: str, schema: T.StructType | None = RAW_SCHEMA) -> DataFrame:
    """Header CSV with an explicit schema (inference only when no schema
    is given).  A missing path raises (AnalysisException) like the original."""
    r = spark.read.option("header", True)
    # keep blanks as blanks (the original reads ' ' as a string, not null)
    r = r.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    if schema is not None:
        return r.schema(schema).csv(path)
    return r.option("inferSchema", True).csv(path)


def csv_sink(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header; parent folders are created by the writer."""
    (df.write.mode(mode).option("header", True)
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
       .csv(path))


def batch_intake_guard(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """One row (rows, is_empty, over_limit).  With a limit the count
    stops early: ``limit(max + 1)`` reads at most max + 1 rows."""
    src = df.limit(max_rows + 1) if max_rows is not None else df
    a = src.agg(F.count(F.lit(1)).alias("rows"))
    over = (F.col("rows") > F.lit(max_rows)) if max_rows is not None else F.lit(False)
    return a.select("rows", (F.col("rows") == 0).alias("is_empty"), over.alias("over_limit"))


def normalize_columns(df: DataFrame, expected: Sequence[str] = C.INPUT_COLUMNS):
    """I4: case-insensitive rename + reorder to ``expected``; extra columns
    dropped.  Returns (frame with the present expected columns, missing)."""
    lookup = {c.lower(): c for c in df.columns}
    present, missing = [], []
    for e in expected:
        actual = lookup.get(e.lower())
        if actual is None:
            missing.append(e)
        else:
            present.append(F.col(f"`{actual}`").alias(e))
    return df.select(*present), missing


def _created(spark: SparkSession, fs, path) -> bool:
    """Create an empty file unless it exists; whether it was created.  The
    local file system and HDFS do it in one step; a store that can't create
    exclusively needs one writer at a time."""
    if fs.getUri().getScheme() == "file":
        return spark.sparkContext._jvm.java.io.File(path.toUri().getPath()).createNewFile()
    try:
        fs.create(path, False).close()
        return True
    except Exception:
        if fs.exists(path):
            return False
        raise


def claim_number(spark: SparkSession, path: str) -> int:
    """The next free number below ``path``, taken for good: the claim is a file
    that must not exist yet, so of two writers one gets the next number."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/_claims")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    n = max((int(name) for name in names if name.isdigit()), default=0) + 1
    while not _created(spark, fs, jvm.org.apache.hadoop.fs.Path(folder, f"{n:09d}")):
        n += 1
    return n


def append_rows(df: DataFrame, path: str, number: int | None = None) -> None:
    """Append ``df`` as a folder of its own number, so writers share no
    temporary files and a lost one leaves nothing that is read."""
    number = claim_number(df.sparkSession, path) if number is None else number
    df.write.parquet(f"{path}/{APPEND}={number}")


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(APPEND)


APPEND = "append"


def metrics_history_append(metrics_long: DataFrame, path: str, run_ts, model_config: str = "") -> None:
    """Append one row per (split, metric) with the run timestamp."""
    append_rows(metrics_long.withColumn("ts", F.lit(run_ts).cast("timestamp")).withColumn("model_config", F.lit(model_config)), path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return read_appended(spark, path)


LOG_FIELDS = ("experiment_id", "exp_no", "model", "ts", "threshold", "accuracy", "precision", "recall", "f1", "roc_auc",
              "precision_0", "recall_0", "f1_0", "precision_1", "recall_1", "f1_1",
              "feature_count", "imbalance", "hyperparameters", "notes")


def experiment_log(spark: SparkSession, path: str, run: DataFrame) -> DataFrame:
    """Append a run (one row per model) with the next sequential ids
    ``exp_%03d``, each claimed, so parallel writers get different ones."""
    numbers = [claim_number(spark, path) for _ in range(run.count())]
    own = F.element_at(F.array(*[F.lit(n) for n in numbers]), F.row_number().over(Window.orderBy("run_order")))
    new = run.withColumn("exp_no", own.cast("int")).withColumn("experiment_id", F.format_string("exp_%03d", F.col("exp_no")))
    if numbers:
        append_rows(new, path, numbers[0])
    return read_appended(spark, path)


def export_view(df: DataFrame, path: str) -> DataFrame:
    """Write a filtered view as CSV and hand back what was written."""
    csv_sink(df, path)
    return df.sparkSession.read.option("header", True).schema(df.schema).csv(path)


def metrics_diff(history: DataFrame) -> DataFrame:
    """Change of each metric vs the previous run of the same split."""
    w = Window.partitionBy("split", "metric").orderBy("ts")
    return (history.withColumn("previous", F.lag("value").over(w))
            .withColumn("delta", F.col("value") - F.col("previous")))


# -- model store (I7) --------------------------------------------------------

def save_segment_model(spark: SparkSession, model: dict, path: str) -> None:
    """Scaler stats and prototypes as two small Parquet tables."""
    sc = [(c, float(m), float(s)) for c, (m, s) in model["scaler"].items()]
    spark.createDataFrame(sc, "feature string, mean double, std double") \
        .write.mode("overwrite").parquet(f"{path}/scaler")
    protos = [(i, [float(v) for v in num], [str(m) for m in modes])
              for i, (num, modes) in enumerate(model["prototypes"])]
    spark.createDataFrame(protos, "segment int, numeric array<double>, modes array<string>") \
        .write.mode("overwrite").parquet(f"{path}/prototypes")
    spark.createDataFrame([(float(model["gamma"]), list(model["numeric"]), list(model["categorical"]))],
                          "gamma double, numeric array<string>, categorical array<string>") \
        .write.mode("overwrite").parquet(f"{path}/meta")


def load_segment_model(spark: SparkSession, path: str) -> dict:
    """Reload (tables of k + features rows)."""
    meta = spark.read.parquet(f"{path}/meta").first()
    sc = {r["feature"]: (r["mean"], r["std"]) for r in spark.read.parquet(f"{path}/scaler").collect()}
    protos = sorted(spark.read.parquet(f"{path}/prototypes").collect(), key=lambda r: r["segment"])
    return {"scaler": sc, "numeric": list(meta["numeric"]), "categorical": list(meta["categorical"]),
            "gamma": meta["gamma"], "prototypes": [(list(r["numeric"]), list(r["modes"])) for r in protos]}


def save_pipeline(model, path: str) -> None:
    """I7 for Spark ML models (encoder, classifier)."""
    model.write().overwrite().save(path)


def save_churn_model(spark: SparkSession, encoder, classifier, tau: float, features, path: str) -> None:
    """Encoder, boosted trees, decision threshold and feature order as one stored model."""
    save_pipeline(encoder, f"{path}/encoder")
    spark.createDataFrame([(float(tau), list(features), classifier.to_json())], "tau double, features array<string>, classifier string") \
        .coalesce(1).write.mode("overwrite").parquet(f"{path}/model")


def load_churn_model(spark: SparkSession, path: str) -> dict:
    """``encoder``, ``classifier``, ``tau`` and ``features``."""
    from pyspark.ml import PipelineModel
    from stayline.operators.boosting import Boosted
    row = spark.read.parquet(f"{path}/model").first()
    return {"encoder": PipelineModel.load(f"{path}/encoder"), "classifier": Boosted.from_json(row["classifier"]),
            "tau": row["tau"], "features": list(row["features"])}
