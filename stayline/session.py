"""Spark session helpers.

Cluster jobs get their session from the caller; ``get_spark`` is only a
convenience for tests, scripts and the bench, and it never overrides a
setting the cluster already provides (``spark.checkpoint.dir`` in
particular).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Defaults for local runs.  On a cluster these come from spark-defaults.
LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app_name: str = "stayline") -> SparkSession:
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    builder = SparkSession.builder.master(master).appName(app_name)
    for k, v in LOCAL_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is configured by the platform and is shared by
    all executors; we only read it.  When it is unset, a local master gets a
    fresh scratch folder; anywhere else that is an error, because a folder of
    one machine is not seen by the others.
    """
    sc = spark.sparkContext
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="stayline-ckpt-", dir="/tmp")
    sc.setCheckpointDir(local)
    return local


def cut_lineage(df):
    """Materialise ``df`` to the shared checkpoint folder (reliable, survives
    executor loss) and return the re-read DataFrame."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location for tables a job
    writes and reads back (never a machine-local temp folder on a cluster)."""
    import uuid
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/stayline-scratch/{name}-{uuid.uuid4().hex[:12]}"
