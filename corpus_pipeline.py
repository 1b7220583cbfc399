"""The corpus pipeline over ``documents``: language ID, n-gram Jaccard join,
benchmark decontamination, mixing to target weights, sharding.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet
and reread as the next stage's ``docs``.
"""

from __future__ import annotations

from stayline.llm.common import saved
from stayline.llm.stages import decontamination_stage, jaccard_stage, language_stage, mixing_stage, sharding_stage

STAGES = [
    ("language_id", language_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Language ID trains a model and the Jaccard join searches; SQL can't express them.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
