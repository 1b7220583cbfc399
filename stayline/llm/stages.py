"""The stages of the corpus pipeline.  All but the last return the columns of
their input, whatever they are."""

from __future__ import annotations

from pyspark.sql import functions as F

from stayline.llm import decontaminate, jaccard_join, language_id, mixing, sharding
from stayline.llm.common import table


def language_stage(spark, docs, sf_dir):
    """Documents in an identified language; ``und`` and undecided ones go."""
    return language_id.accepted(docs)


def jaccard_stage(spark, docs, sf_dir):
    """One document of every group of similar ones."""
    return jaccard_join.keep_first(docs)


def decontamination_stage(spark, docs, sf_dir):
    """Documents without a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mixing_stage(spark, docs, sf_dir):
    """The mix: a document is returned as often as its source's target asks."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    mixed = mixing.mixed_rows(docs.select(whole, "doc_id", "source", "text"))
    return mixed.select(*[F.col(f"__row.`{c}`") for c in docs.columns])


def sharding_stage(spark, docs, sf_dir):
    """All rows, with ``slot`` and ``shard``."""
    return sharding.shard_documents(docs)
