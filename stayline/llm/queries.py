"""The registered query of every operator: production parameters over the
whole table, with the contract's columns.  ``queries()`` and ``oracles()``
are merged into the driver's registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from stayline.llm import decontaminate, fill_in_middle, fingerprints, jaccard_join, language_id, line_dedup, mixing, phrases, quality, sharding, suffix_dedup, token_counts, url_filter
from stayline.llm.common import table


def op1_suffix_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.dedup_substrings(docs, with_text=False).drop("kept")


def op2_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.identify_language(docs).select("doc_id", "held_out", "lang_pred", "score")


def op3_url_filters(spark, sf_dir):
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))


def op4_fingerprints(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fingerprints.fingerprint_documents(docs)


def op5_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_documents(docs).select("doc_id", "size", "source_size", "target", "taken", "shards")


def op6_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text")).drop("key")


def op7_jaccard_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.jaccard_join(docs).select("doc_id", "class_id", "n_links", "copies")


def op8_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_deleted", "n_runs", F.sha2("text", 256).alias("kept_sha256"))


def op9_sharding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_documents(docs).select("doc_id", "slot", "shard")


def op10_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs.withColumn("edits", token_counts.revision()))


def op11_collocations(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op12_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality.score_quality(docs, labels).select("doc_id", "held_out", "score", "predicted")


def op13_fill_in_middle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = fill_in_middle.fill_in_middle(docs)
    return got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(fill_in_middle.restored(), 256).alias("restored_sha256"))


def queries():
    return {f.__name__: f for f in (op1_suffix_dedup, op2_language_id, op3_url_filters, op4_fingerprints, op5_mixing, op6_decontamination, op7_jaccard_join, op8_line_dedup, op9_sharding, op10_token_counts,
                                    op11_collocations, op12_quality, op13_fill_in_middle)}


def oracles():
    return {"op3_url_filters": url_filter.oracle(), "op9_sharding": sharding.oracle(), "op6_decontamination": decontaminate.oracle(),
            "op8_line_dedup": line_dedup.oracle()}
