"""Mixing, sharding, token counts, and the pipeline."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stayline.llm import mixing, queries, sharding, stages, token_counts
from tests.llm.conftest import DOCS, corpus, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, share=1.5, repeat=2.0):
    """Level the shares by bisection on the common level per weight."""
    w = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    lo, hi, total = 0.0, 4.0 * (sum(sizes) + 1), share * sum(sizes)
    for _ in range(200):
        mid = (lo + hi) / 2
        if sum(min(repeat * s, mid * x) for s, x in zip(sizes, w)) < total:
            lo = mid
        else:
            hi = mid
    return [min(repeat * s, hi * x) for s, x in zip(sizes, w)]


@pytest.mark.parametrize("sizes", [[100], [10, 10, 10], [1, 500, 3, 80], [0, 7, 0], [900, 1, 1, 1, 1, 1, 1]])
def test_targets(sizes):
    got = mixing.targets(sizes)
    assert got == pytest.approx(brute_targets(sizes), rel=1e-9, abs=1e-6)
    assert sum(got) == pytest.approx(1.5 * sum(sizes))


def test_split_tree_is_exact_and_even():
    q = [7, 0, 1000, 33, 8191]
    out = mixing.split_tree(q, 13, 5)
    assert (out >= 0).all() and out.sum(0).tolist() == q
    assert out.sum(1).max() - out.sum(1).min() <= 2 * np.ceil(np.log2(13))
    assert np.array_equal(out, mixing.split_tree(q, 13, 5))


def test_mix_follows_the_contract(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, rng.randint(1, 60)), None, rng.choice(["a", "a", "b", "ä", "Z", None]), 0) for i in range(900)]
    rows += [(i, t, None, s, 0) for i, t, _, s, _ in corpus()]
    docs = spark.createDataFrame(rows, DOCS).withColumn("taken", F.lit("clash")).withColumn("__at", F.lit(1))
    got = mixing.mix_documents(docs, shards=8).collect()
    assert len(got) == len(rows)
    size = {s: 0 for *_, s, _ in rows}
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    want = dict(zip(order, brute_targets([size[s] for s in order])))
    taken = Counter()
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-6)
        assert r.taken == r.copies * r.size <= 2 * r.size and len(r.shards) == r.copies
        assert all(0 <= x < 8 for x in r.shards)
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], 4100), s
    again = {(r.doc_id, r.taken, tuple(r.shards)) for r in mixing.mix_documents(docs.repartition(5), shards=8).collect()}
    assert again == {(r.doc_id, r.taken, tuple(r.shards)) for r in got}


def test_mix_rows_and_empty(spark, docs, empty):
    rows = mixing.mixed_rows(docs, shards=4)
    assert rows.count() == mixing.mix_documents(docs, shards=4).agg(F.sum("copies")).first()[0]
    assert mixing.mix_documents(empty).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_documents(docs, max_sources=2)


@pytest.mark.parametrize("n,slots", [(1, 7), (3, 7), (7, 7), (5, 101), (64, 1009)])
def test_lookup_table_equals_turn_taking(n, slots):
    """The same by full preference lists."""
    pref = []
    for s in range(n):
        a, k = sharding._number(f"offset-{s}") % slots, sharding._number(f"skip-{s}") % (slots - 1) + 1
        pref.append([(a + j * k) % slots for j in range(slots)])
    owner, at, turn = {}, [0] * n, 0
    while len(owner) < slots:
        s = turn % n
        while pref[s][at[s]] in owner:
            at[s] += 1
        owner[pref[s][at[s]]] = s
        turn += 1
    got = sharding.lookup_table(n, slots)
    assert got == [owner[k] for k in range(slots)]
    counts = Counter(got)
    assert max(counts.values()) - min(counts.values()) <= 1


def test_lookup_table_moves_few_slots():
    a, b = sharding.lookup_table(16, 4099), sharding.lookup_table(17, 4099)
    assert sum(x != y for x, y in zip(a, b)) < 0.25 * 4099
    with pytest.raises(ValueError):
        sharding.lookup_table(4, 100)


def test_sharding_cases(spark, docs, empty):
    clash = docs.withColumn("shard", F.lit("x")).withColumn("SLOT", F.lit("y"))
    got = sharding.shard_documents(clash).collect()
    assert len(got) == len(corpus())
    assert all(r.shard == sharding.lookup_table()[r.slot] for r in got)
    assert len({r.shard for r in got if r.doc_id == 7}) == 1
    assert sharding.shard_documents(empty).count() == 0


def count(text):
    return len(token_counts.encoder().encode_ordinary(text))


def edited(text, edits):
    for s, n, new in edits:
        s = min(max(s or 0, 0), len(text))
        text = text[:s] + (new or "") + text[s + max(n or 0, 0):]
    return text


@pytest.mark.parametrize("seed", range(12))
def test_tree_counts_equal_whole_text_counts(seed):
    """After every edit of a long series, the sums equal a fresh encoding."""
    rng = random.Random(seed)
    pieces = ["word ", "Ünï ", "\n", "  ", "12,5 ", "don't ", "<|endoftext|>", "xyz", "日本語 ", "\t", ".", "é", "、漢字", "。", "'s", "a'll", "!'re", "_", "½", "²", "\u0301", "\x1c", "-", "😀", "'", "a", "…'", "\u00a0", "۳"]
    text = "".join(rng.choice(pieces) for _ in range(400))
    tree = token_counts.TokenTree(text, lambda t: count(t) if t else 0, leaf=20)
    for _ in range(25):
        e = (rng.randint(-5, len(text) + 5), rng.choice([0, 1, 7, 60, 10_000 if rng.random() < 0.05 else 3]),
             "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))))
        tree.edit(*e)
        text = edited(text, [e])
        assert "".join(tree.text) == text
        assert (tree.tokens[1], tree.chars[1]) == (count(text), len(text))


def test_many_edits_at_one_place_keep_leaves_small():
    rng, leaf = random.Random(4), token_counts.LEAF
    text = words(rng, 300)
    tree = token_counts.TokenTree(text, lambda t: count(t) if t else 0)
    inserted = 0
    for _ in range(30):
        new = words(rng, 60) + " "
        at = text.index(" ", len(text) // 2)
        tree.edit(at, 0, " " + new)
        text = edited(text, [(at, 0, " " + new)])
        inserted += len(new) + 1
    assert "".join(tree.text) == text and tree.tokens[1] == count(text)
    assert max(map(len, tree.text)) <= 2 * leaf
    assert tree.again <= inserted + 30 * 6 * leaf
    for _ in range(40):                                          # and deletions leave no tiny ones behind for good
        tree.edit(len(text) // 3, 150, "")
        text = edited(text, [(len(text) // 3, 150, "")])
    assert "".join(tree.text) == text and tree.tokens[1] == count(text) and len(tree.text) <= 3 + 3 * len(text) // leaf


def test_text_without_blanks_has_many_leaves():
    text = "日本語の文章、区切りは句読点だけ。" * 300
    tree = token_counts.TokenTree(text, lambda t: count(t) if t else 0)
    assert tree.tokens[1] == count(text) and max(map(len, tree.text)) <= 2 * token_counts.LEAF
    tree.edit(2000, 3, "新しい、")
    assert tree.again <= 6 * token_counts.LEAF and tree.tokens[1] == count(edited(text, [(2000, 3, "新しい、")]))


def test_token_counts_ignore_clashing_columns(spark, docs):
    odd = docs.withColumns({"edits": F.lit(3), "leaf_chars": F.lit("x"), "leaf_tokens": F.array(F.lit("y")), "n_tokens": F.lit(1), "n_leaves": F.lit(True)})
    got = {(r.doc_id, r.n_tokens, r.n_edits) for r in token_counts.count_tokens(odd).collect()}
    assert got == {(i, count(t or ""), 0) for i, t, *_ in corpus()}


def test_token_counts_cases(spark, docs, empty):
    plain = {(r.doc_id, r.n_tokens) for r in token_counts.count_tokens(docs).collect()}
    assert plain == {(i, count(t or "")) for i, t, *_ in corpus()}
    rows = [(1, "one two three", [(3, 4, "!"), (None, None, None)]), (2, None, [(5, 9, "new text")]), (3, "same", []), (4, "same", None), (4, "same", None)]
    d = spark.createDataFrame(rows, f"doc_id long, text string, edits {token_counts.EDITS}")
    got = token_counts.count_tokens(d).collect()
    want = {i: edited(t or "", e or []) for i, t, e in rows}
    assert len(got) == 5
    for r in got:
        assert (r.n_tokens_edited, r.n_chars_edited) == (count(want[r.doc_id]), len(want[r.doc_id]))
    assert token_counts.count_tokens(empty).count() == 0


def test_kept_leaves_are_not_encoded_again(spark, docs):
    first = token_counts.count_tokens(docs).where("doc_id is not null").dropDuplicates(["doc_id"])
    again = docs.dropDuplicates(["doc_id"]).join(first.select("doc_id", "leaf_chars", "leaf_tokens"), "doc_id").withColumn("edits", token_counts.revision())
    got = {r.doc_id: (r.n_tokens, r.n_tokens_edited) for r in token_counts.count_tokens(again).collect()}
    fresh = token_counts.count_tokens(docs.withColumn("edits", token_counts.revision())).collect()
    assert got.items() <= {r.doc_id: (r.n_tokens, r.n_tokens_edited) for r in fresh}.items()


def test_stages_keep_columns_on_odd_rows(spark, docs, empty, tmp_path):
    spark.createDataFrame([(1, "x " * 30)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    odd = docs.withColumn("shard", F.lit("x")).withColumn("__id", F.lit(1)).withColumn("copies", F.lit(2))
    for frame in (odd, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, str(tmp_path))
            assert out.columns == frame.columns, name
            out.count()
    assert stages.sharding_stage(spark, odd, str(tmp_path)).count() == odd.count()


def test_pipeline_names_and_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "sharding"]
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    n = out.count()
    assert n > 100 and set(out.columns) >= {"doc_id", "text", "shard"}
    assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2


def test_every_operator_has_a_query():
    assert [int(n[2:].split("_")[0]) for n in queries.queries()] == list(range(1, 14))
    assert set(queries.oracles()) <= set(queries.queries())
