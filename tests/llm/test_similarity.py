"""Jaccard join and fingerprints against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayline.llm import fingerprints, jaccard_join
from stayline.llm.common import shingle_sets
from tests.llm.conftest import DOCS, corpus


def word_sets(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(rows, threshold=0.8):
    """Links and class of every row."""
    sets = [word_sets(r[1]) for r in rows]
    n = len(rows)
    near = [[j for j in range(n) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])]
            for i in range(n)]
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(n):
        for j in near[i]:
            up[max(root(i), root(j))] = min(root(i), root(j))
    members = {}
    for i in range(n):
        members.setdefault(root(i), []).append(rows[i][0])
    return [(rows[i][0], min((x for x in members[root(i)] if x is not None), default=None), len(near[i])) for i in range(n)]


@pytest.mark.parametrize("bucket,block", [(jaccard_join.BUCKET, jaccard_join.BLOCK), (2, 3)])
def test_jaccard_join_equals_brute_force(docs, monkeypatch, bucket, block):
    """Also with buckets and blocks so small that all the splitting runs."""
    monkeypatch.setattr(jaccard_join, "BUCKET", bucket)
    monkeypatch.setattr(jaccard_join.buckets, "__defaults__", (bucket, jaccard_join.DEPTH))
    monkeypatch.setattr(jaccard_join.blocked, "__defaults__", (block,))
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.jaccard_join(docs).collect()), key=str)
    assert got == sorted(brute(corpus()), key=str)


def test_keep_first_keeps_columns_and_one_of_each_class(spark, docs):
    extra = docs.withColumn("class_id", F.lit("clash")).withColumn("copies", F.lit(1)).withColumn("__row", F.lit(2))
    got = jaccard_join.keep_first(extra)
    assert got.columns == extra.columns
    ids = sorted(r.doc_id for r in got.collect() if r.doc_id is not None)
    classes = {}
    for i, c, _ in brute(corpus()):
        if i is not None:
            classes.setdefault(c, set()).add(i)
    assert ids == sorted(classes)          # one of every class, the repeated row once
    assert got.where("doc_id is null").count() == 1


def test_jaccard_empty_table(empty):
    assert jaccard_join.jaccard_join(empty).count() == 0
    assert jaccard_join.keep_first(empty).columns == empty.columns


def test_runs_reach_the_recall():
    """The chance by its formula, against drawing pairs' shared tokens."""
    runs = jaccard_join.runs_for(0.8, 0.999, jaccard_join.DEPTH, jaccard_join.LIKELY)
    assert jaccard_join.recall_of(0.8, runs, jaccard_join.DEPTH, jaccard_join.LIKELY) >= 0.999
    assert jaccard_join.recall_of(0.8, runs - 1, jaccard_join.DEPTH, jaccard_join.LIKELY) < 0.999
    with pytest.raises(ValueError):
        jaccard_join.runs_for(0.8, 1 - 1e-12, jaccard_join.DEPTH, 0.05)
    rng, n = np.random.default_rng(3), 40_000
    shared, found = rng.binomial(jaccard_join.MINHASHES, 0.8, n) / jaccard_join.MINHASHES, np.zeros(n, bool)
    for _ in range(runs):
        alive = np.ones(n, int)                                  # nodes that the pair shares
        for _ in range(2):
            alive = rng.binomial(alive + rng.binomial(alive, 0.25), shared)
        found |= alive > 0
    found &= shared >= 0.8 - jaccard_join.LIKELY
    assert abs(found.mean() - jaccard_join.recall_of(0.8, runs, 2, jaccard_join.LIKELY)) < 0.001


@pytest.mark.parametrize("bucket", [jaccard_join.BUCKET, 1])
def test_lone_pairs_at_the_threshold_are_found(spark, bucket):
    """Pairs with 8 of 10 shingles in common; with a bucket of 1 they are split
    as deep as possible."""
    rng, rows, n = random.Random(8), [], 3000
    for i in range(n):
        t = [f"{rng.randrange(10 ** 9):x}" for _ in range(13)]
        rows += [(2 * i, " ".join(t)), (2 * i + 1, " ".join([*t[:-1], "other"]))]
    got = {r.doc_id: r.class_id for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), bucket=bucket).collect()}
    assert all(c in (i, i - i % 2) for i, c in got.items())
    found = sum(got[2 * i + 1] == 2 * i for i in range(n))
    assert found >= n * 0.999 - 3 * (n * 0.001) ** 0.5                    # three deviations below the stated recall


def test_shingles_agree_with_plain_words():
    texts = ["a b c d e f", "a b", "", "  a\tb\nc d e  f ", "é " * 9, "a b c d e f g a b c d e"]
    got = list(shingle_sets([t.encode() for t in texts], chunk=8))
    assert [len(s) for s in got] == [len(word_sets(t)) for t in texts]
    assert np.array_equal(got[0], got[3])
    a, b = set(got[0].tolist()), set(got[5].tolist())
    assert len(a & b) == len(word_sets(texts[0]) & word_sets(texts[5]))


def test_fingerprints_follow_the_contract(spark, docs):
    rows = corpus()
    got = fingerprints.fingerprint_documents(docs.withColumn("p", F.lit("clash")), range_rows=7).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [r[1] or "" for r in order]
    want = {}
    for k, t in enumerate(texts):
        n = texts[(k + 1) % len(texts)]
        e = t[:len(t) - len(t) // 2] + n[:len(t) // 2]
        want.setdefault(order[k][0], []).append((len(t), hashlib.sha256(e.encode()).hexdigest(), e == t, n == t))
    same = {}
    for r in got:
        w = [x for x in want[r.doc_id] if x[:2] == (r.n_chars, r.edited_sha256)]
        assert w, r.doc_id
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if w[0][2]:
            assert r.near_edited == 1.0
    by_text = {r[0]: r[1] or "" for r in rows if r[0] is not None}
    for r in got:
        if r.doc_id is not None:
            assert same.setdefault(by_text[r.doc_id], r.fingerprint) == r.fingerprint


def test_likeness_is_that_of_the_sketches(spark, docs):
    """The likeness columns against plain sets of the shingles' hashes."""
    def low(text):
        return {h for h in next(shingle_sets([text.encode()])).tolist() if h < 2 ** 64 // fingerprints.SCALE}

    def like(a, b):
        x, y = low(a), low(b)
        return 1.0 if a == b else len(x & y) / len(x | y) if x | y else 0.0

    rows = sorted((r for r in corpus() if r[0] is not None and r[0] != 7), key=lambda r: -r[0])
    texts = [r[1] or "" for r in rows]
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(spark.createDataFrame(rows, DOCS)).collect()}
    for k, r in enumerate(rows):
        t, n = texts[k], texts[(k + 1) % len(rows)]
        edited = t[:len(t) - len(t) // 2] + n[:len(t) // 2]
        assert got[r[0]].near_edited == pytest.approx(like(t, edited)), r[0]
        assert got[r[0]].near_next == pytest.approx(like(t, n)), r[0]


def test_sketches_estimate_and_merge():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2 ** 64, 20_000, dtype=np.uint64))
    b = np.unique(np.concatenate([rng.permutation(a)[:15_000], rng.integers(0, 2 ** 64, 40_000, dtype=np.uint64)]))
    sa, sb = fingerprints.sketch(a), fingerprints.sketch(b)
    j, c = fingerprints.alike(sa, sb, False)
    assert abs(j - 15 / 60) < 0.03 and abs(c - 0.75) < 0.05
    assert np.array_equal(fingerprints.merge(sa, sb), fingerprints.sketch(np.union1d(a, b)))
    assert len(fingerprints.show(sa)) == fingerprints.HEX * len(sa)


def test_fingerprints_single_and_empty(spark, empty):
    one = fingerprints.fingerprint_documents(spark.createDataFrame([(5, "a b c d e f g h", None, None, None)], DOCS)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprints.fingerprint_documents(empty).count() == 0
