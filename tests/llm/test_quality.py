"""Quality classifier: tokens, word vectors, network, calibration, held-out figures."""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayline.llm import quality, queries
from stayline.llm.common import table
from tests.llm.conftest import corpus, words

TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+")
LABELS = "doc_id long, quality int"


def texts():
    return [(t or "").encode() for _, t, *_ in corpus()] + [b"The cat!! the\tcat $$$ | x", b"a" * 700 + b" b" * 900, "é漢!é".encode(), b"\x00\x01a"]


def test_tokens_are_runs():
    b, first = quality.tokens(texts())
    rows, seen = defaultdict(set), {}
    for i, t in enumerate(texts()):
        own = TOKEN.findall(t)
        assert first[i + 1] - first[i] == len(own)
        for w, r in zip(own, b[first[i]:first[i + 1]]):
            assert seen.setdefault(w, r) == r
            rows[r].add(w)
    assert sum(len(w) > 1 for w in rows.values()) < 0.05 * len(rows)


def test_blocks_keep_every_byte():
    for room in (7, 64, 1 << 20):
        back = defaultdict(bytes)
        for group, owner in quality.blocks(texts(), room):
            assert all(len(t) <= room for t in group)
            for t, i in zip(group, owner):
                back[i] += t
        assert [back[i] for i in range(len(texts()))] == texts()


def brute_contexts(dims=8, bits=10, window=2):
    place, sign = quality.index_vectors(np.arange(1 << bits), dims)
    total, n = defaultdict(lambda: np.zeros(dims, int)), defaultdict(int)
    for t in texts():
        b = [int(quality.tokens([w], bits)[0][0]) for w in TOKEN.findall(t)]
        for i, own in enumerate(b):
            n[own] += 1
            for j in range(max(0, i - window), min(len(b), i + window + 1)):
                if j != i:
                    for p, s in zip(place[b[j]], sign[b[j]]):
                        total[own][p] += s
    return {r: (n[r], *total[r].tolist()) for r in n}


def test_context_sums_against_brute_force(spark):
    docs = spark.createDataFrame([(t,) for t in texts()] + [(None,)], "text binary").repartition(3)
    got = {r[0]: tuple(r[1:]) for r in quality.context_sums(docs, bits=10, dims=8).collect()}
    assert got == brute_contexts()


def test_pooled_against_brute_force():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(1 << 10, 8)).astype(np.float32)
    got = quality.pooled(texts(), v)
    for t, x in zip(texts(), got):
        b = [int(quality.tokens([w], 10)[0][0]) for w in TOKEN.findall(t)]
        if not b:
            assert not x.any()
            continue
        own = v[b].astype(float)
        near = [(float(own[i] @ own[i - 1]), b[i] == b[i - 1]) for i in range(1, len(b))]
        want = [*own.mean(0), *own.std(0), sum(a for a, _ in near) / len(b), sum(e for _, e in near) / len(b), 1]
        assert x == pytest.approx(want, abs=2e-4)


def test_network_and_temperature():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 4))
    logit = 3 * np.sign(x[:, 0] * x[:, 1])                       # no single layer separates it
    y = (rng.random(1500) < 1 / (1 + np.exp(-logit))).astype(int)
    net = quality.fit(x[:1000], y[:1000], np.arange(1000) % 5 == 0)
    z = quality.forward(net, x[1000:])
    assert ((z > 0) == (logit[1000:] > 0)).mean() > 0.85
    again = quality.fit(x[:1000], y[:1000], np.arange(1000) % 5 == 0)
    assert np.array_equal(z, quality.forward(again, x[1000:]))
    for t in (0.2, 3.0):                                         # the temperature undoes a scaling of the logits
        raw = quality.log_loss(z * t, y[1000:])
        best = quality.fit_temperature(z * t, y[1000:])
        assert quality.log_loss(z * t / best, y[1000:]) <= raw and best == pytest.approx(t * quality.fit_temperature(z, y[1000:]), rel=1e-3)


def some(seed=4):
    """Plain texts of quality 1; shouting and word repetitions of quality 0."""
    rng, rows, labels = random.Random(seed), [], []
    for i in range(300):
        t = words(rng, rng.randint(20, 60))
        if i % 3 == 0:
            t = "!! ".join(t.upper().split()) if i % 2 else " ".join([rng.choice(t.split())] * 40)
        rows.append((i, t))
        labels.append((i, int(i % 3 != 0)))
    return rows, labels


def test_learns_only_outside_the_held_out_third(spark):
    rows, labels = some()
    docs = spark.createDataFrame([*rows, (None, "a b"), (900, None), (901, ""), (5, rows[5][1])], "doc_id long, text string").withColumn("SCORE", F.lit("x")).withColumn("__row", F.lit(1))
    lab = spark.createDataFrame([*labels, (None, 1), (7, None), (5000, 0), (3, 7)], LABELS)
    got = quality.score_quality(docs, lab)
    assert got.columns == ["doc_id", "text", "__row", "held_out", "score", "predicted"]
    rows_got = got.collect()
    assert len(rows_got) == len(rows) + 4
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(300)}
    truth, good = dict(labels), []
    for r in rows_got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == held.get(r.doc_id, r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if r.doc_id is not None and r.doc_id < 300 and r.held_out:
            good.append(r.predicted == truth[r.doc_id])
    assert np.mean(good) > 0.95
    flipped = spark.createDataFrame([(i, 1 - q if held[i] else q) for i, q in labels], LABELS)
    again = quality.score_quality(docs, flipped).collect()
    assert sorted((str(r.doc_id), r.score) for r in again) == sorted((str(r.doc_id), r.score) for r in rows_got)


def test_bounded_sample(spark):
    rows, labels = some()
    got = quality.learning_labels(spark.createDataFrame(labels * 3, LABELS), per_class=20)
    assert {r["y"]: r["count"] for r in got.groupBy("y").count().collect()} == {0: 20, 1: 20}
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 for r in got.collect())


def test_one_class_and_empty(spark, docs, empty):
    lab = spark.createDataFrame([(i, 1) for i in range(20)], LABELS)
    taught = sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(20))
    assert {round(r.score, 9) for r in quality.score_quality(docs, lab).collect()} == {round((taught + 1) / (taught + 2), 9)}
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in quality.score_quality(docs, none).collect()} == {0.5}
    assert quality.score_quality(empty, lab).count() == 0


def test_held_out_figures(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op12_quality(spark, sf)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.where("held_out").join(table(spark, sf, "labels"), "doc_id").select("quality", "score").collect()
    s, y = np.array([r.score for r in rows]), np.array([r.quality for r in rows])
    pairs = s[y == 1][:, None] - s[y == 0][None]
    assert (pairs > 0).mean() + 0.5 * (pairs == 0).mean() > 0.98
    assert ((s >= 0.5) == (y == 1)).mean() > 0.95
