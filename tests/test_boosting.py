"""Staged boosting: against a plain implementation, restarts, exact sums."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from stayline.operators import boosting as B

COLS = ["a", "b", "c"]


def table(n=900, seed=4):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n).round(2), rng.integers(0, 2, n), rng.integers(0, 2, n)]).astype(float)
    p = 1 / (1 + np.exp(-(1.5 * x[:, 0] + 2 * x[:, 1] * (x[:, 0] > 0) - 1)))
    y = (rng.random(n) < p).astype(int)
    return [(i, *map(float, r), int(t), i % 5) for i, (r, t) in enumerate(zip(x, y))]


@pytest.fixture(scope="module")
def frame(spark):
    df = spark.createDataFrame(table(), "customerID long, a double, b double, c double, label int, part int").repartition(3)
    return VectorAssembler(inputCols=COLS, outputCol="features").transform(df)


@pytest.fixture(scope="module")
def shared(frame):
    cuts = B.cut_points(frame, COLS, ["a"], 16)
    return B.training_blocks(frame, "part", cuts=cuts, partitions=3), cuts


@pytest.fixture(scope="module")
def alone(frame, shared):
    blocks = B.training_blocks(frame, "part", cuts=shared[1])
    assert blocks.count() == 1
    return blocks


def brute(rows, cuts, spec):
    """The same trees by plain loops over rows."""
    x = np.array([r[1:4] for r in rows])
    y, part = np.array([r[4] for r in rows], float), np.array([r[5] for r in rows])
    on = np.isin(part, spec.train)
    m = np.full(len(y), np.log(y[on].sum() / (on.sum() - y[on].sum())))
    curve = []
    for _ in range(spec.rounds):
        v = np.isin(part, spec.valid)
        curve.append(float(np.mean(np.logaddexp(0, np.where(y[v] > 0, -m[v], m[v])))))
        p = 1 / (1 + np.exp(-m))
        g, h = y - p, p * (1 - p)
        step = np.zeros(len(y))

        def grow(at, depth):
            fit = at[on[at]]
            gs, hs = g[fit].sum(), h[fit].sum()
            step[at] = spec.rate * gs / (hs + spec.l2)
            if depth == spec.depth:
                return
            best = None
            for f, cs in enumerate(cuts):
                for c in cs:
                    left = fit[x[fit, f] <= c]
                    if len(left) < spec.least or len(fit) - len(left) < spec.least:
                        continue
                    a, b = g[left].sum(), h[left].sum()
                    gain = a * a / (b + spec.l2) + (gs - a) ** 2 / (hs - b + spec.l2) - gs * gs / (hs + spec.l2)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-6):
                        best = gain, f, c
            if best:
                go = x[at, best[1]] <= best[2]
                grow(at[go], depth + 1)
                grow(at[~go], depth + 1)

        grow(np.arange(len(y)), 0)
        m = m + step
    return m, curve


def test_equals_a_plain_implementation(spark, frame, shared):
    blocks, cuts = shared
    spec = B.Spec(train=(0, 1, 2), valid=(3,), rounds=6, depth=3, rate=0.3, least=10)
    model, = B.boost(blocks, COLS, cuts, [spec], stage=2)
    want, curve = brute(table(), cuts, spec)
    x = np.array([r[1:4] for r in table()])
    assert model.margins(x) == pytest.approx(want, abs=1e-4)
    assert model.curve[:6] == pytest.approx(curve, abs=1e-4) and len(model.curve) == 7
    assert model.curve[-1] < model.curve[0]
    got = {r.customerID: r.churn_margin for r in B.with_margin(frame, model).collect()}
    assert [got[i] for i in range(len(x))] == pytest.approx(model.margins(x).tolist(), abs=1e-12)
    own = {r.customerID: r.churn_prob for r in B.block_scores(blocks, [model]).collect()}
    assert [own[i] for i in range(len(x))] == pytest.approx((1 / (1 + np.exp(-model.margins(x)))).tolist(), abs=1e-12)
    assert sum(model.importance().values()) == pytest.approx(1.0)
    assert B.Boosted.from_json(model.to_json()).to_json() == model.to_json()


SPECS = [B.Spec(train=(0, 1, 2, 3), valid=(4,), rounds=8, depth=2, rows=0.7, columns=0.7, seed=3), B.Spec(train=(1, 2), rounds=5, depth=4), B.Spec(train=(0, 4), valid=(1,), rounds=9, depth=3, patience=2, rate=1.5, least=2)]


def as_json(models):
    return [m.to_json() for m in models]


def test_one_block_gives_the_same_models(spark, shared, alone, tmp_path):
    """A task that has all rows grows whole stages; models and restarts are the same."""
    blocks, cuts = shared
    whole = as_json(B.boost(blocks, COLS, cuts, SPECS, stage=3))
    assert as_json(B.boost(alone, COLS, cuts, SPECS, stage=3)) == whole and as_json(B.boost(alone, COLS, cuts, SPECS)) == whole
    path = str(tmp_path / "run")
    B.boost(alone, COLS, cuts, SPECS, path=path, stage=3, stop_after=5)
    assert B._stages(spark, path)[0] == 3 and as_json(B.boost(alone, COLS, cuts, SPECS, path=path, stage=3)) == whole
    assert B._stages(spark, path)[0] == 8 and as_json(B.boost(alone, COLS, cuts, SPECS, path=path, stage=3)) == whole


def test_a_lost_run_goes_on_to_the_same_models(spark, shared, tmp_path):
    blocks, cuts = shared
    whole = as_json(B.boost(blocks, COLS, cuts, SPECS, stage=3))
    path = str(tmp_path / "run")
    B.boost(blocks, COLS, cuts, SPECS, path=path, stage=3, stop_after=5)          # rounds 4 and 5 are lost
    assert B._stages(spark, path)[0] == 3
    seen = []
    real = B._level_sums
    B._level_sums = lambda *a: (seen.append(a[-1]), real(*a))[1]
    try:
        again = as_json(B.boost(blocks, COLS, cuts, SPECS, path=path, stage=3))
    finally:
        B._level_sums = real
    assert again == whole and min(seen) == 3                                       # no earlier round is repeated


def test_models_do_not_depend_on_stages_partitions_or_company(spark, frame, shared):
    blocks, cuts = shared
    whole = as_json(B.boost(blocks, COLS, cuts, SPECS, stage=100))
    other = B.training_blocks(frame, "part", cuts=cuts, partitions=50)
    assert len(other.inputFiles()) > B.FAN
    assert as_json(B.boost(other, COLS, cuts, SPECS, stage=4)) == whole            # sums added by tasks first
    assert as_json(B.boost_batches(blocks, COLS, cuts, SPECS, batch=1, parallelism=3)) == whole
    assert B.fingerprint(other) != "" and whole[2].count('"feat"') < 9             # stopped early


def test_stopping_keeps_the_best_round(shared):
    blocks, cuts = shared
    m = B.boost(blocks, COLS, cuts, SPECS[2:])[0]
    assert len(m.trees) == int(np.argmin(m.curve)) and len(m.curve) <= len(m.trees) + 2 + SPECS[2].patience


def test_one_class_and_missing_numbers(spark):
    rows = [(i, float("nan") if i % 3 == 0 else float(i), 1, 0) for i in range(200)]
    df = VectorAssembler(inputCols=["a"], outputCol="features", handleInvalid="keep").transform(spark.createDataFrame(rows, "customerID long, a double, label int, part int"))
    cuts = B.cut_points(df.where("not isnan(a)"), ["a"], ["a"])
    blocks = B.training_blocks(df, "part", cuts=cuts)
    m = B.boost(blocks, ["a"], cuts, [B.Spec(train=(0,), rounds=2)])[0]
    assert np.isfinite(m.margins(np.array([[np.nan], [5.0]]))).all()
    two = df.withColumn("label", F.isnan("a").cast("int"))
    m = B.boost(B.training_blocks(two, "part", cuts=cuts), ["a"], cuts, [B.Spec(train=(0,), rounds=5, rate=0.5)])[0]
    low, high = m.margins(np.array([[5.0], [np.nan]]))
    assert high > low


def test_specs_that_differ_in_rounds_are_grown_once(shared, monkeypatch):
    blocks, cuts = shared
    specs = [B.Spec(train=(0, 1, 2), valid=(3,), rounds=n, depth=2, rate=rate, rows=0.8) for rate in (0.1, 0.3) for n in (4, 2, 4, 3)] + SPECS[2:]
    want = as_json([B.boost(blocks, COLS, cuts, [s])[0] for s in specs])
    grown, real = [], B.boost
    monkeypatch.setattr(B, "boost", lambda *a, **k: (grown.extend(a[3]), real(*a, **k))[1])
    assert as_json(B.boost_batches(blocks, COLS, cuts, specs, batch=2)) == want
    assert sorted((s.rate, s.rounds) for s in grown) == [(0.1, 4), (0.3, 4), (1.5, 9)]


def test_rounds_leave_the_rows_as_they_are(shared, monkeypatch):
    """Margins are neither kept nor moved between the stages."""
    blocks, cuts = shared
    moved, real = [], B._moved
    monkeypatch.setattr(B, "_moved", lambda *a: (moved.append(1), real(*a))[1])
    whole = as_json(B.boost(blocks, COLS, cuts, SPECS[:2], stage=20))
    assert not moved
    assert as_json(B.boost(blocks, COLS, cuts, SPECS[:2], stage=3)) == whole and len(moved) == 2


def test_auc_from_counted_scores(shared):
    from stayline.operators.evaluate import roc_auc_grouped, roc_auc_of_counts
    blocks, cuts = shared
    long, = B.boost(blocks, COLS, cuts, [B.Spec(train=(0, 1, 2, 3), rounds=5, depth=3)])
    short = [B.replace(long, trees=long.trees[:n]) for n in (0, 2, 5)]
    models, parts = [long, *short, long], [(4,)] * 4 + [(0, 4)]
    counts, place = B.block_counts(blocks, models, parts)
    assert place[0] == place[3] and len(set(place)) == 4
    got = {r.model: (r.roc_auc, r["rows"]) for r in roc_auc_of_counts(counts, ["model"], ["rows"]).collect()}
    rows = B.block_scores(blocks, models, parts).persist()
    n = {r.model: r["count"] for r in rows.groupBy("model").count().collect()}
    want = {r.model: r.roc_auc for r in roc_auc_grouped(rows, ["model"], "label", "churn_prob").collect()}
    assert [got[p] for p in place] == [(want[i], n[i]) for i in range(5)] and want[1] == 0.5


def test_batches_are_as_many_as_fill_the_cores(spark, shared, alone, monkeypatch):
    specs = [B.Spec(train=(0, 1), rounds=1, depth=1, rate=r / 10) for r in range(1, 9)]
    sizes, real = [], B.boost
    monkeypatch.setattr(B, "boost", lambda *a, **k: (sizes.append(len(a[3])), real(*a, **k))[1])
    B.boost_batches(alone, COLS, shared[1], specs, parallelism=4)
    assert sizes == [2] * 4                                             # a task each
    del sizes[:]
    B.boost_batches(shared[0].repartition(8), COLS, shared[1], specs, parallelism=8)
    assert sizes == [4] * 2
