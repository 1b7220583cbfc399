"""k-prototypes over blocks against plain loops over the rows."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from stayline.operators import segments as S


def _rows(n: int = 300) -> list:
    rng = random.Random(5)
    return [(i, rng.gauss(0, 1), rng.gauss(3, 2), rng.choice("abc"), rng.choice(["x", None, "y", "z"])) for i in range(n)]


@pytest.fixture(scope="module")
def fitted(spark):
    df = spark.createDataFrame(_rows(), "customerID long, u double, v double, p string, q string")
    _, blocks, levels = S._fit_input(df, ["u", "v"], ["p", "q"], {"u": (0.0, 1.0), "v": (0.0, 1.0)})
    return blocks, levels


ROWS = [(i, (u, v), (p, q or "nan")) for i, u, v, p, q in _rows()]


@pytest.mark.parametrize("direct", [64, 0])
def test_sums_equal_plain_loops(fitted, monkeypatch, direct):
    monkeypatch.setattr(S, "DIRECT", max(direct, 1))
    blocks, levels = fitted
    blocks = blocks if direct else blocks.unionByName(blocks.limit(0)).repartition(3)
    models = [[([0.0, 3.0], ["a", "x"])], [([0.0, 3.0], ["a", "x"]), ([0.0, 3.0], ["a", "x"]), ([1.0, 1.0], ["c", "unseen"])]]
    got = {(r["model"], r["seg"]): r for r in S._partial_sums(blocks, models, 0.5, 2, levels)}
    want: dict = {}
    for m, protos in enumerate(models):
        for _, z, c in ROWS:
            d = [sum((a - b) ** 2 for a, b in zip(z, pz)) + 0.5 * sum(a != b for a, b in zip(c, pc)) for pz, pc in protos]
            want.setdefault((m, d.index(min(d))), []).append((min(d), z, c))
    assert set(got) == set(want)
    names = [x for lv in levels for x in sorted(lv)]
    split = len(levels[0])
    for k, rows in want.items():
        r = got[k]
        assert r["n"] == len(rows) and r["cost"] == pytest.approx(sum(x[0] for x in rows))
        assert [r["s0"], r["s1"]] == pytest.approx([sum(x[1][i] for x in rows) for i in range(2)])
        assert [r[f"l{i}"] for i in range(len(names))] == [sum(x[2][i >= split] == v for x in rows) for i, v in enumerate(names)]
        far = max(rows, key=lambda x: (x[0], x[1]))
        assert r["far"]["far"] == pytest.approx(far[0]) and tuple(r["far"]["far_c"]) == far[2]


def test_seeds_equal_plain_loops(fitted):
    blocks, levels = fitted
    got = S.cao_init(blocks, 4, 2, 2, 7, levels)
    seeds: list = []
    while len(seeds) < 4:
        def score(r):
            n = sum(lv[x] for lv, x in zip(levels, r[2]))
            s = min(n * sum(a != b for a, b in zip(r[2], t[2])) for t in seeds) if seeds else n
            return s, hashlib.md5(f"7:{r[0]}".encode()).hexdigest()
        seeds.append(max(ROWS, key=score))
    assert [(tuple(z), tuple(c)) for z, c in got] == [(z, c) for _, z, c in seeds]


def test_rows_are_spread_over_the_cores(spark):
    """One partition of rows was one task per pass, whatever the table's size."""
    df = spark.range(20000).coalesce(1).select(F.col("id").alias("customerID"), (F.col("id") % 7).cast("double").alias("u"), F.lit("a").alias("p"))
    _, blocks, _ = S._fit_input(df, ["u"], ["p"], None)
    assert blocks.rdd.getNumPartitions() >= 4 and blocks.agg(F.sum("n")).first()[0] == 20000


def test_rows_of_nan_go_to_the_first_prototype(spark):
    df = spark.createDataFrame([(i, float("nan"), "a") for i in range(5)], "customerID long, u double, p string")
    _, blocks, levels = S._fit_input(df, ["u"], ["p"], {"u": (0.0, 1.0)})
    row, = S._partial_sums(blocks, [[([0.0], ["a"]), ([1.0], ["a"])]], 0.5, 1, levels)
    assert (row["seg"], row["n"]) == (0, 5) and row["cost"] != row["cost"]
