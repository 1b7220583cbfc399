"""Histograms of packed features and of the smaller children only."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pytest

from stayline.operators import boosting as B


def test_sums_of_packed_features_and_smaller_children():
    rng = np.random.default_rng(2)
    widths = [2, 5, *[2] * 11, 1, 64]                                  # twelve features of two bins in two bytes, one of a single bin
    offsets = np.concatenate([[0], np.cumsum(widths)])
    n = 700
    bins = np.stack([rng.integers(0, w, n) for w in widths], 1).astype(np.uint8)
    r = B._Rows.__new__(B._Rows)
    r.part, r.y, r.w, r.bins, r.codes, r.hash = np.zeros(n, np.uint8), rng.integers(0, 2, n).astype(float), np.ones(n), bins, None, None
    m, spec, tree = rng.normal(size=n), B.Spec(train=(0,), depth=3, least=5), B._new_tree(3)
    p = 1 / (1 + np.exp(-m))
    g, h = np.round((r.y - p) * B.EXACT), np.round(p * (1 - p) * B.EXACT)
    assert len(B.packed_columns(offsets)) == 4
    above = None
    for level in range(3):
        got = B.node_sums(r, m, spec, tree, level, 0, offsets)
        assert len(got) == 3 * len(B.targets(tree, level)) * offsets[-1] + 2 and len(B.targets(tree, level)) <= max(1, (1 << level) // 2)
        above = B.all_sums(above, tree, level, got, offsets)
        node = B.leaf_of(bins, tree) - ((1 << level) - 1)
        want = np.zeros_like(above)
        for f in range(len(widths)):
            for k, weight in enumerate((g, h, np.ones(n))):
                np.add.at(want[k], (node[node >= 0], offsets[f] + bins[node >= 0, f]), weight[node >= 0])
        assert (above == want).all()
        assert B.choose_splits(tree, above, level, spec, offsets, np.ones(len(widths), bool))


def test_rows_move_as_far_as_asked():
    tree = {"feat": np.array([0, -1, 1, -1, -1, -1, -1]), "bin": np.array([1, 0, 0, 0, 0, 0, 0])}
    bins = np.array([[0, 0], [2, 0], [2, 1], [1, 1]], np.uint8)
    assert B.leaf_of(bins, tree).tolist() == [1, 5, 6, 1]
    assert B.leaf_of(bins, tree, np.array([1, 3]), 1).tolist() == [2, 1]
