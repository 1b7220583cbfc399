"""Boosted trees over binned blocks: many models side by side, in stages.

* **Shared input.**  The training table is binned once and written as blocks of
  ``BLOCK_ROWS`` rows in byte arrays (``training_blocks``).  Every model of a
  search reads the same blocks; a model is a ``Spec`` with the parts (split
  or fold codes) it learns from.
* **Histograms.**  One job per tree level: each task adds up, for all models of
  a batch, gradients, curvatures and rows per node and bin, and the driver
  chooses the splits from the sums, whose size doesn't depend on the rows.
  The rows' codes stay in executors' memory (or on their disks), one copy for all
  models of a search.  A task routes rows through trees as bits, a split
  being two operations on the bits of its rows, and evaluates the trees since
  the last stage for the rows that it adds up.  Ten features of two bins share a
  histogram column, and of two children only the smaller is added up.
  With more than ``FAN`` tasks the sums are added in a tree of jobs' tasks
  first.  Gradients are rounded to multiples of 2**-20, so sums are exact and
  the same in any order.  A table of one block needs no sums between tasks:
  its task grows a whole stage of trees, with the same result.
* **Stages.**  Every ``stage`` rounds the margins of all rows are written with
  the blocks, then the trees (kept in memory, where a run has no folder); a
  level then evaluates the trees since the last stage only.  A run that finds its own stages goes on from the last
  one and ends with the same model, because everything is deterministic.
* **Shared trees.**  Specs that differ in their rounds only are grown once, to
  the most rounds (``chains``).
* **Stopping.**  The log loss of the rows kept for validation is added up in the
  next round's first job; a model stops ``patience`` rounds after its best
  round and keeps the trees up to it.

A tree is a complete binary layout: node ``i`` has children ``2i+1`` and ``2i+2``;
rows go left if their bin is at most the node's.  Missing numbers are in the
last bin.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.errors import AnalysisException
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.operators.selection import quantiles
from stayline.session import scratch_path

BLOCK_ROWS = 16_384
BINS = 64                      # of a numeric feature, at most 256
FAN = 32                       # tasks whose sums the driver adds itself
STAGE = 25
HELD_ROWS = 8 * BLOCK_ROWS     # that a task handles at once
EXACT = 1 << 20
STOP = 255                     # cut of a node without a split: no bin is above
TWO = 10                       # features of two bins in a histogram column
BLOCKS = "block long, n int, key binary, hash binary, part binary, y binary, w binary, bins binary"


@dataclass
class Spec:
    """One model: parameters, and the part codes to learn from and to watch."""
    train: tuple
    valid: tuple = ()
    rounds: int = 650
    depth: int = 4
    rate: float = 0.1
    rows: float = 1.0          # share of rows per tree
    columns: float = 1.0       # share of features per tree
    least: int = 21            # rows of a leaf
    l2: float = 1.0
    patience: int | None = None
    seed: int = 42


@dataclass
class Boosted:
    """A fitted model: features, their cut points, trees, validation curve."""
    names: list
    cuts: list
    prior: float = 0.0
    trees: list = field(default_factory=list)
    curve: list = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps({"names": self.names, "cuts": [list(c) for c in self.cuts], "prior": self.prior, "curve": self.curve,
                           "trees": [{k: v.tolist() for k, v in t.items()} for t in self.trees]})

    @classmethod
    def from_json(cls, text: str) -> "Boosted":
        d = json.loads(text)
        types = {"feat": np.int64, "bin": np.int64, "value": float, "rows": float, "gain": float}
        return cls(d["names"], [np.array(c) for c in d["cuts"]], d["prior"], [{k: np.array(v, types[k]) for k, v in t.items()} for t in d["trees"]], d["curve"])

    def _full(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All trees with leaves in the last level only: feature and bin of
        every inner node, and the leaves' values (a line per tree)."""
        feat, cut, value = (np.stack([t[k] for t in self.trees]) for k in ("feat", "bin", "value"))
        inner = feat.shape[1] // 2
        for i in range(inner):                       # a leaf above passes its value down to the left
            stop = feat[:, i] < 0
            value[stop, 2 * i + 1] = value[stop, i]
        return np.maximum(feat[:, :inner], 0), np.where(feat[:, :inner] < 0, 255, cut[:, :inner]).astype(np.uint8), value[:, inner:]

    def margins(self, x: np.ndarray, rows: int = 2048) -> np.ndarray:
        """Log-odds of the rows of ``x`` (rows x features), all trees at once."""
        out = np.full(len(x), self.prior)
        if not self.trees:
            return out
        feat, cut, leaves = self._full()
        trees, inner = feat.shape
        first, level = np.arange(trees)[:, None] * inner, (inner + 1).bit_length() - 1
        for lo in range(0, len(x), rows):
            bins = to_bins(x[lo:lo + rows], self.cuts).T
            left = bins[feat.ravel()] <= cut.ravel()[:, None]                    # (tree, node) x row
            at, node = np.arange(bins.shape[1]), np.zeros((trees, bins.shape[1]), np.int64)
            for _ in range(level):
                node = 2 * node + 2 - left[first + node, at]
            out[lo:lo + rows] += np.take_along_axis(leaves, node - inner, 1).sum(0)
        return out

    def importance(self) -> dict:
        """Share of the total gain by feature; shares add up to 1."""
        total = np.zeros(len(self.names))
        for t in self.trees:
            inner = t["feat"] >= 0
            np.add.at(total, t["feat"][inner], t["gain"][inner])
        return dict(zip(self.names, total / total.sum())) if total.sum() else dict.fromkeys(self.names, 0.0)

    def node_tables(self) -> tuple[list, list]:
        """Trees and weights in the form that ``explain.tree_shap`` takes,
        whose margins are twice the weighted sum."""
        out = []
        for t in self.trees:
            inner, at = t["feat"] >= 0, np.arange(len(t["feat"]))
            out.append({"left": np.where(inner, 2 * at + 1, -1), "right": np.where(inner, 2 * at + 2, -1), "feat": np.maximum(t["feat"], 0),
                        "thr": np.array([float(self.cuts[f][b]) if f >= 0 else 0.0 for f, b in zip(t["feat"], t["bin"])]),
                        "cats": [None] * len(at), "val": t["value"], "cover": t["rows"]})
        return out, [0.5] * len(out)


def to_bins(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bin ``b`` holds values above cut ``b - 1`` and up to cut ``b``."""
    return np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)], 1).astype(np.uint8) if len(cuts) else np.zeros((len(x), 0), np.uint8)


def leaf_of(bins: np.ndarray, tree: dict, rows: np.ndarray | None = None, levels: int | None = None) -> np.ndarray:
    """The node where every row (or those in ``rows``) ends, or is after some levels."""
    feat, cut = tree["feat"], tree["bin"]
    levels = len(feat).bit_length() - 1 if levels is None else levels
    first, flat = (np.arange(len(bins)) if rows is None else rows) * bins.shape[1], bins.ravel()
    node, ends, on = np.zeros(len(first), np.int64), feat < 0, np.maximum(feat, 0)
    late, below = np.arange(len(feat)) * 2 + 2, np.where(ends, -1, cut)          # a leaf's rows stay
    stay = np.flatnonzero(ends)
    late[stay] = stay
    for _ in range(levels):
        node = late[node] - (flat[first + on[node]] <= below[node])
    return node


# -- shared input ----------------------------------------------------------------

def cut_points(df: DataFrame, names: Sequence[str], numeric: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Cut points of every feature: quantiles of the numeric columns (exact),
    one half for 0/1 slots."""
    probs = [i / bins for i in range(1, bins)]
    got = quantiles(df, list(numeric), [*probs, 1.0]) if numeric else {}
    out = []
    for name in names:
        if name in numeric:
            q = got.get(((), name), [0.0])
            out.append(np.array(sorted({x for x in q[:-1] if x < q[-1]}), float))
        else:
            out.append(np.array([0.5]))
    return out


def training_blocks(df: DataFrame, part: str, label: str = "label", weight: str | None = None, key: str = "customerID",
                    vec: str = "features", cuts: Sequence[np.ndarray] = (), partitions: int | None = None) -> DataFrame:
    """Rows as blocks of byte arrays, binned by ``cuts``; ``part`` holds codes
    from 0 to 255.  Written once, in partitions of a full block (or in
    ``partitions`` ones)."""
    cuts = [np.asarray(c, float) for c in cuts]
    rows = df.select(F.col(key).cast("long").alias("key"), F.xxhash64(key).alias("hash"), F.col(part).cast("int").alias("part"), F.col(label).cast("double").alias("y"),
                     (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"), vector_to_array(vec).alias("x"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= BLOCK_ROWS:
                t = pa.Table.from_batches(held)
                yield t.slice(0, BLOCK_ROWS)
                held, n = t.slice(BLOCK_ROWS).to_batches(), n - BLOCK_ROWS
        if n:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in packed(batches):
            get = lambda i, kind: t.column(i).to_numpy().astype(kind)  # noqa: E731, B023
            x = t.column(5).combine_chunks().flatten().to_numpy().reshape(t.num_rows, len(cuts))
            h = get(1, np.int64)
            cells = [h[:1].tolist(), [t.num_rows], *[[a.tobytes()] for a in (get(0, np.int64), h, get(2, np.uint8), get(3, np.float64), get(4, np.float64), to_bins(x, cuts))]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, (pa.int64(), pa.int32(), *[pa.binary()] * 6))], names=[f.split()[0] for f in BLOCKS.split(", ")])

    path = scratch_path(df.sparkSession, "boosting-blocks")
    rows.repartition(partitions or max(1, math.ceil(rows.count() / BLOCK_ROWS))).mapInArrow(run, BLOCKS).write.parquet(path)
    return df.sparkSession.read.schema(BLOCKS).parquet(path)


class _Rows:
    """One block as arrays."""
    codes: list | None = None      # of the histogram columns
    above: dict | None = None      # kept bits of ``bits_above``
    draws: dict | None = None      # and of ``drawn``, of one turn

    def __init__(self, batch: pa.RecordBatch, i: int, features: int):
        get = lambda name, t: np.frombuffer(batch.column(name)[i].as_py(), t)
        self.key, self.hash, self.part = get("key", np.int64), get("hash", np.uint64), get("part", np.uint8)
        self.y, self.w = get("y", np.float64), get("w", np.float64)
        self.bins = get("bins", np.uint8).reshape(len(self.key), features)
        self.margins = get("margins", np.float64).reshape(len(self.key), -1).T if "margins" in batch.schema.names else None    # a line per model

    def packed(self, offsets: np.ndarray) -> tuple[list, list]:
        """The histogram columns and the rows' codes in them."""
        columns = packed_columns(offsets)
        if self.codes is None:
            self.codes = [self.bins[:, c[0]].copy() if offsets[c[0] + 1] - offsets[c[0]] > 2 else sum(self.bins[:, f].astype(np.uint16) << np.uint16(i) for i, f in enumerate(c))
                          for c in columns]
        return columns, self.codes

    def bits_above(self, feature: int, cut: int, offsets: np.ndarray) -> np.ndarray:
        """The rows above a cut of a feature, a bit each."""
        if self.above is None:
            self.above = {}
        got = self.above.get((feature, cut))
        if got is None:
            columns, codes = self.packed(offsets)
            c, i = next((c, x.index(feature)) for c, x in enumerate(columns) if feature in x)
            wide = offsets[feature + 1] - offsets[feature] > 2
            got = np.packbits(codes[c] > cut if wide else (codes[c] & np.uint16(1 << i)) > cut)
            self.above[feature, cut] = got
        return got


def _joined(blocks: list[_Rows], hashed: bool) -> _Rows:
    """What the rounds read of some blocks."""
    both = lambda arrays: np.concatenate(list(arrays), -1)
    r = _Rows.__new__(_Rows)
    r.key, r.bins, r.hash = None, None, both(b.hash for b in blocks) if hashed else None
    r.part, r.y, r.w = both(b.part for b in blocks), both(b.y for b in blocks), both(b.w for b in blocks)
    r.codes = [both(c) for c in zip(*[b.codes for b in blocks])]
    r.margins = None if blocks[0].margins is None else both(b.margins for b in blocks)
    r.y = r.y.astype(np.uint8) if ((r.y == 0) | (r.y == 1)).all() else r.y
    r.w = None if (r.w == 1).all() else r.w
    return r


def _joined_blocks(blocks: Iterator[_Rows], offsets: np.ndarray, hashed: bool) -> Iterator[_Rows]:
    some, n = [], 0
    for r in blocks:
        r.packed(offsets)
        some.append(r)
        n += len(r.y)
        if n >= HELD_ROWS:
            yield _joined(some, hashed)
            some, n = [], 0
    if some:
        yield _joined(some, hashed)


def _some(r: _Rows, on: np.ndarray) -> _Rows:
    """Codes and labels of some joined rows."""
    out = _Rows.__new__(_Rows)
    out.part, out.y, out.codes = r.part[on], r.y[on], [c[on] for c in r.codes]
    return out


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (2 ** 64 - 1))
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def drawn(rows: _Rows, spec: Spec, turn: int) -> np.ndarray:
    """The rows that a tree learns from, a bit each.  Models of a seed share
    the hashes of a turn, so they are mixed once."""
    if rows.draws is None or rows.draws["turn"] != turn:
        rows.draws = {"turn": turn}

    def kept(key: tuple, make: Callable[[], np.ndarray]) -> np.ndarray:
        if key not in rows.draws:
            rows.draws[key] = make()
        return rows.draws[key]

    on = kept(("train", spec.train), lambda: np.packbits(np.isin(rows.part, spec.train)))
    if spec.rows >= 1:
        return on
    mixed = lambda: kept(("hash", spec.seed), lambda: _mixed(rows.hash, spec.seed * 100_003 + turn + 1))
    return on & kept(("share", spec.seed, spec.rows), lambda: np.packbits(mixed() < np.uint64(int(spec.rows * 2 ** 64))))


def features_of(spec: Spec, turn: int, n: int) -> np.ndarray:
    """The features that a tree may split on."""
    keep = np.ones(n, bool)
    if spec.columns < 1:
        keep[:] = False
        keep[np.random.default_rng([spec.seed, turn]).permutation(n)[:max(1, round(spec.columns * n))]] = True
    return keep


# -- growing -----------------------------------------------------------------------

def packed_columns(offsets: np.ndarray) -> list[list[int]]:
    """Features by histogram column: those of two bins ten to a column."""
    few = np.diff(offsets) <= 2
    two = np.flatnonzero(few).tolist()
    return [[f] for f in np.flatnonzero(~few).tolist()] + [two[i:i + TWO] for i in range(0, len(two), TWO)]


def targets(tree: dict, level: int) -> list[int]:
    """The level's nodes that are added up: of two children the one with fewer
    rows.  Sums are exact, so the other's are the parent's less these."""
    if not level:
        return [0]
    rows = tree["rows"]
    return [2 * n + (1 if rows[2 * n + 1] <= rows[2 * n + 2] else 2) for n in range((1 << level - 1) - 1, (1 << level) - 1) if tree["feat"][n] >= 0]


def routed(r: _Rows, feat: list, cut: list, levels: int, offsets: np.ndarray, start: np.ndarray | None = None, left: bool = True) -> tuple[list, list]:
    """The rows (of ``start``, a bit each; all if none) at every node of the last
    of ``levels`` levels (``left``: left ones too), and per level those that go right.  A node without a
    split (cut ``STOP``) passes its rows down to the left; ``False`` is no row."""
    nodes, right = [start], []
    for level in range(levels):
        first, below, gone = (1 << level) - 1, [], None
        for i, bits in enumerate(nodes):
            if bits is False or cut[first + i] == STOP:
                below += [bits, False]
                continue
            go = r.bits_above(feat[first + i], cut[first + i], offsets)
            if bits is not None:
                go = bits & go
            if left or level < levels - 1:
                below += [~go if bits is None else bits ^ go, go]
            gone = go if gone is None else gone | go
        nodes = below
        right.append(gone)
    return nodes, right


def leaf_places(r: _Rows, feat: list, cut: list, levels: int, offsets: np.ndarray) -> np.ndarray:
    """The place in the last level where every row ends."""
    place = np.zeros(len(r.y), np.uint8 if levels <= 8 else np.int64)
    for gone in routed(r, feat, cut, levels, offsets, left=False)[1]:
        place += place
        if gone is not None:
            place += np.unpackbits(gone, count=len(place))
    return place


def full_trees(trees: list) -> list[tuple]:
    """(features, cuts, leaf values, levels) of trees whose leaves are all passed
    down to the last level."""
    if not trees:
        return []
    feat, cut, value = Boosted([], [], 0.0, trees)._full()
    return [(f.tolist(), c.tolist(), v, len(v).bit_length() - 1) for f, c, v in zip(feat, cut, value)]


class _Margins:
    """Margins of a block's rows by one model: the kept ones, or the prior, and
    the trees since then, added in their order."""

    def __init__(self, r: _Rows, col: int, prior: float, trees: list[tuple], offsets: np.ndarray):
        self.r, self.col, self.prior, self.trees, self.offsets = r, col, prior, trees, offsets

    def take(self, rows: np.ndarray) -> np.ndarray:
        m = np.full(len(rows), self.prior) if self.r.margins is None else self.r.margins[self.col].take(rows)
        for feat, cut, value, levels in self.trees:
            m += value.take(leaf_places(self.r, feat, cut, levels, self.offsets).take(rows))
        return m

    def every(self) -> np.ndarray:
        m = np.full(len(self.r.y), self.prior) if self.r.margins is None else self.r.margins[self.col].copy()
        for feat, cut, value, levels in self.trees:
            m += value.take(leaf_places(self.r, feat, cut, levels, self.offsets))
        return m


def _rows_of(bits: np.ndarray | bool, n: int) -> np.ndarray:
    return np.zeros(0, np.int64) if bits is False else np.flatnonzero(np.unpackbits(bits, count=n).view(bool))


def node_sums(r: _Rows, m: np.ndarray | _Margins, spec: Spec, tree: dict | None, level: int, turn: int, offsets: np.ndarray) -> np.ndarray:
    """Gradients, curvatures and rows per target node and bin of the level,
    then (level 0) the validation rows' loss and weight; ``m`` are the margins."""
    wanted = targets(tree, level) if tree else []
    nodes, total = len(wanted), int(offsets[-1])
    loss = np.zeros(2)
    if not level and spec.valid:
        v = np.flatnonzero(np.isin(r.part, spec.valid))
        mv, wv = m.take(v), np.ones(len(v)) if r.w is None else r.w[v]
        loss[:] = np.round(wv * np.logaddexp(0, np.where(r.y[v] > 0, -mv, mv)) * EXACT).sum(), np.round(wv * EXACT).sum()
    if tree is None:
        return loss
    bits, place = [drawn(r, spec, turn)], None
    if level:
        at = routed(r, tree["feat"].tolist(), np.where(tree["feat"] < 0, STOP, tree["bin"]).tolist(), level, offsets, bits[0])[0]
        bits = [at[n - ((1 << level) - 1)] for n in wanted]
    on = [_rows_of(b, len(r.y)) for b in bits]
    if nodes > 1:
        place = np.repeat(np.arange(nodes), [len(x) for x in on])
    on = on[0] if nodes == 1 else np.concatenate(on)
    p = 1 / (1 + np.exp(-m.take(on)))
    g, h = r.y.take(on) - p, p * (1 - p)
    if r.w is not None:
        w = r.w.take(on)
        g, h = w * g, w * h
    g, h = np.round(g * EXACT), np.round(h * EXACT)
    # rows are counted in the high digits of the curvatures, if both fit a double exactly
    digit = float(1 << int(h.sum()).bit_length())
    one = len(on) * digit + digit <= 2.0 ** 53
    weights = (g, h + digit) if one else (g, h, None)
    own, bases = np.zeros((len(weights), nodes, total)), {}
    for features, codes in zip(*r.packed(offsets)):
        wide = offsets[features[0] + 1] - offsets[features[0]] > 2
        size = int(offsets[features[0] + 1] - offsets[features[0]]) if wide else 1 << len(features)
        code = codes.take(on)
        if place is None:
            code = code.astype(np.int64)
        else:
            if size not in bases:
                bases[size] = place * size
            code = code + bases[size]
        for k, weight in enumerate(weights):
            cells = np.bincount(code, weight, nodes * size).reshape(nodes, size)
            if wide:
                own[k, :, offsets[features[0]]:offsets[features[0] + 1]] = cells
                continue
            every, ones = cells.sum(1), cells @ _bits_of(len(features))
            for i, f in enumerate(features):
                lo, two = offsets[f], offsets[f + 1] - offsets[f] == 2
                own[k, :, lo] = every - ones[:, i] if two else every
                if two:
                    own[k, :, lo + 1] = ones[:, i]
    if one:
        count = np.floor(own[1] / digit)
        own = np.stack([own[0], own[1] - count * digit, count])
    return np.append(own.ravel(), loss)


@cache
def _bits_of(features: int) -> np.ndarray:
    """The bits of every code of a column of two-bin features."""
    return ((np.arange(1 << features)[:, None] >> np.arange(features)) & 1).astype(float)


def all_sums(above: np.ndarray | None, tree: dict, level: int, got: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(3, nodes, bins) of the whole level from the sums of its target nodes and
    those of the level above."""
    wanted, nodes, first, total = targets(tree, level), 1 << level, (1 << level) - 1, int(offsets[-1])
    out = np.zeros((3, nodes, total))
    for i, n in enumerate(wanted):
        out[:, n - first] = own = got[:3 * len(wanted) * total].reshape(3, -1, total)[:, i]
        if level:
            out[:, (n + 1 if n % 2 else n - 1) - first] = above[:, (n - 1) // 2 - (nodes // 2 - 1)] - own
    return out


def _held(blocks: DataFrame, specs: Sequence[Spec], features: int, offsets: np.ndarray) -> RDD:
    """The blocks as ``_Rows``, some joined, kept in memory (or on disk) while
    rounds read them, in a partition a core where there are more.  They hold the margins
    of the last stage only: a round evaluates the trees since then, which costs
    less than to move margins to the tasks and back."""
    hashed, spark = any(s.rows < 1 for s in specs), blocks.sparkSession

    def rows(part: Iterator) -> Iterator[_Rows]:
        return _joined_blocks((_Rows(pa.RecordBatch.from_pylist([row.asDict()]), 0, features) for row in part), offsets, hashed)

    got, tasks = blocks.rdd, spark.sparkContext.defaultParallelism
    if got.getNumPartitions() > 2 * tasks:
        got = got.coalesce(tasks)
    return got.mapPartitions(rows).persist(StorageLevel.MEMORY_AND_DISK)


def _moved(held: RDD, priors: list[float], trees: list[list], offsets: np.ndarray) -> RDD:
    """The held rows with the margins after a stage."""
    late = [full_trees(t) for t in trees]

    def run(part: Iterator[_Rows]) -> Iterator[_Rows]:
        for r in part:
            r.margins = np.stack([_Margins(r, k, p, t, offsets).every() for k, (p, t) in enumerate(zip(priors, late))])
            r.above = None
            yield r

    return held.mapPartitions(run).persist(StorageLevel.MEMORY_AND_DISK)


def _level_sums(held: RDD, jobs: list[tuple], offsets: np.ndarray, turn: int) -> dict:
    """``node_sums`` over all rows for every job: (model, spec, tree being grown
    or None, level, prior, trees since the held margins)."""
    def run(part: Iterator[_Rows]) -> Iterator[dict]:
        sums = {}
        for r in part:
            for model, spec, tree, level, prior, late in jobs:
                own = node_sums(r, _Margins(r, model, prior, late, offsets), spec, tree, level, turn, offsets)
                sums[model] = sums[model] + own if model in sums else own
        yield sums

    def add(a: dict, b: dict) -> dict:
        return {k: a[k] + b[k] if k in a and k in b else a.get(k, b.get(k)) for k in {**a, **b}}

    got = held.mapPartitions(run)
    return got.treeReduce(add) if got.getNumPartitions() > FAN else reduce(add, got.collect(), {})


def choose_splits(tree: dict, sums: np.ndarray, level: int, spec: Spec, offsets: np.ndarray, allowed: np.ndarray) -> int:
    """Split the level's nodes where it gains; leaf values of the others and of
    all new nodes.  Returns the number of splits."""
    nodes, total = 1 << level, int(offsets[-1])
    g, h, n = sums.reshape(3, nodes, total) / np.array([EXACT, EXACT, 1.0])[:, None, None]
    start = np.repeat(offsets[:-1], np.diff(offsets))
    left = []
    for x in (g, h, n):
        run = np.concatenate([np.zeros((nodes, 1)), np.cumsum(x, 1)], 1)
        left.append((run[:, 1:] - run[:, start], (run[:, offsets[1]] - run[:, 0])[:, None]))
    (gl, gs), (hl, hs), (nl, ns) = left
    score = lambda a, b: a * a / (b + spec.l2)
    gain = score(gl, hl) + score(gs - gl, hs - hl) - score(gs, hs)
    ok = (nl >= spec.least) & (ns - nl >= spec.least) & np.repeat(allowed, np.diff(offsets))
    ok[:, offsets[1:] - 1] = False                   # nothing is above a feature's last bin
    gain = np.where(ok, gain, -np.inf)
    best, first = gain.argmax(1), (1 << level) - 1
    made = 0
    for i in range(nodes):
        node, at = first + i, best[i]
        if level and tree["feat"][(node - 1) // 2] < 0 or not ns[i, 0]:
            continue
        if not level:
            tree["rows"][0], tree["value"][0] = ns[i, 0], spec.rate * gs[i, 0] / (hs[i, 0] + spec.l2)
        if gain[i, at] <= 1e-9:
            continue
        f = int(np.searchsorted(offsets, at, "right")) - 1
        tree["feat"][node], tree["bin"][node], tree["gain"][node] = f, at - offsets[f], gain[i, at]
        for child, (a, b, c) in ((2 * node + 1, (gl[i, at], hl[i, at], nl[i, at])), (2 * node + 2, (gs[i, 0] - gl[i, at], hs[i, 0] - hl[i, at], ns[i, 0] - nl[i, at]))):
            tree["value"][child], tree["rows"][child] = spec.rate * a / (b + spec.l2), c
        made += 1
    return made


def stopped(curve: list, patience: int | None) -> bool:
    """No better validation loss for ``patience`` rounds."""
    return bool(patience) and len(curve) > patience and len(curve) - 1 - int(np.argmin(curve)) >= patience


def grow_tree(spec: Spec, turn: int, offsets: np.ndarray, sums_of: Callable[[dict, int], np.ndarray], curve: list) -> dict:
    """One tree, level by level, from the sums that ``sums_of`` gives."""
    tree, allowed, above = _new_tree(spec.depth), features_of(spec, turn, len(offsets) - 1), None
    for level in range(spec.depth):
        if level and not (tree["feat"][(1 << level - 1) - 1:(1 << level) - 1] >= 0).any():
            break
        sums = sums_of(tree, level)
        above = all_sums(above, tree, level, sums, offsets)
        choose_splits(tree, above, level, spec, offsets, allowed)
        if not level and sums[-1]:
            curve.append(float(sums[-2] / sums[-1]))
    return tree


def _stage_of_one_block(blocks: DataFrame, jobs: list[tuple], offsets: np.ndarray, turn: int, stage: int) -> dict:
    """{model: (trees, curve)} of the next ``stage`` rounds, where one task has
    all rows: jobs are (model, spec, prior, trees since the stage, curve)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, out = _Rows(batch, 0, len(offsets) - 1), []
            for model, spec, prior, since, curve in jobs:
                m, trees, curve = _Margins(r, model, prior, full_trees(since), offsets).every(), [], list(curve)
                for t in range(turn, min(turn + stage, spec.rounds)):
                    if stopped(curve, spec.patience):
                        break
                    trees.append(grow_tree(spec, t, offsets, lambda tree, level: node_sums(r, m, spec, tree, level, t, offsets), curve))  # noqa: B023
                    (feat, cut, value, levels), = full_trees(trees[-1:])
                    m += value.take(leaf_places(r, feat, cut, levels, offsets))
                out.append(Boosted([], [], 0.0, trees, curve).to_json())
            yield pa.RecordBatch.from_arrays([pa.array([j[0] for j in jobs], pa.int32()), pa.array(out)], names=["model", "json"])

    got = {row.model: Boosted.from_json(row.json) for row in blocks.mapInArrow(run, "model int, json string").collect()}
    return {i: (m.trees, m.curve) for i, m in got.items()}


def _new_tree(depth: int) -> dict:
    n = (2 << depth) - 1
    return {"feat": np.full(n, -1), "bin": np.zeros(n, np.int64), "value": np.zeros(n), "rows": np.zeros(n), "gain": np.zeros(n)}


def _priors(blocks: DataFrame, specs: Sequence[Spec]) -> list[float]:
    def run(batches):
        one, all_w = np.zeros(256), np.zeros(256)
        for batch in batches:
            for row in batch.to_pylist():
                part, y, w = (np.frombuffer(row[c], t) for c, t in (("part", np.uint8), ("y", np.float64), ("w", np.float64)))
                one += np.bincount(part, np.round(w * y * EXACT), 256)
                all_w += np.bincount(part, np.round(w * EXACT), 256)
        yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(one), pa.array(all_w)], names=["part", "one", "every"])

    got = blocks.select("part", "y", "w").mapInArrow(run, "part int, one double, every double").groupBy("part").agg(F.sum("one"), F.sum("every")).collect()
    one, every = {r[0]: r[1] for r in got}, {r[0]: r[2] for r in got}
    out = []
    for s in specs:
        a, b = sum(one.get(p, 0) for p in s.train), sum(every.get(p, 0) for p in s.train)
        out.append(math.log(a / (b - a)) if 0 < a < b else 0.0)
    return out


def fingerprint(blocks: DataFrame) -> str:
    """A checksum of the training rows, independent of their order."""
    r = blocks.agg(F.sum("n"), *[F.sum(F.xxhash64(c, "block").cast("decimal(20,0)")) for c in ("key", "part", "y", "w", "bins")]).first()
    return hashlib.sha256(str(tuple(r)).encode()).hexdigest()[:24]


def _stages(spark: SparkSession, path: str) -> tuple[int, list[str]] | None:
    """Round and models of the last whole stage below ``path``."""
    try:
        rows = spark.read.parquet(f"{path}/models").collect()
    except AnalysisException:
        return None
    last = max(r["round"] for r in rows)
    return last, [r["json"] for r in sorted((r for r in rows if r["round"] == last), key=lambda r: r["model"])]


def _with_margins(blocks: DataFrame, models: list[Boosted], since: list[list], features: int, offsets: np.ndarray) -> DataFrame:
    priors, late = [m.prior for m in models], [full_trees(t) for t in since]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                r = _Rows(batch, i, features)
                out.append(np.stack([_Margins(r, k, p, t, offsets).every() for k, (p, t) in enumerate(zip(priors, late))], 1).tobytes())
            own = batch.drop_columns(["margins"]) if "margins" in batch.schema.names else batch
            yield own.append_column("margins", pa.array(out, pa.binary()))

    return blocks.mapInArrow(run, BLOCKS + ", margins binary")


def boost(blocks: DataFrame, names: Sequence[str], cuts: Sequence[np.ndarray], specs: Sequence[Spec], path: str | None = None, stage: int = STAGE,
          stop_after: int | None = None, rows: RDD | None = None) -> list[Boosted]:
    """Fit all ``specs`` side by side over ``blocks``.  Stages are kept below
    ``path`` (in memory only if none), and a run over the same rows and
    specs goes on from the last one.  ``stop_after`` ends the run early, after
    that many rounds (to try a restart).  ``rows`` are the blocks as held rows,
    where several runs share them."""
    spark, features = blocks.sparkSession, len(names)
    offsets = bin_offsets(cuts)
    done, alone = _stages(spark, path) if path else None, rows is None and blocks.count() == 1
    if done:
        turn, models = done[0], [Boosted.from_json(j) for j in done[1]]
        at = spark.read.schema(BLOCKS + ", margins binary").parquet(f"{path}/blocks-{turn:05d}")
    else:
        turn, at = 0, blocks
        models = [Boosted(list(names), list(cuts), p) for p in _priors(blocks, specs)]
    since, late = [[] for _ in specs], [[] for _ in specs]           # trees since the rows ``at``, and as ``full_trees`` since the held rows

    def live(i: int) -> bool:
        return turn < specs[i].rounds and len(models[i].trees) == turn and not stopped(models[i].curve, specs[i].patience)

    def write() -> None:
        _with_margins(at, models, since, features, offsets).write.mode("overwrite").parquet(f"{path}/blocks-{turn:05d}")
        _keep(spark, path, turn, models)

    held, kept = rows if not done else None, []       # the rows that rounds read, and those of this run that are in memory
    try:
        while True:
            ids = [i for i in range(len(specs)) if live(i)]
            if not ids or stop_after is not None and turn >= stop_after:
                break
            rounds = min(stage - turn % stage, max(specs[i].rounds for i in ids) - turn, *([stop_after - turn] if stop_after else [])) if alone else 1
            if alone:
                got = _stage_of_one_block(at, [(i, specs[i], models[i].prior, since[i], models[i].curve) for i in ids], offsets, turn, rounds)
            else:
                if held is None:
                    held = _held(at, specs, features, offsets)
                    kept.append(held)
                got = _round(held, ids, specs, models, late, offsets, turn)
                while len(kept) > 1:
                    kept.pop(0).unpersist()
            for i, (trees, curve) in got.items():
                models[i].trees, models[i].curve = models[i].trees + trees, curve
                since[i] = since[i] + trees
                late[i] = late[i] + full_trees(trees)
            turn += rounds
            if turn % stage == 0 and any(live(i) for i in range(len(specs))):
                if path:
                    write()
                    at, held = spark.read.schema(BLOCKS + ", margins binary").parquet(f"{path}/blocks-{turn:05d}"), None
                elif not alone:
                    held = _moved(held, [m.prior for m in models], since, offsets)
                    kept.append(held)
                if path or not alone:
                    since, late = [[] for _ in specs], [[] for _ in specs]
        if stop_after is not None and any(live(i) for i in range(len(specs))):
            return models
        if path and (not done or done[0] < turn):                # an equal run finds the whole model
            write()
        watched = [i for i, s in enumerate(specs) if s.valid and len(models[i].curve) == len(models[i].trees)]
        if watched:
            if held is None:
                held = _held(at, specs, features, offsets)
                kept.append(held)
            for i, own in _level_sums(held, [(i, specs[i], None, 0, models[i].prior, late[i]) for i in watched], offsets, turn).items():
                if own[-1]:
                    models[i].curve.append(float(own[-2] / own[-1]))          # of the whole model
    finally:
        for rows in kept:
            rows.unpersist()
    for m, s in zip(models, specs):
        if s.patience and m.curve:
            m.trees = m.trees[:int(np.argmin(m.curve))]
    return models


def bin_offsets(cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Where every feature's bins begin in the histograms."""
    return np.concatenate([[0], np.cumsum([len(c) + 1 for c in cuts])]).astype(np.int64)


def _round(held: RDD, ids: list[int], specs: Sequence[Spec], models: list[Boosted], late: list[list], offsets: np.ndarray, turn: int) -> dict:
    """{model: ([tree], curve)} of one round: a job per level for all models."""
    trees, curves, above = {i: _new_tree(specs[i].depth) for i in ids}, {i: list(models[i].curve) for i in ids}, dict.fromkeys(ids)
    for level in range(max(specs[i].depth for i in ids)):
        grow = [i for i in ids if level < specs[i].depth and (not level or (trees[i]["feat"][(1 << level - 1) - 1:(1 << level) - 1] >= 0).any())]
        if not grow:
            break
        sums = _level_sums(held, [(i, specs[i], trees[i], level, models[i].prior, late[i]) for i in grow], offsets, turn)
        for i in grow:
            own = sums.get(i, np.zeros(3 * len(targets(trees[i], level)) * int(offsets[-1]) + 2))
            above[i] = all_sums(above[i], trees[i], level, own, offsets)
            choose_splits(trees[i], above[i], level, specs[i], offsets, features_of(specs[i], turn, len(offsets) - 1))
            if not level and own[-1]:
                curves[i].append(float(own[-2] / own[-1]))
    return {i: ([trees[i]], curves[i]) for i in ids}


def _keep(spark: SparkSession, path: str, turn: int, models: list[Boosted]) -> None:
    rows = [(turn, i, m.to_json()) for i, m in enumerate(models)]
    spark.createDataFrame(rows, "round int, model int, json string").coalesce(1).write.mode("append").parquet(f"{path}/models")


def chains(specs: Sequence[Spec]) -> tuple[list[Spec], list[int]]:
    """The different models that ``specs`` ask for, and every spec's place among
    them.  Specs that differ in their rounds only are one model, the shorter
    ones its first trees, unless a model chooses its own length."""
    longest = {}
    for s in specs:
        key = repr(s if s.patience else replace(s, rounds=0))
        if key not in longest or longest[key].rounds < s.rounds:
            longest[key] = s
    place = {key: i for i, key in enumerate(longest)}
    return list(longest.values()), [place[repr(s if s.patience else replace(s, rounds=0))] for s in specs]


def boost_batches(blocks: DataFrame, names: Sequence[str], cuts: Sequence[np.ndarray], specs: Sequence[Spec], batch: int = 40, parallelism: int = 8) -> list[Boosted]:
    """``boost`` for many specs: batches of at most ``batch`` models, ``parallelism``
    batches at a time.  All batches read the same held rows, and trees that
    several specs share are grown once.  A table of one block has a task per
    batch; where a batch's own tasks fill the cores, two batches do."""
    own, place = chains(specs)
    order = sorted(range(len(own)), key=lambda i: (own[i].rounds, own[i].depth))              # models of a batch end together
    held = None if blocks.count() == 1 else _held(blocks, own, len(names), bin_offsets(cuts))
    many = parallelism if held is None else min(parallelism, max(2, -(-2 * blocks.sparkSession.sparkContext.defaultParallelism // held.getNumPartitions())))
    batch = min(batch, max(1, -(-len(own) // many)))
    groups = [order[k:k + batch] for k in range(0, len(order), batch)]
    try:
        with ThreadPoolExecutor(parallelism) as pool:
            got = list(pool.map(lambda ids: boost(blocks, names, cuts, [own[i] for i in ids], rows=held), groups))
    finally:
        if held:
            held.unpersist()
    grown = {i: m for ids, models in zip(groups, got) for i, m in zip(ids, models)}
    return [m if s.patience else replace(m, trees=m.trees[:s.rounds], curve=m.curve[:s.rounds + 1]) for s, m in zip(specs, (grown[i] for i in place))]


# -- scoring -------------------------------------------------------------------------

def block_scores(blocks: DataFrame, models: Sequence[Boosted], parts: Sequence[tuple] | None = None) -> DataFrame:
    """(model, customerID, part, label, churn_prob) of the training rows;
    ``parts[i]`` restricts model ``i`` to these part codes."""
    models = list(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = _Rows(batch, i, len(models[0].names))
                for k, m in enumerate(models):
                    on = np.flatnonzero(np.isin(r.part, parts[k])) if parts else np.arange(len(r.y))
                    out = np.full(len(on), m.prior)
                    for t in m.trees:
                        out += t["value"][leaf_of(r.bins[on], t)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(on), k, np.int32)), pa.array(r.key[on]), pa.array(r.part[on].astype(np.int32)), pa.array(r.y[on]),
                                                      pa.array(1 / (1 + np.exp(-out)))], names=["model", "customerID", "part", "label", "churn_prob"])

    return blocks.mapInArrow(run, "model int, customerID long, part int, label double, churn_prob double")


def block_counts(blocks: DataFrame, models: Sequence[Boosted], parts: Sequence[tuple]) -> tuple[DataFrame, list[int]]:
    """How often every model gives a score to the rows of its ``parts``: (model,
    score, pos, neg, rows), counted in the tasks first, and every model's number
    there.  Models that begin with the same trees are evaluated in one pass,
    equal ones have one number."""
    offsets, number, longest = bin_offsets(models[0].cuts), {}, {}
    trees = [tuple(map(id, m.trees)) for m in models]
    for m, t, p in sorted(zip(models, trees, parts), key=lambda x: -len(x[1])):
        begins = next((key for key in longest if key[0] == p and key[1] == m.prior and key[2][:len(t)] == t), None)
        key = begins or (p, m.prior, t)
        longest.setdefault(key, (full_trees(m.trees), {}))[1].setdefault(len(t), number.setdefault((p, m.prior, t), len(number)))
    jobs = [(p, prior, *x) for (p, prior, _), x in longest.items()]

    def scores(r: _Rows) -> Iterator[pa.RecordBatch]:
        own = {}
        for p, prior, late, wanted in jobs:
            if p not in own:
                own[p] = _some(r, np.flatnonzero(np.isin(r.part, p)))
            o = own[p]
            m = np.full(len(o.y), prior)
            for length in range(len(late) + 1):
                if length:
                    feat, cut, value, levels = late[length - 1]
                    m += value.take(leaf_places(o, feat, cut, levels, offsets))
                if length in wanted:
                    score, at = np.unique(1 / (1 + np.exp(-m)), return_inverse=True)
                    count = lambda on: np.bincount(at[on], minlength=len(score))  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), wanted[length], np.int32)), pa.array(score), *[pa.array(count(on)) for on in (o.y == 1, o.y == 0, slice(None))]],
                                                     names=["model", "score", "pos", "neg", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _joined_blocks((_Rows(b, i, len(offsets) - 1) for b in batches for i in range(b.num_rows)), offsets, False):
            yield from scores(r)

    counted = blocks.mapInArrow(run, "model int, score double, pos long, neg long, rows long")
    counted = counted.groupBy("model", "score").agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "rows")])
    return counted, [number[p, m.prior, t] for m, t, p in zip(models, trees, parts)]


def with_margin(df: DataFrame, model: Boosted, vec: str = "features", name: str = "churn_margin") -> DataFrame:
    """Encoded rows with the model's log-odds."""
    width = len(model.names)

    @F.arrow_udf("double")
    def run(x: pa.Array) -> pa.Array:
        return pa.array(model.margins(x.flatten().to_numpy().reshape(len(x), width)))

    return df.withColumn(name, run(vector_to_array(vec)))
