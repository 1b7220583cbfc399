"""Explanations.

* Linear SHAP (X2) for the deployed linear score: phi_j = w_j (x_j - E[x_j])
  with E over the batch (a one-row aggregate, broadcast).  Exact, columnar.
* Per-row top drivers (X3/X11) sort an array of (|phi|, name) structs inside
  each row: no window, no shuffle.
* Batch aggregates (X5/X6) are one ``groupBy(feature)`` over the long form
  with exact micro-unit sums.
* TreeSHAP (X1) for boosted trees: the leaf paths of the fitted trees are listed
  once, neighbouring leaves of at most eight tests are tabulated by the pattern of
  passed tests, and a whole Arrow batch is looked up at once.  Contributions are on the log-odds scale, so base + sum(phi)
  = logit(p); the slots of an encoded column can be added up to the column.
* Kernel Shapley values (X10) of any model: coalitions with Shapley kernel
  weights, one prediction pass over all hybrids of a row, a bounded background
  and the coalitions, then a least-squares fit per row.  Sampled
  Shapley values walk along random feature orders instead.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator
from itertools import combinations
from typing import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayline import config as C
from stayline.functions import exprs as X
from stayline.operators.model import linear_design

FEATURES = [n for n, _ in C.LINEAR_WEIGHTS]
WEIGHTS = dict(C.LINEAR_WEIGHTS)


def design_means(df: DataFrame) -> DataFrame:
    """E[x_j] over the batch (one row)."""
    d = linear_design()
    return df.agg(*[F.avg(F.coalesce(d[f], F.lit(0.0))).alias(f"__mu_{f}") for f in FEATURES])


def linear_shap(df: DataFrame, key: str = "customerID", background: DataFrame | None = None) -> DataFrame:
    """X2 (wide): one ``phi_<feature>`` and ``x_<feature>`` column per design
    feature plus ``base_margin`` (score at the means) and ``margin``."""
    d = linear_design()
    mu = design_means(background if background is not None else df)
    j = df.crossJoin(F.broadcast(mu))
    cols = {}
    for f in FEATURES:
        x = F.coalesce(d[f], F.lit(0.0))
        cols[f"x_{f}"] = x
        cols[f"phi_{f}"] = F.round(F.lit(float(WEIGHTS[f])) * (x - F.col(f"__mu_{f}")), 6)
    base = F.lit(float(C.LINEAR_INTERCEPT))
    margin = F.lit(float(C.LINEAR_INTERCEPT))
    for f in FEATURES:
        base = base + F.col(f"__mu_{f}") * F.lit(float(WEIGHTS[f]))
        margin = margin + F.coalesce(d[f], F.lit(0.0)) * F.lit(float(WEIGHTS[f]))
    cols["base_margin"] = F.round(base, 6)
    cols["margin"] = F.round(margin, 6)
    return j.withColumns(cols).drop(*[f"__mu_{f}" for f in FEATURES])


def shap_long(wide: DataFrame, key: str = "customerID") -> DataFrame:
    """Wide phi columns -> (key, feature, feature_value, contribution)."""
    stack = ", ".join(f"'{f}', `x_{f}`, `phi_{f}`" for f in FEATURES)
    return wide.selectExpr(key, f"stack({len(FEATURES)}, {stack}) AS (feature, feature_value, contribution)")


def top_features_per_row(wide: DataFrame, n: int = C.TOP_N_DRIVERS, key: str = "customerID",
                         eps: float = C.NEUTRAL_EPS) -> DataFrame:
    """X3 + X4 (array form): the row's top-n drivers by |phi| (ties by
    feature name) as ``top_features`` array<struct<feature, contribution,
    feature_value, direction>>, computed inside the row."""
    return wide.select(key, _top_array(n, eps).alias("top_features"))


def _top_array(n: int, eps: float) -> F.Column:
    items = F.array(*[F.struct(F.abs(F.col(f"phi_{f}")).alias("a"), F.lit(f).alias("feature"),
                               F.col(f"phi_{f}").alias("contribution"), F.col(f"x_{f}").alias("feature_value"))
                      for f in FEATURES])
    ordered = F.array_sort(items, lambda l, r: F.when(l["a"] > r["a"], -1).when(l["a"] < r["a"], 1)
                           .when(l["feature"] < r["feature"], -1).when(l["feature"] > r["feature"], 1).otherwise(0))
    return F.transform(F.slice(ordered, 1, n), lambda s: F.struct(
        s["feature"].alias("feature"), s["contribution"].alias("contribution"),
        s["feature_value"].alias("feature_value"),
        X.impact_direction(s["contribution"], eps).alias("direction")))


def top_features_long(top: DataFrame, key: str = "customerID") -> DataFrame:
    """X3 (long form): (key, rank, feature, contribution, feature_value, direction)."""
    return top.select(key, F.posexplode("top_features").alias("pos", "t")).select(
        key, (F.col("pos") + 1).alias("rank"), "t.feature", "t.contribution", "t.feature_value", "t.direction")


def impact_direction(long: DataFrame, eps: float = C.NEUTRAL_EPS) -> DataFrame:
    """X4 on the long form."""
    return long.withColumn("direction", X.impact_direction("contribution", eps))


def global_importance(long: DataFrame, top_n: int = 10) -> DataFrame:
    """Mean |phi| and mean phi per feature, sign, top n by mean |phi|."""
    a = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(X.micro(F.abs("contribution"))).alias("__abs"),
        F.sum(X.micro("contribution")).alias("__sgn"))
    out = a.select("feature", X.mean_from_micro(F.col("__abs"), F.col("n")).alias("mean_abs_shap"),
                   X.mean_from_micro(F.col("__sgn"), F.col("n")).alias("mean_shap"))
    out = out.withColumn("direction", F.when(F.col("mean_shap") > 0, "increases_churn")
                         .when(F.col("mean_shap") < 0, "decreases_churn").otherwise("neutral"))
    return out.orderBy(F.desc("mean_abs_shap"), "feature").limit(top_n)


def batch_top_features(long: DataFrame, top_long: DataFrame, top_n: int = C.TOP_N_DRIVERS) -> DataFrame:
    """Mean |phi| per feature and how often it is in a row's top-n;
    the n features with the largest mean |phi|."""
    a = long.groupBy("feature").agg(F.count(F.lit(1)).alias("n"),
                                    F.sum(X.micro(F.abs("contribution"))).alias("__abs"))
    freq = top_long.groupBy("feature").agg(F.count(F.lit(1)).alias("frequency"))
    return (a.join(freq, "feature", "left")
            .select("feature", X.mean_from_micro(F.col("__abs"), F.col("n")).alias("avg_shap_value"),
                    F.coalesce("frequency", F.lit(0)).cast("long").alias("frequency"))
            .orderBy(F.desc("avg_shap_value"), "feature").limit(top_n))


def explain_customers(wide: DataFrame, keys: DataFrame, n: int = 3, key: str = "customerID") -> DataFrame:
    """For the requested keys (semi join): probability, base value and the
    top-n drivers, all from one projection of the rows of ``linear_shap``."""
    base = F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("base_margin"))), 6)
    return wide.join(keys.select(key), key, "left_semi").select(key, "churn_prob", base.alias("base_value"), _top_array(n, C.NEUTRAL_EPS).alias("top_features"))


def additivity_check(wide: DataFrame, tol: float = 1e-4, key: str = "customerID") -> DataFrame:
    """Rows where base + sum(phi) differs from the margin by more than
    ``tol`` (contributions are rounded to 1e-6 each)."""
    total = F.col("base_margin")
    for f in FEATURES:
        total = total + F.col(f"phi_{f}")
    return wide.select(key, (total - F.col("margin")).alias("gap")).filter(F.abs("gap") > tol)


def with_drivers(scored: DataFrame, background: DataFrame | None = None) -> DataFrame:
    """X11 in place: the scored rows with their first three drivers, computed
    inside the row (no join by customer)."""
    wide = linear_shap(scored, background=background)
    top = wide.withColumn("top_features", _top_array(C.TOP_N_DRIVERS, C.NEUTRAL_EPS))
    names = {f"driver_{i}": F.coalesce(F.try_element_at("top_features", F.lit(i))["feature"], F.lit("")) for i in (1, 2, 3)}
    return top.withColumns(names).drop("top_features", "base_margin", "margin", *[f"{k}_{f}" for f in FEATURES for k in ("x", "phi")])


def driver_columns(top: DataFrame, key: str = "customerID") -> DataFrame:
    """X11: first three drivers as columns ('' when absent)."""
    return top.select(key, *[F.coalesce(F.try_element_at("top_features", F.lit(i))["feature"], F.lit(""))
                             .alias(f"driver_{i}") for i in (1, 2, 3)])


# ---------------------------------------------------------------------------
# Contributions of boosted trees
# ---------------------------------------------------------------------------

def _expected_value(t: dict, node: int = 0) -> float:
    if t["left"][node] < 0:
        return t["val"][node]
    l, r = t["left"][node], t["right"][node]
    c = t["cover"][node]
    return (t["cover"][l] * _expected_value(t, l) + t["cover"][r] * _expected_value(t, r)) / c


def leaf_paths(t: dict) -> list[tuple]:
    """Every leaf as (value, {feature: (share of training rows kept, tests)}):
    the tests (node, goes left) of the splits on a feature along the path,
    and the product of the cover ratios at those splits."""
    out = []

    def down(n: int, path: dict) -> None:
        if t["left"][n] < 0:
            out.append((t["val"][n], path))
            return
        f = int(t["feat"][n])
        for child, to_left in ((t["left"][n], True), (t["right"][n], False)):
            share, tests = path.get(f, (1.0, ()))
            down(child, {**path, f: (share * t["cover"][child] / t["cover"][n], (*tests, (n, to_left)))})

    down(0, {})
    return out


def tree_shap_batch(x: np.ndarray, t: dict, paths: list[tuple]) -> np.ndarray:
    """Path-dependent Shapley values of one tree for all rows of ``x``."""
    phi = np.zeros_like(x)
    for f, v in path_values(node_tests(x.T, t, np.flatnonzero(t["left"] >= 0)), paths, len(x)).items():
        phi[:, f] = v
    return phi


def node_tests(columns: np.ndarray, t: dict, nodes: Sequence[int]) -> dict:
    """Whether the rows pass the tests of the nodes, by node."""
    out = {}
    for n in map(int, nodes):
        v = columns[t["feat"][n]]
        out[n] = np.isin(v, list(t["cats"][n])) if t["cats"][n] is not None else v <= t["thr"][n]
    return out


def path_values(passes: dict, paths: list[tuple], rows: int) -> dict:
    """Shapley values by feature of the leaves ``paths``.

    For a leaf of value v with features 1..m on its path, a row that passes
    the tests of feature j has o_j = 1, else 0; z_j is the share of training
    rows that pass.  The leaf gives feature i the value v (o_i - z_i) times the
    sum over subsets S of the other features of |S|! (m-1-|S|)! / m! * prod_S o
    * prod_rest z, whose sums by size are the coefficients of prod (z_j + o_j u)."""
    phi = {}
    for value, path in paths:
        m = len(path)
        if not m or not value:
            continue
        feats = list(path)
        z = [path[f][0] for f in feats]
        o = [np.logical_and.reduce([passes[n] if left else ~passes[n] for n, left in path[f][1]]).astype(float) for f in feats]
        weight = [math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)]
        for i, f in enumerate(feats):
            poly = [np.ones(rows)]
            for j in range(m):
                if j != i:
                    poly = [(poly[k] * z[j] if k < len(poly) else 0.0) + (poly[k - 1] * o[j] if k else 0.0) for k in range(len(poly) + 1)]
            phi[f] = phi.get(f, 0.0) + value * (o[i] - z[i]) * sum(w * c for w, c in zip(weight, poly))
    return phi


MOST_TESTS = 8
PATTERNS = (np.arange(1 << MOST_TESTS)[:, None] >> np.arange(MOST_TESTS) & 1).astype(bool)


def pieces(paths: list[tuple]) -> list[tuple[list[int], list[tuple]]]:
    """Neighbouring leaves whose tests are at most ``MOST_TESTS``, with the tests'
    nodes; a longer path is a piece of its own."""
    out = []
    for leaf in paths:
        nodes = {n for _, tests in leaf[1].values() for n, _ in tests}
        if out and len(out[-1][0] | nodes) <= MOST_TESTS:
            out[-1] = (out[-1][0] | nodes, [*out[-1][1], leaf])
        else:
            out.append((nodes, [leaf]))
    return [(sorted(nodes), leaves) for nodes, leaves in out]


def piece_tables(t: dict, w: float) -> list[tuple]:
    """A tree's pieces as (nodes, {feature: value of every pattern of passed tests},
    None), or with the paths instead of a table if the tests are too many."""
    out = []
    for nodes, leaves in pieces(leaf_paths(t)):
        if len(nodes) > MOST_TESTS:
            out.append((nodes, None, leaves))
        else:
            seen = {n: PATTERNS[:1 << len(nodes), k] for k, n in enumerate(nodes)}
            out.append((nodes, {f: w * v for f, v in path_values(seen, leaves, 1 << len(nodes)).items()}, None))
    return out


def pattern(passes: dict, nodes: Sequence[int], rows: int) -> np.ndarray:
    """The rows' patterns of passed tests as one number."""
    out = np.zeros(rows, np.uint8)
    for k, n in enumerate(nodes):
        out |= passes[n].view(np.uint8) << np.uint8(k)
    return out.astype(np.intp)


def tree_shap(df: DataFrame, trees: list, weights: list, n_features: int, key: str = "customerID",
              vec: str = "features", model_prior: float = 0.0) -> DataFrame:
    """X1 + X8: per row base value, margin (log-odds) and contribution array.

    Trees and weights are closed over by the Python function, so Spark
    ships them once per task (broadcast through the closure)."""
    base = model_prior + 2.0 * sum(w * _expected_value(t) for t, w in zip(trees, weights))
    inp = df.select(F.col(key), vector_to_array(vec).alias("__x"))

    tables = [(t, w, piece_tables(t, 2.0 * w)) for t, w in zip(trees, weights)]
    kind, sc = df.schema[key].dataType.simpleString(), df.sparkSession.sparkContext

    def contributions(columns: np.ndarray) -> np.ndarray:
        rows, phi = columns.shape[1], np.zeros_like(columns)
        for t, w, parts in tables:
            passes = node_tests(columns, t, np.flatnonzero(t["left"] >= 0))
            for nodes, table, leaves in parts:
                if table is None:
                    table, at = {f: 2.0 * w * v for f, v in path_values(passes, leaves, rows).items()}, slice(None)
                else:
                    at = pattern(passes, nodes, rows)
                for f, v in table.items():
                    phi[f] += v[at]
        return phi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                own = batch.slice(lo, 4096)
                x = own.column(1).flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, -1)
                phi = np.ascontiguousarray(contributions(np.ascontiguousarray(x.T)).T)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(phi.ravel()))
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(np.full(len(x), base)), pa.array(base + phi.sum(1)), lists], names=[key, "base_value", "margin", "contributions"])

    tasks = max(sc.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))      # much work per row
    return inp.repartition(tasks).mapInArrow(run, f"`{key}` {kind}, base_value double, margin double, contributions array<double>")


def fold_slots(shap: DataFrame, names: Sequence[str], source: Callable[[str], str]) -> tuple[DataFrame, list[str]]:
    """Contributions with the slots of every source feature added up, and the
    source features in order."""
    groups = {}
    for i, n in enumerate(names):
        groups.setdefault(source(n), []).append(i)
    item = lambda i: F.get("contributions", F.lit(i))
    folded = F.array(*[sum((item(i) for i in at[1:]), item(at[0])) for at in groups.values()])
    return shap.withColumn("contributions", folded), list(groups)


def tree_shap_long(shap: DataFrame, names: Sequence[str], key: str = "customerID") -> DataFrame:
    arr = F.array(*[F.lit(n) for n in names])
    return shap.select(key, F.posexplode("contributions").alias("i", "contribution")) \
               .select(key, F.element_at(arr, F.col("i") + 1).alias("feature"), "contribution")


def model_drivers(shap: DataFrame, names: Sequence[str], n: int = C.TOP_N_DRIVERS, key: str = "customerID", eps: float = C.NEUTRAL_EPS) -> DataFrame:
    """X3 + X4 of a trained model: per row its first ``n`` drivers by size of the
    contribution (equal ones by name) as ``top_features``, inside the row."""
    items = F.array(*[F.struct(-F.abs(F.get("contributions", F.lit(i))).alias("a"), F.lit(f).alias("feature"), F.get("contributions", F.lit(i)).alias("contribution"))
                      for i, f in enumerate(names)])
    top = F.transform(F.slice(F.sort_array(items), 1, n), lambda s: F.struct(
        s["feature"].alias("feature"), s["contribution"].alias("contribution"), X.impact_direction(s["contribution"], eps).alias("direction")))
    return shap.select(key, "base_value", "margin", top.alias("top_features"))


def model_importance(shap: DataFrame, names: Sequence[str]) -> DataFrame:
    """X5 of a trained model: mean size and mean of every feature's
    contributions, and their sign, in one aggregation of arrays' entries."""
    at = lambda i: F.get("contributions", F.lit(i))
    sums = shap.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.abs(at(i))).alias(f"a{i}") for i in range(len(names))], *[F.sum(at(i)).alias(f"s{i}") for i in range(len(names))])
    rows = sums.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), (F.col(f"a{i}") / F.col("n")).alias("mean_abs_shap"), (F.col(f"s{i}") / F.col("n")).alias("mean_shap"))
                                          for i, f in enumerate(names)])))
    sign = F.when(F.col("mean_shap") > 0, "increases_churn").when(F.col("mean_shap") < 0, "decreases_churn").otherwise("neutral")
    return rows.withColumn("direction", sign).orderBy(F.desc("mean_abs_shap"), "feature")


# ---------------------------------------------------------------------------
# Sampled Shapley (model-agnostic)
# ---------------------------------------------------------------------------

def linear_predict(df: DataFrame) -> DataFrame:
    """The deployed linear score as a ``predict`` for X10: adds ``value`` (the margin)."""
    margin = F.lit(float(C.LINEAR_INTERCEPT))
    for f in FEATURES:
        margin = margin + F.col(f) * F.lit(float(WEIGHTS[f]))
    return df.withColumn("value", margin)


def sampled_shapley(df: DataFrame, background: DataFrame, features: Sequence[str], predict, n_perm: int = 1,
                    seed: int = C.SEED, key: str = "customerID", max_background: int = 500) -> DataFrame:
    """Monte-Carlo Shapley values of any model, (key, feature, contribution).

    ``predict`` takes a frame with ``features`` and adds ``value``.  Each row is
    crossed with every background row (``max_background`` at most, checked) in
    ``n_perm`` seeded feature orders of its own; along an order the
    features switch from the background row's values to the row's, one by one.
    The hybrids after and before a switch are predicted side by side in one pass,
    and the change of the value is credited to the feature: means by row and
    feature are added up in the tasks, so the exchange doesn't hold the hybrids."""
    features, spark = list(features), df.sparkSession
    size = background.limit(max_background + 1).count()
    if size > max_background:
        raise ValueError(f"the background has more than {max_background} rows")
    rng = random.Random(seed)
    orders = []
    for b in range(size * n_perm):
        order = list(range(len(features)))
        rng.shuffle(order)
        place = {f: i + 1 for i, f in enumerate(order)}
        orders.append((b // n_perm, b % n_perm, [place[i] for i in range(len(features))], [features[i] for i in order]))
    plan = spark.createDataFrame(orders, "__b int, __p int, __place array<int>, __order array<string>")
    bg = background.select(*[F.col(f).alias(f"__bg_{f}") for f in features])
    bg = bg.withColumn("__b", F.row_number().over(Window.orderBy(*bg.columns)) - 1).join(plan, "__b")     # max_background rows
    steps = F.explode(F.sequence(F.lit(1), F.lit(len(features)))).alias("__step")
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))      # much work per row
    rows = df.select(key, *features).repartition(tasks).crossJoin(F.broadcast(bg)).select("*", steps, *[F.col(f).alias(f"__own_{f}") for f in features])

    def hybrids(at: DataFrame, step: F.Column) -> DataFrame:
        return at.withColumns({f: F.when(F.col("__place")[i] <= step, F.col(f"__own_{f}")).otherwise(F.col(f"__bg_{f}")) for i, f in enumerate(features)})

    after = predict(hybrids(rows, F.col("__step"))).withColumnRenamed("value", "__after")
    both = predict(hybrids(after, F.col("__step") - 1))
    return both.groupBy(key, F.get("__order", F.col("__step") - 1).alias("feature")).agg(F.avg(F.col("__after") - F.col("value")).alias("contribution"))


def kernel_coalitions(m: int, samples: int, seed: int = C.SEED) -> tuple[np.ndarray, np.ndarray]:
    """Coalitions of ``m`` features (without the empty and the full one) and
    their weights.  Sizes are listed whole, from the outside in and each with
    its complement, while they fit into ``samples``; the weight of the other
    sizes is shared by coalitions drawn from them in complementary pairs."""
    weight = [0.0] + [(m - 1) / (k * (m - k)) for k in range(1, m)]          # of a size in all
    rows, weights, left = [], [], samples
    inner = []
    for k in range(1, m // 2 + 1):
        pair = {k, m - k}
        n = sum(math.comb(m, j) for j in pair)
        if not inner and n <= left:
            for j in pair:
                rows += [[int(i in c) for i in range(m)] for c in map(set, combinations(range(m), j))]
                weights += [weight[j] / math.comb(m, j)] * math.comb(m, j)
            left -= n
        else:
            inner += sorted(pair)
    if inner and left >= 2:
        rng, seen = random.Random(seed), {}
        share = [weight[j] for j in inner]
        for _ in range(left // 2):
            chosen = set(rng.sample(range(m), rng.choices(inner, share)[0]))
            z = tuple(int(i in chosen) for i in range(m))
            for c in (z, tuple(1 - i for i in z)):
                seen[c] = seen.get(c, 0) + 1
        total = sum(seen.values())
        rows += [list(c) for c in seen]
        weights += [sum(share) * n / total for n in seen.values()]
    return np.array(rows, float).reshape(-1, m), np.array(weights)


def kernel_solution(z: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matrices (A, c) with ``phi = A v + c d``: the weighted least squares of
    coalition values ``v`` under ``sum(phi) = d``.  The normal equations are
    the same for every row, so they are solved once."""
    m = z.shape[1]
    if m == 1:
        return np.zeros((1, len(z))), np.ones(1)
    x, last = z[:, :-1] - z[:, -1:], z[:, -1]
    solve = np.linalg.pinv(x.T @ (w[:, None] * x)) @ (x.T * w)
    a, c = np.vstack([solve, -solve.sum(0)]), np.append(-solve @ last, 1 + (solve @ last).sum())
    return a, c


def coalition_tables(trees: list, weights: list, bg: np.ndarray, mask: np.ndarray, a: np.ndarray) -> list[tuple] | None:
    """Per piece of a tree (nodes of its tests, table): ``a`` times the mean value
    over the background of every coalition (``mask``: its slots), for every pattern
    of the row's passed tests.  None if a path has too many tests."""
    out = []
    for t, w in zip(trees, weights):
        own = node_tests(bg.T, t, np.flatnonzero(t["left"] >= 0))
        tables = []
        for nodes, leaves in pieces(leaf_paths(t)):
            if len(nodes) > MOST_TESTS:
                return None
            n, bits = 1 << len(nodes), {x: k for k, x in enumerate(nodes)}
            seen, value = PATTERNS[:n], np.zeros(n)
            for v, path in leaves:
                value += 2.0 * w * v * np.logical_and.reduce([seen[:, bits[x]] == left for _, tests in path.values() for x, left in tests] or [np.ones(n, bool)])
            back, every = pattern(own, nodes, len(bg)), np.arange(n)
            switched = (mask[:, t["feat"][nodes]] @ (1 << np.arange(len(nodes)))).astype(np.intp)        # a coalition's tests
            kinds, of = np.unique(switched, return_inverse=True)
            means = np.stack([value[(every & k)[:, None] | (back & ~k)[None]].mean(1) for k in kinds], 1)
            tables.append((nodes, np.ascontiguousarray(means[:, of] @ a.T)))
        out.append((t, tables))
    return out


def _looked_up(x: np.ndarray, tables: list[tuple]) -> np.ndarray:
    columns, out = np.ascontiguousarray(x.T), 0.0
    for t, parts in tables:
        passes = node_tests(columns, t, np.flatnonzero(t["left"] >= 0))
        for nodes, table in parts:
            out = out + table[pattern(passes, nodes, len(x))]
    return out


def kernel_shapley(df: DataFrame, background: DataFrame, features: dict, predict: Callable[[np.ndarray], np.ndarray], samples: int = 256,
                   seed: int = C.SEED, key: str = "customerID", vec: str = "x", max_background: int = 500,
                   trees: tuple[list, list] | None = None, prior: float = 0.0) -> DataFrame:
    """Shapley values of any model by kernel-weighted least squares, as
    (key, base_value, margin, contributions).

    ``vec`` is an array of doubles; ``features`` maps every feature to the
    slots that it owns, which switch together.  ``predict`` takes rows x slots
    and returns one value a row; it is sent to the tasks.  For each row
    all hybrids of the coalitions with the ``background`` rows (``max_background``
    at most, checked) are predicted in one pass; a coalition's value is their
    mean.  Exact if ``samples`` holds all ``2**features - 2`` coalitions.

    Where the value is a weighted sum of ``trees`` (with ``prior``) these means are
    tabulated: what a piece of a tree is worth to a coalition depends on the
    row by its pattern of passed tests only (``coalition_tables``), so a row
    costs a look-up a piece and not a prediction a hybrid."""
    bg = background.select(vec).limit(max_background + 1).toArrow().column(0).combine_chunks()
    if len(bg) > max_background:
        raise ValueError(f"the background has more than {max_background} rows")
    bg = bg.flatten().to_numpy().reshape(len(bg), -1)
    names, owners = list(features), np.full(bg.shape[1], -1)
    for i, f in enumerate(names):
        owners[list(features[f])] = i
    z, w = kernel_coalitions(len(names), samples, seed)
    a, c = kernel_solution(z, w)
    mask = np.hstack([z, np.zeros((len(z), 1))])[:, owners].astype(bool)          # slots of no feature stay the background's

    tables = coalition_tables(*trees, bg, mask, a) if trees and len(bg) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = predict(bg).mean() if len(bg) else 0.0
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            if tables is not None:
                solved = np.concatenate([np.zeros((0, len(names))), *[_looked_up(x[lo:lo + 4096], tables) for lo in range(0, len(x), 4096)]])
                solved += prior * a.sum(1)
            values = np.empty((0 if tables is not None else len(x), len(z)))
            for i, row in enumerate(x[:len(values)]):                                           # one row's hybrids at a time
                hybrids = np.where(mask[:, None, :], row, bg[None])
                values[i] = predict(hybrids.reshape(-1, x.shape[1])).reshape(len(z), len(bg)).mean(1)
            margin = predict(x) if len(x) else np.zeros(0)
            phi = (solved - base * a.sum(1) if tables is not None else (values - base) @ a.T) + (margin - base)[:, None] * c
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(x), base)), pa.array(margin), pa.array(phi.tolist(), pa.list_(pa.float64()))],
                                             names=[key, "base_value", "margin", "contributions"])

    kind, sc = df.schema[key].dataType.simpleString(), df.sparkSession.sparkContext
    tasks = max(4 * sc.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))      # much work per row
    return df.select(key, vec).repartition(tasks).mapInArrow(run, f"`{key}` {kind}, base_value double, margin double, contributions array<double>")
