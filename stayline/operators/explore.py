"""Exploratory aggregates (D1-D11).  Each is one or two grouped
aggregations; the correlations of all pairs come from one co-moment matrix."""

from __future__ import annotations

from itertools import combinations
import math
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline import config as C
from stayline.operators.positions import group_positions
from stayline.operators.selection import order_statistics, summaries

QUARTILES = (0.25, 0.5, 0.75)


def value_counts(df: DataFrame, c: str) -> DataFrame:
    """Counts per value, descending (ties by value)."""
    return df.groupBy(c).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), c)


def value_share(df: DataFrame, c: str) -> DataFrame:
    """Percent per value (total is a one-row broadcast aggregate)."""
    tot = df.agg(F.count(F.lit(1)).alias("__tot"))
    return (df.groupBy(c).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(tot))
            .select(c, "n", (F.col("n") * 100.0 / F.col("__tot")).alias("pct")))


def filtered_group_count(df: DataFrame, by: str = "gender", label: str = "Churn") -> DataFrame:
    """D3: counts by ``by`` among churned (1) and retained (0) customers,
    filtering on the 0/1 label (not on the old 'Yes'/'No' strings)."""
    return df.filter(F.col(label).isin(0, 1)).groupBy(label, by).agg(F.count(F.lit(1)).alias("n"))


def pair_counts(df: DataFrame, keys: Sequence[str] = ("gender", "InternetService", "Churn")) -> DataFrame:
    """Multi-key counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def grouped_bars(df: DataFrame, feats: Sequence[str] = C.EDA_BAR_FEATURES, label: str = "Churn") -> DataFrame:
    """Counts of each categorical by label - one stack + one groupBy."""
    stack = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in feats)
    return (df.selectExpr(label, f"stack({len(feats)}, {stack}) AS (feature, value)")
            .groupBy("feature", "value", label).agg(F.count(F.lit(1)).alias("n")))


def describe_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, sample std, min, quartiles, max per column (long), all
    from one pass over the columns' counted values."""
    got = summaries(df, cols, QUARTILES)
    rows = [(c, *got[c][:4], *got[c][5], got[c][4]) if c in got else (c, 0, *[None] * 7) for c in cols]
    return df.sparkSession.createDataFrame(rows, "column_name string, count long, mean double, std double, min double, q1 double, median double, q3 double, max double")


def churn_rate_by(df: DataFrame, by: str, label: str = "Churn") -> DataFrame:
    """Mean label per value of ``by``."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("churn_rate"))


def coded_columns(df: DataFrame, cols: Sequence[str], by: str = "first", key: str = "customerID", max_inline: int = 1000, suffix: str = "_code") -> DataFrame:
    """``df`` with a code per value of every column: the order of first
    appearance (F19, ``by='first'``) or of the values (F18, ``by='value'``), null
    as -1.

    The values of all columns are ranked in one distributed sort.  Columns of
    at most ``max_inline`` values get their codes as an expression, the others
    by a join on the value."""
    long = df.select(F.col(key).alias("k"), F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c in cols])))
    values = long.where("v IS NOT NULL").groupBy("c", "v").agg(F.min("k").alias("first"))
    codes = group_positions(values, ["c"], ["first", "v"] if by == "first" else ["v"], "code").select("c", "v", "code")
    size = {r.c: r["count"] for r in codes.groupBy("c").count().collect()}
    levels = {c: [] for c in cols if size.get(c, 0) <= max_inline}
    for r in codes.where(F.col("c").isin([*levels, ""])).orderBy("c", "code").collect():        # at most max_inline a column
        levels[r.c].append(r.v)
    at = lambda c: F.coalesce(F.array_position(F.array(*[F.lit(v) for v in levels[c]]), F.col(f"`{c}`").cast("string")), F.lit(0)) - 1 if levels[c] else F.lit(-1)
    out = df.withColumns({f"{c}{suffix}": at(c).cast("long") for c in levels}) if levels else df
    for c in cols:
        if c not in levels:
            own = codes.where(F.col("c") == c).select(F.col("v").alias("__v"), F.col("code").alias(f"{c}{suffix}"))
            out = out.join(own, out[c].cast("string") == own["__v"], "left").drop("__v").withColumn(f"{c}{suffix}", F.coalesce(f"{c}{suffix}", F.lit(-1)))
    return out


def comoments(df: DataFrame, cols: Sequence[str]) -> dict:
    """{(a, b): (n, sum a, sum b, sum aa, sum bb, sum ab)} over the rows where
    both are present, of values less their column's mean: one pass for the
    means, one for all sums.  Columns without nulls share their own sums."""
    x = {c: F.col(f"`{c}`").cast("double") for c in cols}
    head = df.agg(F.count(F.lit(1)).alias("n"), *[f(x[c]).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in (("n", F.count), ("m", F.avg))]).first()
    whole = {c for i, c in enumerate(cols) if head[f"n{i}"] == head["n"]}
    d = {c: x[c] - F.lit(head[f"m{i}"] if head[f"m{i}"] is not None else 0.0) for i, c in enumerate(cols)}
    sums, plan = [], {}

    def add(e) -> int:
        sums.append(F.sum(e).alias(f"s{len(sums)}"))
        return len(sums) - 1

    own = {c: (add(F.lit(1.0)), add(d[c]), add(d[c] * d[c])) for c in cols if c in whole}
    for a, b in combinations(cols, 2):
        if a in whole and b in whole:
            plan[a, b] = (own[a][0], own[a][1], own[b][1], own[a][2], own[b][2], add(d[a] * d[b]))
        else:
            both = x[a].isNotNull() & x[b].isNotNull()
            plan[a, b] = tuple(add(F.when(both, e)) for e in (F.lit(1.0), d[a], d[b], d[a] * d[a], d[b] * d[b], d[a] * d[b]))
    got = df.agg(*sums).first()
    return {k: tuple(got[f"s{i}"] or 0.0 for i in v) for k, v in plan.items()}


def _pearson(n: float, a: float, b: float, aa: float, bb: float, ab: float) -> float | None:
    if n < 2:
        return None
    va, vb = aa - a * a / n, bb - b * b / n
    return (ab - a * b / n) / math.sqrt(va * vb) if va > 1e-12 * max(aa, 1e-300) and vb > 1e-12 * max(bb, 1e-300) else None


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair from one co-moment matrix, long
    form (a, b, corr) including both orders and the diagonal; null for a
    constant column."""
    got = {k: _pearson(*v) for k, v in comoments(df, cols).items()}
    rows = [(a, b, r) for (a, b), r in got.items()] + [(b, a, r) for (a, b), r in got.items()] + [(c, c, 1.0) for c in cols]
    return df.sparkSession.createDataFrame(rows, "a string, b string, corr double")


def corr_with_target(df: DataFrame, cols: Sequence[str], label: str = "Churn") -> DataFrame:
    """Correlation of each column with the label, sorted descending, from
    the same matrix."""
    got = comoments(df, [*cols, label])
    rows = [(c, _pearson(*got[c, label])) for c in cols]
    return df.sparkSession.createDataFrame(sorted(rows, key=lambda r: (-(r[1] if r[1] is not None else -2), r[0])), "feature string, corr double")


def density_by_class(df: DataFrame, c: str = "MonthlyCharges", label: str = "Churn", width: float = 5.0) -> DataFrame:
    """Histogram density per class: count / (class size * bin width)."""
    b = F.floor(F.col(c) / width).cast("long")
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    h = df.withColumn("bin", b).groupBy(label, "bin").agg(F.count(F.lit(1)).alias("n"))
    return (h.join(F.broadcast(n), label)
            .select(label, "bin", (F.col("bin") * width).alias("bin_start"), "n",
                    (F.col("n") / (F.col("__n") * width)).alias("density")))


CELLS = 4096


def kernel_density(df: DataFrame, cols: Sequence[str] = ("MonthlyCharges", "TotalCharges"), label: str = "Churn",
                   points: int = 50, cells: int = CELLS) -> DataFrame:
    """Gaussian kernel density per class on ``points`` grid points from
    the column's minimum to its maximum, with Scott's bandwidth (sample
    deviation * n^-1/5).

    Values are counted in ``cells`` cells with the powers of their place in the
    cell, which gives the cubic weights of the four nodes around it; the
    kernel is then summed over nodes, whatever the number of values.  With
    cells of width d and a bandwidth h the density is off by at most
    3/128 (d/h)^4 * 1.2 / h (see ``kernel_error``)."""
    x = F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in cols]))
    vals = df.select(label, x).where("x is not null")
    ends = vals.groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    sums = vals.groupBy(label, "feature").agg(F.count(F.lit(1)).alias("rows"), (F.stddev_samp("x") * F.pow(F.count(F.lit(1)).cast("double"), F.lit(-0.2))).alias("bw"))
    grid = ends.where("hi > lo").select("feature", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"), "lo", "hi").select(
        "feature", "point", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("point") / float(points - 1)).alias("at"))
    place = (F.col("x") - F.col("lo")) / F.col("d")
    cell = F.least(F.floor(place), F.lit(cells - 1)).cast("int")
    located = vals.join(F.broadcast(ends.where("hi > lo").select("feature", "lo", ((F.col("hi") - F.col("lo")) / cells).alias("d"))), "feature") \
        .withColumn("cell", cell).withColumn("t", place - F.col("cell"))
    t = F.col("t")
    held = located.groupBy(label, "feature", "lo", "d", "cell").agg(*[F.sum(e).alias(f"t{k}") for k, e in enumerate((F.lit(1.0), t, t * t, t * t * t))])
    t0, t1, t2, t3 = (F.col(f"t{k}") for k in range(4))
    weights = ((-1, -(t3 - 3 * t2 + 2 * t1) / 6), (0, (t3 - 2 * t2 - t1 + 2 * t0) / 2), (1, -(t3 - t2 - 2 * t1) / 2), (2, (t3 - t1) / 6))
    nodes = held.select(label, "feature", F.inline(F.array(*[F.struct((F.col("lo") + (F.col("cell") + k) * F.col("d")).alias("x"), w.alias("n")) for k, w in weights])))
    z = (F.col("at") - F.col("x")) / F.col("bw")
    return (nodes.join(F.broadcast(sums.where("bw > 0")), [label, "feature"]).join(F.broadcast(grid), "feature")
            .groupBy(label, "feature", "point", "at", "rows", "bw").agg(F.sum(F.col("n") * F.exp(-z * z / 2)).alias("k"))
            .select(label, "feature", "point", "at", (F.col("k") / (F.col("rows") * F.col("bw") * F.sqrt(F.lit(2 * math.pi)))).alias("density")))


def kernel_error(width: float, bandwidth: float, cells: int = CELLS) -> float:
    """Bound of the error of ``kernel_density``: the cubic through four nodes
    misses the kernel by 3/128 of its fourth derivative, at most 3 / sqrt(2 pi)."""
    return 3 / 128 * (width / cells / bandwidth) ** 4 * 3 / math.sqrt(2 * math.pi) / bandwidth


def box_stats(df: DataFrame, c: str = "tenure", label: str = "Churn") -> DataFrame:
    """Quartiles, 1.5 IQR whiskers (most extreme data inside the
    fences) and outlier counts per class.  Class stats (2 rows) are joined
    back by broadcast for the whisker pass."""
    x = F.col(c).cast("double")
    q = order_statistics(df, [c], QUARTILES, [label]).select(label, *[F.col(f"{c}__{i}").alias(n) for i, n in enumerate(("q1", "median", "q3"))])
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    j = df.join(F.broadcast(q), label)
    lo, hi = F.col("q1") - 1.5 * F.col("iqr"), F.col("q3") + 1.5 * F.col("iqr")
    w = j.groupBy(label).agg(
        F.min(F.when(x >= lo, x)).alias("whisker_low"), F.max(F.when(x <= hi, x)).alias("whisker_high"),
        F.sum(((x < lo) | (x > hi)).cast("long")).alias("outliers"))
    return q.join(w, label)
