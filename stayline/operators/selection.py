"""Exact order statistics by distributed selection.

``quantiles`` finds the quantiles of several columns, in all groups at once,
without sorting a column and without one task that holds its values:

1. rows are aggregated to (group, column, value, count), partly on the map
   side, and kept for the passes below;
2. every double becomes a long of the same order (its bits), read as digits of
   22, 21 and 21 bits;
3. a histogram of the first digit, at most 2**22 rows a group and column, gives
   the bin of every wanted rank and the rank inside it.  The next digit is
   counted in these bins only, or the values themselves once the bins hold
   at most ``DIRECT`` rows.

The driver gets one row per group, column and wanted rank; groups are few
(labels, segments), which is checked.  Quantiles interpolate between
neighbours (``quantile_cont``, ``percentile``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHIFTS = (42, 21, 0)           # where the digits begin
DIRECT = 1 << 16               # rows of all wanted bins that are ranked by value at once
MAX_BINS = 100_000             # wanted ranks over all groups and columns
_INF = 0x7FF0000000000000


def ordered_bits(x: str) -> Column:
    """A long that orders like the double column ``x``, from its binary
    exponent and mantissa: -0.0 equals 0.0, NaN is above infinity.  The estimate
    of the exponent by ``log2`` is corrected with exact powers of two."""
    guess = f"CAST(greatest(least(floor(log2(abs({x}))), 1023), -1022) AS INT)"
    exact = (f"greatest({guess} + CASE WHEN pow(2.0D, {guess}) > abs({x}) THEN -1 "
             f"WHEN abs({x}) / pow(2.0D, {guess}) >= 2 THEN 1 ELSE 0 END, -1022)")
    bits = f"(({exact}) + 1022) * 4503599627370496L + CAST(abs({x}) / pow(2.0D, {exact}) * 4503599627370496.0D AS BIGINT)"
    return F.expr(f"CASE WHEN {x} IS NULL THEN NULL WHEN isnan({x}) THEN {2 ** 63 - 1}L WHEN {x} = 0 THEN 0L WHEN {x} = double('Infinity') THEN {_INF}L "
                  f"WHEN {x} = double('-Infinity') THEN -{_INF}L WHEN {x} < 0 THEN -({bits}) ELSE {bits} END")


def _counted(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(g0.., c, x, n, k): how often every value occurs, and its bits."""
    items = F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("double").alias("x")) for c in cols]))
    rows = df.select(*[F.col(f"`{b}`").alias(f"g{i}") for i, b in enumerate(by)], items).where("x IS NOT NULL")
    return rows.groupBy(*[f"g{i}" for i in range(len(by))], "c", "x").agg(F.count(F.lit(1)).alias("n")).withColumn("k", ordered_bits("x"))


def _first_bins(counted: DataFrame, groups: list[str], probs: Sequence[float]) -> DataFrame:
    """The bins of the first digit that hold a wanted rank."""
    h = counted.groupBy(*groups, "c", F.shiftright("k", SHIFTS[0]).alias("d")).agg(F.sum("n").alias("n"))
    within = Window.partitionBy(*groups, "c")
    h = h.withColumns({"all": F.sum("n").over(within), "run": F.sum("n").over(within.orderBy("d"))})
    at = [(F.col("all") - 1) * F.lit(float(p)) for p in probs]
    ranks = F.array_distinct(F.array(*[f(x).cast("long") for x in at for f in (F.floor, F.ceil)]))
    inside = F.filter(ranks, lambda r: (r >= F.col("run") - F.col("n")) & (r < F.col("run")))
    return h.select(*groups, "c", "all", F.explode(inside).alias("rank"), "d", (F.col("run") - F.col("n")).alias("off"), "n")


def _inner_bins(counted: DataFrame, groups: list[str], bins: DataFrame, up: int, shift: int) -> DataFrame:
    """The same for the digits down to ``shift``, inside the wanted bins."""
    same = [counted[g].eqNullSafe(F.col(f"b.{g}")) for g in groups] + [counted["c"] == F.col("b.c"), F.shiftright("k", up) == F.col("b.d")]
    own = [*[F.col(f"b.{g}").alias(g) for g in groups], F.col("b.c").alias("c"), F.col("b.all").alias("all"), F.col("b.rank").alias("rank"), F.col("b.off").alias("off")]
    rows = counted.join(F.broadcast(bins.alias("b")), same).select(*own, F.shiftright("k", shift).alias("d"), counted["n"].alias("n"), "x")
    h = rows.groupBy(*groups, "c", "all", "rank", "off", "d").agg(F.sum("n").alias("n"), F.min("x").alias("x"))
    run = F.col("off") + F.sum("n").over(Window.partitionBy(*groups, "c", "rank").orderBy("d"))
    h = h.withColumn("run", run).where((F.col("rank") >= F.col("run") - F.col("n")) & (F.col("rank") < F.col("run")))
    return h.select(*groups, "c", "all", "rank", "d", (F.col("run") - F.col("n")).alias("off"), "n", "x")


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), max_bins: int = MAX_BINS, direct: int = DIRECT) -> dict:
    """{(group values, column): [quantile per prob]} of the non-null values.
    Groups and columns without a value are left out."""
    groups = [f"g{i}" for i in range(len(by))]
    counted = _counted(df, cols, by).persist(StorageLevel.MEMORY_AND_DISK)      # recomputed if an executor goes
    try:
        return _selected(counted, groups, probs, max_bins, direct)
    finally:
        counted.unpersist()


def summaries(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict:
    """{column: (count, mean, sample deviation, minimum, maximum, quantiles)} of
    the non-null values, from one pass over ``df``: the moments are taken of
    the counted values, around the column's middle."""
    counted = _counted(df, cols, ()).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        got = _selected(counted, [], [*probs, 0.5], MAX_BINS, DIRECT)
        aggs = [F.sum("n").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")]
        middle = F.lit(0.0)
        for (_, c), q in got.items():
            middle = F.when(F.col("c") == c, F.lit(q[-1])).otherwise(middle)
        off = F.col("x") - middle
        rows = counted.groupBy("c").agg(*aggs, F.sum(F.col("n") * off).alias("s"), F.sum(F.col("n") * off * off).alias("ss")).collect()
    finally:
        counted.unpersist()
    out = {}
    for r in rows:
        q = got[(), r.c]
        var = (r.ss - r.s * r.s / r.n) / (r.n - 1) if r.n > 1 else None
        out[r.c] = (r.n, q[-1] + r.s / r.n, None if var is None else math.sqrt(max(var, 0.0)), r.lo, r.hi, q[:-1])
    return out


def _selected(counted: DataFrame, groups: list[str], probs: Sequence[float], max_bins: int, direct: int) -> dict:
    spark = counted.sparkSession
    few = (lambda d: d.orderBy("c", "rank").limit(max_bins + 1)) if groups else (lambda d: d)
    found = _first_bins(counted, groups, probs)
    schema = T.StructType([f for f in found.schema if f.name != "n"])
    rows, up = few(found).collect(), SHIFTS[0]
    while up:
        if len(rows) > max_bins:
            raise ValueError(f"more than {max_bins} ranks are wanted; select fewer groups, columns or quantiles")
        if not rows:
            return {}
        held = {(*[r[g] for g in groups], r.c, r.d): r.n for r in rows}
        if not groups and sum(held.values()) <= direct and len(held) <= 100:
            return _from_values(counted, rows, up, probs)
        shift = 0 if sum(held.values()) <= direct else SHIFTS[SHIFTS.index(up) + 1]
        bins = spark.createDataFrame(pa.Table.from_pylist([{f.name: r[f.name] for f in schema} for r in rows]), schema)
        rows, up = few(_inner_bins(counted, groups, bins, up, shift)).collect(), shift
    return _interpolated(rows, groups, probs)


def _from_values(counted: DataFrame, rows: list, up: int, probs: Sequence[float]) -> dict:
    """The quantiles from the values of the wanted bins, at most ``DIRECT`` rows
    in all, which the driver ranks."""
    here = " OR ".join(f"c = '{c}' AND shiftright(k, {up}) = {d}L" for c, d in {(r.c.replace("'", "\\'"), r.d) for r in rows})
    values = sorted(counted.where(F.expr(here)).select("c", F.shiftright("k", up).alias("d"), "k", "x", "n").collect(), key=lambda v: v.k)
    found = []
    for r in rows:
        run = r.off
        for v in values:
            if (v.c, v.d) == (r.c, r.d):
                run += v.n
                if r["rank"] < run:
                    found.append({"c": r.c, "all": r["all"], "rank": r["rank"], "x": v.x})
                    break
    return _interpolated(found, [], probs)


def _interpolated(rows: list, groups: list[str], probs: Sequence[float]) -> dict:
    value = {(*[r[g] for g in groups], r["c"], r["rank"]): r["x"] for r in rows}
    out = {}
    for r in rows:
        key = tuple(r[g] for g in groups)
        if (key, r["c"]) not in out:
            got = []
            for p in probs:
                h = (r["all"] - 1) * float(p)
                lo, hi = math.floor(h), math.ceil(h)
                a, b = value[(*key, r["c"], lo)], value[(*key, r["c"], hi)]
                got.append(a if a == b or lo == hi else (hi - h) * a + (h - lo) * b)
            out[key, r["c"]] = got
    return out


def order_statistics(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """One row per group: ``by`` and ``<column>__<i>``, the exact quantile
    ``probs[i]`` of the column's non-null values (null if it has none).  A
    group without any value has no row, an empty table no rows."""
    got = quantiles(df, cols, probs, by)
    schema = T.StructType([T.StructField(b, df.schema[b].dataType) for b in by] + [T.StructField(f"{c}__{i}", T.DoubleType()) for c in cols for i in range(len(probs))])
    none = [None] * len(probs)
    rows = [(*g, *[x for c in cols for x in got.get((g, c), none)]) for g in dict.fromkeys(g for g, _ in got)]
    return df.sparkSession.createDataFrame(rows, schema)
