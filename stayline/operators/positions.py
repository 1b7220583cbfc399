"""Exact row positions without a single-task window.

``row_number() over (partition by g order by o)`` puts every row of a group
into one task; with a group holding a third of the table that task is the
job.  ``group_positions`` computes the same 0-based positions as a
two-level prefix sum:

1. range-sort by ``(g, o)`` (distributed sort) and stamp each row with
   ``monotonically_increasing_id`` (partition id in the high 31 bits, index
   inside the partition in the low 33 bits); the result is checkpointed to
   the shared checkpoint folder so the stamps are stable and the lineage is
   cut,
2. count rows per ``(partition, group)`` - one row per pair, tiny,
3. prefix-sum those counts per group (window over the tiny table) and
   join the offsets back.

Ties in ``o`` must be broken by the caller (include the key) for a
deterministic result.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.session import cut_lineage


def group_positions(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence,
                    name: str = "pos") -> DataFrame:
    group_cols = list(group_cols)
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    sort_keys = [F.col(g) for g in group_cols] + order
    stamped = cut_lineage(
        df.repartitionByRange(*sort_keys).sortWithinPartitions(*sort_keys)
          .withColumn("__mid", F.monotonically_increasing_id()))
    pid = F.shiftright("__mid", 33)
    local = F.col("__mid") - F.shiftleft(pid, 33)
    counts = (stamped.groupBy(pid.alias("__pid"), *group_cols)
              .agg(F.count(F.lit(1)).alias("__n"), F.min(local).alias("__first")))
    w = Window.partitionBy(*group_cols).orderBy("__pid") if group_cols else Window.orderBy("__pid")
    offsets = counts.withColumn("__off", F.sum("__n").over(w) - F.col("__n")).drop("__n")
    # one row per (partition, group): the planner broadcasts it if it is small
    joined = stamped.withColumn("__pid", pid).join(offsets, ["__pid", *group_cols], "inner")
    return (joined.withColumn(name, (F.col("__off") + local - F.col("__first")).cast("long"))
            .drop("__pid", "__off", "__first", "__mid"))


def prefix_sums(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence,
                sum_cols: Sequence[str], suffix: str = "_cum") -> DataFrame:
    """Running sums (rows unbounded preceding .. current row) of ``sum_cols``
    within each group in ``order_cols`` order, as a two-level prefix sum:
    per-(partition, group) totals are prefix-summed on a tiny table and
    joined back; the in-partition running sum is a window over one
    range partition at most.  ``order_cols`` must be unique within a group.
    """
    group_cols = list(group_cols)
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    sort_keys = [F.col(g) for g in group_cols] + order
    stamped = cut_lineage(
        df.repartitionByRange(*sort_keys).sortWithinPartitions(*sort_keys)
          .withColumn("__mid", F.monotonically_increasing_id()))
    pid = F.shiftright("__mid", 33)
    stamped = stamped.withColumn("__pid", pid)
    totals = stamped.groupBy("__pid", *group_cols).agg(
        *[F.sum(c).alias(f"__t_{c}") for c in sum_cols])
    w = Window.partitionBy(*group_cols).orderBy("__pid") if group_cols else Window.orderBy("__pid")
    offsets = totals.select("__pid", *group_cols,
                            *[(F.sum(f"__t_{c}").over(w) - F.col(f"__t_{c}")).alias(f"__o_{c}")
                              for c in sum_cols])
    wl = (Window.partitionBy("__pid", *group_cols).orderBy("__mid")
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = stamped.join(offsets, ["__pid", *group_cols], "inner")
    out = out.withColumns({f"{c}{suffix}": F.col(f"__o_{c}") + F.sum(c).over(wl) for c in sum_cols})
    return out.drop("__pid", "__mid", *[f"__o_{c}" for c in sum_cols])


BUCKET_ROWS = 200_000
MAX_BUCKETS = 10_000


def positions_under(df: DataFrame, values: dict[str, Column], key: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(sort_key, key, position): the 0-based place of every row in the
    ascending order of each value (nulls first), ties by ``key``, for all
    values at once.

    One mergeable quantile summary of all values gives cut points; the rows
    between two cuts are a bucket, and so are the rows of a cut point itself,
    which are cut once more by ``key``, so a value that a third of the rows share is
    spread.  A position is the count of the buckets before plus the place in
    the bucket: one narrow exchange, and nothing is written."""
    names = list(values)
    base = df.select(F.col(key).alias("__id"), F.col(key).cast("double").alias("__k"), *[values[n].cast("double").alias(f"__v{i}") for i, n in enumerate(names)])
    parts = min(MAX_BUCKETS, math.ceil(base.count() / bucket_rows))
    cols = [*[f"__v{i}" for i in range(len(names))], "__k"]
    cuts = [sorted(set(q)) for q in base.stat.approxQuantile(cols, [i / parts for i in range(1, parts)], 0.25 / parts)] if parts > 1 else [[]] * len(cols)
    inf = float("inf")
    for c, q in zip(cols, cuts):
        if q:
            q = [x for x in q if abs(x) < inf]
            base = Bucketizer(splits=[-inf, *q, inf], inputCol=c, outputCol=f"{c}b", handleInvalid="keep").transform(base)
            at = F.col(f"{c}b").cast("int")
            same = F.coalesce((at > 0) & (F.col(c) == F.get(F.array(*[F.lit(x) for x in q]), at - 1)), F.lit(False))
            base = base.withColumn(f"{c}b", F.when(F.col(c).isNull(), -1).otherwise(2 * at + F.when(same, 0).otherwise(1))).withColumn(f"{c}e", same)
        else:
            base = base.withColumns({f"{c}b": F.when(F.col(c).isNull(), -1).otherwise(0), f"{c}e": F.lit(False)})
    sub = lambda i: F.when(F.col(f"__v{i}e") | F.col(f"__v{i}").isNull(), F.col("__kb")).otherwise(0)
    rows = base.select("__id", F.inline(F.array(*[F.struct(F.lit(n).alias("sort_key"), F.col(f"__v{i}b").alias("__b"), sub(i).alias("__s"), F.col(f"__v{i}").alias("__v"))
                                                  for i, n in enumerate(names)])))
    cell = ["sort_key", "__b", "__s"]
    place = F.row_number().over(Window.partitionBy(*cell).orderBy("__v", "__id")) - 1
    cell_n = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("sort_key").orderBy("__b", "__s")) - F.col("__n")      # one row per bucket
    offsets = cell_n.select(*cell, before.alias("__off"))
    return (rows.withColumn("__at", place).join(offsets, cell)
            .select("sort_key", F.col("__id").alias(key), (F.col("__off") + F.col("__at")).cast("long").alias("position")))
