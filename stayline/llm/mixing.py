"""Mixing sources to target weights with a hypergeometric splitting tree.

Targets.  Sources in code-point order, null last, weigh 5, 2, 1, repeating.
They share ``share`` (150 %) of all words by weight; a target stops at
``repeat`` (2) times its source's words and the excess is shared again by
weight among the rest, until no source is above.

Blocks.  A document's permutation key is a hash of its id.  Equal ranges of
that key cut a source into blocks (``BLOCKS`` at most, whatever its size), so
a hot source is dealt over as many blocks, and a per-source affine permutation
gives the order in which blocks are drawn.  A source's quota is the number
of draws that comes nearest to its target: whole passes over all blocks, then
a prefix of the permuted order.

Tree.  The quotas of all sources are split over the output shards by a binary
tree: at each node the left child's share of every source's blocks is one
multivariate-hypergeometric draw without replacement.  A leaf's draws are a
run of its source's permuted blocks that no other leaf has.  Documents of a
shard are then ordered by a hash of (id, copy).

The tree and the quotas work on one row per source (``MAX_SOURCES`` at most,
checked) and one per (source, block), never on documents.

Cases.  Null text has size 0 and takes nothing.  A null source is a source of
its own.  Rows with equal or null ids share one permutation key, so they
stay in one block, and are drawn together.  An empty table gives an empty
result.  Input columns named like an output column are replaced.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayline.llm.common import saved

WEIGHTS = (5, 2, 1)
BLOCKS = 4096
SHARDS = 64
MAX_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"
KEY_BITS = 40
OUT = ("size", "source_size", "target", "copies", "taken", "shards")


def targets(sizes: list[int], share: float = 1.5, repeat: float = 2.0,
            weights: tuple = WEIGHTS) -> list[float]:
    """Target words per source; ``sizes`` are in source order."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, left, active = [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while active:
        per = left / sum(w[i] for i in active)
        over = [i for i in sorted(active) if per * w[i] > repeat * sizes[i]]
        if not over:
            for i in active:
                out[i] = per * w[i]
            break
        for i in over:
            out[i] = repeat * sizes[i]
            left -= out[i]
        active -= set(over)
    return out


def split_tree(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of every source for every shard, ``(shards, sources)``; the
    columns add up to ``quotas``."""
    out = np.zeros((shards, len(quotas)), np.int64)
    todo = [(0, shards, np.asarray(quotas, np.int64))]
    while todo:
        lo, hi, q = todo.pop()
        if hi - lo == 1:
            out[lo] = q
            continue
        mid = (lo + hi) // 2
        rng = np.random.Generator(np.random.Philox(key=[seed, lo * shards + hi]))
        left = rng.multivariate_hypergeometric(q, int(q.sum()) * (mid - lo) // (hi - lo))
        todo += [(lo, mid, left), (mid, hi, q - left)]
    return out


def _step(n: int, i: int, seed: int) -> tuple[int, int]:
    """An affine permutation of ``range(n)``."""
    rng = np.random.Generator(np.random.Philox(key=[seed + 1, i]))
    a = int(rng.integers(1, n + 1))
    while math.gcd(a, n) != 1:
        a = a % n + 1
    return a, int(rng.integers(0, n))


def _prefixes(cells: DataFrame, plan: list, blocks: int) -> dict:
    """Per source the number of leading blocks in its permuted order whose
    words come nearest to what whole passes leave of its target."""
    table = cells.sparkSession.createDataFrame(
        [(p[0], p[3], p[4], p[6]) for p in plan], "__source string, __a long, __c long, rest double")
    w = Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ends = (cells.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("__source")))
            .withColumn("at", F.pmod(F.col("__a") * F.col("__block") + F.col("__c"), F.lit(blocks)))
            .withColumn("gap", F.abs(F.sum("words").over(w) - F.col("rest"))))
    best = ends.groupBy("source", "rest").agg(F.min(F.struct("gap", "at")).alias("m"))
    return {r.source: r.n for r in best.select("source", F.when(F.col("m.gap") < F.col("rest"), F.col("m.at") + 1)
                                               .otherwise(0).cast("int").alias("n")).collect()}


def mix_documents(docs: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS, share: float = 1.5,
                  repeat: float = 2.0, seed: int = 17, max_sources: int = MAX_SOURCES) -> DataFrame:
    """Every row with ``size``, its source's ``source_size`` and ``target``,
    ``copies`` (how often the mix takes it), ``taken`` words and ``shards``
    (the output shard of each copy)."""
    spark = docs.sparkSession
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in OUT]
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 64 - KEY_BITS)
    rows = docs.select(*keep, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                       F.shiftright(key * F.lit(blocks), KEY_BITS).cast("int").alias("__block"))
    cells = saved(rows.groupBy("source", "__block").agg(F.sum("size").alias("words")), "mix-cells")
    per = cells.groupBy("source").agg(F.sum("words").alias("words")).limit(max_sources + 1).collect()
    if len(per) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    per.sort(key=lambda r: (r.source is None, r.source or ""))
    plan = []
    for i, (r, target) in enumerate(zip(per, targets([r.words for r in per], share, repeat))):
        full = min(int(target // r.words), int(repeat)) if r.words else 0
        plan.append([r.source, int(r.words), float(target), *_step(blocks, i, seed), full, float(target - full * r.words)])
    part = _prefixes(cells, plan, blocks) if plan else {}
    quotas = []
    for p in plan:
        p[-1] = part.get(p[0], 0) if p[5] < repeat else 0
        quotas.append(p[5] * blocks + p[-1])
    ends = np.cumsum(split_tree(quotas, shards, seed), axis=0) if plan else np.zeros((shards, 0), np.int64)
    for i, p in enumerate(plan):
        p.append([int(x) for x in ends[:, i]])
    table = spark.createDataFrame([tuple(p) for p in plan], "__source string, source_size long, target double, __a long, "
                                  "__c long, __full int, __part int, __ends array<long>")
    at = F.pmod(F.col("__a") * F.col("__block") + F.col("__c"), F.lit(blocks))
    copies = F.when(F.col("size") > 0, F.col("__full") + (F.col("__at") < F.col("__part")).cast("int")).otherwise(0)
    shard = F.expr(f"transform(if(copies > 0, sequence(0, copies - 1), array()), "
                   f"e -> size(filter(__ends, x -> x <= e * {blocks}L + __at)))")
    return (rows.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("__source")))
            .withColumn("__at", at).withColumn("copies", copies)
            .withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
            .withColumn("shards", shard)
            .drop("__source", "__block", "__a", "__c", "__full", "__part", "__ends", "__at"))


def mixed_rows(docs: DataFrame, seed: int = 17, **params) -> DataFrame:
    """The mix itself: one row per copy, with ``shard`` and the hash
    ``position`` by which a shard's rows are shuffled locally."""
    mixed = mix_documents(docs, seed=seed, **params)
    cols = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in (*OUT, "shard", "position")]
    return (mixed.select(*cols, F.posexplode("shards").alias("copy", "shard"))
            .withColumn("position", F.xxhash64(F.lit(seed), "doc_id", "copy")))


def write_mix(docs: DataFrame, path: str, **params) -> None:
    """Write the mix, one folder per shard, locally shuffled."""
    (mixed_rows(docs, **params).repartition("shard", F.shiftrightunsigned("position", 60))
     .sortWithinPartitions("shard", "position").write.partitionBy("shard").parquet(path))
