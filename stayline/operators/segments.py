"""Customer segmentation with k-prototypes.

A model is a plain dict::

    {"scaler": {feature: (mean, std)}, "numeric": [...], "categorical": [...],
     "gamma": float, "prototypes": [([z...], [mode...]), ...]}

* **assign** (G3) is one projection: per prototype the distance is
  ``sum((z - c)^2) + gamma * sum(cat != mode)`` as native expressions over
  literal prototypes, then the nearest id (ties -> lowest id), the cost and
  the confidence ``1 - d1/d2``.  No shuffle.
* **fit** (G1) is Lloyd's algorithm as a short loop of Spark jobs over blocks
  of byte arrays, written once: one job per iteration assigns every row for all
  starts at once (NumPy; mismatches and sums are matrix products) and adds up,
  per start and cluster, the numeric sums and the level counts - the driver
  only ever sees starts x k x (features + levels) numbers.  Initialisation
  follows Cao et al. (2009) density/distance selection on the categorical part:
  the level counts (one aggregation) and k passes that each pick the row with
  the largest score (one row per task, then ``max``).
"""

from __future__ import annotations

import hashlib
import math
import random
from typing import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayline import config as C
from stayline.operators.selection import order_statistics

SEG_KEY = "customerID"


def reference_model() -> dict:
    """The deployed segmentation model used by the scored view."""
    return {
        "scaler": dict(C.SEGMENT_SCALER),
        "numeric": list(C.SEG_NUMERIC),
        "categorical": list(C.SEG_CATEGORICAL),
        "gamma": C.SEGMENT_GAMMA,
        "prototypes": [(list(z), list(m)) for z, m in C.SEGMENT_PROTOTYPES],
    }


def _z(c: str, scaler: dict) -> F.Column:
    m, s = scaler[c]
    return (F.col(c).cast("double") - F.lit(float(m))) / F.lit(float(s) if s else 1.0)


def _cat(c: str) -> F.Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("nan"))


def distance_exprs(model: dict) -> list:
    """One distance column per prototype (numeric part + gamma * mismatches),
    each parsed from one SQL expression."""
    num = lambda x: f"double('{float(x)!r}')"
    text = lambda x: "'" + str(x).replace("\\", "\\\\").replace("'", "\\'") + "'"
    zs = []
    for c in model["numeric"]:
        m, s = model["scaler"][c]
        zs.append(f"((CAST(`{c}` AS DOUBLE) - {num(m)}) / {num(s if s else 1.0)})")
    cats = [f"coalesce(CAST(`{c}` AS STRING), 'nan')" for c in model["categorical"]]
    out = []
    for values, modes in model["prototypes"]:
        sq = " + ".join(f"({z} - {num(v)}) * ({z} - {num(v)})" for z, v in zip(zs, values))
        mm = " + ".join(f"CAST({c} != {text(mv)} AS INT)" for c, mv in zip(cats, modes))
        out.append(F.expr(f"({sq}) + {num(model['gamma'])} * CAST(({mm}) AS DOUBLE)"))
    return out


def assign_segments(df: DataFrame, model: dict | None = None,
                    labels: dict = C.SEGMENT_LABELS, keep_distances: bool = False) -> DataFrame:
    """G3 + G6 + J2: nearest prototype, its cost, confidence and label.

    The k distances are computed once into an array; the nearest id is the
    first position of the minimum (ties -> lowest id) and the runner-up
    comes from the sorted array, so each distance expression appears once
    in the generated code."""
    model = model or reference_model()
    d = distance_exprs(model)
    tmp = df.withColumn("__d", F.array(*d))
    tmp = tmp.withColumns({"segment_cost": F.array_min("__d"), "__ds": F.sort_array("__d")})
    second = F.col("__ds")[1] if len(d) > 1 else F.col("segment_cost")
    tmp = tmp.withColumns({
        "segment": (F.array_position("__d", F.col("segment_cost")) - 1).cast("int"),
        "segment_confidence": F.round(F.when(second > 0, F.lit(1.0) - F.col("segment_cost") / second)
                                      .otherwise(F.lit(0.0)), 6),
    })
    tmp = tmp.withColumn("segment_label", segment_label(F.col("segment"), labels))
    if keep_distances:
        tmp = tmp.withColumns({f"__d{i}": F.col("__d")[i] for i in range(len(d))})
    return tmp.drop("__d", "__ds")


def segment_label(seg: F.Column, labels: dict = C.SEGMENT_LABELS) -> F.Column:
    """J2 as an expression (the map is a handful of literals)."""
    expr = None
    for i, name in labels.items():
        expr = F.when(seg == i, name) if expr is None else expr.when(seg == i, name)
    return expr.otherwise(F.concat(F.lit("Segment "), seg.cast("string")))


def segment_label_lookup(df: DataFrame, labels_df: DataFrame) -> DataFrame:
    """J2 as a broadcast join with a (segment, segment_label) dimension."""
    return df.join(F.broadcast(labels_df), "segment", "left")


def attach_segments(processed: DataFrame, segs: DataFrame | None = None, key: str = SEG_KEY, model: dict | None = None) -> DataFrame:
    """Segment + label on processed rows.  Without ``segs`` they are
    computed from the rows themselves, in one projection; segments from
    elsewhere are joined by key (never by position)."""
    if segs is not None:
        return processed.join(segs.select(key, "segment", "segment_label"), key, "left")
    from stayline.operators.features import engineer_features
    return assign_segments(engineer_features(processed), model).select(*processed.columns, "segment", "segment_label")


def cluster_cost(assigned: DataFrame) -> DataFrame:
    """Total within-cluster cost."""
    return assigned.agg(F.sum("segment_cost").alias("cost"))


def segment_sizes(assigned: DataFrame) -> DataFrame:
    """G7"""
    return assigned.groupBy("segment", "segment_label").agg(F.count(F.lit(1)).alias("customers"))


def segment_summary(assigned: DataFrame) -> DataFrame:
    """Size, churn rate and medians per segment (sorted by size)."""
    cols = {"tenure": "median_tenure", "MonthlyCharges": "median_monthly", "TotalCharges": "median_total"}
    medians = order_statistics(assigned, list(cols), [0.5], ["segment"])
    sizes = assigned.groupBy("segment", "segment_label").agg(F.count(F.lit(1)).alias("customers"), F.avg(F.col("Churn").cast("double")).alias("churn_rate"))
    return (sizes.join(F.broadcast(medians), "segment", "left")       # one row per segment
            .select("segment", "segment_label", "customers", "churn_rate", *[F.col(f"{c}__0").alias(n) for c, n in cols.items()])
            .orderBy(F.desc("customers"), "segment"))


def segment_naming(assigned: DataFrame, names: Sequence[str] = (
        "Loyal High-Value", "Low Engagement", "Stable Mid-Value", "At risk High-value")) -> DataFrame:
    """Deterministic profile rule for naming clusters of a fresh fit.

    * the cluster with the lowest mean MonthlyCharges -> 'Low Engagement'
    * of the rest, the highest mean tenure -> 'Loyal High-Value'
    * of the rest, the highest churn rate -> 'At risk High-value'
    * the remaining one -> 'Stable Mid-Value'
    Works on a per-cluster profile (k rows); returns (segment, segment_name).
    """
    prof = assigned.groupBy("segment").agg(
        F.avg("MonthlyCharges").alias("m"), F.avg("tenure").alias("t"),
        F.avg(F.col("Churn").cast("double")).alias("c")).collect()
    rest = sorted(prof, key=lambda r: r["segment"])
    out = {}
    low = min(rest, key=lambda r: (r["m"], r["segment"]))
    out[low["segment"]] = names[1]
    rest = [r for r in rest if r is not low]
    if rest:
        loyal = max(rest, key=lambda r: (r["t"], -r["segment"]))
        out[loyal["segment"]] = names[0]
        rest = [r for r in rest if r is not loyal]
    if rest:
        risk = max(rest, key=lambda r: (r["c"], -r["segment"]))
        out[risk["segment"]] = names[3]
        rest = [r for r in rest if r is not risk]
    for r in rest:
        out[r["segment"]] = names[2] if names[2] not in out.values() else f"Segment {r['segment']}"
    spark = assigned.sparkSession
    return spark.createDataFrame(sorted(out.items()), "segment int, segment_name string")


def segment_profile(assigned: DataFrame) -> DataFrame:
    """Per segment demographic shares, service adoption, contract and
    payment mix and charge distribution."""
    yes = lambda c: F.avg((F.col(c) == "Yes").cast("double"))
    shares = (assigned.groupBy("segment", "segment_label").agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg((F.col("gender") == "Female").cast("double")).alias("share_female"),
        F.avg((F.col("SeniorCitizen") == "yes").cast("double")).alias("share_senior"),
        yes("Partner").alias("share_partner"),
        yes("Dependents").alias("share_dependents"),
        yes("PhoneService").alias("share_phone"),
        F.avg((F.col("InternetService") == "Fiber optic").cast("double")).alias("share_fiber"),
        F.avg((F.col("InternetService") == "No").cast("double")).alias("share_no_internet"),
        yes("OnlineSecurity").alias("share_security"),
        yes("TechSupport").alias("share_support"),
        yes("StreamingTV").alias("share_streaming_tv"),
        F.avg((F.col("Contract") == "Month-to-month").cast("double")).alias("share_month_to_month"),
        F.avg((F.col("Contract") == "Two year").cast("double")).alias("share_two_year"),
        F.avg((F.col("PaymentMethod") == "Electronic check").cast("double")).alias("share_electronic_check"),
        F.min("MonthlyCharges").alias("min_monthly"),
        F.max("MonthlyCharges").alias("max_monthly")))
    quartiles = order_statistics(assigned, ["MonthlyCharges"], [0.25, 0.5, 0.75], ["segment"])
    own = [c for c in shares.columns if c != "max_monthly"]
    return shares.join(F.broadcast(quartiles), "segment", "left").select(      # one row per segment
        *own, *[F.col(f"MonthlyCharges__{i}").alias(n) for i, n in enumerate(("q1_monthly", "median_monthly", "q3_monthly"))], "max_monthly")


def segment_mix(assigned: DataFrame, features: Sequence[str], k: int = C.N_CLUSTERS) -> DataFrame:
    """G10, comparison: share of each level within every segment, the
    segments side by side (``segment_0`` ...)."""
    long = assigned.select("segment", F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("level")) for f in features])))
    counts = long.groupBy("feature", "level", "segment").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("feature", "segment").agg(F.sum("n").alias("all"))
    shares = counts.join(F.broadcast(total), ["feature", "segment"])      # features x k rows
    return shares.groupBy("feature", "level").agg(*[
        F.coalesce(F.max(F.when(F.col("segment") == i, F.col("n") / F.col("all"))), F.lit(0.0)).alias(f"segment_{i}") for i in range(k)])


# ---------------------------------------------------------------------------
# Fitting (G1, G2, G5)
# ---------------------------------------------------------------------------

MAX_LEVELS = 1000
CHUNK = 512            # rows whose distances to all prototypes are held at a time
DIRECT = 64            # tasks whose sums go straight to the driver; of more they are added up by prototype first
PARTIAL = "proto int, n long, cost double, sums binary, far double, far_z array<double>, far_c array<string>"
BLOCKS = "n int, z binary, c binary, key array<string>"


def _prepare(df: DataFrame, numeric, categorical, scaler) -> DataFrame:
    cols = [F.col(SEG_KEY)] if SEG_KEY in df.columns else []
    return df.select(*cols,
                     *[_z(c, scaler).alias(f"z{i}") for i, c in enumerate(numeric)],
                     *[_cat(c).alias(f"c{j}") for j, c in enumerate(categorical)])


def level_counts(prep: DataFrame, n_cat: int) -> list[dict]:
    """Per categorical column its levels with their numbers of rows; more than
    ``MAX_LEVELS`` levels in all columns together is an error."""
    stack = ", ".join(f"{j}, c{j}" for j in range(n_cat))
    rows = (prep.selectExpr(f"stack({n_cat}, {stack}) AS (j, level)").groupBy("j", "level").agg(F.count(F.lit(1)).alias("n"))
            .limit(MAX_LEVELS + 1).collect())
    if len(rows) > MAX_LEVELS:
        raise ValueError(f"more than {MAX_LEVELS} categorical levels")
    out: list[dict] = [{} for _ in range(n_cat)]
    for r in rows:
        out[r["j"]][r["level"]] = r["n"]
    return out


def _blocks(prep: DataFrame, n_num: int, levels: list[dict]) -> DataFrame:
    """Prepared rows as blocks (an Arrow batch each): numerics and level numbers
    as byte arrays, keys as text.  Written once, spread over the cores."""
    from stayline.session import cut_lineage
    names = [pa.array(sorted(lv), pa.string()) for lv in levels]
    key = F.col(SEG_KEY).cast("string") if SEG_KEY in prep.columns else F.lit(None).cast("string")
    schema = pa.schema([("n", pa.int32()), ("z", pa.binary()), ("c", pa.binary()), ("key", pa.list_(pa.string()))])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            z = np.array([b.column(f"z{i}").to_numpy(zero_copy_only=False) for i in range(n_num)], float).reshape(n_num, -1)
            c = np.array([pc.index_in(b.column(f"c{j}"), value_set=v).to_numpy(zero_copy_only=False) for j, v in enumerate(names)], np.uint16)
            keys = b.column("key").cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int32()), pa.array([z.T.tobytes()]), pa.array([c.T.tobytes()]),
                                              pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)], schema=schema)

    rows = prep.select(*[f"z{i}" for i in range(n_num)], *[f"c{j}" for j in range(len(levels))], key.alias("key"))
    parts = min(math.ceil(prep.count() / 4096), 4 * prep.sparkSession.sparkContext.defaultParallelism)
    return cut_lineage(rows.repartition(max(1, parts)).mapInArrow(run, BLOCKS))


def _arrays(batches, n_num: int, n_cat: int):
    """The blocks of a task as (numerics, level numbers, keys)."""
    for b in batches:
        for i in range(b.num_rows):
            n = b.column("n")[i].as_py()
            yield (np.frombuffer(b.column("z")[i].as_py(), float).reshape(n, n_num), np.frombuffer(b.column("c")[i].as_py(), np.uint16).reshape(n, n_cat),
                   b.column("key")[i].values if "key" in b.schema.names else None)


def cao_init(prep: DataFrame, k: int, n_num: int, n_cat: int, seed: int, levels: list[dict] | None = None) -> list:
    """Cao density/distance initialisation for the categorical modes.

    density(x) = mean over features of freq(x_j)/n.  The first seed is the
    densest row; each next seed maximises min over chosen seeds of
    (mismatch distance * density).  Numeric seeds are the z-values of the
    chosen rows; ties go to the largest md5 of "seed:key", then key.
    """
    levels = levels or level_counts(prep, n_cat)
    blocks = prep if "key" in prep.columns else _blocks(prep, n_num, levels)
    names = [sorted(lv) for lv in levels]
    counts = [np.array([lv[x] for x in ns], np.int64) for lv, ns in zip(levels, names)]
    seeds: list = []

    def run(batches):
        best = None
        for z, c, keys in _arrays(batches, n_num, n_cat):
            density = sum(counts[j][c[:, j]] for j in range(n_cat))
            # mismatches * level counts: an integer in the order of distance * density
            score = density * np.min([(c != s[1]).sum(1) for s in seeds], 0) if seeds else density
            top = int(score.max())
            if best and top < best[0]:
                continue
            for i in np.flatnonzero(score == top).tolist():
                key = keys[i].as_py()
                row = (top, hashlib.md5(f"{seed}:{key}".encode()).hexdigest() if key is not None else "", z[i].tobytes(), c[i].tobytes())
                best = row if best is None else max(best, row)
        if best:
            yield pa.RecordBatch.from_pylist([dict(zip(("score", "tie", "z", "c"), best))])

    while len(seeds) < k:
        p = blocks.mapInArrow(run, "score long, tie string, z binary, c binary").agg(F.max(F.struct("score", "tie", "z", "c")).alias("p")).first()["p"]
        seeds.append((np.frombuffer(p["z"], float), np.frombuffer(p["c"], np.uint16)))
    return [(z.tolist(), [names[j][x] for j, x in enumerate(c)]) for z, c in seeds]


def _partial_sums(prep: DataFrame, models: list, gamma: float, n_num: int, levels: list[dict], tasks: int | None = None) -> list:
    """Assign every row to its nearest prototype in each of ``models`` and
    return, per model and cluster, rows, cost, sums, level counts and the
    farthest row.  One pass over the blocks whatever the number of models; a
    task contributes one row per (model, cluster)."""
    n_cat = len(levels)
    names = [sorted(lv) for lv in levels]
    start = np.cumsum([0] + [len(ns) for ns in names])
    at = {(j, v): start[j] + i for j, ns in enumerate(names) for i, v in enumerate(ns)}
    first = np.cumsum([0] + [len(m) for m in models])
    protos = [p for m in models for p in m]
    num = np.array([p[0] for p in protos], float).reshape(len(protos), n_num)
    modes = np.zeros((len(protos), int(start[-1])), np.float32)
    for k, (_, vs) in enumerate(protos):
        for j, v in enumerate(vs):
            if (j, v) in at:
                modes[k, at[j, v]] = 1

    def run(batches):
        n, cost = np.zeros(len(protos), np.int64), np.zeros(len(protos))
        total, level = np.zeros((len(protos), n_num)), np.zeros((len(protos), int(start[-1])))
        far, far_row = np.full(len(protos), -1.0), [None] * len(protos)
        for zs, cs, _ in _arrays(batches, n_num, n_cat):
            for lo in range(0, len(zs), CHUNK):
                z, c = zs[lo:lo + CHUNK], cs[lo:lo + CHUNK]
                hot = np.zeros((len(z), int(start[-1])), np.float32)
                hot[np.arange(len(z))[:, None], c + start[:-1]] = 1
                d, x, columns = np.zeros((len(protos), len(z))), np.empty((len(protos), len(z))), np.ascontiguousarray(z.T)
                for i in range(n_num):
                    np.subtract(columns[i], num[:, i, None], out=x)
                    x *= x
                    d += x
                d += gamma * (n_cat - modes @ hot.T).astype(float)
                near = np.zeros(d.shape, bool)                       # the first of the nearest, per model
                for a, b in zip(first, first[1:]):
                    least, free = d[a:b].min(0), np.ones(len(z), bool)
                    for k in range(a, b):
                        near[k] = ~(d[k] > least) & free              # a NaN distance counts as least
                        free &= ~near[k]
                n += near.sum(1)
                level += near.astype(np.float32) @ hot               # whole numbers up to CHUNK: exact
                total += near.astype(float) @ z
                cost += np.where(near, d, 0.0).sum(1)
                own = np.where(near, d, -1.0)
                most = own.max(1)
                for k in np.flatnonzero(~(most < far) & ~(most < 0)).tolist():
                    i = int(own[k].argmax())
                    if far_row[k] is None or most[k] > far[k] or z[i].tolist() > far_row[k][0]:
                        far[k], far_row[k] = most[k], (z[i].tolist(), [names[j][x] for j, x in enumerate(c[i])])
        used = np.flatnonzero(n)
        both = np.concatenate([total, level], 1)
        yield _partial([(int(k), int(n[k]), cost[k], both[k].tobytes(), far[k], *far_row[k]) for k in used])

    part = prep.select("n", "z", "c").mapInArrow(run, PARTIAL)
    if (tasks or prep.rdd.getNumPartitions()) > DIRECT:
        part = part.repartition(DIRECT, "proto").mapInArrow(lambda batches: [_partial(_added(r for b in batches for r in map(tuple, map(dict.values, b.to_pylist()))))], PARTIAL)
    out = []
    for k, n, cost, both, *far in _added(part.collect()):
        m = int(np.searchsorted(first, k, "right")) - 1
        both = np.frombuffer(both)
        out.append({"model": m, "seg": k - int(first[m]), "n": n, "cost": cost, "far": dict(zip(("far", "far_z", "far_c"), far)),
                    **{f"s{i}": x for i, x in enumerate(both[:n_num].tolist())}, **{f"l{i}": x for i, x in enumerate(both[n_num:].tolist())}})
    return out


def _partial(rows: list) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.float64(), pa.binary(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[x.split()[0] for x in PARTIAL.split(", ")])


def _added(rows) -> list[tuple]:
    """Partial sums of several tasks added up by prototype, with the farthest row."""
    out: dict = {}
    for k, n, cost, both, *far in rows:
        both = np.frombuffer(both)
        if k in out:
            o = out[k]
            n, cost, both, far = n + o[0], cost + o[1], both + o[2], max(far, o[3], key=lambda f: (f[0], f[1]))
        out[k] = (n, cost, both, far)
    return [(k, n, cost, both.tobytes(), *far) for k, (n, cost, both, far) in sorted(out.items())]


def _updated(rows: list, protos: list, n_num: int, levels: list[dict]) -> list:
    """New prototypes: means and commonest levels; an empty cluster is
    re-seeded with the row farthest from its prototype."""
    names = [sorted(lv) for lv in levels]
    new, by = [], {r["seg"]: r for r in rows}
    far = sorted((r["far"] for r in rows), key=lambda f: (-f["far"], f["far_z"]))
    for k in range(len(protos)):
        if k not in by:
            f = far.pop(0)
            new.append((list(f["far_z"]), list(f["far_c"])))
            continue
        r, modes, i = by[k], [], 0
        for ns in names:
            counts = [r[f"l{i + x}"] for x in range(len(ns))]
            modes.append(ns[counts.index(max(counts))])
            i += len(ns)
        new.append(([r[f"s{x}"] / r["n"] for x in range(n_num)], modes))
    return new


def fit_starts(prep: DataFrame, starts: list, gamma: float, n_num: int, levels: list[dict], max_iter: int) -> list[dict]:
    """Lloyd's iterations of all starts at once, one pass over the data per
    iteration, until every start has converged (or ``max_iter``).  Per start:
    prototypes, their cost, and the cost of every iteration."""
    runs = [{"prototypes": p, "history": [], "done": False} for p in starts]
    tasks = prep.rdd.getNumPartitions()
    for _ in range(max_iter + 1):
        live = [r for r in runs if not r["done"]]
        if not live:
            break
        rows = _partial_sums(prep, [r["prototypes"] for r in live], gamma, n_num, levels, tasks)
        for m, r in enumerate(live):
            own = [x for x in rows if x["model"] == m]
            r["cost"] = sum(x["cost"] for x in sorted(own, key=lambda x: x["seg"]))     # of the prototypes as they are now
            r["history"].append(r["cost"])
            new = _updated(own, r["prototypes"], n_num, levels)
            if new == r["prototypes"] or len(r["history"]) > max_iter or (len(r["history"]) > 1 and r["history"][-2] - r["cost"] <= 1e-9 * r["cost"]):
                r["done"] = True
            else:
                r["prototypes"] = new
    return runs


def seeded_starts(first: list, n_init: int, seed: int) -> list:
    """Cao's modes with the chosen rows' numerics first, then with numerics
    drawn from the standard normal (the numerics are standardised)."""
    out = [first]
    for i in range(1, n_init):
        rng = random.Random(seed * 1000 + i)
        out.append([([rng.gauss(0.0, 1.0) for _ in num], list(modes)) for num, modes in first])
    return out


def _fit_input(df: DataFrame, numeric, categorical, scaler):
    from stayline.operators.features import fit_scaler
    from stayline.session import cut_lineage
    keys = [SEG_KEY] if SEG_KEY in df.columns else []
    df = cut_lineage(df.select(*keys, *[c for c in dict.fromkeys([*numeric, *categorical]) if c not in keys]))
    missing = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in numeric]).first().asDict()
    bad = sorted(c for c, n in missing.items() if n)
    if bad:
        raise ValueError(f"null values in {bad}: drop or fill these rows before fitting")
    scaler = scaler or fit_scaler(df, numeric)
    prep = _prepare(df, numeric, categorical, scaler)
    levels = level_counts(prep, len(categorical))
    return scaler, _blocks(prep, len(numeric), levels), levels


def kprototypes_fit(df: DataFrame, k: int = C.N_CLUSTERS, numeric=C.SEG_NUMERIC,
                    categorical=C.SEG_CATEGORICAL, n_init: int = C.N_INIT, max_iter: int = 100,
                    seed: int = C.SEED, gamma: float | None = None, scaler: dict | None = None) -> dict:
    """G1: fit k-prototypes to convergence; the best of ``n_init`` distinct
    starts.  ``cost`` belongs to the returned prototypes and ``history`` is its
    course (it never rises, but where an empty cluster was re-seeded).  A null
    numeric is an error.  The input and its blocks are written once."""
    numeric, categorical = list(numeric), list(categorical)
    scaler, prep, levels = _fit_input(df, numeric, categorical, scaler)
    gamma = 0.5 if gamma is None else gamma      # half the mean std of the numerics, which is 1 after scaling
    starts = seeded_starts(cao_init(prep, k, len(numeric), len(categorical), seed, levels), n_init, seed)
    runs = fit_starts(prep, starts, gamma, len(numeric), levels, max_iter)
    at = min(range(len(runs)), key=lambda i: (runs[i]["cost"], i))
    best = runs[at]
    return {"scaler": scaler, "numeric": numeric, "categorical": categorical, "gamma": gamma, "prototypes": best["prototypes"],
            "cost": best["cost"], "history": best["history"], "start": at}


def elbow(df: DataFrame, ks: Sequence[int] = range(2, 11), n_init: int = 5, max_iter: int = 100,
          seed: int = C.SEED, numeric=C.SEG_NUMERIC, categorical=C.SEG_CATEGORICAL) -> DataFrame:
    """Final cost per k, the best of ``n_init`` starts.  All starts of all
    k run in the same passes over the data."""
    _, prep, levels = _fit_input(df, list(numeric), list(categorical), None)
    first = cao_init(prep, max(ks), len(numeric), len(categorical), seed, levels)       # the seeds of a smaller k are a prefix
    starts = [(k, s) for k in ks for s in seeded_starts(first[:k], n_init, seed)]
    runs = fit_starts(prep, [s for _, s in starts], 0.5, len(numeric), levels, max_iter)
    best: dict = {}
    for (k, _), r in zip(starts, runs):
        best[k] = min(best.get(k, float("inf")), r["cost"])
    return df.sparkSession.createDataFrame([(int(k), float(c)) for k, c in best.items()], "k int, cost double")
