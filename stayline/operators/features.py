"""Feature engineering.

``engineer_features`` adds the 12 engineered columns in one projection.
The only data-dependent piece is the MonthlyCharges median behind
``is_high_value``: fitted on the batch when the plan is built, or a fitted constant
(``high_value_threshold=...``) so that scoring one row gives the same
answer as scoring it inside a batch.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline import config as C
from stayline.functions import exprs as X
from stayline.operators.selection import quantiles


def avg_monthly_spend() -> F.Column:
    """TotalCharges / tenure (0 -> 1)."""
    t = F.col("tenure")
    return F.col("TotalCharges") / F.when(t == 0, F.lit(1)).otherwise(t)


def charge_gap() -> F.Column:
    """F2"""
    return F.col("MonthlyCharges") - avg_monthly_spend()


def median_of(df: DataFrame, c: str) -> float | None:
    """Exact median (average of the two middle values) by distributed
    selection; None without values."""
    return quantiles(df, [c], [0.5]).get(((), c), [None])[0]


def high_value_threshold(df: DataFrame) -> float | None:
    """Fit the is_high_value threshold (median MonthlyCharges) once."""
    return median_of(df, "MonthlyCharges")


def engineer_features(df: DataFrame, high_value_threshold: float | Column | None = None,
                      bins: Sequence[float] = C.TENURE_BINS,
                      labels: Sequence[str] = C.TENURE_LABELS) -> DataFrame:
    """all engineered features, each guarded by column presence."""
    cols = set(df.columns)
    out = df
    has_billing = {"TotalCharges", "tenure", "MonthlyCharges"} <= cols
    if has_billing and high_value_threshold is None:
        thr = F.lit(median_of(df, "MonthlyCharges")).cast("double")       # fitted now, a literal in the plan
    else:
        thr = high_value_threshold if isinstance(high_value_threshold, Column) else F.lit(high_value_threshold)
    new = {}
    if has_billing:
        new["avg_monthly_spend"] = avg_monthly_spend()
        new["charge_gap"] = charge_gap()
        new["is_high_value"] = X.flag(F.col("MonthlyCharges") > thr)
    if "tenure" in cols:
        new["tenure_band"] = X.tenure_band("tenure", bins, labels)
    if set(C.STREAMING_SERVICES) <= cols:
        new["streaming_count"] = X.count_yes(C.STREAMING_SERVICES)
    if set(C.SECURITY_SERVICES) <= cols:
        new["security_count"] = X.count_yes(C.SECURITY_SERVICES)
    if "PaymentMethod" in cols:
        new["payment_electronic_check"] = X.flag(F.col("PaymentMethod") == "Electronic check")
    if {"Contract", "PaperlessBilling"} <= cols:
        new["month_to_month_paperless"] = X.flag(
            (F.col("Contract") == "Month-to-month") & (F.col("PaperlessBilling") == "Yes"))
    if {"TechSupport", "OnlineSecurity"} <= cols:
        new["no_support_services"] = X.flag(
            (F.col("TechSupport") == "No") & (F.col("OnlineSecurity") == "No"))
    if {"Partner", "Dependents"} <= cols:
        new["is_isolated"] = X.flag((F.col("Partner") == "No") & (F.col("Dependents") == "No"))
    if {"InternetService", "OnlineSecurity"} <= cols:
        new["fiber_no_security"] = X.flag(
            (F.col("InternetService") == "Fiber optic") & (F.col("OnlineSecurity") == "No"))
    if "InternetService" in cols:
        new["no_internet_services"] = X.flag(F.col("InternetService") == "No")
    out = out.withColumns(new)
    return out


def num_services(cols: Sequence[str] = C.ALL_SERVICES) -> F.Column:
    """number of services equal to 'Yes'."""
    return sum(X.flag(F.col(c) == "Yes") for c in cols)


# -- scaling and encoding ------------------------------------------------------

def fit_scaler(df: DataFrame, cols: Sequence[str]) -> dict:
    """F16 fit: population mean / std (ddof 0); zero variance -> scale 1."""
    aggs = []
    for c in cols:
        aggs += [F.avg(F.col(c).cast("double")).alias(f"m_{c}"),
                 F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}")]
    r = df.agg(*aggs).first()
    return {c: (r[f"m_{c}"], r[f"s_{c}"] if r[f"s_{c}"] else 1.0) for c in cols}


def standard_scale(df: DataFrame, stats: dict, suffix: str = "") -> DataFrame:
    """F16 transform: (x - mean) / std with fitted (or literal) stats."""
    return df.withColumns({f"{c}{suffix}": (F.col(c) - F.lit(m)) / F.lit(s if s else 1.0)
                           for c, (m, s) in stats.items()})


def standard_scale_batch(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """F16 fitted and applied in one plan: stats are a broadcast 1-row frame."""
    aggs = []
    for c in cols:
        aggs += [F.avg(F.col(c).cast("double")).alias(f"__m_{c}"),
                 F.stddev_pop(F.col(c).cast("double")).alias(f"__s_{c}")]
    stats = df.agg(*aggs)
    out = df.crossJoin(F.broadcast(stats))
    out = out.withColumns({
        f"{c}_z": (F.col(c) - F.col(f"__m_{c}")) /
                  F.when(F.col(f"__s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"__s_{c}"))
        for c in cols})
    return out.drop(*[x for c in cols for x in (f"__m_{c}", f"__s_{c}")])


def one_hot_drop_first(df: DataFrame, cols: Sequence[str], levels: dict | None = None, max_levels: int = 1000) -> DataFrame:
    """F17 (plain-column variant): 0/1 column per level except the
    alphabetically first.  ``levels`` (feature -> sorted list) comes from
    training; when absent the distinct levels of all columns are read in one
    job, and a column of more than ``max_levels`` is an error."""
    if levels is None:
        r = (df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols])))
             .where("v is not null").distinct().limit(max_levels * len(cols) + 1).collect())
        if len(r) > max_levels * len(cols):
            raise ValueError(f"more than {max_levels} levels per column; pass levels=")
        levels = {c: sorted(x.v for x in r if x.c == c) for c in cols}
        many = [c for c in cols if len(levels[c]) > max_levels]
        if many:
            raise ValueError(f"more than {max_levels} levels in {many}; pass levels=")
    new = {}
    for c in cols:
        for lv in sorted(levels[c])[1:]:
            new[f"{c}_{lv}"] = (F.col(c).cast("string") == lv).cast("int")
    return df.withColumns(new)


def label_encode(df: DataFrame, c: str, name: str | None = None) -> DataFrame:
    """code by sorted order of distinct values (0-based).

    Distinct values are positioned by a distributed sort and joined back;
    the planner broadcasts them only if they are small.
    """
    from stayline.operators.positions import group_positions
    name = name or f"{c}_code"
    codes = group_positions(df.select(F.col(c)).distinct(), [], [F.col(c).asc_nulls_last()], name)
    return df.join(codes.withColumn(name, F.col(name).cast("int")), on=c, how="left")


def factorize(df: DataFrame, c: str, order_key: str = "customerID", name: str | None = None) -> DataFrame:
    """code by first appearance (first = smallest ``order_key``)."""
    from stayline.operators.positions import group_positions
    name = name or f"{c}_code"
    first = df.groupBy(c).agg(F.min(order_key).alias("__min"))
    codes = group_positions(first, [], ["__min", c], name).drop("__min")
    return df.join(codes.withColumn(name, F.col(name).cast("int")), on=c, how="left")


def class_weight(df: DataFrame, label: str = "Churn", weight: float | None = None,
                 name: str = "weight") -> DataFrame:
    """positive rows weighted by ``weight`` (default neg/pos ratio)."""
    if weight is None:
        stats = df.agg((F.sum(1 - F.col(label)) / F.sum(F.col(label))).alias("__ratio"))
        return (df.crossJoin(F.broadcast(stats))
                .withColumn(name, F.when(F.col(label) == 1, F.col("__ratio")).otherwise(F.lit(1.0)))
                .drop("__ratio"))
    return df.withColumn(name, F.when(F.col(label) == 1, F.lit(float(weight))).otherwise(F.lit(1.0)))


def hash_order(key: str = "customerID", seed: int = C.SEED) -> F.Column:
    """Pseudo-random but engine-independent order: md5 of 'seed:key'."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def stratified_split(df: DataFrame, label: str = "Churn", key: str = "customerID",
                     fractions=C.SPLIT_FRACTIONS, seed: int = C.SEED,
                     names=("train", "validation", "test")) -> DataFrame:
    """exact stratified split into named parts.

    Within each label the rows are ordered by a seeded md5 of the key (same
    order in any engine); the row's position decides its part: as in a
    two-stage split, ``test`` gets ceil(n * test share), ``validation``
    ceil(rest * val / (train + val)) of the rest, ``train`` the remainder.
    The cut points are found by counting hash buckets, so nothing is sorted
    and rows are only compared with their label's two cut points (one broadcast row per label).
    """
    cuts = _split_cuts(df.select(F.col(label), F.col(key)), label, key, fractions, seed)
    place = F.struct(hash_order(key, seed).alias("h"), F.col(key).alias("k"))
    part = (F.when(F.col("__val").isNull() | (place < F.col("__val")), names[0])
            .when(F.col("__test").isNull() | (place < F.col("__test")), names[1]).otherwise(names[2]))
    return (df.join(F.broadcast(cuts), F.col(label).eqNullSafe(F.col("__label")))
            .withColumn("split", part).drop("__label", "__val", "__test"))


BUCKET_DIGITS = 4      # hex digits of the hash: 65,536 buckets per label, whatever the table's size


def _bucket_offsets(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """(label, bucket, n, rows of the label before the bucket, rows of the
    label): at most 65,536 rows per label."""
    b = F.substring(hash_order(key, seed), 1, BUCKET_DIGITS).alias("__b")
    n = df.groupBy(F.col(label).alias("__label"), b).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy("__label")
    before = F.sum("__n").over(w.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    return n.select("__label", "__b", "__n", F.coalesce(before, F.lit(0)).alias("__off"), F.sum("__n").over(w).alias("__all"))


def _split_cuts(df: DataFrame, label: str, key: str, fractions, seed: int) -> DataFrame:
    """One row per label: the (hash, key) where validation and test begin.
    Counting hash buckets finds the two buckets that hold a cut; only their
    rows are ranked."""
    f_train, f_val, f_test = fractions
    off = _bucket_offsets(df, label, key, seed)
    n_rest = F.col("__all") - F.ceil(F.col("__all") * F.lit(f_test) - F.lit(1e-9))
    n_val = F.ceil(n_rest * F.lit(f_val / (f_train + f_val)) - F.lit(1e-9))
    cuts = off.select("__label", "__b", "__n", "__off", F.inline(F.array(
        F.struct(F.lit("__val").alias("cut"), (n_rest - n_val).alias("at")), F.struct(F.lit("__test").alias("cut"), n_rest.alias("at")))))
    here = cuts.where((F.col("at") >= F.col("__off")) & (F.col("at") < F.col("__off") + F.col("__n")))
    h = hash_order(key, seed)
    rows = df.select(F.col(label).alias("__l"), h.alias("h"), F.col(key).alias("k"))
    rows = rows.join(F.broadcast(here), F.col("__l").eqNullSafe(F.col("__label")) & (F.substring("h", 1, BUCKET_DIGITS) == F.col("__b")))
    w = Window.partitionBy("__label", "cut").orderBy("h", "k")
    hit = rows.withColumn("__r", F.row_number().over(w) - 1 + F.col("__off")).where(F.col("__r") == F.col("at"))
    pick = lambda c: F.max(F.when(F.col("cut") == c, F.struct("h", "k"))).alias(c)
    return (off.select("__label").distinct().withColumnRenamed("__label", "__l2")
            .join(hit.groupBy("__label").agg(pick("__val"), pick("__test")), F.col("__l2").eqNullSafe(F.col("__label")), "left")
            .select(F.col("__l2").alias("__label"), "__val", "__test"))


def stratified_kfold(df: DataFrame, k: int = 5, label: str = "Churn", key: str = "customerID",
                     seed: int = C.SEED, name: str = "fold") -> DataFrame:
    """fold = position within label (seeded md5 order) mod k.  The
    position is the rank in a hash bucket plus the bucket's offset (65,536
    buckets per label), so a hot label is spread over its buckets."""
    off = _bucket_offsets(df.select(F.col(label), F.col(key)), label, key, seed).select("__label", "__b", "__off")
    d = df.withColumn("__h", hash_order(key, seed)).withColumn("__b0", F.substring("__h", 1, BUCKET_DIGITS))
    w = Window.partitionBy(label, "__b0").orderBy("__h", key)
    d = d.withColumn("__r", F.row_number().over(w) - 1)
    out = d.join(F.broadcast(off), F.col(label).eqNullSafe(F.col("__label")) & (F.col("__b0") == F.col("__b")))
    return out.withColumn(name, ((F.col("__off") + F.col("__r")) % k).cast("int")).drop("__h", "__b0", "__r", "__label", "__b", "__off")


def trainval_union(train: DataFrame, val: DataFrame) -> DataFrame:
    """F24"""
    return train.unionByName(val)
