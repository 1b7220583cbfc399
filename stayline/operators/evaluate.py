"""Evaluation.

Counting metrics are one grouped aggregation of ``sum(when(...))``.
Curve metrics (AUC, ROC, PR, best-F1 threshold) first aggregate by
distinct score - partial aggregation, so a score shared by a third of the
rows costs nothing extra - and then take running sums over the distinct
scores with a two-level prefix sum (``positions.prefix_sums``), never a
single-task window over the table.  All ratios are single IEEE operations
on exact integer counts, so any engine gives the same bits.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayline import config as C
from stayline.operators.positions import prefix_sums


def _div0(a, b):
    """a / b with 0 on 0/0 (zero_division=0)."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def confusion_counts(y: str, pred: str) -> list:
    yc, pc = F.col(y), F.col(pred)
    return [F.sum(((yc == 0) & (pc == 0)).cast("long")).alias("tn"),
            F.sum(((yc == 0) & (pc == 1)).cast("long")).alias("fp"),
            F.sum(((yc == 1) & (pc == 0)).cast("long")).alias("fn"),
            F.sum(((yc == 1) & (pc == 1)).cast("long")).alias("tp")]


def confusion_matrix(df: DataFrame, y: str = "label", pred: str = "pred",
                     groups: Sequence[str] = ()) -> DataFrame:
    """Tn, fp, fn, tp (always defined, also for one-class input)."""
    g = df.groupBy(*groups) if groups else df.groupBy()
    return g.agg(*confusion_counts(y, pred))


def with_binary_metrics(cm: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 from the four counts."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    prec = _div0(tp, tp + fp)
    rec = _div0(tp, tp + fn)
    out = cm.withColumns({
        "accuracy": _div0(tp + tn, tn + fp + fn + tp),
        "precision": prec,
        "recall": rec,
    })
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r == 0, F.lit(0.0)).otherwise(F.lit(2.0) * p * r / (p + r)))


def binary_metrics(df: DataFrame, y: str = "label", pred: str = "pred",
                   groups: Sequence[str] = ()) -> DataFrame:
    return with_binary_metrics(confusion_matrix(df, y, pred, groups))


def classification_report(df: DataFrame, y: str = "label", pred: str = "pred") -> DataFrame:
    """Per class precision/recall/F1/support, accuracy, macro and
    weighted averages, as rows (row_label, precision, recall, f1, support)."""
    cm = binary_metrics(df, y, pred)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    per = cm.select(
        F.explode(F.array(
            F.struct(F.lit("0").alias("row_label"), _div0(tn, tn + fn).alias("precision"),
                     _div0(tn, tn + fp).alias("recall"), (tn + fp).alias("support")),
            F.struct(F.lit("1").alias("row_label"), _div0(tp, tp + fp).alias("precision"),
                     _div0(tp, tp + fn).alias("recall"), (tp + fn).alias("support")))).alias("r"),
        F.col("accuracy"), n.alias("n")).select("r.*", "accuracy", "n")
    p, r = F.col("precision"), F.col("recall")
    per = per.withColumn("f1", F.when(p + r == 0, F.lit(0.0)).otherwise(F.lit(2.0) * p * r / (p + r)))
    classes = per.select("row_label", "precision", "recall", "f1", "support")
    macro = per.groupBy().agg(F.lit("macro avg").alias("row_label"),
                              (F.sum("precision") / 2).alias("precision"),
                              (F.sum("recall") / 2).alias("recall"),
                              (F.sum("f1") / 2).alias("f1"), F.max("n").alias("support"))
    weighted = per.groupBy().agg(F.lit("weighted avg").alias("row_label"),
                                 (F.sum(F.col("precision") * F.col("support")) / F.max("n")).alias("precision"),
                                 (F.sum(F.col("recall") * F.col("support")) / F.max("n")).alias("recall"),
                                 (F.sum(F.col("f1") * F.col("support")) / F.max("n")).alias("f1"),
                                 F.max("n").alias("support"))
    acc = per.groupBy().agg(F.lit("accuracy").alias("row_label"), F.max("accuracy").alias("precision"),
                            F.max("accuracy").alias("recall"), F.max("accuracy").alias("f1"),
                            F.max("n").alias("support"))
    return classes.unionByName(acc).unionByName(macro).unionByName(weighted)


def score_counts(df: DataFrame, y: str, p: str, groups: Sequence[str] = ()) -> DataFrame:
    """(groups..., score, pos, neg) - one row per distinct score."""
    return df.groupBy(*groups, F.col(p).alias("score")).agg(
        F.sum((F.col(y) == 1).cast("long")).alias("pos"),
        F.sum((F.col(y) == 0).cast("long")).alias("neg"))


def _desc_cum(df: DataFrame, y: str, p: str, groups: Sequence[str]) -> DataFrame:
    """Per distinct score: pos/neg at the score and cumulative counts of
    rows with score >= it (descending running sums)."""
    return _cum_of_counts(score_counts(df, y, p, groups), groups)


def _cum_of_counts(counts: DataFrame, groups: Sequence[str]) -> DataFrame:
    sc = counts.withColumn("__neg_score", -F.col("score"))
    return prefix_sums(sc, groups, ["__neg_score"], ["pos", "neg"]).drop("__neg_score")


def roc_auc_grouped(df: DataFrame, groups: Sequence[str], y: str = "label", p: str = "churn_prob") -> DataFrame:
    """Exact AUC with ties (= Mann-Whitney rank-sum) per group.

    AUC = sum_s pos(s) * (neg_below(s) + neg(s)/2) / (P*N); with
    neg_below(s) = N - neg_cum(s) the numerator is an exact integer
    (times 2), so the result is one division.
    """
    return roc_auc_of_counts(score_counts(df, y, p, groups), groups)


def roc_auc_of_counts(counts: DataFrame, groups: Sequence[str], also: Sequence[str] = ()) -> DataFrame:
    """``roc_auc_grouped`` of rows that are counted by (groups..., score); the
    columns ``also`` are added up per group."""
    cum = _cum_of_counts(counts, groups)
    tot = cum.groupBy(*groups).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"), *[F.sum(c).alias(f"__all_{c}") for c in also])
    j = cum.join(tot, list(groups)) if groups else cum.crossJoin(tot)
    num2 = F.col("pos") * (F.lit(2) * (F.col("N") - F.col("neg_cum")) + F.col("neg"))
    agg = j.groupBy(*groups).agg(F.sum(num2).alias("__num2"), F.max("P").alias("P"), F.max("N").alias("N"), *[F.max(f"__all_{c}").alias(c) for c in also])
    return agg.select(*groups, F.when((F.col("P") == 0) | (F.col("N") == 0), F.lit(None).cast("double"))
                      .otherwise(F.col("__num2").cast("double") / (F.lit(2.0) * F.col("P") * F.col("N")))
                      .alias("roc_auc"), *also)


def roc_auc(df: DataFrame, y: str = "label", p: str = "churn_prob") -> DataFrame:
    return roc_auc_grouped(df, [], y, p)


def roc_curve(df: DataFrame, y: str = "label", p: str = "churn_prob", groups: Sequence[str] = ()) -> DataFrame:
    """E5: (threshold, fpr, tpr) per distinct score, no point dropped."""
    cum = _desc_cum(df, y, p, groups)
    tot = cum.groupBy(*groups).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    j = cum.join(F.broadcast(tot), list(groups)) if groups else cum.crossJoin(F.broadcast(tot))
    return j.select(*groups, F.col("score").alias("threshold"),
                    _div0(F.col("neg_cum"), F.col("N")).alias("fpr"),
                    _div0(F.col("pos_cum"), F.col("P")).alias("tpr"))


def pr_curve(df: DataFrame, y: str = "label", p: str = "churn_prob", groups: Sequence[str] = (),
             eps: float = C.F1_EPS) -> DataFrame:
    """(threshold, precision, recall, f1) per distinct score, where
    predicted positive means score >= threshold; f1 uses +eps."""
    cum = _desc_cum(df, y, p, groups)
    tot = cum.groupBy(*groups).agg(F.sum("pos").alias("P"))
    j = cum.join(F.broadcast(tot), list(groups)) if groups else cum.crossJoin(F.broadcast(tot))
    prec = _div0(F.col("pos_cum"), F.col("pos_cum") + F.col("neg_cum"))
    rec = F.when(F.col("P") == 0, F.lit(1.0)).otherwise(F.col("pos_cum") / F.col("P"))
    out = j.select(*groups, F.col("score").alias("threshold"), prec.alias("precision"), rec.alias("recall"))
    pr, rc = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.lit(2.0) * (pr * rc) / (pr + rc + F.lit(eps)))


def best_f1_threshold(df: DataFrame, y: str = "label", p: str = "churn_prob",
                      groups: Sequence[str] = ()) -> DataFrame:
    """Argmax F1 over the PR curve; ties -> lowest threshold.

    ``max_by`` over a (f1, -threshold) ordering is a partial aggregate, so
    the curve is never gathered in one place.
    """
    curve = pr_curve(df, y, p, groups)
    order = F.struct(F.col("f1"), -F.col("threshold"))
    best = curve.groupBy(*groups).agg(F.max_by(F.struct("threshold", "precision", "recall", "f1"), order).alias("b"))
    return best.select(*groups, "b.threshold", "b.precision", "b.recall", "b.f1")


def best_f1_threshold_value(df: DataFrame, y: str = "label", p: str = "churn_prob") -> float:
    r = best_f1_threshold(df, y, p).first()
    return float(r["threshold"]) if r else C.DEFAULT_THRESHOLD


def evaluate_grouped(df: DataFrame, groups: Sequence[str], y: str = "label", pred: str = "pred",
                     p: str | None = "churn_prob") -> DataFrame:
    """E8/E9 core: counts + metrics (+ AUC) per group."""
    m = binary_metrics(df, y, pred, groups)
    if p is None:
        return m
    auc = roc_auc_grouped(df, groups, y, p)
    return m.join(auc, list(groups)) if groups else m.crossJoin(auc)


def evaluate_model(df: DataFrame, tau: float = C.DEFAULT_THRESHOLD, y: str = "label",
                   p: str = "churn_prob", inclusive: bool = True, rank: str | None = None) -> DataFrame:
    """Metrics of one labelled score set at threshold tau."""
    pred = (F.col(p) >= tau) if inclusive else (F.col(p) > tau)
    return evaluate_grouped(df.withColumn("pred", pred.cast("int")), [], y, "pred", rank or p) \
        .withColumn("threshold", F.lit(float(tau)))


def evaluate_splits(df: DataFrame, tau: float = C.DEFAULT_THRESHOLD, split: str = "split",
                    y: str = "label", p: str = "churn_prob", rank: str | None = None) -> DataFrame:
    """E8 per split (splits that are absent simply do not appear)."""
    d = df.withColumn("pred", (F.col(p) >= tau).cast("int"))
    return evaluate_grouped(d, [split], y, "pred", rank or p).withColumn("threshold", F.lit(float(tau)))


def _per_threshold(df: DataFrame, thresholds: Sequence[float], y: str, p: str, extra=()) -> DataFrame:
    """One row per threshold from a single aggregation: conditional sums for
    every threshold, so rows are never multiplied by the thresholds.
    ``extra`` maps a name to a function of the flag column."""
    yc, pc = F.col(y), F.col(p)
    cells = []
    for t in thresholds:
        flag = pc >= F.lit(float(t))
        one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
        cells.append(F.struct(F.lit(float(t)).alias("threshold"), one((yc == 0) & ~flag).alias("tn"), one((yc == 0) & flag).alias("fp"),
                              one((yc == 1) & ~flag).alias("fn"), one((yc == 1) & flag).alias("tp"),
                              *[f(flag).alias(n) for n, f in extra]))
    return df.agg(F.array(*cells).alias("__t")).select(F.inline("__t"))


def compare_thresholds(df: DataFrame, thresholds: Sequence[float] = C.COMPARE_THRESHOLDS,
                       y: str = "label", p: str = "churn_prob", rank: str | None = None) -> DataFrame:
    """Metrics at each threshold; ``rank`` is the column whose order
    the AUC uses (the score unless given)."""
    return with_binary_metrics(_per_threshold(df, thresholds, y, p)).crossJoin(roc_auc(df, y, rank or p))


def threshold_tuning_summary(df: DataFrame, model: str = "model", y: str = "label",
                             p: str = "churn_prob", default: float = C.DEFAULT_THRESHOLD) -> DataFrame:
    """Per model, metrics at the default threshold vs at the best-F1
    threshold, and the F1 gain."""
    best = best_f1_threshold(df, y, p, [model]).select(
        model, F.col("threshold").alias("opt_threshold"))
    d = df.join(F.broadcast(best), model)
    d = d.withColumn("pred_default", (F.col(p) >= default).cast("int")) \
         .withColumn("pred_opt", (F.col(p) >= F.col("opt_threshold")).cast("int"))
    a = binary_metrics(d, y, "pred_default", [model]).select(
        model, F.col("precision").alias("default_precision"), F.col("recall").alias("default_recall"),
        F.col("f1").alias("default_f1"))
    b = binary_metrics(d, y, "pred_opt", [model]).select(
        model, F.col("precision").alias("opt_precision"), F.col("recall").alias("opt_recall"),
        F.col("f1").alias("opt_f1"))
    return (a.join(b, model).join(best, model)
            .withColumn("f1_gain", F.col("opt_f1") - F.col("default_f1")))


def cm_delta(df: DataFrame, tau: float, y: str = "label", p: str = "churn_prob",
             default: float = C.DEFAULT_THRESHOLD) -> DataFrame:
    """Tp / fn / fp at the default vs the tuned threshold."""
    d = df.withColumn("pa", (F.col(p) >= default).cast("int")).withColumn("pb", (F.col(p) >= tau).cast("int"))
    a = confusion_matrix(d, y, "pa").select(*[F.col(c).alias(f"{c}_default") for c in ("tn", "fp", "fn", "tp")])
    b = confusion_matrix(d, y, "pb").select(*[F.col(c).alias(f"{c}_tuned") for c in ("tn", "fp", "fn", "tp")])
    out = a.crossJoin(b)
    return out.withColumns({f"{c}_delta": F.col(f"{c}_tuned") - F.col(f"{c}_default") for c in ("tp", "fn", "fp")})


def model_ranking(metrics: DataFrame, model: str = "model") -> DataFrame:
    """Average rank (pandas 'average' method, 1 = best, truncated to
    int) of AUC and F1 per model, and which model is best by either (ties to
    the first name).  Model tables hold one row per model."""
    def avg_rank(c):
        w = Window.orderBy(F.desc(c))
        ties = Window.partitionBy(c)
        return (F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)

    def best(c):
        return F.row_number().over(Window.orderBy(F.desc(c), model)) == 1
    return (metrics.select(model, "roc_auc", "f1")
            .withColumn("auc_rank", avg_rank("roc_auc").cast("int"))
            .withColumn("f1_rank", avg_rank("f1").cast("int"))
            .withColumn("best_by_auc", best("roc_auc")).withColumn("best_by_f1", best("f1")))


def threshold_scenario(scored: DataFrame, thresholds: Sequence[float] = C.COMPARE_THRESHOLDS,
                       p: str = "churn_prob", y: str = "Churn") -> DataFrame:
    """Per threshold: customers flagged, their MRR (exact cents), and
    the confusion counts against the label."""
    cents = F.round(F.col("MonthlyCharges") * 100).cast("long")
    return _per_threshold(scored, thresholds, y, p, [
        ("flagged", lambda f: F.sum(f.cast("long"))),
        ("flagged_mrr", lambda f: F.sum(F.when(f, cents).otherwise(F.lit(0))) / 100.0)])


def latest_metrics(history: DataFrame) -> DataFrame:
    """Latest value per (split, metric) by timestamp."""
    w = Window.partitionBy("split", "metric").orderBy(F.desc("ts"))
    return history.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def metrics_long(metrics: DataFrame, split: str = "split",
                 names=("accuracy", "precision", "recall", "f1", "roc_auc")) -> DataFrame:
    """Wide metrics (one row per split) -> long (split, metric, value)."""
    stack = ", ".join(f"'{n}', CAST(`{n}` AS DOUBLE)" for n in names)
    return metrics.selectExpr(split, f"stack({len(names)}, {stack}) AS (metric, value)")
