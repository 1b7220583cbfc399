"""Column-expression building blocks.

Every helper returns a native ``Column`` so it compiles into whole-stage
codegen; no Python runs per row.  Helpers that turn doubles into text do it
from integers so the text is identical in any SQL engine.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from stayline import config as C


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def idiv(a, b) -> Column:
    """Integer division of non-negative integers (SQL ``a div b``)."""
    a, b = col(a), (F.lit(b) if isinstance(b, int) else col(b))
    return ((a - a % b) / b).cast("long")


def nan_to_null(c) -> Column:
    c = col(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def coerce_numeric(c) -> Column:
    """String -> double; blanks, junk and 'nan' become null (to_numeric with
    errors='coerce')."""
    return nan_to_null(F.trim(col(c).cast("string")).try_cast("double"))


def flag(cond: Column) -> Column:
    """Boolean -> 0/1 int, missing -> 0 (pandas comparisons with NaN are False)."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def is_yes(c) -> Column:
    return F.coalesce(col(c).isin("Yes", "yes"), F.lit(False))


def count_yes(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [is_yes(c).cast("int") for c in cols])


def tenure_band(c="tenure", bins: Sequence[float] = C.TENURE_BINS,
                labels: Sequence[str] = C.TENURE_LABELS) -> Column:
    """Right-closed bins (lo, hi] -> label; anything else -> the string 'nan'."""
    c = col(c)
    expr = None
    for lo, hi, lab in zip(bins[:-1], bins[1:], labels):
        cond = (c > lo) & (c <= hi)
        expr = F.when(cond, lab) if expr is None else expr.when(cond, lab)
    return expr.otherwise(F.lit("nan"))


def decide(p, tau, inclusive: bool = True) -> Column:
    p = col(p)
    tau = F.lit(tau) if isinstance(tau, (int, float)) else col(tau)
    return (p >= tau) if inclusive else (p > tau)


def micro(c) -> Column:
    """Probability-like double -> exact integer micro-units."""
    return F.round(col(c) * 1_000_000).cast("long")


def mean_from_micro(sum_micro: Column, n: Column) -> Column:
    """sum of micro-units / (n * 1e6) as one IEEE division."""
    return sum_micro.cast("double") / (n.cast("double") * 1_000_000.0)


# -- rules ------------------------------------------------------------------

def value_tier(tenure="tenure", charges="MonthlyCharges",
               th: dict = C.RULE_THRESHOLDS) -> Column:
    t = F.coalesce(col(tenure), F.lit(0))
    m = F.coalesce(col(charges), F.lit(0.0))
    return (F.when((t >= th["high_value_tenure_months"]) & (m >= th["high_value_monthly_charges"]), "high")
            .when(m < th["low_value_monthly_charges"], "low")
            .otherwise("medium"))


def value_score(tier) -> Column:
    t = col(tier)
    s = C.VALUE_TIER_SCORE
    return (F.when(t == "low", s["low"]).when(t == "medium", s["medium"])
            .when(t == "high", s["high"]).otherwise(0.5))


def segment_risk(label, risks: dict = C.SEGMENT_RISK, default: float = C.DEFAULT_SEGMENT_RISK) -> Column:
    lab = col(label)
    expr = None
    for name, r in risks.items():
        expr = F.when(lab == name, r) if expr is None else expr.when(lab == name, r)
    return expr.otherwise(F.lit(default))


def clamp01(c) -> Column:
    return F.least(F.greatest(col(c), F.lit(0.0)), F.lit(1.0))


def rule_priority(p, seg_risk, v_score, w: dict = C.PRIORITY_WEIGHTS) -> Column:
    return clamp01(col(p) * w["churn_probability"] + col(seg_risk) * w["segment_risk"]
                   + (F.lit(1.0) - col(v_score)) * w["customer_value"])


def select_action(p, tier, contract, th: dict = C.RULE_THRESHOLDS) -> Column:
    p, tier = col(p), col(tier)
    monthly = F.coalesce(col(contract), F.lit("Month-to-month")).contains("Month")
    high, med = th["high_churn_prob"], th["medium_churn_prob"]
    return (F.when(p >= high,
                   F.when(tier == "high", F.when(monthly, "early_exit_waiver").otherwise("vip_support"))
                   .when(tier == "medium", "retention_call")
                   .otherwise("discount_offer"))
            .when(p >= med,
                  F.when(tier == "high", "discount_offer")
                  .when(tier == "medium", "retention_call")
                  .otherwise("do_nothing"))
            .otherwise(F.when(tier == "high", "loyalty_program").otherwise("do_nothing")))


def risk_level(p, high: float = 0.6, medium: float = 0.4) -> Column:
    p = col(p)
    return F.when(p >= high, "high").when(p >= medium, "medium").otherwise("low")


def pct1_text(p) -> Column:
    """p in [0, 1] -> 'xx.x%' rounded half-up on micro-units."""
    tenths = idiv(micro(p) + 500, 1000)
    return F.concat(idiv(tenths, 10).cast("string"), F.lit("."),
                    (tenths % 10).cast("string"), F.lit("%"))


def action_reason(label, p, tier) -> Column:
    p = col(p)
    level = F.when(p >= 0.6, "High").when(p >= 0.4, "Medium").otherwise("Low")
    return F.concat_ws(" | ",
                       F.concat(F.lit("Segment: "), F.coalesce(col(label), F.lit(""))),
                       F.concat(level, F.lit(" churn risk ("), pct1_text(p), F.lit(")")),
                       F.concat(F.lit("Customer value: "), F.initcap(col(tier))))


def band(c, cuts: Sequence[float], labels: Sequence[str] = ("High", "Medium", "Low")) -> Column:
    """Descending cut points: c >= cuts[0] -> labels[0], ... else labels[-1]."""
    c = col(c)
    expr = None
    for cut, lab in zip(cuts, labels):
        expr = F.when(c >= cut, lab) if expr is None else expr.when(c >= cut, lab)
    return expr.otherwise(labels[len(cuts)])


def impact_direction(phi, eps: float = C.NEUTRAL_EPS) -> Column:
    phi = col(phi)
    return (F.when(F.abs(phi) < eps, "neutral")
            .when(phi > 0, "increases_churn").otherwise("decreases_churn"))


def money0_text(cents) -> Column:
    """'$1,234' from integer cents (rounded half-up to dollars)."""
    return F.concat(F.lit("$"), F.format_number(idiv(col(cents) + 50, 100), 0))


def money2_text(cents) -> Column:
    """'$1,234.56' from integer cents."""
    c = col(cents)
    return F.concat(F.lit("$"), F.format_number(idiv(c, 100), 0), F.lit("."),
                    F.lpad((c % 100).cast("string"), 2, "0"))


def and_all(conds: Iterable[Column]) -> Column:
    conds = list(conds)
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)
