"""Registered queries: rules, lookups, portfolio, exploration, evaluation
and what-if (R*, J*, P*, D*, E*, W*, B*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stayline import config as C
from stayline.operators import evaluate as E
from stayline.operators import explore as D
from stayline.operators import explain, features, model as M, portfolio as P, rules, segments, whatif
from stayline.plans import score as B
from stayline.plans.oracle import SHAP, dbl, feat_sql, scored_sql, sstr, with_views
from stayline.plans.queries_core import SPLIT_SQL
from stayline.plans.registry import query
from stayline.plans.score import processed_view, scored_view
from stayline.session import cut_lineage, scratch_path
from stayline.sources.tables import customer_view

CENTS = "CAST(round(MonthlyCharges * 100) AS BIGINT)"


def micro(c: str) -> str:
    return f"CAST(round({c} * 1000000) AS BIGINT)"


def mean_micro(c: str, n: str = "count(*)") -> str:
    return f"CAST(sum({micro(c)}) AS DOUBLE) / (CAST({n} AS DOUBLE) * 1000000.0)"


def pct1(x: str) -> str:
    t = f"((CAST(round(({x}) * 1000000) AS BIGINT) + 500) // 1000)"
    return f"(CAST({t} // 10 AS VARCHAR) || '.' || CAST({t} % 10 AS VARCHAR) || '%')"


def money0(cents: str) -> str:
    return f"('$' || format('{{:,}}', ({cents} + 50) // 100))"


def money2(cents: str) -> str:
    return f"('$' || format('{{:,}}', {cents} // 100) || '.' || lpad(CAST({cents} % 100 AS VARCHAR), 2, '0'))"


# ---------------------------------------------------------------------------
# R: rules
# ---------------------------------------------------------------------------

RULE_COLS = ["customerID", "segment_label", "churn_prob", "tenure", "MonthlyCharges", "Contract"]


@query("value_tier", with_views("SELECT customerID, value_tier FROM scored"))
def q_value_tier(spark, sf_dir):
    return rules.value_tier(scored_view(spark, sf_dir).select(*RULE_COLS)).select("customerID", "value_tier")


@query("value_score", with_views("SELECT customerID, value_tier, value_score FROM scored"))
def q_value_score(spark, sf_dir):
    s = rules.value_score(rules.value_tier(scored_view(spark, sf_dir).select(*RULE_COLS)))
    return s.select("customerID", "value_tier", "value_score")


@query("rule_priority", with_views("SELECT customerID, priority FROM scored"))
def q_rule_priority(spark, sf_dir):
    return scored_view(spark, sf_dir).select("customerID", "priority")


@query("select_action", with_views("SELECT customerID, action_key FROM scored"))
def q_select_action(spark, sf_dir):
    return scored_view(spark, sf_dir).select("customerID", "action_key")


@query("action_reason", with_views("SELECT customerID, reason FROM scored"))
def q_action_reason(spark, sf_dir):
    return scored_view(spark, sf_dir).select("customerID", "reason")


@query("decide_action", with_views(
    "SELECT customerID, action_key, action_label, priority, reason FROM scored"))
def q_decide_action(spark, sf_dir):
    return scored_view(spark, sf_dir).select("customerID", "action_key", "action_label", "priority", "reason")


def _override_sql() -> str:
    th = C.RULE_THRESHOLDS
    lvl = (f"CASE WHEN churn_prob >= {dbl(th['high_churn_prob'])} THEN 'high' "
           f"WHEN churn_prob >= {dbl(th['medium_churn_prob'])} THEN 'medium' ELSE 'low' END")
    rows = ", ".join(f"({sstr(seg)}, '{l}', {sstr(a[f'{l}_churn'])})"
                     for seg, a in C.SEGMENT_SPECIFIC_ACTIONS.items() for l in ("low", "medium", "high"))
    return ("SELECT s.customerID, s.segment_label, s.risk_level, o.override_action FROM "
            f"(SELECT customerID, segment_label, {lvl} AS risk_level FROM scored) s LEFT JOIN "
            f"(SELECT * FROM (VALUES {rows}) t(segment_label, risk_level, override_action)) o "
            "ON s.segment_label = o.segment_label AND s.risk_level = o.risk_level")


@query("segment_action_override", with_views(_override_sql()))
def q_segment_action_override(spark, sf_dir):
    s = scored_view(spark, sf_dir).select("customerID", "segment_label", "churn_prob")
    return rules.segment_action_override(s).select("customerID", "segment_label", "risk_level", "override_action")


# ---------------------------------------------------------------------------
# J: joins and lookups
# ---------------------------------------------------------------------------

@query("attach_segments", with_views(
    "SELECT c.*, s.segment, s.segment_label FROM clean c LEFT JOIN scored s ON c.customerID = s.customerID"))
def q_attach_segments(spark, sf_dir):
    """J1 on the processed rows' own features: one projection, no join."""
    return segments.attach_segments(processed_view(spark, sf_dir))


@query("segment_label_lookup", with_views(
    "SELECT customerID, segment, CASE segment " + " ".join(f"WHEN {i} THEN {sstr(n)}" for i, n in C.SEGMENT_LABELS.items())
    + " END AS segment_label FROM scored"))
def q_segment_label_lookup(spark, sf_dir):
    s = scored_view(spark, sf_dir).select("customerID", "segment")
    dim = spark.createDataFrame(list(C.SEGMENT_LABELS.items()), "segment int, segment_label string")
    return segments.segment_label_lookup(s, dim)


@query("segment_risk_lookup", with_views("SELECT customerID, segment_label, segment_risk FROM scored"))
def q_segment_risk_lookup(spark, sf_dir):
    s = scored_view(spark, sf_dir).select("customerID", "segment_label")
    return rules.segment_risk_lookup(s).select("customerID", "segment_label", "segment_risk")


@query("action_lookup", with_views(
    "SELECT customerID, action_key, action_label, CASE action_key "
    + " ".join(f"WHEN {sstr(k)} THEN {sstr(d)}" for k, (_, d) in C.ACTIONS.items())
    + " ELSE '' END AS action_description FROM scored"))
def q_action_lookup(spark, sf_dir):
    s = scored_view(spark, sf_dir).select("customerID", "action_key")
    return rules.action_lookup(s).select("customerID", "action_key", "action_label", "action_description")


SEG_MEAN_SQL = f"segmean AS (SELECT segment, {mean_micro('churn_prob')} AS seg_risk FROM scored GROUP BY segment)"


@query("batch_risk_join", with_views(
    "SELECT s.customerID, s.segment, m.seg_risk FROM scored s LEFT JOIN segmean m ON s.segment = m.segment",
    extra=SEG_MEAN_SQL))
def q_batch_risk_join(spark, sf_dir):
    return P.batch_risk_join(scored_view(spark, sf_dir)).select("customerID", "segment", "seg_risk")


@query("failed_rows", with_views(
    "SELECT r.customerID, r.tenure, r.TotalCharges FROM raw r ANTI JOIN scored s ON r.customerID = s.customerID"))
def q_failed_rows(spark, sf_dir):
    raw = customer_view(spark, sf_dir)
    return B.failed_rows(raw).select("customerID", "tenure", "TotalCharges")


# ---------------------------------------------------------------------------
# P: portfolio and action plan
# ---------------------------------------------------------------------------

@query("risk_frame", with_views(
    f"SELECT customerID, segment, segment_label, is_churner, churn_prob, tenure, MonthlyCharges, TotalCharges, "
    f"action_label, priority, {CENTS} AS monthly_cents, CAST({micro('churn_prob')} * {CENTS} AS DOUBLE) / 1e8 AS expected_loss, "
    f"CASE WHEN is_churner THEN MonthlyCharges * 12 ELSE 0.0 END AS arr_at_risk FROM scored"))
def q_risk_frame(spark, sf_dir):
    return P.risk_frame(scored_view(spark, sf_dir))


@query("portfolio_kpis", with_views(f"""
SELECT customers, CAST(m AS DOUBLE) / 100 AS total_mrr, CAST(r AS DOUBLE) / 100 AS mrr_at_risk,
  CASE WHEN m = 0 THEN 0.0 ELSE CAST(r AS DOUBLE) * 100.0 / CAST(m AS DOUBLE) END AS pct_mrr_at_risk,
  CAST(el AS DOUBLE) / 1e8 AS expected_loss, CAST(r * 12 AS DOUBLE) / 100 AS arr_at_risk,
  CAST(m AS DOUBLE) / (CAST(customers AS DOUBLE) * 100.0) AS avg_customer_value
FROM (SELECT count(*) AS customers, sum({CENTS}) AS m,
        sum(CASE WHEN is_churner THEN {CENTS} ELSE 0 END) AS r,
        sum({micro('churn_prob')} * {CENTS}) AS el FROM scored) t"""))
def q_portfolio_kpis(spark, sf_dir):
    return P.portfolio_kpis(scored_view(spark, sf_dir))


SEG_REV_SQL = f"""
segrev AS (
  SELECT segment_label AS segment, count(*) AS customers, CAST(sum(CAST(is_churner AS INTEGER)) AS BIGINT) AS churners,
    CAST(sum({CENTS}) AS DOUBLE) / 100 AS mrr,
    CAST(sum(CASE WHEN is_churner THEN {CENTS} ELSE 0 END) AS DOUBLE) / 100 AS mrr_at_risk,
    CAST(sum({micro('churn_prob')} * {CENTS}) AS DOUBLE) / 1e8 AS expected_loss,
    {mean_micro('churn_prob')} AS avg_prob,
    CAST(sum(tenure) AS DOUBLE) / count(*) AS avg_tenure,
    CAST(sum({CENTS}) AS DOUBLE) / (CAST(count(*) AS DOUBLE) * 100.0) AS avg_monthly,
    {mean_micro('priority')} AS avg_priority,
    CAST(sum(CASE WHEN is_churner THEN {CENTS} ELSE 0 END) AS BIGINT) AS risk_cents,
    CAST(sum({CENTS}) AS BIGINT) AS mrr_cents
  FROM scored GROUP BY segment_label),
segrat AS (
  SELECT segrev.* EXCLUDE (risk_cents, mrr_cents),
    CAST(churners AS DOUBLE) / CAST(customers AS DOUBLE) AS churn_rate,
    CAST(risk_cents * 12 AS DOUBLE) / 100 AS arr_at_risk,
    CASE WHEN tot = 0 THEN 0.0 ELSE CAST(risk_cents AS DOUBLE) / CAST(tot AS DOUBLE) END AS risk_share,
    CAST(mrr_cents - risk_cents AS DOUBLE) / 100 AS safe_mrr
  FROM segrev CROSS JOIN (SELECT sum(risk_cents) AS tot FROM segrev) t)"""


@query("segment_revenue", with_views(
    "SELECT segment, customers, churners, mrr, mrr_at_risk, expected_loss, avg_prob, avg_tenure, avg_monthly, "
    "avg_priority, risk_cents AS mrr_at_risk_cents, mrr_cents FROM segrev", extra=SEG_REV_SQL))
def q_segment_revenue(spark, sf_dir):
    return P.segment_revenue(scored_view(spark, sf_dir))


@query("segment_ratios", with_views("SELECT * FROM segrat", extra=SEG_REV_SQL))
def q_segment_ratios(spark, sf_dir):
    return P.segment_ratios(P.segment_revenue(scored_view(spark, sf_dir)))


TOP_ACTION_SQL = """
topact AS (
  SELECT segment_label AS segment, action_label AS top_action, n AS top_action_n FROM (
    SELECT segment_label, action_label, count(*) AS n FROM scored GROUP BY segment_label, action_label) t
  QUALIFY row_number() OVER (PARTITION BY segment_label ORDER BY n DESC, action_label) = 1)"""


@query("top_action_per_segment", with_views("SELECT * FROM topact", extra=TOP_ACTION_SQL))
def q_top_action_per_segment(spark, sf_dir):
    return P.top_action_per_segment(scored_view(spark, sf_dir))


@query("segment_intelligence", with_views(f"""
SELECT r.segment, r.customers, r.churners, {pct1('r.churn_rate')} AS churn_rate_text,
  {pct1('r.avg_prob')} AS avg_prob_text,
  {money0('CAST(round(r.mrr * 100) AS BIGINT)')} AS mrr_text,
  {money0('CAST(round(r.mrr_at_risk * 100) AS BIGINT)')} AS mrr_at_risk_text,
  {pct1('r.risk_share')} AS risk_share_text,
  coalesce(t.top_action, '—') AS top_action,
  CASE WHEN r.churn_rate > 0.4 THEN 'danger' WHEN r.churn_rate > 0.2 THEN 'warn' ELSE 'ok' END AS tone,
  r.avg_tenure, {money2('CAST(round(r.mrr * 100 / r.customers) AS BIGINT)')} AS avg_mrr_text,
  {money0('CAST(round(r.mrr_at_risk * 100) AS BIGINT) * 12')} AS arr_at_risk_text, r.avg_priority, r.mrr_at_risk
FROM segrat r LEFT JOIN topact t ON r.segment = t.segment""", extra=SEG_REV_SQL + "," + TOP_ACTION_SQL))
def q_segment_intelligence(spark, sf_dir):
    return P.segment_intelligence(scored_view(spark, sf_dir))


@query("distribution", with_views(
    "SELECT 'segment' AS dimension, segment_label AS value, count(*) AS customers FROM scored GROUP BY segment_label "
    "UNION ALL SELECT 'action', action_label, count(*) FROM scored GROUP BY action_label"))
def q_distribution(spark, sf_dir):
    s = scored_view(spark, sf_dir)
    a = P.distribution(s, "segment_label").select(F.lit("segment").alias("dimension"),
                                                  F.col("segment_label").alias("value"), "customers")
    b = P.distribution(s, "action_label").select(F.lit("action").alias("dimension"),
                                                 F.col("action_label").alias("value"), "customers")
    return a.unionByName(b)


MINMAX_SQL = "mm AS (SELECT min(MonthlyCharges) AS mc_min, max(MonthlyCharges) AS mc_max FROM scored)"
VNORM = ("(coalesce(MonthlyCharges, 0.0) - mc_min) / CASE WHEN mc_max - mc_min = 0 THEN 1.0 "
         "ELSE mc_max - mc_min END")


@query("minmax_value", with_views(f"SELECT customerID, {VNORM} AS value_norm FROM scored CROSS JOIN mm",
                                  extra=MINMAX_SQL))
def q_minmax_value(spark, sf_dir):
    return P.minmax_value(scored_view(spark, sf_dir)).select("customerID", "value_norm")


DRIVER_SQL = SHAP + ", drivers AS (SELECT customerID, " + ", ".join(
    f"max(CASE WHEN rank = {i} THEN feature END) AS driver_{i}" for i in (1, 2, 3)) + " FROM topl GROUP BY customerID)"


PLAN_SQL = SEG_MEAN_SQL + "," + MINMAX_SQL + "," + DRIVER_SQL + f""",
plan0 AS (
  SELECT s.*, m.seg_risk, {VNORM} AS value_norm FROM scored s LEFT JOIN segmean m ON s.segment = m.segment CROSS JOIN mm),
plan1 AS (
  SELECT plan0.*, least(greatest({dbl(0.4)} * churn_prob + {dbl(0.3)} * seg_risk + {dbl(0.3)} * value_norm, 0.0), 1.0)
    AS plan_priority FROM plan0),
plan AS (
  SELECT customerID, segment_label AS segment_name, segment,
    CAST(round(plan_priority * 100) AS INTEGER) AS priority_pct,
    CASE WHEN plan_priority >= 0.67 THEN 'High' WHEN plan_priority >= 0.34 THEN 'Medium' ELSE 'Low' END AS priority_level,
    CASE WHEN churn_prob >= 0.65 THEN 'High' WHEN churn_prob >= 0.35 THEN 'Medium' ELSE 'Low' END AS risk_level,
    round(churn_prob, 4) AS churn_prob, is_churner, action_label, reason,
    round(seg_risk, 3) AS seg_risk, round(value_norm, 3) AS value_norm, MonthlyCharges,
    CAST(CASE WHEN is_churner THEN {CENTS} ELSE 0 END AS DOUBLE) / 100 AS mrr_at_risk,
    round(churn_prob * MonthlyCharges, 2) AS expected_loss,
    coalesce(tenure, 0) AS tenure, Contract, PaymentMethod, InternetService,
    round(segment_confidence, 3) AS segment_confidence,
    coalesce(driver_1, '') AS driver_1, coalesce(driver_2, '') AS driver_2, coalesce(driver_3, '') AS driver_3, plan_priority
  FROM plan1 LEFT JOIN drivers USING (customerID))"""


def plan_view(spark, sf_dir):
    return P.action_plan(explain.with_drivers(scored_view(spark, sf_dir)))


@query("composite_priority", with_views("SELECT customerID, plan_priority FROM plan1", extra=PLAN_SQL))
def q_composite_priority(spark, sf_dir):
    return plan_view(spark, sf_dir).select("customerID", "plan_priority")


@query("risk_band", with_views("SELECT customerID, risk_level FROM plan", extra=PLAN_SQL))
def q_risk_band(spark, sf_dir):
    return plan_view(spark, sf_dir).select("customerID", "risk_level")


@query("priority_band", with_views("SELECT customerID, priority_level FROM plan", extra=PLAN_SQL))
def q_priority_band(spark, sf_dir):
    return plan_view(spark, sf_dir).select("customerID", "priority_level")


@query("action_plan", with_views("SELECT * FROM plan", extra=PLAN_SQL))
def q_action_plan(spark, sf_dir):
    return plan_view(spark, sf_dir)


SEGS = sorted(C.SEGMENT_RISK)[:3]


@query("plan_filters", with_views(
    "SELECT plan.*, row_number() OVER (ORDER BY plan_priority DESC, customerID) AS number FROM plan "
    "QUALIFY risk_level IN ('High', 'Medium') AND priority_level IN ('High', 'Medium') AND action_label IN ('Retention Call', 'Discount Offer', "
    f"'Early Exit Waiver') AND segment_name IN ({', '.join(map(sstr, SEGS))}) AND Contract IN ('Month-to-month', 'One year') "
    "AND churn_prob >= 0.3 AND MonthlyCharges >= 40.0 AND is_churner "
    "AND number IN (" + ", ".join(str(n) for n in range(1, 200, 2)) + ")", extra=PLAN_SQL))
def q_plan_filters(spark, sf_dir):
    return P.plan_filters(P.numbered_plan(plan_view(spark, sf_dir)), segments=SEGS, priority=["High", "Medium"], risk=["High", "Medium"],
                          actions=["Retention Call", "Discount Offer", "Early Exit Waiver"], contract=["Month-to-month", "One year"],
                          min_prob=0.3, min_monthly=40.0, churner_only=True, numbers=list(range(1, 200, 2)))


def _preset_sql() -> str:
    parts = []
    for name, spec in C.FOCUS_PRESETS.items():
        conds = ["true"]
        if spec.get("priority"):
            conds.append("priority_level IN (" + ", ".join(sstr(x) for x in spec["priority"]) + ")")
        if spec.get("risk"):
            conds.append("risk_level IN (" + ", ".join(sstr(x) for x in spec["risk"]) + ")")
        if spec.get("contract"):
            conds.append("Contract IN (" + ", ".join(sstr(x) for x in spec["contract"]) + ")")
        if spec.get("min_monthly"):
            conds.append(f"MonthlyCharges >= {dbl(spec['min_monthly'])}")
        if spec.get("churner_only"):
            conds.append("is_churner")
        parts.append(f"SELECT {sstr(name)} AS preset, count(*) AS customers, "
                     f"CAST(sum({CENTS}) AS DOUBLE) / 100 AS mrr FROM plan WHERE {' AND '.join(conds)}")
    return " UNION ALL ".join(parts)


@query("focus_presets", with_views(_preset_sql(), extra=PLAN_SQL))
def q_focus_presets(spark, sf_dir):
    return P.preset_summary(plan_view(spark, sf_dir))


def _sort_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{k}' AS sort_key, customerID, row_number() OVER (ORDER BY {c} {'ASC' if asc else 'DESC'}, customerID) - 1 AS position FROM plan"
        for k, (c, asc) in P.SORT_KEYS.items())


@query("plan_sort", with_views(_sort_sql(), extra=PLAN_SQL))
def q_plan_sort(spark, sf_dir):
    """The place of every customer under each of the seven sort keys."""
    return P.plan_positions(plan_view(spark, sf_dir))


@query("view_kpis", with_views(f"""
SELECT count(*) AS in_view, CAST(sum(CASE WHEN priority_level = 'High' THEN 1 ELSE 0 END) AS BIGINT) AS high_priority,
  CAST(sum(CAST(is_churner AS INTEGER)) AS BIGINT) AS churners, CAST(sum({CENTS}) AS DOUBLE) / 100 AS mrr,
  CAST(sum(CASE WHEN is_churner THEN {CENTS} ELSE 0 END) AS DOUBLE) / 100 AS mrr_at_risk,
  CAST(sum(CAST(round(expected_loss * 100) AS BIGINT)) AS DOUBLE) / 100 AS expected_loss
FROM plan WHERE risk_level IN ('High', 'Medium')""", extra=PLAN_SQL))
def q_view_kpis(spark, sf_dir):
    return P.view_kpis(P.plan_filters(plan_view(spark, sf_dir), risk=["High", "Medium"]))


@query("priority_risk_matrix", with_views("""
SELECT l.priority_level,
  CAST(count(*) FILTER (WHERE p.risk_level = 'High') AS BIGINT) AS risk_high,
  CAST(count(*) FILTER (WHERE p.risk_level = 'Medium') AS BIGINT) AS risk_medium,
  CAST(count(*) FILTER (WHERE p.risk_level = 'Low') AS BIGINT) AS risk_low
FROM (VALUES ('High'), ('Medium'), ('Low')) l(priority_level) LEFT JOIN plan p ON p.priority_level = l.priority_level
GROUP BY l.priority_level""", extra=PLAN_SQL))
def q_priority_risk_matrix(spark, sf_dir):
    return P.priority_risk_matrix(plan_view(spark, sf_dir))


@query("action_mix", with_views(
    "SELECT action_label, count(*) AS customers FROM plan GROUP BY action_label", extra=PLAN_SQL))
def q_action_mix(spark, sf_dir):
    return P.action_mix(plan_view(spark, sf_dir))


@query("top_k_risk", with_views(
    "SELECT * FROM plan ORDER BY is_churner DESC, plan_priority DESC, churn_prob DESC, customerID LIMIT 20",
    extra=PLAN_SQL))
def q_top_k_risk(spark, sf_dir):
    return P.top_k_risk(plan_view(spark, sf_dir))


@query("format_display", with_views(
    f"SELECT customerID, {money2(CENTS)} AS monthly_text, {pct1('churn_prob')} AS churn_prob_text, "
    f"CAST(priority_pct AS VARCHAR) || '%' AS priority_text, CASE WHEN is_churner THEN '●' ELSE '○' END AS churner_mark "
    f"FROM plan", extra=PLAN_SQL))
def q_format_display(spark, sf_dir):
    return P.format_display(plan_view(spark, sf_dir))


LOOKUP_FIELDS = ["segment_name", "priority_level", "risk_level", "churn_prob", "action_label", "MonthlyCharges",
                 "tenure", "Contract", "PaymentMethod", "InternetService"]


@query("customer_lookup", with_views(
    "SELECT customerID, field, value FROM (" + " UNION ALL ".join(
        f"SELECT customerID, '{f}' AS field, CAST({f} AS VARCHAR) AS value FROM plan" for f in LOOKUP_FIELDS)
    + ") t WHERE customerID = (SELECT max(customerID) FROM plan WHERE is_churner)", extra=PLAN_SQL))
def q_customer_lookup(spark, sf_dir):
    """P21 for the highest-id predicted churner (the lookup key itself is
    read from the data)."""
    plan = plan_view(spark, sf_dir)
    return P.customer_lookup(plan, plan.filter("is_churner").agg(F.max("customerID")).scalar())


@query("risk_histogram", with_views(
    "SELECT bin, count(*) AS customers, CAST(sum(CASE WHEN churn_prob >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS above_threshold, "
    "bin / 20.0 AS bin_start, (bin + 1) / 20.0 AS bin_end FROM (SELECT churn_prob, CAST(least(floor(churn_prob * 20), 19) AS INTEGER) AS bin FROM scored) t "
    "GROUP BY bin"))
def q_risk_histogram(spark, sf_dir):
    return P.risk_histogram(scored_view(spark, sf_dir))


BAND = "CASE WHEN churn_prob >= 0.65 THEN 'High' WHEN churn_prob >= 0.35 THEN 'Medium' ELSE 'Low' END"


@query("segment_risk_matrix", with_views(
    f"SELECT segment_label AS segment, CAST(count(*) FILTER (WHERE {BAND} = 'High') AS BIGINT) AS risk_high, "
    f"CAST(count(*) FILTER (WHERE {BAND} = 'Medium') AS BIGINT) AS risk_medium, "
    f"CAST(count(*) FILTER (WHERE {BAND} = 'Low') AS BIGINT) AS risk_low FROM scored GROUP BY segment_label"))
def q_segment_risk_matrix(spark, sf_dir):
    return P.segment_risk_matrix(scored_view(spark, sf_dir))


@query("risk_band_summary", with_views(f"""
SELECT risk_level, customers, CAST(customers AS DOUBLE) * 100.0 / CAST(n AS DOUBLE) AS pct_of_total,
  CAST(sp AS DOUBLE) / (CAST(customers AS DOUBLE) * 1000000.0) AS avg_prob,
  CAST(mrr AS DOUBLE) / 100 AS revenue_at_risk, CAST(ltv AS DOUBLE) / (CAST(customers AS DOUBLE) * 100.0) AS avg_lifetime_value
FROM (SELECT {BAND} AS risk_level, count(*) AS customers, sum({micro('churn_prob')}) AS sp, sum({CENTS}) AS mrr,
        sum(CAST(round(TotalCharges * 100) AS BIGINT)) AS ltv FROM scored GROUP BY 1) a
CROSS JOIN (SELECT count(*) AS n FROM scored) t"""))
def q_risk_band_summary(spark, sf_dir):
    return P.risk_band_summary(scored_view(spark, sf_dir))


@query("revenue_projection", with_views(f"""
SELECT CAST(r AS DOUBLE) / 100 AS mrr_at_risk, CAST(r * 12 AS DOUBLE) / 100 AS revenue_1y,
  CAST(r * 24 AS DOUBLE) / 100 AS revenue_2y
FROM (SELECT sum(CASE WHEN is_churner THEN {CENTS} ELSE 0 END) AS r FROM scored) t"""))
def q_revenue_projection(spark, sf_dir):
    return P.revenue_projection(scored_view(spark, sf_dir))


@query("segment_risk_actions", with_views(f"""
SELECT segment_label AS segment, risk_level, action_label AS top_action, n AS top_action_n FROM (
  SELECT segment_label, {BAND} AS risk_level, action_label, count(*) AS n FROM scored GROUP BY 1, 2, 3) t
QUALIFY row_number() OVER (PARTITION BY segment_label, risk_level ORDER BY n DESC, action_label) = 1"""))
def q_segment_risk_actions(spark, sf_dir):
    return P.segment_risk_actions(scored_view(spark, sf_dir))


# ---------------------------------------------------------------------------
# B: batch scoring
# ---------------------------------------------------------------------------

@query("score_batch", with_views(
    "SELECT customerID, segment, segment_label, segment_confidence, churn_prob, is_churner, action_key, "
    "action_label, priority, reason FROM scored"))
def q_score_batch(spark, sf_dir):
    return B.score_batch(customer_view(spark, sf_dir))


@query("score_trained", with_views(
    "SELECT customerID, true AS in_range, true AS decided, true AS known_action, true AS segment_kept FROM scored"))
def q_score_trained(spark, sf_dir):
    """B1 with the stored trained model instead of the deployed score, as a
    check per customer: probability in range, decision at the model's own
    threshold, a known action, and the segment of the deployed scorer."""
    from stayline.plans.queries_model import _model_input, stored_model
    enc, trained, tau, _ = M.train_churn(_model_input(spark, sf_dir))
    stored = stored_model(spark, enc, trained, tau)
    got = B.score_frame(B.features_view(spark, sf_dir), churn_model=stored)
    own = segments.assign_segments(B.features_view(spark, sf_dir)).select("customerID", F.col("segment").alias("own"))
    return got.join(own, "customerID").select(
        "customerID", F.col("churn_prob").between(0, 1).alias("in_range"), (F.col("is_churner") == (F.col("churn_score") >= stored["tau"])).alias("decided"),
        F.col("action_key").isin(list(C.ACTIONS)).alias("known_action"), (F.col("segment") == F.col("own")).alias("segment_kept"))


@query("decide_churner", with_views(
    "SELECT customerID, churn_prob, churn_prob >= 0.5 AS is_churner, churn_prob > 0.5 AS is_churner_strict FROM scored"))
def q_decide_churner(spark, sf_dir):
    from stayline.functions.exprs import decide
    s = scored_view(spark, sf_dir)
    return s.select("customerID", "churn_prob", decide("churn_prob", 0.5).alias("is_churner"),
                    decide("churn_prob", 0.5, inclusive=False).alias("is_churner_strict"))


SUMMARY_SQL = f"""
SELECT ri AS rows_input, rp AS rows_processed, ch AS churners, CAST(ch AS DOUBLE) / CAST(rp AS DOUBLE) AS churn_rate,
  CAST(ch AS DOUBLE) / CAST(ri AS DOUBLE) AS churn_rate_input,
  CAST(sp AS DOUBLE) / (CAST(rp AS DOUBLE) * 1000000.0) AS avg_churn_probability,
  CAST(sc AS DOUBLE) / (CAST(rp AS DOUBLE) * 1000000.0) AS avg_segment_confidence
FROM (SELECT count(*) AS rp, CAST(sum(CAST(is_churner AS INTEGER)) AS BIGINT) AS ch, sum({micro('churn_prob')}) AS sp,
        sum({micro('segment_confidence')}) AS sc FROM scored) a CROSS JOIN (SELECT count(*) AS ri FROM raw) b"""


@query("batch_summary", with_views(SUMMARY_SQL))
def q_batch_summary(spark, sf_dir):
    st = B.status_frame(spark, B.score_and_account(customer_view(spark, sf_dir), scratch_path(spark, "scored_batch")))
    return st.drop("failed", "action_counts", "segment_counts")


@query("batch_status", with_views(
    "SELECT s.*, rows_input - rows_processed AS failed, kind, name, customers FROM (" + SUMMARY_SQL + ") s CROSS JOIN ("
    "SELECT 'action' AS kind, action_label AS name, count(*) AS customers FROM scored GROUP BY ALL UNION ALL "
    "SELECT 'segment', CAST(segment AS VARCHAR), count(*) FROM scored GROUP BY ALL) m"))
def q_batch_status(spark, sf_dir):
    """B5 with both count maps, one row per entry: the batch is scored and
    written, its status is what the write observed."""
    st = B.status_frame(spark, B.score_and_account(customer_view(spark, sf_dir), scratch_path(spark, "scored_batch")))
    scalars = [c for c in st.columns if c not in ("action_counts", "segment_counts")]
    maps = [st.select(*scalars, F.lit(kind).alias("kind"), F.explode(F.col(f"{kind}_counts")).alias("name", "customers"))
            .withColumn("name", F.col("name").cast("string")) for kind in ("action", "segment")]
    return maps[0].unionByName(maps[1])


ECHO = [c for c in C.INPUT_COLUMNS]


@query("prediction_record", with_views(
    "SELECT customerID, segment, segment_label, churn_prob, is_churner, segment_confidence, CAST(0.5 AS DOUBLE) AS threshold, "
    "action_key, action_label, priority AS priority_score, reason, rank, feature, contribution, direction, "
    + ", ".join(f"CAST({c} AS VARCHAR) AS in_{c}" for c in ECHO) + " FROM scored JOIN topl USING (customerID)", extra=SHAP))
def q_prediction_record(spark, sf_dir):
    """B6, flattened: one row per record and driver."""
    scored = scored_view(spark, sf_dir)
    rec = B.prediction_record(scored, explain.top_features_per_row(explain.linear_shap(scored)))
    return rec.select("customerID", "segment", "segment_label", "churn_prob", "is_churner", "segment_confidence", "threshold",
                      "recommended_action.*", F.posexplode("top_features").alias("pos", "t"),
                      *[F.col("input_features")[c].alias(f"in_{c}") for c in ECHO]) \
        .select("*", (F.col("pos") + 1).cast("int").alias("rank"), "t.feature", "t.contribution", "t.direction").drop("pos", "t")


# ---------------------------------------------------------------------------
# D: exploration
# ---------------------------------------------------------------------------

@query("value_counts", with_views("SELECT Contract, count(*) AS n FROM clean GROUP BY Contract", "clean"))
def q_value_counts(spark, sf_dir):
    return D.value_counts(processed_view(spark, sf_dir), "Contract")


@query("value_share", with_views(
    "SELECT PaymentMethod, count(*) AS n, CAST(count(*) AS DOUBLE) * 100.0 / CAST((SELECT count(*) FROM clean) AS DOUBLE) AS pct "
    "FROM clean GROUP BY PaymentMethod", "clean"))
def q_value_share(spark, sf_dir):
    return D.value_share(processed_view(spark, sf_dir), "PaymentMethod")


@query("filtered_group_count", with_views(
    "SELECT Churn, gender, count(*) AS n FROM clean WHERE Churn IN (0, 1) GROUP BY Churn, gender", "clean"))
def q_filtered_group_count(spark, sf_dir):
    return D.filtered_group_count(processed_view(spark, sf_dir))


@query("pair_counts", with_views(
    "SELECT gender, InternetService, Churn, count(*) AS n FROM clean GROUP BY ALL", "clean"))
def q_pair_counts(spark, sf_dir):
    return D.pair_counts(processed_view(spark, sf_dir))


@query("grouped_bars", with_views(
    "SELECT feature, value, Churn, count(*) AS n FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value, Churn FROM clean" for c in C.EDA_BAR_FEATURES)
    + ") t GROUP BY ALL", "clean"))
def q_grouped_bars(spark, sf_dir):
    return D.grouped_bars(processed_view(spark, sf_dir))


DESC_COLS = ["tenure", "MonthlyCharges", "TotalCharges"]


@query("describe_numeric", with_views(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count({c}) AS DOUBLE) AS count, round(avg(CAST({c} AS DOUBLE)), 6) AS mean, "
    f"round(stddev_samp(CAST({c} AS DOUBLE)), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, "
    f"quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median, "
    f"quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3, CAST(max({c}) AS DOUBLE) AS max FROM clean" for c in DESC_COLS),
    "clean"))
def q_describe_numeric(spark, sf_dir):
    d = D.describe_numeric(processed_view(spark, sf_dir), DESC_COLS)
    return d.select("column_name", F.col("count").cast("double").alias("count"), F.round("mean", 6).alias("mean"),
                    F.round("std", 6).alias("std"), "min", "q1", "median", "q3", "max")


@query("churn_rate_by", with_views(
    "SELECT tenure_band, count(*) AS n, CAST(sum(Churn) AS DOUBLE) / count(*) AS churn_rate FROM feat GROUP BY tenure_band",
    "feat"))
def q_churn_rate_by(spark, sf_dir):
    return D.churn_rate_by(B.features_view(spark, sf_dir), "tenure_band")


CORR_COLS = ["tenure", "MonthlyCharges", "TotalCharges", "avg_monthly_spend", "charge_gap"]
TABLE_COLS = [c for c in C.RAW_COLUMNS if c != "customerID"]
NUMERIC_COLS = ("tenure", "MonthlyCharges", "TotalCharges", "Churn")


def _corr_sql(cols, src: str) -> str:
    from itertools import combinations
    pairs = list(combinations(cols, 2))
    one = "SELECT " + ", ".join(f"round(corr(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE)), 6) AS c{i}" for i, (x, y) in enumerate(pairs)) + f" FROM {src}"
    parts = [f"SELECT '{a}' AS a, '{b}' AS b, c{i} AS corr FROM one" for i, (x, y) in enumerate(pairs) for a, b in ((x, y), (y, x))]
    return f"WITH one AS ({one}) " + " UNION ALL ".join(parts + [f"SELECT '{c}', '{c}', 1.0 FROM one" for c in cols])


def _coded_sql(cols, order: str) -> str:
    """CTE ``coded``: ``cols`` as codes by first customer or by value."""
    tables = [f"k_{c} AS (SELECT {c} AS v, row_number() OVER (ORDER BY {order.format(c=c)}) - 1 AS code FROM clean WHERE {c} IS NOT NULL GROUP BY {c})" for c in cols]
    joins = " ".join(f"LEFT JOIN k_{c} ON clean.{c} = k_{c}.v" for c in cols)
    rest = [c for c in TABLE_COLS if c not in cols]
    return ",".join([*tables, "coded AS (SELECT " + ", ".join([*[f"coalesce(k_{c}.code, -1) AS {c}" for c in cols], *rest]) + f" FROM clean {joins})"])


@query("corr_matrix", with_views("SELECT * FROM (" + _corr_sql(TABLE_COLS, "coded") + ")", "clean", _coded_sql(TABLE_COLS, "min(customerID), CAST({c} AS VARCHAR)")))
def q_corr_matrix(spark, sf_dir):
    """D8 over all 20 columns of the table, coded by first appearance."""
    coded = cut_lineage(D.coded_columns(processed_view(spark, sf_dir), TABLE_COLS))
    got = D.corr_matrix(coded, [f"{c}_code" for c in TABLE_COLS])
    return got.select(*[F.regexp_replace(c, "_code$", "").alias(c) for c in ("a", "b")], F.round("corr", 6).alias("corr"))


@query("corr_numeric", with_views("SELECT * FROM (" + _corr_sql(CORR_COLS, "feat") + ")", "feat"))
def q_corr_numeric(spark, sf_dir):
    """D8 over the numeric features."""
    return D.corr_matrix(B.features_view(spark, sf_dir), CORR_COLS).withColumn("corr", F.round("corr", 6))


@query("corr_with_target", with_views(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(corr(CAST({c} AS DOUBLE), CAST(Churn AS DOUBLE)), 6) AS corr FROM coded"
    for c in TABLE_COLS if c != "Churn"), "clean", _coded_sql([c for c in TABLE_COLS if c not in NUMERIC_COLS], "CAST({c} AS VARCHAR)")))
def q_corr_with_target(spark, sf_dir):
    """D9 over all columns, text coded by sorted value, numbers as they are."""
    text = [c for c in TABLE_COLS if c not in NUMERIC_COLS]
    coded = cut_lineage(D.coded_columns(processed_view(spark, sf_dir), text, by="value"))
    got = D.corr_with_target(coded, [f"{c}_code" if c in text else c for c in TABLE_COLS if c != "Churn"])
    return got.select(F.regexp_replace("feature", "_code$", "").alias("feature"), F.round("corr", 6).alias("corr"))


@query("density_by_class", with_views("""
SELECT h.Churn, h.bin, CAST(h.bin AS DOUBLE) * 5.0 AS bin_start, h.n,
  CAST(h.n AS DOUBLE) / (CAST(t.n_cls AS DOUBLE) * 5.0) AS density
FROM (SELECT Churn, CAST(floor(MonthlyCharges / 5.0) AS BIGINT) AS bin, count(*) AS n FROM clean GROUP BY ALL) h
JOIN (SELECT Churn, count(*) AS n_cls FROM clean GROUP BY Churn) t ON h.Churn = t.Churn""", "clean"))
def q_density_by_class(spark, sf_dir):
    return D.density_by_class(processed_view(spark, sf_dir))


@query("kernel_density", with_views("""
SELECT v.Churn, v.feature, point, round(g.at, 6) AS at, round(sum(v.n * exp(-((g.at - x) / bw) * ((g.at - x) / bw) / 2)) / (max(s.cnt) * max(bw) * sqrt(2 * pi())), 9) AS density
FROM (SELECT Churn, feature, x, count(*) AS n FROM kd GROUP BY ALL) v
JOIN (SELECT Churn, feature, count(*) AS cnt, stddev_samp(x) * pow(CAST(count(*) AS DOUBLE), -0.2) AS bw FROM kd GROUP BY ALL) s USING (Churn, feature)
JOIN (SELECT feature, point, lo + (hi - lo) * point / 49.0 AS at FROM (SELECT feature, min(x) AS lo, max(x) AS hi FROM kd GROUP BY ALL), range(50) r(point)) g USING (feature)
GROUP BY v.Churn, v.feature, point, g.at""", "clean", """
kd AS (SELECT Churn, 'MonthlyCharges' AS feature, CAST(MonthlyCharges AS DOUBLE) AS x FROM clean WHERE MonthlyCharges IS NOT NULL
  UNION ALL SELECT Churn, 'TotalCharges', CAST(TotalCharges AS DOUBLE) FROM clean WHERE TotalCharges IS NOT NULL)"""))
def q_kernel_density(spark, sf_dir):
    """Kernel density of both charges by class."""
    d = D.kernel_density(processed_view(spark, sf_dir))
    return d.select("Churn", "feature", F.col("point").cast("long").alias("point"), F.round("at", 6).alias("at"), F.round("density", 9).alias("density"))


@query("box_stats", with_views("""
SELECT q.Churn, q.q1, q.median, q.q3, q.iqr, w.whisker_low, w.whisker_high, w.outliers FROM
 (SELECT Churn, quantile_cont(CAST(tenure AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(tenure AS DOUBLE), 0.5) AS median,
         quantile_cont(CAST(tenure AS DOUBLE), 0.75) AS q3,
         quantile_cont(CAST(tenure AS DOUBLE), 0.75) - quantile_cont(CAST(tenure AS DOUBLE), 0.25) AS iqr
  FROM clean GROUP BY Churn) q
JOIN (SELECT c.Churn,
        min(CASE WHEN tenure >= q1 - 1.5 * iqr THEN CAST(tenure AS DOUBLE) END) AS whisker_low,
        max(CASE WHEN tenure <= q3 + 1.5 * iqr THEN CAST(tenure AS DOUBLE) END) AS whisker_high,
        CAST(sum(CASE WHEN tenure < q1 - 1.5 * iqr OR tenure > q3 + 1.5 * iqr THEN 1 ELSE 0 END) AS BIGINT) AS outliers
      FROM clean c JOIN (SELECT Churn, quantile_cont(CAST(tenure AS DOUBLE), 0.25) AS q1,
                                quantile_cont(CAST(tenure AS DOUBLE), 0.75) AS q3,
                                quantile_cont(CAST(tenure AS DOUBLE), 0.75) - quantile_cont(CAST(tenure AS DOUBLE), 0.25) AS iqr
                         FROM clean GROUP BY Churn) qq ON c.Churn = qq.Churn
      GROUP BY c.Churn) w ON q.Churn = w.Churn""", "clean"))
def q_box_stats(spark, sf_dir):
    return D.box_stats(processed_view(spark, sf_dir))


# ---------------------------------------------------------------------------
# E: evaluation on the scored view (label = Churn, score = churn_prob)
# ---------------------------------------------------------------------------

def labelled(spark, sf_dir):
    return scored_view(spark, sf_dir).select("customerID", F.col("Churn").alias("label"), "churn_prob", "churn_score",
                                             "churn_margin", "priority", "MonthlyCharges")


def shown(margin) -> F.Column:
    """A threshold on the margin as the probability that is reported."""
    return F.round(M.probability(F.col(margin)), 6)


CM = lambda tau: (f"CAST(sum(CASE WHEN Churn = 0 AND churn_score < {tau} THEN 1 ELSE 0 END) AS BIGINT) AS tn, "
                  f"CAST(sum(CASE WHEN Churn = 0 AND churn_score >= {tau} THEN 1 ELSE 0 END) AS BIGINT) AS fp, "
                  f"CAST(sum(CASE WHEN Churn = 1 AND churn_score < {tau} THEN 1 ELSE 0 END) AS BIGINT) AS fn, "
                  f"CAST(sum(CASE WHEN Churn = 1 AND churn_score >= {tau} THEN 1 ELSE 0 END) AS BIGINT) AS tp")


def metrics_sql(src: str) -> str:
    """accuracy / precision / recall / f1 columns over a CTE with tn fp fn tp."""
    return f"""SELECT *,
  CAST(tp + tn AS DOUBLE) / CAST(tn + fp + fn + tp AS DOUBLE) AS accuracy,
  CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) END AS precision,
  CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) END AS recall FROM {src}"""


def f1_sql(src: str) -> str:
    return (f"SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE {dbl(2.0)} * precision * recall / "
            f"(precision + recall) END AS f1 FROM ({src}) m")


@query("confusion_matrix", with_views(f"SELECT {CM(0.5)} FROM scored"))
def q_confusion_matrix(spark, sf_dir):
    d = labelled(spark, sf_dir).withColumn("pred", (F.col("churn_score") >= 0.5).cast("int"))
    return E.confusion_matrix(d)


@query("binary_metrics", with_views(f1_sql(metrics_sql("cm")), extra=f"cm AS (SELECT {CM(0.5)} FROM scored)"))
def q_binary_metrics(spark, sf_dir):
    d = labelled(spark, sf_dir).withColumn("pred", (F.col("churn_score") >= 0.5).cast("int"))
    return E.binary_metrics(d)


@query("classification_report", with_views("""
SELECT row_label, precision, recall, CASE WHEN precision + recall = 0 THEN 0.0 ELSE CAST(2.0 AS DOUBLE) * precision * recall / (precision + recall) END AS f1, support FROM (
  SELECT '0' AS row_label, CASE WHEN tn + fn = 0 THEN 0.0 ELSE CAST(tn AS DOUBLE) / CAST(tn + fn AS DOUBLE) END AS precision,
         CASE WHEN tn + fp = 0 THEN 0.0 ELSE CAST(tn AS DOUBLE) / CAST(tn + fp AS DOUBLE) END AS recall, tn + fp AS support FROM cm
  UNION ALL
  SELECT '1', CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) END,
         CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) END, tp + fn FROM cm) c
UNION ALL
SELECT 'accuracy', a, a, a, n FROM (SELECT CAST(tp + tn AS DOUBLE) / CAST(tn + fp + fn + tp AS DOUBLE) AS a, tn + fp + fn + tp AS n FROM cm) x
UNION ALL
SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM pc
UNION ALL
SELECT 'weighted avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, (f0 * s0 + f1 * s1) / n, n FROM pc""",
    extra=f"""cm AS (SELECT {CM(0.5)} FROM scored),
pc0 AS (SELECT tn + fp + fn + tp AS n, tn + fp AS s0, tp + fn AS s1,
  CASE WHEN tn + fn = 0 THEN 0.0 ELSE CAST(tn AS DOUBLE) / CAST(tn + fn AS DOUBLE) END AS p0,
  CASE WHEN tn + fp = 0 THEN 0.0 ELSE CAST(tn AS DOUBLE) / CAST(tn + fp AS DOUBLE) END AS r0,
  CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) END AS p1,
  CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) END AS r1 FROM cm),
pc AS (SELECT *, CASE WHEN p0 + r0 = 0 THEN 0.0 ELSE CAST(2.0 AS DOUBLE) * p0 * r0 / (p0 + r0) END AS f0,
  CASE WHEN p1 + r1 = 0 THEN 0.0 ELSE CAST(2.0 AS DOUBLE) * p1 * r1 / (p1 + r1) END AS f1 FROM pc0)"""))
def q_classification_report(spark, sf_dir):
    d = labelled(spark, sf_dir).withColumn("pred", (F.col("churn_score") >= 0.5).cast("int"))
    return E.classification_report(d)


def curve_sql(score: str = "churn_margin", src: str = "scored", label: str = "Churn") -> str:
    return f"""
sc AS (SELECT {score} AS score, CAST(sum(CASE WHEN {label} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
              CAST(sum(CASE WHEN {label} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS neg FROM {src} GROUP BY {score}),
cum AS (SELECT *, sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS pos_cum,
               sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS neg_cum FROM sc),
tot AS (SELECT sum(pos) AS P, sum(neg) AS N FROM sc),
prc AS (SELECT score AS margin, round(1.0 / (1.0 + exp(-score)), 6) AS threshold,
          CASE WHEN pos_cum + neg_cum = 0 THEN 0.0 ELSE CAST(pos_cum AS DOUBLE) / CAST(pos_cum + neg_cum AS DOUBLE) END AS precision,
          CASE WHEN P = 0 THEN 1.0 ELSE CAST(pos_cum AS DOUBLE) / CAST(P AS DOUBLE) END AS recall
        FROM cum CROSS JOIN tot),
prf AS (SELECT *, {dbl(2.0)} * (precision * recall) / (precision + recall + {dbl(1e-8)}) AS f1 FROM prc),
best AS (SELECT margin, threshold, precision, recall, f1 FROM prf ORDER BY f1 DESC, margin ASC LIMIT 1),
auc AS (SELECT CASE WHEN max(P) = 0 OR max(N) = 0 THEN NULL ELSE
          CAST(sum(pos * (2 * (N - neg_cum) + neg)) AS DOUBLE) / ({dbl(2.0)} * CAST(max(P) AS DOUBLE) * CAST(max(N) AS DOUBLE)) END AS roc_auc
        FROM cum CROSS JOIN tot)"""


@query("roc_auc", with_views("SELECT roc_auc FROM auc", extra=curve_sql()))
def q_roc_auc(spark, sf_dir):
    return E.roc_auc(labelled(spark, sf_dir), p="churn_margin")


@query("roc_curve", with_views(
    "SELECT round(1.0 / (1.0 + exp(-score)), 6) AS threshold, CASE WHEN N = 0 THEN 0.0 ELSE CAST(neg_cum AS DOUBLE) / CAST(N AS DOUBLE) END AS fpr, "
    "CASE WHEN P = 0 THEN 0.0 ELSE CAST(pos_cum AS DOUBLE) / CAST(P AS DOUBLE) END AS tpr FROM cum CROSS JOIN tot",
    extra=curve_sql()))
def q_roc_curve(spark, sf_dir):
    return E.roc_curve(labelled(spark, sf_dir), p="churn_margin").withColumn("threshold", shown("threshold"))


@query("pr_curve", with_views("SELECT * EXCLUDE (margin) FROM prf", extra=curve_sql()))
def q_pr_curve(spark, sf_dir):
    return E.pr_curve(labelled(spark, sf_dir), p="churn_margin").withColumn("threshold", shown("threshold"))


@query("best_f1_threshold", with_views("SELECT * EXCLUDE (margin) FROM best", extra=curve_sql()))
def q_best_f1_threshold(spark, sf_dir):
    return E.best_f1_threshold(labelled(spark, sf_dir), p="churn_margin").withColumn("threshold", shown("threshold"))


@query("evaluate_model", with_views(
    "SELECT m.*, auc.roc_auc, CAST(0.5 AS DOUBLE) AS threshold FROM (" + f1_sql(metrics_sql("cm")) + ") m CROSS JOIN auc",
    extra=f"cm AS (SELECT {CM(0.5)} FROM scored)," + curve_sql()))
def q_evaluate_model(spark, sf_dir):
    return E.evaluate_model(labelled(spark, sf_dir), 0.5, p="churn_score", rank="churn_margin")


def _split_auc_sql() -> str:
    return """
ssc AS (SELECT split, churn_margin AS score, CAST(sum(CASE WHEN Churn = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
               CAST(sum(CASE WHEN Churn = 0 THEN 1 ELSE 0 END) AS BIGINT) AS neg FROM ssplit GROUP BY split, churn_margin),
scum AS (SELECT *, sum(neg) OVER (PARTITION BY split ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS neg_cum FROM ssc),
stot AS (SELECT split, sum(pos) AS P, sum(neg) AS N FROM ssc GROUP BY split),
sauc AS (SELECT s.split, CAST(sum(pos * (2 * (N - neg_cum) + neg)) AS DOUBLE) / (CAST(2.0 AS DOUBLE) * CAST(max(P) AS DOUBLE) * CAST(max(N) AS DOUBLE)) AS roc_auc
         FROM scum s JOIN stot t ON s.split = t.split GROUP BY s.split)"""


SCORED_SPLIT = (SPLIT_SQL.replace("SELECT clean.*,", "SELECT scored.*,", 1).replace("FROM clean),", "FROM scored),", 1)
                .replace("split AS (", "ssplit AS ("))


def split_scores(spark, sf_dir):
    """Scored customers with their split: the narrow table is written once, and
    cut points, counts and AUC are read from it."""
    return features.stratified_split(cut_lineage(scored_view(spark, sf_dir).select("customerID", "Churn", "churn_score", "churn_margin")))


@query("evaluate_splits", with_views(
    "SELECT m.*, a.roc_auc, CAST(0.5 AS DOUBLE) AS threshold FROM (" + f1_sql(metrics_sql("scm")) + ") m JOIN sauc a ON m.split = a.split",
    extra=SCORED_SPLIT + f", scm AS (SELECT split, {CM(0.5)} FROM ssplit GROUP BY split)," + _split_auc_sql()))
def q_evaluate_splits(spark, sf_dir):
    d = split_scores(spark, sf_dir).select("split", F.col("Churn").alias("label"), "churn_score", "churn_margin")
    return E.evaluate_splits(d, 0.5, p="churn_score", rank="churn_margin")


@query("compare_thresholds", with_views(
    "SELECT m.*, auc.roc_auc FROM (" + f1_sql(metrics_sql("tcm")) + ") m CROSS JOIN auc",
    extra="tcm AS (SELECT threshold, " + ", ".join(
        f"CAST(sum(CASE WHEN Churn = {y} AND churn_score {op} threshold THEN 1 ELSE 0 END) AS BIGINT) AS {n}"
        for y, op, n in ((0, "<", "tn"), (0, ">=", "fp"), (1, "<", "fn"), (1, ">=", "tp")))
    + " FROM scored CROSS JOIN (VALUES " + ", ".join(f"({dbl(t)})" for t in C.COMPARE_THRESHOLDS)
    + ") th(threshold) GROUP BY threshold)," + curve_sql()))
def q_compare_thresholds(spark, sf_dir):
    return E.compare_thresholds(labelled(spark, sf_dir), p="churn_score", rank="churn_margin")


def two_models(spark, sf_dir):
    """Two score columns of the scored view as two 'models'."""
    s = labelled(spark, sf_dir)
    a = s.select(F.lit("linear").alias("model"), "customerID", "label", "churn_prob")
    b = s.select(F.lit("rule_priority").alias("model"), "customerID", "label", F.col("priority").alias("churn_prob"))
    return a.unionByName(b)


TWO_MODELS_SQL = """
tm AS (SELECT 'linear' AS model, customerID, Churn, churn_prob FROM scored
       UNION ALL SELECT 'rule_priority', customerID, Churn, priority FROM scored),
tsc AS (SELECT model, churn_prob AS score, CAST(sum(CASE WHEN Churn = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
               CAST(sum(CASE WHEN Churn = 0 THEN 1 ELSE 0 END) AS BIGINT) AS neg FROM tm GROUP BY model, churn_prob),
tcum AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS pos_cum,
               sum(neg) OVER (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS neg_cum FROM tsc),
ttot AS (SELECT model, sum(pos) AS P, sum(neg) AS N FROM tsc GROUP BY model),
tprf0 AS (SELECT c.model, score AS threshold,
          CASE WHEN pos_cum + neg_cum = 0 THEN 0.0 ELSE CAST(pos_cum AS DOUBLE) / CAST(pos_cum + neg_cum AS DOUBLE) END AS precision,
          CASE WHEN P = 0 THEN 1.0 ELSE CAST(pos_cum AS DOUBLE) / CAST(P AS DOUBLE) END AS recall
          FROM tcum c JOIN ttot t ON c.model = t.model),
tprf AS (SELECT *, CAST(2.0 AS DOUBLE) * (precision * recall) / (precision + recall + CAST(1e-08 AS DOUBLE)) AS f1 FROM tprf0),
tbest AS (SELECT model, threshold AS opt_threshold FROM tprf QUALIFY row_number() OVER (PARTITION BY model ORDER BY f1 DESC, threshold) = 1),
tauc AS (SELECT c.model, CAST(sum(pos * (2 * (N - neg_cum) + neg)) AS DOUBLE) / (CAST(2.0 AS DOUBLE) * CAST(max(P) AS DOUBLE) * CAST(max(N) AS DOUBLE)) AS roc_auc
         FROM tcum c JOIN ttot t ON c.model = t.model GROUP BY c.model)"""


def _tm_metrics(pred: str, prefix: str) -> str:
    cm = (f"SELECT tm.model, " + ", ".join(
        f"CAST(sum(CASE WHEN Churn = {y} AND {pred if v == 1 else 'NOT (' + pred + ')'} THEN 1 ELSE 0 END) AS BIGINT) AS {n}"
        for y, v, n in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")))
          + " FROM tm JOIN tbest b ON tm.model = b.model GROUP BY tm.model")
    m = f1_sql(metrics_sql(f"({cm}) x"))
    return (f"SELECT model, precision AS {prefix}_precision, recall AS {prefix}_recall, f1 AS {prefix}_f1 FROM ({m}) y")


@query("threshold_tuning_summary", with_views(
    "SELECT a.model, a.default_precision, a.default_recall, a.default_f1, b.opt_precision, b.opt_recall, b.opt_f1, "
    "t.opt_threshold, b.opt_f1 - a.default_f1 AS f1_gain FROM (" + _tm_metrics("churn_prob >= 0.5", "default")
    + ") a JOIN (" + _tm_metrics("churn_prob >= b.opt_threshold", "opt") + ") b ON a.model = b.model "
    "JOIN tbest t ON a.model = t.model", extra=TWO_MODELS_SQL))
def q_threshold_tuning_summary(spark, sf_dir):
    return E.threshold_tuning_summary(two_models(spark, sf_dir))


@query("cm_delta", with_views(
    "SELECT d.tn AS tn_default, d.fp AS fp_default, d.fn AS fn_default, d.tp AS tp_default, "
    "t.tn AS tn_tuned, t.fp AS fp_tuned, t.fn AS fn_tuned, t.tp AS tp_tuned, "
    "t.tp - d.tp AS tp_delta, t.fn - d.fn AS fn_delta, t.fp - d.fp AS fp_delta FROM "
    f"(SELECT {CM(0.5)} FROM scored) d CROSS JOIN (SELECT "
    + ", ".join(f"CAST(sum(CASE WHEN Churn = {y} AND churn_margin {op} (SELECT margin FROM best) THEN 1 ELSE 0 END) AS BIGINT) AS {n}"
                for y, op, n in ((0, "<", "tn"), (0, ">=", "fp"), (1, "<", "fn"), (1, ">=", "tp")))
    + " FROM scored) t", extra=curve_sql()))
def q_cm_delta(spark, sf_dir):
    """E12, on the margin: the default probability 0.5 is margin 0."""
    lab = labelled(spark, sf_dir)
    tau = E.best_f1_threshold_value(lab, p="churn_margin")
    return E.cm_delta(lab, tau, p="churn_margin", default=0.0)


@query("model_ranking", with_views("""
SELECT model, roc_auc, f1,
  CAST(rank() OVER (ORDER BY roc_auc DESC) + (count(*) OVER (PARTITION BY roc_auc) - 1) / 2.0 AS INTEGER) AS auc_rank,
  CAST(rank() OVER (ORDER BY f1 DESC) + (count(*) OVER (PARTITION BY f1) - 1) / 2.0 AS INTEGER) AS f1_rank,
  row_number() OVER (ORDER BY roc_auc DESC, model) = 1 AS best_by_auc, row_number() OVER (ORDER BY f1 DESC, model) = 1 AS best_by_f1
FROM (SELECT a.model, a.roc_auc, m.f1 FROM tauc a JOIN (""" + f1_sql(metrics_sql(
    "(SELECT model, " + ", ".join(
        f"CAST(sum(CASE WHEN Churn = {y} AND churn_prob {op} 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS {n}"
        for y, op, n in ((0, "<", "tn"), (0, ">=", "fp"), (1, "<", "fn"), (1, ">=", "tp"))) + " FROM tm GROUP BY model) x"))
    + ") m ON a.model = m.model) z", extra=TWO_MODELS_SQL))
def q_model_ranking(spark, sf_dir):
    tm = two_models(spark, sf_dir).withColumn("pred", (F.col("churn_prob") >= 0.5).cast("int"))
    met = E.evaluate_grouped(tm, ["model"], "label", "pred", "churn_prob")
    return E.model_ranking(met)


@query("threshold_scenario", with_views(
    "SELECT threshold, CAST(sum(CASE WHEN churn_score >= threshold THEN 1 ELSE 0 END) AS BIGINT) AS flagged, "
    f"CAST(sum(CASE WHEN churn_score >= threshold THEN {CENTS} ELSE 0 END) AS DOUBLE) / 100 AS flagged_mrr, "
    + ", ".join(f"CAST(sum(CASE WHEN Churn = {y} AND churn_score {op} threshold THEN 1 ELSE 0 END) AS BIGINT) AS {n}"
                for y, op, n in ((0, "<", "tn"), (0, ">=", "fp"), (1, "<", "fn"), (1, ">=", "tp")))
    + " FROM scored CROSS JOIN (VALUES " + ", ".join(f"({dbl(t)})" for t in C.COMPARE_THRESHOLDS)
    + ") th(threshold) GROUP BY threshold"))
def q_threshold_scenario(spark, sf_dir):
    return E.threshold_scenario(scored_view(spark, sf_dir), p="churn_score")


# ---------------------------------------------------------------------------
# W: what-if
# ---------------------------------------------------------------------------

SCEN_FIELDS = sorted({k for _, m in C.POLICY_SCENARIOS for k in m})


def _scen_sql(include_empty: bool = True) -> str:
    rows = []
    for name, mods in C.POLICY_SCENARIOS:
        mods = whatif.normalize_payment(mods)
        rows.append("(" + ", ".join([sstr(name)] + [sstr(mods[f]) if f in mods else "CAST(NULL AS VARCHAR)"
                                                    for f in SCEN_FIELDS]) + ")")
    if include_empty:
        rows.append("(" + ", ".join(["'No Change'"] + ["CAST(NULL AS VARCHAR)"] * len(SCEN_FIELDS)) + ")")
    return (f"scen AS (SELECT * FROM (VALUES {', '.join(rows)}) t(scenario, "
            + ", ".join(f"m_{f}" for f in SCEN_FIELDS) + "))")


WHATIF_SQL = _scen_sql() + """,
sim AS (SELECT clean.* REPLACE (""" + ", ".join(f"coalesce(m_{f}, {f}) AS {f}" for f in SCEN_FIELDS) + """), scen.scenario
        FROM clean CROSS JOIN scen),""" + feat_sql("sim", "sfeat", None) + "," + scored_sql(src="sfeat", dst="sscored", p="s_") + """,
delta AS (
  SELECT n.customerID, n.scenario, o.churn_prob AS orig_churn_prob, n.churn_prob AS new_churn_prob,
    round(n.churn_prob - o.churn_prob, 6) AS churn_prob_delta, n.segment <> o.segment AS segment_changed,
    o.segment AS orig_segment, n.segment AS new_segment, n.is_churner <> o.is_churner AS is_churner_changed,
    n.action_key <> o.action_key AS action_changed, o.action_label AS orig_action_label,
    n.action_label AS new_action_label,
    CASE WHEN round(n.churn_prob - o.churn_prob, 6) < -1e-6 THEN 'improvement'
         WHEN round(n.churn_prob - o.churn_prob, 6) > 1e-6 THEN 'worsening' ELSE 'no change' END AS outcome,
    CASE WHEN o.is_churner AND NOT n.is_churner THEN 'saved' WHEN NOT o.is_churner AND n.is_churner THEN 'pushed to churn'
         ELSE 'unchanged' END AS churn_outcome, n.MonthlyCharges
  FROM sscored n JOIN scored o ON n.customerID = o.customerID)"""


def _delta(spark, sf_dir):
    proc = processed_view(spark, sf_dir)
    scen = whatif.policy_scenarios(spark, include_empty=True)
    return whatif.what_if_delta(whatif.simulate(proc, scen))


@query("apply_modifications", with_views(
    "SELECT customerID, scenario, " + ", ".join(SCEN_FIELDS) + " FROM sim", extra=WHATIF_SQL))
def q_apply_modifications(spark, sf_dir):
    proc = processed_view(spark, sf_dir).select("customerID", *SCEN_FIELDS)
    scen = whatif.policy_scenarios(spark, include_empty=True)
    crossed = proc.crossJoin(F.broadcast(scen.select("scenario", "modifications")))
    return whatif.apply_modifications(crossed).select("customerID", "scenario", *SCEN_FIELDS)


@query("what_if_delta", with_views("SELECT * FROM delta", extra=WHATIF_SQL))
def q_what_if_delta(spark, sf_dir):
    return _delta(spark, sf_dir)


@query("what_if_batch", with_views("""
SELECT scenario, count(*) AS simulated, CAST(sum(CAST(segment_changed AS INTEGER)) AS BIGINT) AS segment_changes,
  CAST(sum(CAST(is_churner_changed AS INTEGER)) AS BIGINT) AS churner_changes,
  CAST(sum(CAST(action_changed AS INTEGER)) AS BIGINT) AS action_changes,
  CAST(sum(CASE WHEN outcome = 'improvement' THEN 1 ELSE 0 END) AS BIGINT) AS improved
FROM delta GROUP BY scenario""", extra=WHATIF_SQL))
def q_what_if_batch(spark, sf_dir):
    return whatif.what_if_batch(_delta(spark, sf_dir))


@query("outcome_class", with_views(
    "SELECT customerID, scenario, outcome, churn_outcome FROM delta", extra=WHATIF_SQL))
def q_outcome_class(spark, sf_dir):
    return _delta(spark, sf_dir).select("customerID", "scenario", "outcome", "churn_outcome")


@query("modification_ledger", with_views(
    "SELECT customerID, scenario, field, original, modified FROM (" + " UNION ALL ".join(
        f"SELECT c.customerID, s.scenario, '{f}' AS field, CAST(c.{f} AS VARCHAR) AS original, s.m_{f} AS modified "
        f"FROM clean c CROSS JOIN scen s WHERE s.m_{f} IS NOT NULL" for f in SCEN_FIELDS) + ") t",
    extra=_scen_sql()))
def q_modification_ledger(spark, sf_dir):
    proc = processed_view(spark, sf_dir)
    scen = whatif.policy_scenarios(spark, include_empty=True)
    return whatif.modification_ledger(whatif.ledger_input(proc, scen))


@query("scenario_ranking", with_views(f"""
SELECT scenario, customers, saved, pushed, CAST(rev AS DOUBLE) / 100 AS retained_mrr,
  CAST(dp AS DOUBLE) / (CAST(customers AS DOUBLE) * 1000000.0) AS avg_prob_delta
FROM (SELECT scenario, count(*) AS customers, CAST(sum(CASE WHEN churn_outcome = 'saved' THEN 1 ELSE 0 END) AS BIGINT) AS saved,
        CAST(sum(CASE WHEN churn_outcome = 'pushed to churn' THEN 1 ELSE 0 END) AS BIGINT) AS pushed,
        sum(CASE WHEN churn_outcome = 'saved' THEN {CENTS} ELSE 0 END) AS rev,
        sum(CAST(round(churn_prob_delta * 1000000) AS BIGINT)) AS dp FROM delta GROUP BY scenario) t""",
    extra=WHATIF_SQL))
def q_scenario_ranking(spark, sf_dir):
    return whatif.scenario_ranking(_delta(spark, sf_dir))


@query("scenario_cross", with_views(
    "SELECT c.customerID, s.scenario FROM clean c CROSS JOIN scen s", extra=_scen_sql()))
def q_scenario_cross(spark, sf_dir):
    """Every customer x every scenario (scenario table broadcast)."""
    proc = processed_view(spark, sf_dir).select("customerID")
    scen = whatif.policy_scenarios(spark, include_empty=True)
    return proc.crossJoin(F.broadcast(scen.select("scenario")))
