"""Independent SQL formulation of the shared views, for the DuckDB oracle.

``with_views(final_sql, upto)`` prefixes a query with the CTE chain
``raw -> clean -> feat -> scored``.  The SQL is written directly against
the driver tables (``customer``, ``orders``, ...); only configuration
constants are shared with the Spark code.
"""

from __future__ import annotations

from stayline import config as C


def dbl(v: float) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


def sstr(v: str) -> str:
    return "'" + str(v).replace("'", "''") + "'"


RAW = """
ord AS (
  SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS odate, o_orderstatus, o_orderpriority,
         CAST(round(o_totalprice * 100) AS BIGINT) AS cents
  FROM orders),
per_cust AS (
  SELECT o_custkey, count(*) AS n_orders, sum(cents) AS sum_cents FROM ord GROUP BY o_custkey),
latest AS (
  SELECT o_custkey, cents AS latest_cents, o_orderstatus AS latest_status,
         o_orderpriority AS latest_prio, odate AS latest_date
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY odate DESC, o_orderkey DESC) AS rn
        FROM ord) t
  WHERE rn = 1),
lastday AS (SELECT max(odate) AS last_day FROM ord WHERE o_custkey IS NOT NULL),
rawb AS (
  SELECT c.c_custkey AS k, c.c_nationkey, c.c_acctbal,
         CASE WHEN c.c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'Fiber optic'
              WHEN c.c_mktsegment IN ('FURNITURE', 'HOUSEHOLD') THEN 'DSL'
              WHEN c.c_mktsegment = 'MACHINERY' THEN 'No' END AS internet,
         CAST(greatest(0, 4 * (p.n_orders - 3)) AS INTEGER) AS ten,
         p.n_orders, p.sum_cents, l.latest_cents, l.latest_status, l.latest_prio, l.latest_date, d.last_day
  FROM customer c
  LEFT JOIN per_cust p ON c.c_custkey = p.o_custkey
  LEFT JOIN latest l ON l.o_custkey = c.c_custkey
  CROSS JOIN lastday d),
rawc AS (
  SELECT *, (sum_cents * ten) // (n_orders * 4000) AS tc FROM rawb),
raw AS (
  SELECT k AS customerID,
    CASE WHEN c_nationkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
    CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END AS SeniorCitizen,
    CASE WHEN k % 2 = 1 THEN 'Yes' ELSE 'No' END AS Partner,
    CASE WHEN k % 10 < 3 THEN 'Yes' ELSE 'No' END AS Dependents,
    ten AS tenure,
    CASE WHEN k % 10 <> 0 THEN 'Yes' ELSE 'No' END AS PhoneService,
    CASE WHEN k % 10 = 0 THEN 'No phone service' WHEN k % 7 < 3 THEN 'Yes' ELSE 'No' END AS MultipleLines,
    internet AS InternetService,
    CASE WHEN internet = 'No' THEN 'No internet service' WHEN (k * 7 + 3) % 5 < 2 THEN 'Yes' ELSE 'No' END AS OnlineSecurity,
    CASE WHEN internet = 'No' THEN 'No internet service' WHEN (k * 7 + 6) % 5 < 2 THEN 'Yes' ELSE 'No' END AS OnlineBackup,
    CASE WHEN internet = 'No' THEN 'No internet service' WHEN (k * 7 + 9) % 5 < 2 THEN 'Yes' ELSE 'No' END AS DeviceProtection,
    CASE WHEN internet = 'No' THEN 'No internet service' WHEN (k * 7 + 12) % 5 < 2 THEN 'Yes' ELSE 'No' END AS TechSupport,
    CASE WHEN internet = 'No' THEN 'No internet service' WHEN (k * 7 + 15) % 5 < 2 THEN 'Yes' ELSE 'No' END AS StreamingTV,
    CASE WHEN internet = 'No' THEN 'No internet service' WHEN (k * 7 + 18) % 5 < 2 THEN 'Yes' ELSE 'No' END AS StreamingMovies,
    CASE latest_status WHEN 'P' THEN 'Month-to-month' WHEN 'O' THEN 'One year' WHEN 'F' THEN 'Two year' END AS Contract,
    CASE WHEN c_acctbal >= 2000 THEN 'Yes' ELSE 'No' END AS PaperlessBilling,
    CASE substr(latest_prio, 1, 1) WHEN '1' THEN 'Electronic check' WHEN '2' THEN 'Mailed check'
         WHEN '3' THEN 'Bank transfer (automatic)' WHEN '4' THEN 'Credit card (automatic)'
         WHEN '5' THEN 'Credit card (automatic)' END AS PaymentMethod,
    CAST(latest_cents // 4000 AS DOUBLE) / 100 AS MonthlyCharges,
    CASE WHEN ten = 0 THEN ' '
         ELSE CAST(tc // 100 AS VARCHAR) || '.' || lpad(CAST(tc % 100 AS VARCHAR), 2, '0') END AS TotalCharges,
    CASE WHEN date_diff('day', latest_date, last_day) > 330 THEN 'Yes' ELSE 'No' END AS Churn
  FROM rawc)"""

CLEAN = """
clean0 AS (
  SELECT * REPLACE (
      CASE WHEN isnan(TRY_CAST(trim(TotalCharges) AS DOUBLE)) THEN NULL
           ELSE TRY_CAST(trim(TotalCharges) AS DOUBLE) END AS TotalCharges)
  FROM raw),
clean AS (
  SELECT * REPLACE (
      CASE WHEN SeniorCitizen = 1 THEN 'yes' WHEN SeniorCitizen = 0 THEN 'no' END AS SeniorCitizen,
      CASE WHEN Churn = 'Yes' THEN 1 WHEN Churn = 'No' THEN 0 END AS Churn)
  FROM clean0
  WHERE TotalCharges IS NOT NULL AND (tenure IS NULL OR tenure <> 0))"""


def _yes(c: str) -> str:
    return f"CAST(coalesce({c} IN ('Yes', 'yes'), false) AS INTEGER)"


def _flag(cond: str) -> str:
    return f"CAST(coalesce({cond}, false) AS INTEGER)"


def _band(c: str) -> str:
    parts = []
    for lo, hi, lab in zip(C.TENURE_BINS[:-1], C.TENURE_BINS[1:], C.TENURE_LABELS):
        parts.append(f"WHEN {c} > {lo} AND {c} <= {hi} THEN '{lab}'")
    return "CASE " + " ".join(parts) + " ELSE 'nan' END"


def feat_sql(src: str = "clean", dst: str = "feat", med: str | None = "med") -> str:
    """Engineered features of ``src`` as CTE ``dst``; ``med`` names the CTE
    holding the MonthlyCharges median (created here when it is 'med')."""
    head = f"med AS (SELECT median(MonthlyCharges) AS med_mc FROM {src})," if med == "med" else ""
    return f"""
{head}
{dst} AS (
  SELECT {src}.*,
    TotalCharges / (CASE WHEN tenure = 0 THEN 1 ELSE tenure END) AS avg_monthly_spend,
    MonthlyCharges - TotalCharges / (CASE WHEN tenure = 0 THEN 1 ELSE tenure END) AS charge_gap,
    {_flag('MonthlyCharges > med_mc')} AS is_high_value,
    {_band('tenure')} AS tenure_band,
    {' + '.join(_yes(c) for c in C.STREAMING_SERVICES)} AS streaming_count,
    {' + '.join(_yes(c) for c in C.SECURITY_SERVICES)} AS security_count,
    {_flag("PaymentMethod = 'Electronic check'")} AS payment_electronic_check,
    {_flag("Contract = 'Month-to-month' AND PaperlessBilling = 'Yes'")} AS month_to_month_paperless,
    {_flag("TechSupport = 'No' AND OnlineSecurity = 'No'")} AS no_support_services,
    {_flag("Partner = 'No' AND Dependents = 'No'")} AS is_isolated,
    {_flag("InternetService = 'Fiber optic' AND OnlineSecurity = 'No'")} AS fiber_no_security,
    {_flag("InternetService = 'No'")} AS no_internet_services
  FROM {src} CROSS JOIN (SELECT med_mc FROM med) mm)"""


FEAT = feat_sql()


def _distance(num, modes) -> str:
    sq = []
    for c, v in zip(C.SEG_NUMERIC, num):
        m, s = C.SEGMENT_SCALER[c]
        z = f"((CAST({c} AS DOUBLE) - {dbl(m)}) / {dbl(s)})"
        sq.append(f"({z} - {dbl(v)}) * ({z} - {dbl(v)})")
    mm = [f"(CASE WHEN coalesce(CAST({c} AS VARCHAR), 'nan') <> {sstr(mv)} THEN 1 ELSE 0 END)"
          for c, mv in zip(C.SEG_CATEGORICAL, modes)]
    return " + ".join(sq) + f" + {dbl(C.SEGMENT_GAMMA)} * CAST({' + '.join(mm)} AS DOUBLE)"


def _linear() -> str:
    design = {
        "tenure": "coalesce(CAST(tenure AS DOUBLE), 0.0)",
        "MonthlyCharges": "coalesce(MonthlyCharges, 0.0)",
        "contract_month_to_month": "CAST(Contract = 'Month-to-month' AS DOUBLE)",
        "contract_two_year": "CAST(Contract = 'Two year' AS DOUBLE)",
        "payment_electronic_check": "CAST(PaymentMethod = 'Electronic check' AS DOUBLE)",
        "fiber_optic": "CAST(InternetService = 'Fiber optic' AS DOUBLE)",
        "no_support_services": "CAST(TechSupport = 'No' AND OnlineSecurity = 'No' AS DOUBLE)",
        "month_to_month_paperless": "CAST(Contract = 'Month-to-month' AND PaperlessBilling = 'Yes' AS DOUBLE)",
        "is_isolated": "CAST(Partner = 'No' AND Dependents = 'No' AS DOUBLE)",
        "senior": "CAST(SeniorCitizen = 'yes' AS DOUBLE)",
    }
    z = dbl(C.LINEAR_INTERCEPT)
    for name, w in C.LINEAR_WEIGHTS:
        z = f"{z} + coalesce({design[name]}, 0.0) * {dbl(w)}"
    return z


def linear_design_sql() -> dict:
    return {
        "tenure": "coalesce(CAST(tenure AS DOUBLE), 0.0)",
        "MonthlyCharges": "coalesce(MonthlyCharges, 0.0)",
        "contract_month_to_month": "coalesce(CAST(Contract = 'Month-to-month' AS DOUBLE), 0.0)",
        "contract_two_year": "coalesce(CAST(Contract = 'Two year' AS DOUBLE), 0.0)",
        "payment_electronic_check": "coalesce(CAST(PaymentMethod = 'Electronic check' AS DOUBLE), 0.0)",
        "fiber_optic": "coalesce(CAST(InternetService = 'Fiber optic' AS DOUBLE), 0.0)",
        "no_support_services": "coalesce(CAST(TechSupport = 'No' AND OnlineSecurity = 'No' AS DOUBLE), 0.0)",
        "month_to_month_paperless": "coalesce(CAST(Contract = 'Month-to-month' AND PaperlessBilling = 'Yes' AS DOUBLE), 0.0)",
        "is_isolated": "coalesce(CAST(Partner = 'No' AND Dependents = 'No' AS DOUBLE), 0.0)",
        "senior": "coalesce(CAST(SeniorCitizen = 'yes' AS DOUBLE), 0.0)",
    }


def _seg_label(c: str) -> str:
    parts = " ".join(f"WHEN {c} = {i} THEN {sstr(n)}" for i, n in C.SEGMENT_LABELS.items())
    return f"CASE {parts} ELSE 'Segment ' || CAST({c} AS VARCHAR) END"


def _seg_risk(c: str) -> str:
    parts = " ".join(f"WHEN {c} = {sstr(n)} THEN {dbl(r)}" for n, r in C.SEGMENT_RISK.items())
    return f"CASE {parts} ELSE {dbl(C.DEFAULT_SEGMENT_RISK)} END"


def _pct1(p: str) -> str:
    t = f"((CAST(round({p} * 1000000) AS BIGINT) + 500) // 1000)"
    return f"(CAST({t} // 10 AS VARCHAR) || '.' || CAST({t} % 10 AS VARCHAR) || '%')"


def _action_label(c: str) -> str:
    parts = " ".join(f"WHEN {c} = {sstr(k)} THEN {sstr(lab)}" for k, (lab, _) in C.ACTIONS.items())
    return f"CASE {parts} ELSE {c} END"


def _select_action() -> str:
    th = C.RULE_THRESHOLDS
    monthly = "contains(coalesce(Contract, 'Month-to-month'), 'Month')"
    return f"""CASE
      WHEN churn_score >= {dbl(th['high_churn_prob'])} THEN
        CASE WHEN value_tier = 'high' THEN CASE WHEN {monthly} THEN 'early_exit_waiver' ELSE 'vip_support' END
             WHEN value_tier = 'medium' THEN 'retention_call' ELSE 'discount_offer' END
      WHEN churn_score >= {dbl(th['medium_churn_prob'])} THEN
        CASE WHEN value_tier = 'high' THEN 'discount_offer'
             WHEN value_tier = 'medium' THEN 'retention_call' ELSE 'do_nothing' END
      ELSE CASE WHEN value_tier = 'high' THEN 'loyalty_program' ELSE 'do_nothing' END END"""


def scored_sql(tau: float = C.DEFAULT_THRESHOLD, src: str = "feat", dst: str = "scored", p: str = "") -> str:
    th = C.RULE_THRESHOLDS
    d = [_distance(num, modes) for num, modes in C.SEGMENT_PROTOTYPES]
    dcols = ", ".join(f"{e} AS d{i}" for i, e in enumerate(d))
    dl = ", ".join(f"d{i}" for i in range(len(d)))
    seg = "CASE " + " ".join(f"WHEN d{i} = least({dl}) THEN {i}" for i in range(len(d))) + " END"
    w = C.PRIORITY_WEIGHTS
    vs = C.VALUE_TIER_SCORE
    return f"""
{p}segd AS (SELECT {src}.*, {dcols} FROM {src}),
{p}seg AS (
  SELECT {p}segd.*, CAST({seg} AS INTEGER) AS segment, least({dl}) AS segment_cost,
    round(CASE WHEN list_sort([{dl}])[2] > 0 THEN 1.0 - least({dl}) / list_sort([{dl}])[2] ELSE 0.0 END, 6)
      AS segment_confidence
  FROM {p}segd),
{p}lin AS (
  SELECT {p}seg.*, {_seg_label('segment')} AS segment_label, {_linear()} AS churn_margin,
    1.0 / (1.0 + exp(-({_linear()}))) AS churn_score,
    round(1.0 / (1.0 + exp(-({_linear()}))), 6) AS churn_prob
  FROM {p}seg),
{p}tier AS (
  SELECT {p}lin.*, churn_score >= {dbl(tau)} AS is_churner,
    CASE WHEN coalesce(tenure, 0) >= {th['high_value_tenure_months']}
              AND coalesce(MonthlyCharges, 0.0) >= {dbl(th['high_value_monthly_charges'])} THEN 'high'
         WHEN coalesce(MonthlyCharges, 0.0) < {dbl(th['low_value_monthly_charges'])} THEN 'low'
         ELSE 'medium' END AS value_tier
  FROM {p}lin),
{p}tier2 AS (
  SELECT {p}tier.*,
    CASE value_tier WHEN 'low' THEN {dbl(vs['low'])} WHEN 'medium' THEN {dbl(vs['medium'])}
                    WHEN 'high' THEN {dbl(vs['high'])} ELSE 0.5 END AS value_score,
    {_seg_risk('segment_label')} AS segment_risk
  FROM {p}tier),
{p}act AS (
  SELECT {p}tier2.*,
    round(least(greatest(churn_score * {dbl(w['churn_probability'])} + segment_risk * {dbl(w['segment_risk'])}
                   + (1.0 - value_score) * {dbl(w['customer_value'])}, 0.0), 1.0), 6) AS priority,
    {_select_action()} AS action_key
  FROM {p}tier2),
{dst} AS (
  SELECT {p}act.* EXCLUDE ({dl}), {_action_label('action_key')} AS action_label,
    'Segment: ' || coalesce(segment_label, '') || ' | ' ||
    (CASE WHEN churn_score >= 0.6 THEN 'High' WHEN churn_score >= 0.4 THEN 'Medium' ELSE 'Low' END)
    || ' churn risk (' || {_pct1('churn_prob')} || ') | Customer value: '
    || upper(substr(value_tier, 1, 1)) || substr(value_tier, 2) AS reason
  FROM {p}act)"""


CHAIN = {"raw": [RAW], "clean": [RAW, CLEAN], "feat": [RAW, CLEAN, FEAT],
         "scored": [RAW, CLEAN, FEAT, None]}


def with_views(final_sql: str, upto: str = "scored", extra: str = "") -> str:
    parts = [p if p is not None else scored_sql() for p in CHAIN[upto]]
    ctes = ",".join(p.strip("\n") for p in parts)
    if extra:
        ctes += "," + extra.strip("\n")
    return f"WITH {ctes}\n{final_sql}"


LINEAR_W = dict(C.LINEAR_WEIGHTS)
LINEAR_DESIGN = linear_design_sql()


def _shap_sql() -> str:
    mu = ", ".join(f"avg({LINEAR_DESIGN[f]}) AS mu_{f}" for f in LINEAR_W)
    cols = ", ".join(f"{LINEAR_DESIGN[f]} AS x_{f}, round({dbl(LINEAR_W[f])} * ({LINEAR_DESIGN[f]} - mu_{f}), 6) AS phi_{f}" for f in LINEAR_W)
    base = dbl(C.LINEAR_INTERCEPT) + "".join(f" + mu_{f} * {dbl(LINEAR_W[f])}" for f in LINEAR_W)
    margin = dbl(C.LINEAR_INTERCEPT) + "".join(f" + {LINEAR_DESIGN[f]} * {dbl(LINEAR_W[f])}" for f in LINEAR_W)
    long = " UNION ALL ".join(
        f"SELECT customerID, '{f}' AS feature, x_{f} AS feature_value, phi_{f} AS contribution FROM shapw" for f in LINEAR_W)
    return f"""
mu AS (SELECT {mu} FROM scored),
shapw AS (SELECT customerID, {cols}, round({base}, 6) AS base_margin, round({margin}, 6) AS margin
          FROM scored CROSS JOIN mu),
shapl AS ({long}),
topl AS (SELECT customerID, CAST(row_number() OVER (PARTITION BY customerID ORDER BY abs(contribution) DESC, feature) AS INTEGER) AS rank,
                feature, contribution, feature_value,
                CASE WHEN abs(contribution) < 1e-6 THEN 'neutral' WHEN contribution > 0 THEN 'increases_churn'
                     ELSE 'decreases_churn' END AS direction
         FROM shapl QUALIFY rank <= {C.TOP_N_DRIVERS})"""


SHAP = _shap_sql()
