"""Table access and the 21-column subscriber view.

The subscriber table is derived from ``customer`` and ``orders`` with
integer arithmetic only (so any SQL engine reproduces it bit for bit):

* one hash aggregation of ``orders`` by customer (map-side partial
  aggregation; a customer holding a third of all orders costs one buffer
  per partition, not one task),
* the "latest order" is picked with ``max_by`` over a packed
  ``(order day, order key)`` long, so the aggregation keeps fixed-width
  buffers and stays a ``HashAggregate`` (no sort),
* the global last order day is a scalar subquery over the one date column,
* customers without orders are kept: tenure 0, a blank total, no contract
  or payment method, and the label "No" - cleaning drops them and the
  failed-row report lists them,
* one join with ``customer`` on the key the aggregate is already
  partitioned by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
]

# Fixed values of the derived view (see README, "Subscriber view").
CHURN_GAP_DAYS = 330
CENTS_PER_MONTH_UNIT = 4000
DAY_SHIFT = 1 << 40  # packed latest-order key: day * 2^40 + order key


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def customer_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw subscriber table (customerID + 19 inputs + Churn)."""
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        "o_orderdate", "o_orderpriority")
    cust = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    return customer_view_from(orders, cust)


def customer_view_from(orders: DataFrame, cust: DataFrame) -> DataFrame:
    """The view from both tables.  Expressions are SQL text, parsed in one call
    each: the view is built for every query."""
    o = orders.selectExpr(
        "o_custkey", f"CAST(unix_date(to_date(o_orderdate)) AS BIGINT) * {DAY_SHIFT}L + o_orderkey AS packed",
        "CAST(round(o_totalprice * 100) AS BIGINT) AS cents",
        "CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 WHEN 'F' THEN 2 END AS status_code",
        "CAST(substring(o_orderpriority, 1, 1) AS INT) AS prio_code")
    per_cust = o.groupBy("o_custkey").agg(*[F.expr(e) for e in (
        "count(1) AS n_orders", "sum(cents) AS sum_cents", "max(packed) AS latest_packed", "max_by(cents, packed) AS latest_cents",
        "max_by(status_code, packed) AS latest_status", "max_by(prio_code, packed) AS latest_prio")])
    # one pruned column, evaluated once, then a literal
    last_day = orders.where("o_custkey is not null").agg(F.expr("max(unix_date(to_date(o_orderdate)))")).scalar()
    c = cust.join(per_cust, cust.c_custkey == per_cust.o_custkey, "left")
    tenure = "CAST(greatest(0, (n_orders - 3) * 4) AS INT)"
    internet = "CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'Fiber optic' WHEN c_mktsegment IN ('FURNITURE', 'HOUSEHOLD') THEN 'DSL' WHEN c_mktsegment = 'MACHINERY' THEN 'No' END"
    c = c.withColumns({"__tenure": F.expr(tenure), "__internet": F.expr(internet)})
    total = f"(sum_cents * __tenure) DIV (n_orders * {CENTS_PER_MONTH_UNIT})"
    service = lambda i, name: f"CASE WHEN __internet = 'No' THEN 'No internet service' WHEN (c_custkey * 7 + {i * 3}) % 5 < 2 THEN 'Yes' ELSE 'No' END AS {name}"
    names = ("OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies")
    phone = "CASE WHEN c_custkey % 10 != 0 THEN 'Yes' ELSE 'No' END"
    text = [
        "c_custkey AS customerID", "CASE WHEN c_nationkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender",
        "CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END AS SeniorCitizen", "CASE WHEN c_custkey % 2 = 1 THEN 'Yes' ELSE 'No' END AS Partner",
        "CASE WHEN c_custkey % 10 < 3 THEN 'Yes' ELSE 'No' END AS Dependents", "__tenure AS tenure", f"{phone} AS PhoneService",
        f"CASE WHEN {phone} = 'No' THEN 'No phone service' WHEN c_custkey % 7 < 3 THEN 'Yes' ELSE 'No' END AS MultipleLines", "__internet AS InternetService",
        *[service(i, n) for i, n in enumerate(names, 1)],
        "CASE latest_status WHEN 0 THEN 'Month-to-month' WHEN 1 THEN 'One year' WHEN 2 THEN 'Two year' END AS Contract",
        "CASE WHEN c_acctbal >= 2000 THEN 'Yes' ELSE 'No' END AS PaperlessBilling",
        "CASE WHEN latest_prio = 1 THEN 'Electronic check' WHEN latest_prio = 2 THEN 'Mailed check' WHEN latest_prio = 3 THEN 'Bank transfer (automatic)' "
        "WHEN latest_prio IN (4, 5) THEN 'Credit card (automatic)' END AS PaymentMethod",
        f"(latest_cents DIV {CENTS_PER_MONTH_UNIT}) / 100.0D AS MonthlyCharges",
        f"CASE WHEN __tenure = 0 THEN ' ' ELSE concat(CAST({total} DIV 100 AS STRING), '.', lpad(CAST({total} % 100 AS STRING), 2, '0')) END AS TotalCharges"]
    gone = F.when(last_day - F.expr(f"latest_packed DIV {DAY_SHIFT}L") > CHURN_GAP_DAYS, "Yes").otherwise("No")
    return c.select(*[F.expr(e) for e in text], gone.alias("Churn"))
