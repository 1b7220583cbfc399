"""Cleaning and feature fixtures (hand-computed expectations)."""

from pyspark.sql import functions as F

from stayline.operators import clean, features


def test_preprocess_fixture(spark):
    rows = [("C001", 0, 1, 29.85, "nan", "No"), ("C002", 1, 12, 65.0, "780.0", "Yes"),
            ("C003", 0, 24, 52.0, "1248.0", "No"), ("C004", 0, 0, 45.0, "0", "Yes"),
            ("C005", 0, 5, 40.0, " ", "No"), ("C006", 0, None, 40.0, "100.0", "No"),
            ("C007", 2, 5, 40.0, "200.0", "Maybe")]
    df = spark.createDataFrame(rows, "customerID string, SeniorCitizen int, tenure int, MonthlyCharges double, "
                                     "TotalCharges string, Churn string")
    out = {r["customerID"]: r for r in clean.preprocess(df).collect()}
    assert set(out) == {"C002", "C003", "C006", "C007"}  # null tenure kept
    assert out["C002"]["SeniorCitizen"] == "yes" and out["C002"]["Churn"] == 1
    assert out["C003"]["SeniorCitizen"] == "no" and out["C003"]["Churn"] == 0
    assert out["C002"]["TotalCharges"] == 780.0
    assert out["C007"]["SeniorCitizen"] is None and out["C007"]["Churn"] is None


def test_engineer_features_fixture(spark):
    cols = ("tenure int, MonthlyCharges double, TotalCharges double, StreamingTV string, StreamingMovies string, "
            "OnlineSecurity string, OnlineBackup string, DeviceProtection string, TechSupport string, "
            "Contract string, PaperlessBilling string, PaymentMethod string, Partner string, Dependents string, "
            "InternetService string, id int")
    rows = [(1, 29.85, 29.85, "No", "No", "No", "No", "No", "No", "Month-to-month", "Yes", "Electronic check",
             "No", "No", "DSL", 1),
            (12, 65.0, 780.0, "Yes", "Yes", "Yes", "No", "No", "Yes", "Two year", "No", "Credit card", "Yes", "No",
             "Fiber optic", 2),
            (24, 52.0, 1248.0, "No", "Yes", "No", "Yes", "No", "No", "Month-to-month", "Yes", "Bank transfer",
             "No", "No", "DSL", 3),
            (60, 45.0, 2700.0, "Yes", "Yes", "Yes", "Yes", "Yes", "Yes", "One year", "No", "Mailed check", "Yes",
             "Yes", "Fiber optic", 4)]
    df = spark.createDataFrame(rows, cols)
    out = sorted(features.engineer_features(df).collect(), key=lambda r: r["id"])
    assert [r["avg_monthly_spend"] for r in out] == [29.85, 65.0, 52.0, 45.0]
    assert [r["charge_gap"] for r in out] == [0.0, 0.0, 0.0, 0.0]
    assert [r["is_high_value"] for r in out] == [0, 1, 1, 0]  # median 48.5
    assert [r["tenure_band"] for r in out] == ["0-12", "0-12", "12-36", "36+"]
    assert [r["streaming_count"] for r in out] == [0, 2, 1, 2]
    assert [r["security_count"] for r in out] == [0, 2, 1, 4]
    assert [r["payment_electronic_check"] for r in out] == [1, 0, 0, 0]
    assert [r["month_to_month_paperless"] for r in out] == [1, 0, 1, 0]
    assert [r["no_support_services"] for r in out] == [1, 0, 1, 0]
    assert [r["is_isolated"] for r in out] == [1, 0, 1, 0]
    assert [r["fiber_no_security"] for r in out] == [0, 0, 0, 0]
    assert [r["no_internet_services"] for r in out] == [0, 0, 0, 0]


def test_tenure_band_edges(spark):
    from stayline.functions.exprs import tenure_band
    df = spark.createDataFrame([(t,) for t in (0, 12, 36, 37, 72, 73)], "tenure int")
    got = [r[0] for r in df.select(tenure_band("tenure")).collect()]
    assert got == ["nan", "0-12", "12-36", "36+", "36+", "nan"]


def test_stratified_split_exact(spark):
    from stayline.plans.score import processed_view
    from tests.conftest import SF
    sp = features.stratified_split(processed_view(spark, SF))
    counts = {(r["Churn"], r["split"]): r["count"] for r in sp.groupBy("Churn", "split").count().collect()}
    for lab in (0, 1):
        n = sum(v for (l, _), v in counts.items() if l == lab)
        import math
        n_test = math.ceil(n * 0.15 - 1e-9)
        n_val = math.ceil((n - n_test) * (0.15 / 0.85) - 1e-9)
        assert counts[(lab, "test")] == n_test and counts[(lab, "validation")] == n_val
    again = features.stratified_split(processed_view(spark, SF))
    a = {r["customerID"]: r["split"] for r in sp.select("customerID", "split").collect()}
    b = {r["customerID"]: r["split"] for r in again.select("customerID", "split").collect()}
    assert a == b


def test_row_positions_distributed(spark):
    from stayline.operators.positions import group_positions
    df = spark.range(0, 1000).withColumn("g", (F.col("id") % 3 == 0).cast("int")).repartition(7)
    out = group_positions(df, ["g"], [F.col("id")], "pos").collect()
    for g in (0, 1):
        ids = sorted(r["id"] for r in out if r["g"] == g)
        pos = {r["id"]: r["pos"] for r in out if r["g"] == g}
        assert [pos[i] for i in ids] == list(range(len(ids)))
