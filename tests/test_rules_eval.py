"""Rules, evaluation and portfolio fixtures."""

from pyspark.sql import functions as F

from stayline.operators import evaluate as E
from stayline.operators import portfolio as P
from stayline.operators import rules


def test_rule_cases(spark):
    cases = [(0.60, 36, 75.0, "Month-to-month", "high", "early_exit_waiver"),
             (0.60, 36, 75.0, "Two year", "high", "vip_support"),
             (0.70, 10, 50.0, "One year", "medium", "retention_call"),
             (0.70, 40, 29.99, "One year", "low", "discount_offer"),
             (0.40, 36, 75.0, "One year", "high", "discount_offer"),
             (0.59, 10, 30.0, "One year", "medium", "retention_call"),
             (0.45, 10, 20.0, "One year", "low", "do_nothing"),
             (0.39, 40, 80.0, "One year", "high", "loyalty_program"),
             (0.10, 10, 50.0, "One year", "medium", "do_nothing")]
    df = spark.createDataFrame([(i, p, t, m, c, "At risk High-value") for i, (p, t, m, c, _, _) in enumerate(cases)],
                               "id int, churn_prob double, tenure int, MonthlyCharges double, Contract string, "
                               "segment_label string")
    out = {r["id"]: r for r in rules.decide_action(df).collect()}
    for i, (_, _, _, _, tier, action) in enumerate(cases):
        assert out[i]["value_tier"] == tier
        assert out[i]["action_key"] == action
    # priority example: p .7, 'At risk High-value' (.8), medium (.5) -> .67
    assert abs(out[2]["priority"] - 0.67) < 1e-12
    assert out[2]["reason"] == "Segment: At risk High-value | High churn risk (70.0%) | Customer value: Medium"


def test_unknown_segment_risk(spark):
    df = spark.createDataFrame([(0.5, 10, 50.0, "One year", "Nobody")],
                               "churn_prob double, tenure int, MonthlyCharges double, Contract string, segment_label string")
    assert rules.decide_action(df).first()["segment_risk"] == 0.5


def test_hand_metrics(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "label int, churn_prob double")
    assert E.roc_auc(df).first()["roc_auc"] == 0.75
    m = E.evaluate_model(df, 0.5).first()
    assert (m["tn"], m["fp"], m["fn"], m["tp"]) == (2, 0, 1, 1)
    assert m["precision"] == 1.0 and m["recall"] == 0.5 and abs(m["f1"] - 2 / 3) < 1e-12 and m["accuracy"] == 0.75
    b = E.best_f1_threshold(df).first()
    assert b["threshold"] == 0.35 and abs(b["precision"] - 2 / 3) < 1e-12 and b["recall"] == 1.0
    assert abs(b["f1"] - 0.8) < 1e-6


def test_published_confusion_matrix(spark):
    cm = spark.createDataFrame([(580, 195, 60, 220)], "tn long, fp long, fn long, tp long")
    m = E.with_binary_metrics(cm).first()
    assert round(m["precision"], 5) == 0.53012 and round(m["recall"], 5) == 0.78571
    assert round(m["f1"], 5) == 0.63309 and round(m["accuracy"], 5) == 0.75829


def test_one_class_split(spark):
    df = spark.createDataFrame([(0, 0.2), (0, 0.7)], "label int, churn_prob double")
    m = E.evaluate_model(df, 0.5).first()
    assert (m["tn"], m["fp"], m["fn"], m["tp"]) == (1, 1, 0, 0) and m["precision"] == 0.0 and m["roc_auc"] is None


def test_auc_equals_rank_sum(spark):
    import random
    rng = random.Random(42)
    rows = [(rng.randint(0, 1), round(rng.random(), 2)) for _ in range(300)]
    df = spark.createDataFrame(rows, "label int, churn_prob double")
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    expect = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert abs(E.roc_auc(df).first()["roc_auc"] - expect) < 1e-12


def test_portfolio_hand_case(spark):
    rows = [(1, 0, "A", True, 0.8, 100.0, 5, "x", 0.5, "Month-to-month", "DSL", "Mailed check", 1000.0, 0.9),
            (2, 0, "A", False, 0.2, 50.0, 5, "x", 0.5, "Month-to-month", "DSL", "Mailed check", 500.0, 0.9),
            (3, 1, "B", False, 0.1, 30.0, 5, "y", 0.5, "Month-to-month", "DSL", "Mailed check", 300.0, 0.9)]
    df = spark.createDataFrame(rows, "customerID long, segment int, segment_label string, is_churner boolean, "
                                     "churn_prob double, MonthlyCharges double, tenure int, action_label string, "
                                     "priority double, Contract string, InternetService string, PaymentMethod string, "
                                     "TotalCharges double, segment_confidence double")
    k = P.portfolio_kpis(df).first()
    assert k["total_mrr"] == 180.0 and k["mrr_at_risk"] == 100.0 and k["expected_loss"] == 93.0
    assert k["arr_at_risk"] == 1200.0
    rat = {r["segment"]: r for r in P.segment_ratios(P.segment_revenue(df)).collect()}
    assert rat["A"]["risk_share"] == 1.0 and rat["B"]["risk_share"] == 0.0
    eq = df.withColumn("MonthlyCharges", F.lit(50.0))
    assert {r["value_norm"] for r in P.minmax_value(eq).collect()} == {0.0}
    none = df.withColumn("is_churner", F.lit(False))
    assert {r["risk_share"] for r in P.segment_ratios(P.segment_revenue(none)).collect()} == {0.0}
