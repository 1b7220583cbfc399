"""DuckDB oracle parity for a representative set of registered queries
(scripts/oracle_check.py runs all of them)."""

import math

import duckdb
import pytest

from stayline.sources.tables import TABLES
from tests.conftest import SF

SAMPLE = ["preprocess", "engineer_features", "score_batch", "segment_ratios", "segment_intelligence",
          "action_plan", "roc_auc", "pr_curve", "classification_report", "what_if_delta", "global_importance",
          "metrics_diff", "value_share", "box_stats", "stratified_split", "describe_numeric", "segment_summary", "segment_profile",
          "corr_matrix", "corr_with_target", "kernel_density", "null_dtype_profile", "plan_sort", "plan_filters", "row_number_id",
          "batch_status", "failed_rows", "attach_segments", "explain_customers", "prediction_record", "experiment_log", "kernel_shapley",
          "train_churn", "early_stopping", "model_feature_importance", "tree_shap", "model_drivers", "logistic_baseline", "refine_search"]


def _rows(pdf):
    cols = sorted(pdf.columns)

    def norm(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        if hasattr(v, "item"):
            v = v.item()
        return float(f"{v:.9g}") if isinstance(v, float) else v
    return cols, sorted((tuple(norm(x) for x in r) for r in pdf[cols].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("slug", SAMPLE)
def test_oracle(spark, con, slug):
    import __spark_entry__ as E
    got = _rows(E.queries()[slug](spark, SF).toPandas())
    want = _rows(con.execute(E.oracle_sql()[slug]).df())
    assert got == want


def test_every_oracle_has_a_query():
    import __spark_entry__ as E
    assert set(E.oracle_sql()) <= set(E.queries())
