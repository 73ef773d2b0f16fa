"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from noveltybench.plans import base, registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One query of each family; FULL=1 runs all.
CORE = """time_blocks count_windows window_label_majority window_class_mask dedupe_windows split_temporal_gap split_composition make_sets loaco_folds
natural_novelty_sets rolling_feasibility purge_adjacent_blocks verify_sets verify_purge audit_nan_inf audit_sorted_in_file reconcile_published_counts
clean_mean_std clean_transform metric_auc metric_pr_auc metric_tpr_at_fpr metric_mcc spearman_rho delong_test group_bootstrap_metric pool_by_dimension
protocol_agreement pvalue_train_ref pvalue_lagged_reference ecusum_no_reset ecusum_reset coordination_circular_test ebh_reject own_history_scan
window_power linear_filter_recurrence embed_centroid_score rank_normalise wasserstein_1d scan_csv_typed source_archive stream_cusum_alarms
gated_reference_alarms purge_quarantine_pool stream_windowed_sums verify_recorded_hashes protocol_agreement_rollup gate_dose_response identify_conformal_knn
calibrate_roc_slope pvalue_online_full_past pvalue_online_sliced det_mahalanobis reanchor whitener det_knn sort_by_time manifest_immutability schema_check""".split()
NAMES = [n for n in registry.queries() if n in registry.oracle_sql() and (os.environ.get("FULL") or n in CORE)]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows_of(frame):
    columns = sorted(frame.columns)

    def value(v):
        if v is None or (isinstance(v, (float, np.floating)) and np.isnan(v)) or v is np.ma.masked or str(v) in ("<NA>", "NaT"):
            return ""
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (int, float, np.integer, np.floating)):
            return f"{round(float(v), 5) + 0.0:.5g}"
        return str(v)

    return columns, sorted(tuple(value(v) for v in row) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, duck, name):
    got = rows_of(registry.queries()[name](spark, sf).toPandas())
    assert got == rows_of(duck.sql(registry.oracle_sql()[name]).df())


def test_core_names_exist():
    assert set(CORE) <= set(registry.queries())


def test_flagship(spark, sf):
    assert registry.flagship(spark, sf).count() > 0
    base.forget()


def test_entry_points():
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
