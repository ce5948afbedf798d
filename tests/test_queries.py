"""Registered queries against their check SQL.

A cross-section by default; CARTLOOM_ALL_CHECKS=1 runs every one.
"""

import os

import pytest

import __spark_entry__ as entry
from compare import connect, difference

SOME = """profile_shape profile_columns profile_box_stats profile_histograms duplicate_rows_listing issue_snapshot validate_schema
validate_numeric_text quality_metrics validate_dataset alerts_model clean_dataset_lib clean_report_lib clean_guest_ids clean_composite_nb
clean_summary financial_performance sales_daily sales_by_weekday customer_metrics_sales product_metrics_sales top_countries_share
heatmap_day_hour quarterly_growth seasonal_extremes order_value_anomalies pareto_customers kpi_growth rfm_scores rfm_segment_nb
rfm_features_nb customer_features_lib clv segment_insights segment_summary_nb feature_correlation priority_segments_bands standardize
auc classification_report churn_labels churn_features_temporal retention_roi churn_patterns campaign_segments budget_allocation
calendar_summary ab_metrics ab_winner attribution_time_decay campaign_planning csv_scan segment_scan_tolerant attribution_last_touch
attribution_first_touch attribution_linear csv_detect_encoding csv_detect_separator file_catalog file_info_preview load_metrics scan_cache
table_scan_clean profile_cardinality clean_quality_score clean_business_logic_nb quality_recommendations validate_model_input alerts_quality
calendar_features message_assignment kmeans_clusters pca_2d clustering_metrics churn_logistic churn_random_forest churn_gbt
feature_importance model_selection model_train_record model_predict model_sink model_scan churn_train_select churn_score
risk_band_analysis retention_impact churn_dashboard churn_analysis_full segment_analysis_cluster customer_analysis_full
cluster_summary_nb priority_segments campaign_strategy_summary customer_anomalies_iforest anomaly_summary""".split()

CHECKS = entry.oracle_sql()
KEYS = sorted(CHECKS) if os.environ.get("CARTLOOM_ALL_CHECKS") else SOME


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("key", KEYS)
def test_query_equals_check(spark, sf_dir, duck, key):
    assert difference(entry.queries()[key](spark, sf_dir), duck, CHECKS[key]) is None


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_keys_line_up():
    assert set(CHECKS) <= set(entry.queries())


def test_partitioning_does_not_change_results(spark, sf_dir):
    from cartloom.plans.mart import Mart
    from cartloom.plans.catalog import QUERIES

    keys = ["clean_guest_ids", "rfm_scores", "pareto_customers"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            fresh = Mart(spark, sf_dir)
            seen.append([sorted(map(str, QUERIES[k](fresh).collect())) for k in keys])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]
