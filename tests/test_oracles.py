"""Registered queries against their SQL on the smallest tables.

Set CHECK_ALL=1 to run every query; the default is one per operator family.
"""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tools.check_oracle import compare, connect

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
CORE = [
    "sales_panel_labeled", "reviews_panel_labeled", "a4_first_event_per_product", "a10_correlations_sales",
    "a16_column_quality", "c6_median_imputation", "e2_classification_report", "e3_auc_per_class",
    "f3_first_of_duplicate_reviews", "f8_quantile_outlier_cut", "i3_walk_forward_folds",
    "j6_branch_assembly", "k3_best_threshold", "k4_best_class_weights", "k8_reliability_table",
    "l8_forward_labels_sales", "p20_text_statistics", "r12_subgroup_metrics", "s1_read_reviews_csv",
    "t2_declining_products", "w14_z_scores_sales", "x21_scored_trajectory",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("CHECK_ALL") else CORE


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    status, _, _, note = compare(spark, con, name, SF_DIR)
    assert status.startswith("ok"), note


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
