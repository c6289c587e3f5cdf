"""Registered queries against their DuckDB texts on the smallest tables.

A choice of queries that touches every operator; tools/check_oracle.py runs all.
"""

import os

import pytest

from check_oracle import compare, duck

DATA = "/root/testdata/sf0.001"
CHECKED = [
    "a2_actual_labels", "a9_new_labels_sheet", "b1_remove_comments", "b10_request_body", "b19_junk_rows",
    "b17_tabular_rows", "c4_choice_status", "c6_param_problems", "c9_example_mismatches", "c11_request_fields",
    "e6_consensus", "e6_row_votes", "e2_overall_accuracy", "e4_overall_confusion", "h2_exact_confidence",
    "h3_threshold_failures", "i1_statement_scan", "i6_user_functions", "j0_rule_dispatch", "f4_evidence_lists",
    "l3_student_rows", "m1_label_submissions", "m5_request_stream", "a7_resume_from_cache",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(DATA)


def test_names_agree():
    from __spark_entry__ import oracle_sql, queries

    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, con, name):
    from __spark_entry__ import oracle_sql, queries

    assert compare(queries()[name](spark, DATA), con, oracle_sql()[name]) is None


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() > 0
