"""Registered queries against SQL on the smallest tables; check.py runs all of them."""

import os

import pytest

import check
from queries import registry

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "shipments_page", "shipments_page_filtered", "new_shipments", "geo_enrich", "kpi", "ingestion_metrics", "impute_weight_median",
    "constraint_checks", "valid_coords", "to_weight_and_delay", "risk_display", "latest_log", "flatten_headers", "process_manifest",
    "classify_cells", "cell_predicates", "row_profiles", "dataset_profile_docs", "table_regions", "data_start_scores",
    "cycle_scores_docs", "group_scored", "row_boundary_scores", "boundary_report", "sparse_merge_docs", "rechunk_stream", "record_coherence",
    "best_shifts", "aligned_tables", "reconstruct_customers",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return check.duck_connection(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    ok, message = check.compare(spark, con, SF, name, registry()[name])
    assert ok, message


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 50
    assert set(entry.oracle_sql()) <= set(entry.queries())
