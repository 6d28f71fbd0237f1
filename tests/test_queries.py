"""Registered queries: shape of the plans, and agreement with their SQL on small tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from dossier.plans.catalog import QUERIES, SQL
from oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables")

AGREE = """counts_by_dimension heatmap sector_summary top_groups coverage costliest taxonomy presence_matrix
family_rollup norm_key split_groups parse_usd host_of strip_html incidents_table normalize_postings cross_sector_groups
only_in shared_targets hazard_reach rematch cited_sources resolve_edges merge_nodes exposure_inventory intake_status
corroborate contained_names taxonomy_members family_labels family_subcategories with_incident_ids route vector_topk_by_type entity_evidence validate check_ids upsert postings_csv
journal_records replace_by_key posting_lists upsert_buckets replace_in_buckets expand_hits write_collections vector_table with_sector_summary""".split()


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", AGREE)
def test_agrees_with_sql(spark, db, name):
    assert compare(entry.queries()[name](spark, FOLDER), db, entry.oracle_sql()[name]) == ""


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["group", "industries", "incidents"] and df.count() == 20


@pytest.mark.parametrize("name", ["heatmap", "cross_sector_groups", "intake_status", "contained_names", "route", "neighbour_context"])
def test_no_pairing_of_everything(spark, name):
    text = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_scans_read_only_needed_columns(spark):
    text = entry.queries()["count_by"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_type:string>" in text
    text = entry.queries()["fold_in"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(p_type), IsNotNull(p_size), EqualTo(p_type,ECONOMY), GreaterThan(p_size,40)]" in text
