"""Registered queries against their SQL on the smallest tables.

A query of every kind by default; all of them with ``FAULTLINE_ALL=1``.
"""

import os

import duckdb
import pytest

from checks import load_all
from checks.compare import TABLES, compare

SF = "/root/testdata/sf0.001"
REG = load_all()
KINDS = [
    "multiline_events", "timestamp_carry_forward", "eventviewer_records", "log_line_scan", "correlate_entries",
    "correlate_entries_unstamped", "correlate_entries_crowded", "error_summaries", "incident_ranking", "incidents_and_health", "package_validation",
    "knowledge_base_scan", "component_match", "context_rollup", "representative_evidence", "error_pattern_match",
    "timeline_events", "investigation_text", "distilled_facts", "grounding_semi_joins", "guard_unknowns", "merge_responses",
    "log_facts", "fingerprint_match", "application_profile", "openapi_contributions", "attach_project", "source_methods",
    "repository_contributions",
]
NAMES = sorted(REG.QUERIES) if os.environ.get("FAULTLINE_ALL") else KINDS


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(REG.QUERIES) == set(REG.ORACLES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    result, _ = compare(spark, con, name, REG.QUERIES[name], REG.ORACLES[name], SF)
    assert result.startswith("ok"), result
