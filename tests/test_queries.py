"""Named queries against their SQL counterparts, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as driver
from tests.conftest import TABLES

# A cross-section; every query is compared in the same way by the driver.
SAMPLE = [
    "strip_literals", "behavior_findings", "enclosing_function", "sink_boost", "dedupe_findings", "corpus_script_scan",
    "file_report", "line_limit", "repo_limits", "usage_upsert", "actor_key", "parse_package_json", "dep_findings_ranked",
    "manifest_summary", "repo_behavior", "stream_usage", "taint_map", "part_exclude_blocks", "part_functions", "advisory_json",
    "manifest_files_findings", "repo_files", "repo_report", "stream_quota", "report_sink", "file_tree", "program_call_sites",
    "salted_dep_refs", "indexed_behavior", "indexed_word_rules", "bucketed_repo_files",
]


def _plain(value):
    return repr(round(value, 9) + 0.0) if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def oracle(small):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, small, oracle, name):
    frame = driver.queries()[name](spark, small)
    names = sorted(frame.columns)
    got = sorted(tuple(_plain(r[c]) for c in names) for r in frame.collect())
    result = oracle.execute(driver.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == names
    want = sorted(tuple(_plain(row[columns.index(c)]) for c in names) for row in result.fetchall())
    assert got == want


def test_entry(spark):
    rows = driver.entry(spark).limit(3).collect()
    assert [r.risk for r in rows] == ["red"] * 3


def test_every_oracle_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
