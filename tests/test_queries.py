"""Registered queries against their SQL, and streams against the batch."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry_point
from workload import check
from workload.oracle import oracle_sql
from workload.queries import QUERIES

ROOT = Path(__file__).resolve().parents[1]
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# Covered by the operators above them, and slow: full set via `python -m workload.check`.
QUICK = [
    "clean_text_docs", "rating_normalize", "date_normalize", "content_key", "url_list",
    "page_triage", "extract_reviews", "dedup_cross_page", "dedup_two_pass", "page_runs",
    "merged_stats", "progress_running", "import_alias_dedup", "append_to_table",
    "product_quality", "stream_ingest", "stream_metrics", "dedup_cross_page_hot", "ingest_existing",
    "migrate_titles_limited", "upsert_reviews", "export_ndjson", "export_product_limit",
    "extract_fallback", "has_next_forms", "ingest_runs", "import_csv_split", "crawl_frontier",
    "last_run_export", "migrate_table", "ingest_tranches", "header_total_forms", "failed_products",
    "latest_of_product", "union_missing_cols", "dedup_metrics_written", "stream_quarantine",
]


@pytest.fixture(scope="module")
def db():
    return check.database(SF_DIR)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, db, name):
    result = check.compare(spark, db, name, SF_DIR)
    assert result.startswith("ok") and "differ" not in result, result


def test_every_query_has_sql():
    assert set(QUERIES) == set(oracle_sql())
    assert set(QUERIES) <= set(entry_point.queries())


def test_entry_runs(spark):
    assert entry_point.entry(spark).count() > 0


def test_workers_find_the_package_from_any_folder(tmp_path):
    """A session of its own, started elsewhere, reads the blocks of pages."""
    code = (f"import sys; sys.path.insert(0, {str(ROOT)!r})\n"
            "import __spark_entry__ as e\n"
            "from workload.session import local_session\n"
            "spark = local_session('elsewhere', cpus='2')\n"
            f"rows = e.queries()['extract_fallback'](spark, {SF_DIR!r}).count()\n"
            "print('rows', rows)")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows " in ran.stdout and "rows 0" not in ran.stdout, ran.stderr[-2000:]
