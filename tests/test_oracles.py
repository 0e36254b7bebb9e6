"""Registered queries beside their SQL, on the smallest tables."""

import threading
from concurrent.futures import ThreadPoolExecutor

import __spark_entry__ as entry
import pytest
from workload.compare import check, oracle_connection

THREADS = 6


@pytest.fixture(scope="module")
def results(spark, sf):
    """Every registered query with SQL beside it, a few at a time; a thread has its own DuckDB."""
    own = threading.local()

    def run(name):
        if not hasattr(own, "con"):
            own.con = oracle_connection(sf)
        return check(spark, own.con, sf, name, entry.queries()[name], entry.oracle_sql()[name])

    with ThreadPoolExecutor(THREADS) as pool:
        yield {name: pool.submit(run, name) for name in entry.oracle_sql()}


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(results, name):
    result = results[name].result()
    assert result.startswith("ok"), result


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_registration_needs_no_session():
    """The driver may list queries before it opens a session."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 100"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
