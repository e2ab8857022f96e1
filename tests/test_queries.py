"""Registered queries on the smallest tables next to their checking SQL."""

import importlib.util
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SMALL = "/root/testdata/sf0.001"


def load(path):
    spec = importlib.util.spec_from_file_location(path.stem.strip("_"), path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


entry = load(ROOT / "__spark_entry__.py")
check = load(ROOT / "tools" / "check.py")

#: Queries that may find nothing in the smallest tables.
MAY_BE_EMPTY = {
    "balanced_cells", "denial_rates_by", "differential_selection", "join_base_year", "join_semi_cells", "trend_adjusted",
    "within_cell_estimator",
}


def test_entry(spark):
    assert entry.entry(spark).columns[:4] == ["year", "state", "race", "band"]


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


@pytest.mark.parametrize("key", sorted(check.registry.CHECKS))
def test_query_matches_its_check(spark, key):
    verdict, _, info = check.compare(key, spark, SMALL)
    assert verdict == "ok" or verdict == "EMPTY" and key in MAY_BE_EMPTY, (verdict, info)
