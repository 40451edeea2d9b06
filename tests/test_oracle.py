"""Every core query with SQL, against DuckDB on the smallest tables; the others run to their end."""

from pathlib import Path

import pytest

from cloudfork.plans import catalogue
from tests.conftest import same_rows, tables_in_duckdb

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    return tables_in_duckdb(DATA)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_same_rows(spark, duck, name):
    same_rows(catalogue.QUERIES[name](spark, str(DATA)), duck, catalogue.ORACLE[name])


#: Rows of the queries without SQL at the smallest scale, where they are known beforehand.
ROWS = {"stream_node_assignment": 500, "pipeline_branch_scores": 30, "layout_xy": 30, "view_marker_values": 30 * 64, "view_densities": 30, "six_layouts": None}


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE) - {"recursive_labels"}))  # that one runs in test_graph
def test_every_other_query_runs(spark, name):
    rows = catalogue.QUERIES[name](spark, str(DATA)).collect()
    assert rows and len({tuple(r.asDict()) for r in rows}) == 1
    if ROWS.get(name):
        assert len(rows) == ROWS[name]


def test_entry_imports_without_session():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
