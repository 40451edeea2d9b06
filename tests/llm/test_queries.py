"""Queries of this subpackage with SQL, against DuckDB."""

from pathlib import Path

import pytest

from cloudfork.llm import queries
from tests.conftest import same_rows, tables_in_duckdb

DATA = Path("/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows(spark, name):
    same_rows(queries.QUERIES[name](spark, str(DATA)), tables_in_duckdb(DATA), queries.ORACLE[name])
