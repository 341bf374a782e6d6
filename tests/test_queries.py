"""Every registered query of the library against its SQL on the smallest dataset."""

from __future__ import annotations

import pytest

from tests.conftest import rows_of, sql_rows

from cairn import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    frame = catalog.queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = rows_of(frame, columns)
    if name in SQL:
        assert got == sql_rows(duck, SQL[name], columns)
