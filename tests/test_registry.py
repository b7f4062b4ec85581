"""Every registered hazard query agrees with its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from slopeworks.plans import registry


def _rows(frame):
    columns = sorted(frame.columns)
    text = lambda v: "null" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
    return columns, sorted(tuple(map(text, r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_agrees_with_sql(spark, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir)
    if name not in registry.ORACLE:
        assert got.count() > 0
        return
    with duckdb.connect() as con:
        for f in Path(sf_dir).glob("*.parquet"):
            con.execute(f"create view {f.stem} as select * from '{f}'")
        assert _rows(got.toPandas()) == _rows(con.execute(registry.ORACLE[name]).df())


def test_entry_imports_without_a_session():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
