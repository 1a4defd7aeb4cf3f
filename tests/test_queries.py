"""Every query of the core beside its SQL on the smallest tables."""

import duckdb
import pytest

from conftest import SF
from forgeline import plans


@pytest.fixture(scope="module")
def con():
    from pathlib import Path

    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_equals_sql(spark, con, name):
    df = plans.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    sql = plans.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert canon(rows, df.columns) == canon(cur.fetchall(), columns)
