"""Every query with SQL against DuckDB on the smallest fixture."""

import os

import duckdb
import pytest

from tremorloom.plans import fitting, geometry, point_process, publishing, registry, replay, simulation  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return db


def rows(table):
    return sorted(map(repr, zip(*[c.to_pylist() for c in table.columns], strict=True)))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    mine = df.select(*[f"`{c}`" for c in sorted(df.columns)]).toArrow()
    sql = duck.sql(registry.ORACLES[name])
    other = sql.select(",".join(f'"{c}"' for c in sorted(sql.columns))).to_arrow_table()
    assert mine.column_names == other.column_names
    assert [str(f.type) for f in mine.schema] == [str(f.type) for f in other.schema]
    assert rows(mine) == rows(other)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_has_rows(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0
