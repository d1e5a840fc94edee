"""Every registered query of the library against its SQL in DuckDB, and the rest for their invariants."""

import duckdb
import pytest

from quillspark.plans import catalogue, chunks, stored, workflows  # noqa: F401
from quillspark.plans.registry import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    made = [tuple(round(r[i], 5) if isinstance(r[i], float) else r[i] for i in order) for r in rows]
    return sorted(made, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    found = _rows([tuple(r) for r in df.collect()], df.columns)
    cursor = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert found == _rows(cursor.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
