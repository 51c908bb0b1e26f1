"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest
from quarry import registry

registry.load()
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    for name in TABLES:
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return found


def plain(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, (int, float)):
        return None if isinstance(value, float) and math.isnan(value) else round(float(value), 5) + 0.0
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else plain(float(value)) if hasattr(value, "as_tuple") else str(value)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    frame = registry.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in frame.collect())
    if name not in registry.ORACLE_SQL:
        return
    rows = duck.execute(registry.ORACLE_SQL[name])
    heads = [d[0] for d in rows.description]
    assert sorted(heads) == columns
    want = sorted(repr([plain(r[heads.index(c)]) for c in columns]) for r in rows.fetchall())
    assert got == want


def test_registry_is_large_and_consistent():
    assert len(registry.QUERIES) > 120 and set(registry.ORACLE_SQL) <= set(registry.QUERIES)
