"""Every query with SQL gives the same rows as DuckDB."""

import math
from collections import Counter

import duckdb
import pytest

from tallyweave.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.10g}")
    if isinstance(x, bool) or x is None:
        return x
    return int(x) if isinstance(x, int) else str(x)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(v[i]) for i in order) for v in values)


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, sf_dir, name):
    frame = catalog.QUERIES[name](spark, sf_dir)
    got = frame.collect()
    assert len(set(frame.columns)) == len(frame.columns)
    if name in catalog.ORACLES:
        cursor = duck.execute(catalog.ORACLES[name])
        columns = [c[0] for c in cursor.description]
        want = cursor.fetchall()
        assert sorted(columns) == sorted(frame.columns)
        assert rows(frame.columns, got) == rows(columns, want)
    assert got or name in ("contradictions_anchorless", "relation_endpoints", "signatory_mismatch")
