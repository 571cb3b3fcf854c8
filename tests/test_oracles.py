"""Every catalogued query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from voltrace.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.6g}") + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("T", " ").removesuffix(" 00:00:00")
    if type(v).__name__ == "Decimal":
        return float(v)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = ordered([[r[names.index(c)] for c in columns] for r in found.fetchall()])
    assert ordered([[r[c] for c in columns] for r in df.collect()]) == want


def test_entry_is_never_empty(spark):
    import __spark_entry__ as entry

    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    found = entry.entry(spark)
    assert found.count() == 6000 and set(entry.oracle_sql()) <= set(entry.queries())
