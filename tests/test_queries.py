"""Every query of the engine against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from syndromeframe import registry
from syndromeframe.functions import ids

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
SLOW = {"decode_verify_tiled"}  # tests/test_engine.py holds this operator against the kernel


def comparable(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(round(r[k], 9) if isinstance(r[k], float) else r[k] for k in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert registry.QUERIES.keys() == registry.ORACLE_SQL.keys()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - SLOW))
def test_query_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    found = duck.execute(registry.ORACLE_SQL[name])
    columns = [x[0] for x in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert comparable([tuple(r) for r in df.collect()], df.columns) == comparable(found.fetchall(), columns)


def test_bit_helpers_of_large_keys(spark, tmp_path):
    """Tables beyond 100,000 parts: the SQL's only unit is K; keys beyond 32 bits have a power of two, too."""
    keys = [0, 1, 99, 100, 99_999, 100_000, 123_456, 1_199_999, 99_999_999, 100_000_000, (1 << 31) + 1, (1 << 33) + 1, 1 << 40]
    spark.createDataFrame([(k,) for k in keys], "p_partkey bigint").write.parquet(f"{tmp_path}/part.parquet")
    df = registry.QUERIES["bit_helpers"](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    found = c.execute(registry.ORACLE_SQL["bit_helpers"])
    columns = [x[0] for x in found.description]
    assert comparable([tuple(r) for r in df.collect()], df.columns) == comparable(found.fetchall(), columns)


def test_short_number_units(spark):
    n = [0, 999, 1000, 999_999, 1_234_567, 2_345_678_901]
    rows = spark.createDataFrame([(k,) for k in n], "n bigint").select("n", ids.short_number("n").alias("g"), ids.short_number("n", "M").alias("m")).orderBy("n").collect()
    assert [r.g for r in rows] == ["0", "999", "1.0K", "1000.0K", "1.2M", "2.3G"] and rows[-1].m == "2345.7M"
