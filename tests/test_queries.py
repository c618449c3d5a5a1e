"""Every registered corpus query against its SQL on the small tables."""

import os

import duckdb
import pytest

from lectern.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    return con


def shown(frame, columns):
    text = lambda x: "" if x is None or x != x else str(x)
    return sorted(tuple(map(text, row)) for row in frame[columns].values.tolist())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name not in registry.ORACLE_SQL:
        assert len(got)
        return
    want = duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    assert shown(got, columns) == shown(want, columns)


def test_round_trip_of_masks(spark):
    assert registry.QUERIES["mask_round_trip"](spark, SF).where("not identical").isEmpty()
