"""Each query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from flowmill.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        at = f if os.path.isfile(f) else f"{f}/*.parquet"
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{at}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_duckdb(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, FOLDER).toPandas(), duck.execute(catalog.SQL[name]).df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns) and len(got) == len(want)
    got, want = (x[columns].sort_values(columns, ignore_index=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=1e-9)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0


def test_sketches_are_within_their_error(spark):
    from pyspark.sql import functions as F

    from flowmill.operators import profiles
    from flowmill.plans.flows import events_as_flows

    got = catalog.QUERIES["merged_sketches"](spark, FOLDER)
    flows = profiles.with_categories(events_as_flows(spark, FOLDER, "ip_src", "ip_dst", "port_src", "port_dst"))
    want = flows.groupBy("ip_src").agg(*[F.count_distinct(*c).alias(f"exact_{n}") for n, c in profiles.DISTINCT.items()])
    for r in got.join(want, "ip_src").collect():
        for n in profiles.DISTINCT:
            assert abs(r[n] - r[f"exact_{n}"]) <= 0.05 * r[f"exact_{n}"] + 1
