"""Rows that tie, and values that stand half-way, come out as the twins have them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from factloom import catalog
from factloom.functions import text


def both(spark, folder, name, rows, schema, table):
    """Rows of a query and of its twin over one table; the twin reads in order on one thread."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, str(folder))
    cur = con.execute(catalog.ORACLES[name])
    at = [[d[0] for d in cur.description].index(c) for c in df.columns]
    return sorted(map(tuple, df.collect()), key=repr), sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=repr)


EVENTS = "event_id long, user_id long, event_type string, value double"


@pytest.mark.parametrize("name", ["a7_row_of_the_extreme", "a14_cluster_rollup"])
def test_the_first_of_equal_extremes_is_taken(spark, tmp_path, name):
    kinds = ["view", "click", "error", "signup", None]
    rows = [(i, i % 3, kinds[i * 7 % 5], [50.0, 99.5, 99.5, None][i // 3 % 4]) for i in range(120)] + [(200, 5, None, 3.0), (201, 5, "view", 1.0), (202, 6, "view", None)]
    got, want = both(spark, tmp_path, name, rows, EVENTS, "events")
    assert got == want


def test_halves_are_told_as_doubles(spark, tmp_path):
    prices = [20108.5, 37588.5, 8660.5, 25323.75, 72276.5, 0.25, 0.75, -0.25, 2.5, 1e17, 1e308, -1e308, float("nan"), float("inf"), None]
    rows = [(i, k, 1.0, p, d) for i, p in enumerate(prices) for k, d in enumerate([0.1, 0.04, 0.07, 1.0, 10.0, None])]
    got, want = both(spark, tmp_path, "f24_half_even_rounding", rows, "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double", "lineitem")
    assert repr(got) == repr(want)
    near = [2010.8500000000001, 1012.9499999999999, 0.25, 0.35, -0.05]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in near], "x double").select(text.half_even(F.col("x"), 1)).collect()] == [2010.8, 1013.0, 0.2, 0.4, -0.0]


def test_seven_tenths_of_ninety_are_63(spark, tmp_path):
    rows = [(i, n, "view", float(i)) for n in (1, 9, 10, 90, 100, 180, 210) for i in range(n)]
    got, want = both(spark, tmp_path, "a30_upper_median", rows, EVENTS, "events")
    assert got == want
