"""Quantile breaks beside those of the SQL checks."""

from __future__ import annotations

import random

import duckdb

from obsframe.functions.aggregates import quantile_breaks


def test_breaks_equal_the_sql_to_the_last_bit(spark):
    random.seed(5)
    rows = [(g, float(random.randint(0, 400)) / random.choice((1, 2, 7))) for g in range(200) for _ in range(1 + g % 9)]
    rows += [(g, None) for g in range(150, 201)]
    got = spark.createDataFrame(rows, "g int, x double").groupBy("g").agg(quantile_breaks("x", 11).alias("b")).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE t(g INTEGER, x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    want = dict(con.execute("SELECT g, quantile_cont(x, [i/11.0::DOUBLE FOR i IN range(0,12)]) FROM t GROUP BY g").fetchall())
    assert {r["g"]: r["b"] for r in got} == want
