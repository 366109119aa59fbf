"""Rounding at ties, where decimal text and a double's own arithmetic part."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from tapestone.functions import projections as pro


def test_combined_score_is_the_sql_at_every_tie(spark):
    rows = spark.range(10_003).select("id", (F.least("id", F.lit(10000)) / 10000.0).alias("s"))
    got = {r["id"]: r["c"] for r in rows.select("id", pro.combined_score(F.col("s") * 60, F.col("s")).alias("c")).collect()}
    sql = "SELECT id, round((least(1.0, CASE WHEN s * 60 > 1 THEN s * 60 / 100 ELSE s * 60 END) + s) / 2, 4) FROM (SELECT range AS id, least(range, 10000) / 10000.0 AS s FROM range(10003))"
    want = dict(duckdb.sql(sql).fetchall())
    assert got == want and (got[63], got[75]) == (0.1921, 0.2288)


def test_half_up_is_the_sql_on_either_side_of_zero(spark):
    rows = spark.range(-20_005, 20_006, 10).select("id", *[pro.half_up(F.col("id") / F.lit(k), p).alias(f"c{p}") for p, k in ((1, 100.0), (4, 100000.0))])
    got = {tuple(r) for r in rows.collect()}
    assert got == set(duckdb.sql("SELECT range, round(range / 100.0, 1), round(range / 100000.0, 4) FROM range(-20005, 20006, 10)").fetchall())
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),)], "x double").select(pro.half_up(F.col("x"), 4)).collect()
    assert odd[0][0] is None and odd[1][0] != odd[1][0] and odd[2][0] == float("inf")
