"""The quality report, session minutes and trend parameters on rows worked out by hand."""

from __future__ import annotations

from datetime import datetime

from tapestone.functions import indicators as ind
from tapestone.sources import bars as src

SCHEMA = "symbol string, bar long, ts timestamp, open double, high double, low double, close double, volume double, spread double"


def bars(spark, *rows):
    return spark.createDataFrame([("a", i, datetime(2024, 1, d, h), 1.0, 2.0, 0.5, 1.0, v, x) for i, (d, h, v, x) in enumerate(rows)], SCHEMA)


def test_quality_report(spark):
    made = bars(spark, (2, 1, 5.0, 4.0), (2, 20, 0.0, None), (2, 22, 1.0, 0.0), (3, 0, 1.0, 5.0))
    got = {(r["section"], r["item"]): (r["n"], r["value"]) for r in src.quality_report(made, 60, "spread").collect()}
    assert got == {
        ("rows", "bars"): (4, None), ("rows", "zero_volume"): (1, None), ("gap", "short_gap"): (1, 1140.0), ("gap", "daily_break"): (2, 120.0),
        ("break_hour", "20"): (1, None), ("break_hour", "22"): (1, None), ("offset", "3"): (1, None), ("offset", "2"): (1, None),
        ("spread", "min"): (3, 0.0), ("spread", "max"): (3, 5.0), ("spread", "mean"): (3, 3.0), ("spread", "median"): (3, 4.0), ("spread", "zero"): (3, 1.0),
    }


def test_quality_report_of_nothing(spark):
    assert src.quality_report(bars(spark, (2, 1, 1.0, 1.0)).limit(0), 60, "spread").count() == 0


def test_minutes_from_open(spark):
    made = bars(spark, *[(2, h, 1.0, 1.0) for h in (1, 7, 9, 18, 23)])
    out = ind.add_sessions(made, {"asia": (2, 8), "london": (7, 16), "late": (22, 2)})
    got = {r["hour"]: (r["n_sessions"], r["minutes_from_open"]) for r in out.collect()}
    assert got == {1: (1, -1260), 7: (2, 300), 9: (1, 120), 18: (0, None), 23: (1, 60)}
