"""Best-first selection by rounds of blocks against the loop."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapestone.operators import events as ev
from tapestone.operators import patterns as pat
from tapestone.plans.winners import best_first

SPANS = "symbol string, direction string, start_bar long, end_bar long, depth double"


def loop(rows, n):
    """Spans kept best first; a kept span marks its bars."""
    taken, out = np.zeros(n, bool), set()
    for _, a, z in sorted({(-d, a, z) for a, z, d in rows}):
        if not taken[a : z + 1].any():
            taken[a : z + 1] = True
            out.add((a, z))
    return out


def test_one_island_of_a_hundred_thousand_spans(spark):
    r = np.random.default_rng(5)
    n = 100_000
    a = np.arange(n)
    frame = pd.DataFrame({"symbol": "a", "direction": "long", "start_bar": a, "end_bar": a + r.integers(1, 40, n), "depth": np.round(r.random(n), 3)})
    got = ev.suppress_overlaps(spark.createDataFrame(frame, SPANS)).select("start_bar", "end_bar").collect()
    assert {tuple(x) for x in got} == loop(frame[["start_bar", "end_bar", "depth"]].itertuples(index=False, name=None), n + 50)


@pytest.mark.parametrize("rising", [True, False])
def test_a_chain_that_hangs_on_its_last_row(spark, rising):
    n = 600
    a = np.arange(n) * 3
    frame = pd.DataFrame({"symbol": "a", "direction": "long", "start_bar": a, "end_bar": a + 3, "depth": np.arange(n) * (1.0 if rising else -1.0)})
    rows = best_first(spark.createDataFrame(frame, SPANS), ["symbol"], "start_bar", "end_bar", [-F.col("depth")], lambda c, i, t: (c["start_bar"][t] <= c["end_bar"][i]) & (c["start_bar"][i] <= c["end_bar"][t]), block=512)
    got = {r["start_bar"] for r in rows.filter("_kept").collect()}
    assert got == set((a[::-2] if rising else a[::2]).tolist())


def test_spans_odd_rows(spark):
    rows = [("a", "long", 0, 5, 1.0), ("a", "long", 0, 5, 1.0), ("a", "long", 5, 9, 1.0), ("a", "long", 6, 9, None), ("a", "long", None, 9, 2.0), ("a", "short", 0, 5, 0.1), ("b", "long", 0, 9000, 0.1), ("b", "long", 4000, 4000, 0.2)]
    got = ev.suppress_overlaps(spark.createDataFrame(rows, SPANS)).collect()
    assert sorted((r["symbol"], r["direction"], r["start_bar"]) for r in got) == [("a", "long", 0), ("a", "long", 0), ("a", "short", 0), ("b", "long", 4000)]
    assert ev.suppress_overlaps(spark.createDataFrame([], SPANS)).count() == 0


def test_opposite_readings_are_the_loop(spark):
    r = np.random.default_rng(2)
    n = 3000
    a = r.integers(0, 9000, n)
    frame = pd.DataFrame({"event_id": np.arange(n), "symbol": "a", "direction": r.choice(["bullish", "bearish"], n), "start_bar": a, "end_bar": a + r.integers(1, 60, n), "rule_score": np.round(r.random(n), 2)})
    frame["neck_bar"] = [None if x % 9 == 0 else int(s + x % 30) for x, s in zip(range(n), frame["start_bar"])]
    rows = [tuple(None if v != v else int(v) if c == "neck_bar" else v for c, v in zip(frame.columns, x)) for x in frame.itertuples(index=False)]
    df = spark.createDataFrame(rows, "event_id long, symbol string, direction string, start_bar long, end_bar long, rule_score double, neck_bar long")
    kept = []
    for x in sorted(frame.itertuples(), key=lambda x: (-x.rule_score, x.event_id)):
        inside = lambda p, y: p is not None and p == p and y.start_bar <= p <= y.end_bar
        if not any(y.direction != x.direction and x.start_bar <= y.end_bar and y.start_bar <= x.end_bar and (inside(x.neck_bar, y) or inside(y.neck_bar, x)) for y in kept):
            kept.append(x)
    assert {r["event_id"] for r in pat.drop_opposite(df).collect()} == {x.event_id for x in kept}
    assert 0 < len(kept) < n
