"""First and last passages, counts, whole level states and greedy selection against plain loops, at any distance and density."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapestone.operators import events as ev
from tapestone.plans import layout, passage


def _series(spark, n, seed, symbol="a"):
    draw = np.random.default_rng(seed)
    v = np.round(draw.normal(0, 1, n).cumsum(), 1)
    return spark.createDataFrame([(symbol, i, float(x) if i % 97 else None) for i, x in enumerate(v)], "symbol string, bar long, v double"), [float(x) if i % 97 else None for i, x in enumerate(v)]


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("last", [False, True])
def test_passages_and_counts(spark, strict, last):
    bars, v = _series(spark, 9000, 1)
    other, w = _series(spark, 70, 2, "b")
    draw = random.Random(4)
    asks = [(i, s, draw.randrange(-5, len(x) + 5), draw.choice([draw.uniform(min(y for y in x if y is not None) - 1, 30), -1e9, 1e9])) for i, (s, x) in enumerate([("a", v), ("b", w)] * 150)] + [(999, "none", 0, 1.0)]
    rows = spark.createDataFrame(asks, "id long, symbol string, start long, price double")
    both = bars.unionByName(other)
    found = {r["id"]: r["at"] for r in passage.passages(rows, both, F.col("v"), F.col("price"), F.col("start"), "at", strict, last).collect()}
    counted = {r["id"]: r["n"] for r in passage.counts_from(rows, both, F.col("v"), F.col("price"), F.col("start"), "n", 0.7).collect()}
    for i, s, start, price in asks:
        x = {"a": v, "b": w}.get(s, [])
        hits = [k for k, y in enumerate(x) if y is not None and (y < price if strict else y <= price) and (k <= start if last else k >= start)]
        assert found[i] == ((hits[-1] if last else hits[0]) if hits else None)
        assert counted.get(i, 0) == sum(y is not None and y <= price and k >= start for k, y in enumerate(x))


def test_passage_far_away(spark):
    bars = spark.range(200_000).select(F.lit("a").alias("symbol"), F.col("id").alias("bar"), F.when(F.col("id") == 150_001, 1.0).otherwise(5.0).alias("v"))
    asks = spark.range(2000).select(F.lit("a").alias("symbol"), F.col("id"), (F.col("id") * 25).alias("start"), F.lit(2.0).alias("price"))
    at = passage.passages(asks, bars, F.col("v"), F.col("price"), F.col("start"), "at")
    assert at.groupBy("at").count().collect() == [(150_001, 2000)]


def test_level_states(spark):
    draw = np.random.default_rng(6)
    close = 50 + np.round(draw.normal(0, 1, 1500).cumsum(), 1)
    bars = [("a", i, float(c + 1), float(c - 1), float(c), 2.0 if i >= 14 else None) for i, c in enumerate(close)]
    levels, known = [], []
    for i in range(0, 1490, 7):
        kind, of = ("L", "H")[i % 2], ("swing", "prev_day", "equal")[i % 3]
        levels.append(("a", f"{of}_{i}", of, kind, bars[i][3 if kind == "L" else 2], i, i + 3, 2 if of == "equal" else 0))
    levels += [("a", f"{of}_far", of, "L", -1000.0, 10, 13, 2 if of == "equal" else 0) for of in ("swing", "equal")]
    frame = spark.createDataFrame(bars, "symbol string, bar long, high double, low double, close double, atr double")
    given = spark.createDataFrame(levels, "symbol string, level_id string, level_type string, kind string, price double, origin_bar long, known_bar long, n_seed int")
    got = {r["level_id"]: r for r in ev.level_states(given, frame, 0.1, 200).collect()}
    assert len(got) == len(levels)
    for _, name, of, kind, price, origin, at, seed in levels:
        tol, since = (0.1, at + 1) if of == "equal" else (0.0, at if of == "prev_day" else origin)
        touch = [b for _, b, h, lo, _, atr in bars if b >= since and atr is not None and (lo <= price + tol * atr if kind == "L" else h >= price - tol * atr)]
        sweep = [b for _, b, h, lo, _, atr in bars if b >= at and atr is not None and (lo < price - tol * atr if kind == "L" else h > price + tol * atr)]
        first = origin if of == "equal" else touch[0] if touch else None
        last = touch[-1] if touch else at if of == "equal" else None
        state = "swept" if sweep else "invalidated" if 1499 - origin > 200 else "active"
        r = got[name]
        assert (r["touch_count"], r["first_touch_bar"], r["last_touch_bar"], r["swept_bar"], r["sweep_state"], r["age_bars"]) == (len(touch) + seed, first, last, sweep[0] if sweep else None, state, 1499 - origin), name
        assert r["bars_since_last_touch"] == (None if last is None else 1499 - last) and r["invalidated_bar"] == (origin + 201 if state == "invalidated" else None)
        known.append(state)
    assert set(known) == {"swept", "invalidated", "active"}


def _greedy(bars, k):
    out, last = [], None
    for b in sorted(set(bars)):
        if last is None or b - last > k:
            out.append(b)
            last = b
    return out


@pytest.mark.parametrize("k,inclusive", [(0, False), (3, False), (3, True), (1, True), (700, False), (9000, True)])
def test_greedy_against_the_loop(spark, k, inclusive):
    draw = random.Random(k)
    rows = [("a", b) for b in range(30_000) if draw.random() < 0.9] + [("b", b) for b in sorted(draw.sample(range(200_000), 400))] + [("b", 5), ("b", 5), ("c", -7)]
    df = spark.createDataFrame([(s, b, i) for i, (s, b) in enumerate(rows)], "symbol string, bar long, row int")
    got = {}
    for r in layout.greedy_cooldown(df, k, ["symbol"], inclusive=inclusive).collect():
        got.setdefault(r["symbol"], []).append(r["bar"])
    for s in "abc":
        own = [b for t, b in rows if t == s]
        want = set(_greedy(own, max(0, k - 1) if inclusive else k))
        assert sorted(got[s]) == sorted(b for b in own if b in want)


def test_a_million_rows_in_one_island(spark):
    df = spark.range(1_000_000).select(F.lit("a").alias("symbol"), (F.col("id") + F.floor(F.col("id") / 7)).alias("bar"))
    kept = layout.greedy_cooldown(df, 5, ["symbol"])
    assert "collect_list" not in kept._jdf.queryExecution().toString()
    i = np.arange(1_000_000)
    want = _greedy((i + i // 7).tolist(), 5)
    told = kept.agg(F.count("bar").alias("n"), F.sum("bar").alias("s"), F.max("bar").alias("m")).first()
    assert tuple(told) == (len(want), sum(want), want[-1])
