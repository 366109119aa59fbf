"""Equal-price levels by blocks against one pass over the whole series."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from tapestone.operators.clusters import equal_levels

SCHEMA = "symbol string, bar long, low double, high double, atr double"


def one_pass(bars, tolerance, min_touches, max_age):
    out = set()
    for (symbol,), own in bars.groupby(["symbol"]):
        for kind, column in (("L", "low"), ("H", "high")):
            clusters = []  # touches, bars
            for r in own.sort_values("bar").itertuples():
                price = getattr(r, column)
                if pd.isna(price) or pd.isna(r.atr) or r.atr <= 0:
                    continue
                near = [(abs(price - (min(t) + max(t)) / 2), i) for i, (t, _) in enumerate(clusters)]
                near = [x for x in near if x[0] <= tolerance * r.atr]
                if near:
                    touches, at = clusters[min(near)[1]]
                else:
                    touches, at = [], []
                    clusters.append((touches, at))
                touches.append(price)
                at.append(r.bar)
                if len(touches) == min_touches:
                    out.add((symbol, kind, at[0], r.bar, (min(touches) + max(touches)) / 2, min(touches), max(touches), min_touches))
                clusters = [c for c in clusters if r.bar - c[1][-1] <= max_age]
    return out


def found(spark, bars, tolerance, min_touches, max_age, block):
    rows = equal_levels(spark.createDataFrame(bars, SCHEMA), tolerance, min_touches, max_age, block).collect()
    out = [(r["symbol"], r["kind"], r["origin_bar"], r["known_bar"], r["price"], r["price_min"], r["price_max"], r["touch_count"]) for r in rows]
    assert len(out) == len(set(out)) and all(r["level_id"] == f"equal_{r['kind']}_{r['origin_bar']}" for r in rows)
    return set(out)


def frame(symbol, price, bars=None):
    bars = np.arange(len(price)) if bars is None else bars
    return pd.DataFrame({"symbol": symbol, "bar": bars, "low": price, "high": price[::-1], "atr": 1.0})


def drift(n):
    """A cluster that never dies, whose middle creeps with every touch, beside prices that tell its exact place."""
    price = np.cumsum(np.full(n, 0.004)) + 0.09 * np.sin(np.arange(n) * 2.1)
    price[::7] = 0.1 * np.round(price[::7] * 10) + 0.1
    return price


@pytest.mark.parametrize("touches,age", [(2, 30), (3, 9), (1, 30), (2, 100000)])
def test_blocks_are_one_pass(spark, touches, age):
    r = np.random.default_rng(touches)
    gaps = np.sort(r.choice(3000, 700, replace=False))  # blocks without a bar, and bars far apart
    bars = pd.concat([
        frame("walk", np.cumsum(r.normal(0, 0.3, 900))), frame("ties", r.integers(0, 9, 900) * 0.2), frame("flat", np.full(500, 5.0)), frame("drift", drift(900)),
        frame("gaps", np.round(r.normal(0, 1, 700), 1), gaps), frame("one", np.array([1.0])),
    ])
    bars.loc[bars["bar"] % 41 == 0, "atr"] = np.nan
    bars.loc[bars["bar"] % 53 == 0, "low"] = np.nan
    want = one_pass(bars, 0.1, touches, age)
    assert len(want) > 100
    assert found(spark, bars, 0.1, touches, age, 64) == want
    assert found(spark, bars, 0.1, touches, age, 4096) == want


def test_an_empty_table_has_no_levels(spark):
    assert equal_levels(spark.createDataFrame([], SCHEMA)).count() == 0
