"""Operators that SQL can't express, against brute force; guards, plug-ins and limits."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapestone.functions import indicators as ind
from tapestone.operators import events as ev
from tapestone.operators import features as fea
from tapestone.operators import groups as grp
from tapestone.operators import patterns as pat
from tapestone.operators import portfolio as port
from tapestone.operators import regimes, trainers
from tapestone.operators import reports as rep
from tapestone.operators.clusters import equal_levels
from tapestone.plans import layout
from tapestone.sources import bars as src
from tapestone.sources import lake


def series(spark, n=300, seed=3, symbols=("a", "b")):
    draw, rows = random.Random(seed), []
    for s in symbols:
        price = 100.0
        for i in range(n):
            o = price
            c = price = max(5.0, o + draw.gauss(0, 1))
            h, low = max(o, c) + abs(draw.gauss(0, 0.5)), min(o, c) - abs(draw.gauss(0, 0.5))
            rows.append((s, i, o, h, low, c, float(draw.randint(1, 9))))
    df = spark.createDataFrame(rows, "symbol string, bar long, open double, high double, low double, close double, volume double")
    return df.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("bar") * 3600))


# --- layouts over more than one bucket

def test_asof_carries_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(layout, "BUCKET", 8)
    left = [("a", t) for t in range(60)] + [("b", 5), ("c", 1)]
    right = [("a", t, t) for t in (3, 4, 30, 31, 50)] + [("b", 6, 6)]
    ldf, rdf = spark.createDataFrame(left, "symbol string, t long"), spark.createDataFrame(right, "symbol string, t long, v long")
    for forward in (False, True):
        got = {(r["symbol"], r["t"]): r["v"] for r in layout.asof_backward(ldf, rdf, "t", ["v"], forward=forward).collect()}
        for s, t in left:
            fits = [v for k, at, v in right if k == s and (at >= t if forward else at <= t)]
            assert got[s, t] == ((min(fits) if forward else max(fits)) if fits else None)


def test_islands_and_places_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(layout, "BUCKET", 8)
    bars = sorted(random.Random(2).sample(range(200), 70))
    df = spark.createDataFrame([("a", b) for b in bars], "symbol string, bar long")
    got = {r["bar"]: (r["island"], r["place"]) for r in layout.placed(layout.islands(df, 4, ["symbol"]), ["symbol"], ["bar"]).collect()}
    island = 0
    for i, b in enumerate(bars):
        island += i == 0 or b - bars[i - 1] > 4
        assert got[b] == (island, i)


def test_affine_scan_over_groups_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(layout, "SUPER", 3)
    bars = series(spark, 100)
    got = {(r["symbol"], r["bar"]): r["y"] for r in layout.affine_scan(bars, 0.8, "close", "y", block=4).collect()}
    last: dict = {}
    for r in bars.orderBy("symbol", "bar").collect():
        y = last[r["symbol"]] = 0.8 * last[r["symbol"]] + 0.2 * r["close"] if r["symbol"] in last else r["close"]
        assert abs(got[r["symbol"], r["bar"]] - y) < 1e-9


# --- levels and patterns

def test_equal_levels_are_the_state_machine(spark):
    bars = ind.add_atr(series(spark))
    got = {(r["symbol"], r["kind"], r["known_bar"], round(r["price"], 6), r["touch_count"]) for r in equal_levels(bars, 0.1, 2, 30).collect()}
    want, rows = set(), bars.orderBy("symbol", "bar").collect()
    for symbol in ("a", "b"):
        for kind, column in (("L", "low"), ("H", "high")):
            clusters: list[list] = []  # touches, last bar
            for r in (x for x in rows if x["symbol"] == symbol and x["atr"]):
                price, tol = r[column], 0.1 * r["atr"]
                best = None
                for c in clusters:
                    away = abs(price - (min(c[0]) + max(c[0])) / 2)
                    if away <= tol and (best is None or away < best[0]):
                        best = (away, c)
                if best is None:
                    best = (0, [[], r["bar"]])
                    clusters.append(best[1])
                best[1][0].append(price)
                best[1][1] = r["bar"]
                if len(best[1][0]) == 2:
                    want.add((symbol, kind, r["bar"], round((min(best[1][0]) + max(best[1][0])) / 2, 6), 2))
                clusters = [c for c in clusters if r["bar"] - c[1] <= 30]
    assert got == want and len(want) > 10


def test_one_reading_of_a_structure(spark):
    rows = [(1, "a", "bullish", 0, 5, 10, 0.5), (2, "a", "bearish", 4, 8, 12, 0.9), (3, "a", "bearish", 20, None, 30, 0.1), (4, "a", "bullish", 25, None, 40, 0.2), (5, "b", "bullish", 4, 8, 12, 0.1)]
    df = spark.createDataFrame(rows, "event_id long, symbol string, direction string, start_bar long, neck_bar long, end_bar long, rule_score double")
    assert {r["event_id"] for r in pat.drop_opposite(df).collect()} == {2, 3, 4, 5}


def test_detectors_say_what_they_lack(spark):
    pat.register("broken", lambda bars, p: bars)
    with pytest.raises(ValueError, match="lacks"):
        pat.detect_all(ind.add_atr(series(spark, 30)), [{"detector": "broken"}])


def test_patterns_of_a_prefix(spark):
    """What confirms by a bar is the same on a series that ends there."""
    bars = ind.add_atr(series(spark))
    loose = {"left": 2, "right": 2, "min_apart": 1, "min_depth": 0.5, "min_reward": 0.0, "max_length": 0}
    rows = lambda b: {(r["symbol"], r["start_bar"], r["end_bar"], r["confirm_bar"]) for r in pat.double_patterns(b, **loose).collect()}
    whole, prefix = rows(bars), rows(bars.filter("bar <= 200"))
    assert prefix == {r for r in whole if r[3] <= 200} and prefix


def test_neckline_stops_are_tighter(spark):
    bars = ind.add_atr(series(spark))
    loose = {"left": 2, "right": 2, "min_apart": 1, "min_depth": 0.5, "min_reward": 0.0, "max_length": 0}
    key = lambda r: (r["symbol"], r["start_bar"], r["end_bar"])
    wide = {key(r): r for r in pat.double_patterns(bars, **loose).collect()}
    for r in pat.double_patterns(bars, stop_mode="neckline", target_cap=1.0, **loose).collect():
        side = 1 if r["direction"] == "bullish" else -1
        assert side * (r["stop"] - wide[key(r)]["stop"]) >= 0 and side * (r["entry"] - r["stop"]) > 0
        assert side * (r["target"] - r["entry"]) > 0


# --- lake

def test_lake_guards(spark, tmp_path):
    rows = spark.sql("select id as event_id, 'p' as pattern, 's' as symbol, timestamp'2024-01-01' as detect_time from range(5)")
    path = str(tmp_path / "events")
    assert lake.append_events(rows, path) == 5
    for bad in (rows, rows.withColumn("detect_time", F.lit(None).cast("timestamp")), rows.unionByName(rows).withColumn("event_id", F.col("event_id") + 100)):
        with pytest.raises(lake.RejectedRows):
            lake.append_events(bad, path)
    assert lake.append_events(rows.withColumn("event_id", F.col("event_id") + 3), path, "skip") == 3
    assert spark.read.parquet(path).count() == 8
    assert lake.stored(spark, str(tmp_path / "none")) is None


def test_candles_and_exports(spark, tmp_path):
    good = '{"time": "2024-01-01T00:00:00Z", "open": 1, "high": 2, "low": 0.5, "close": %s, "volume": 3}'
    raw = spark.createDataFrame([("s", good % 1.5, 1), ("s", good % 1.75, 2), ("s", "{broken", 3), ("s", '{"time": "nonsense", "open": 1}', 4), ("s", None, 5)], "symbol string, value string, offset long")
    assert [(r["close"], r["volume"]) for r in lake.candles_to_bars(raw).collect()] == [(1.75, 3.0)]
    bars = series(spark, 5, symbols=("s",)).withColumn("tickvol", F.lit(4))
    lake.write_export(bars, str(tmp_path / "x"), comma=True)
    back = {r["ts"]: round(r["close"], 5) for r in src.read_export(spark, str(tmp_path / "x"), "s", "H1").collect()}
    assert back == {r["ts"]: round(r["close"], 5) for r in bars.collect()}


def test_bars_without_their_tick_raise(spark):
    bars = series(spark, 3, symbols=("s",))
    probe = bars.select("symbol", (F.col("ts") + F.expr("interval 1 minute")).alias("ts"))
    assert ev.bar_at(probe, bars, strict=False).count() == 0
    with pytest.raises(Exception, match="no bar at"):
        ev.bar_at(probe, bars).collect()


# --- groups, portfolio and reports

def test_capped_replay_is_the_loop(spark):
    draw = random.Random(4)
    trades = [(i, draw.choice("ab"), draw.choice(["long", "short"]), draw.randint(0, 60), draw.uniform(95, 105), draw.choice([0.5, 1.0]), 2.0) for i in range(80)]
    rows = [(*t[:4], t[3] + draw.randint(1, 12), *t[4:]) for t in trades]
    df = spark.createDataFrame(rows, "event_id long, symbol string, direction string, entry_bar long, exit_bar long, entry double, risk_fraction double, atr double")
    got = {r["event_id"]: (r["executed"], r["cap_reason"]) for r in port.capped_replay(df, 2.0, 1.0).collect()}
    for s in "ab":
        taken: list = []
        for i, _, side, a, z, p, r, w in sorted((x for x in rows if x[1] == s), key=lambda x: (x[3], x[0])):
            still = [t for t in taken if t[0] > a]
            why = "max_total_risk" if r + sum(t[3] for t in still) > 2.0 else "max_direction_cluster" if r + sum(t[3] for t in still if t[1] == side and abs(t[2] - p) <= w) > 1.0 else None
            assert got[i] == (why is None, why)
            if why is None:
                taken.append((z, side, p, r))
    assert {w for _, w in got.values()} == {None, "max_total_risk", "max_direction_cluster"}


def test_group_modes(spark):
    df = spark.createDataFrame([(i, "a", "long", 3 * i, 100.0, 1.0) for i in range(4)], "event_id long, symbol string, direction string, bar long, close double, atr double")
    assert grp.resolved_groups(df, "independent", F.col("bar")).filter("group_id <> event_id or discard_reason is not null").count() == 0
    assert grp.resolved_groups(df, "dedup", F.col("bar")).filter("discard_reason is null").count() == 1
    assert grp.resolved_groups(df, "confluence", F.col("bar")).first()["n"] == 4
    with pytest.raises(ValueError):
        grp.resolved_groups(df, "other", F.col("bar"))


def test_bootstraps_against_plain_resampling(spark):
    x = np.array([1.0, -1.0, 2.0, 0.5, -0.5, 1.5, -1.0, 0.7, -0.3, 1.1] * 6)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "symbol string, i long, result_r double")
    draw = np.random.default_rng(0)
    picks = x[draw.integers(0, len(x), (4000, len(x)))]
    pf = np.where(picks > 0, picks, 0).sum(1) / np.abs(np.where(picks < 0, picks, 0).sum(1))
    assert abs(rep.bootstrap_pf(df, ["symbol"], "i").first()["pf_low"] - np.percentile(pf, 5)) < 0.12
    starts = draw.integers(0, len(x) - 15 + 1, (4000, 4))
    blocks = np.concatenate([x[s : s + 15] for row in starts for s in row]).reshape(4000, 60)
    pf = np.where(blocks > 0, blocks, 0).sum(1) / np.abs(np.where(blocks < 0, blocks, 0).sum(1))
    row = rep.block_bootstrap_pf(df, ["symbol"], ["i"]).first()
    assert abs(row["pf_low"] - np.percentile(pf, 5)) < 0.15 and abs(row["pf_high"] - np.percentile(pf, 95)) < 0.3
    assert rep.kill_switch(df.withColumn("result_r", F.when(F.col("i") % 4 == 0, 0.1).otherwise(-1.0)), ["symbol"], ["i"]).first()["stop"] is True


# --- regimes

def test_em_round_is_the_textbook(spark):
    draw = np.random.default_rng(1)
    x = np.where(np.arange(90) // 30 % 2 == 0, -1.0, 1.0) + draw.normal(0, 0.4, 90)
    df = spark.createDataFrame([("s", i, float(v) if i != 7 else None) for i, v in enumerate(x)], "symbol string, bar long, x double")
    params = regimes.initial_parameters(df, ["x"], 2)
    p = params.first()
    z = np.delete((x - p["shift"][0]) / p["scale"][0], 7)
    start, trans, mu, var = np.array(p["start"]), np.array(p["trans"]).reshape(2, 2), np.array(p["means"]), np.array(p["vars"])
    dens = np.exp(-0.5 * (z[:, None] - mu) ** 2 / var) / np.sqrt(2 * np.pi * var)
    alpha, beta = np.zeros((89, 2)), np.ones((89, 2))
    alpha[0] = start * dens[0]
    for t in range(1, 89):
        alpha[t] = alpha[t - 1] @ trans * dens[t]
    for t in range(87, -1, -1):
        beta[t] = trans @ (dens[t + 1] * beta[t + 1])
    like = alpha[-1].sum()
    gamma = alpha * beta / like
    xi = sum(alpha[t][:, None] * trans * dens[t + 1] * beta[t + 1] / like for t in range(88))
    got = regimes.expectation(regimes._blocked(df, ["x"], 16), params).first()
    want = np.concatenate([gamma[0], xi.ravel(), gamma.sum(0), gamma.T @ z, gamma.T @ z**2])
    assert np.allclose(got["v"], want, atol=1e-8) and abs(got["loglik"] - np.log(like)) < 1e-8
    fitted = regimes.ordered_by_drift(regimes.fit_regimes(df, ["x"], 2, 20, least_rows=10, block=16))
    states = {r["bar"]: r["state"] for r in regimes.regime_states(df, ["x"], fitted, 2, least_bars=10, block=16).collect()}
    assert np.mean([states[i] == (i // 30 % 2) for i in range(90)]) > 0.9 and states[7] == states[6]
    early = {r["bar"]: r["state"] for r in regimes.regime_states(df.filter("bar < 50"), ["x"], fitted, 2, least_bars=10, block=16).collect()}
    assert early == {b: s for b, s in states.items() if b < 50}


def test_degenerate_regimes_raise(spark):
    df = spark.createDataFrame([("s", i, float(i % 5)) for i in range(60)], "symbol string, bar long, x double")
    params = regimes.initial_parameters(df, ["x"], 2).withColumn("vars", F.array(F.lit(0.0), F.lit(1.0)))
    with pytest.raises(Exception, match="degenerate"):
        regimes.ordered_by_drift(params).collect()


# --- features and scorers

def test_features_of_a_prefix(spark):
    bars = ind.add_percentile(ind.add_sweep_inputs(series(spark)), "close", 50)
    sessions = {"asia": (0, 8), "london": (8, 16), "new_york": (13, 21)}

    def rows(b, last):
        events = ev.sweep_rows(ev.sweep_flags(b)).withColumn("anchor_bar", F.col("bar"))
        done = fea.all_confirmations(events, b, ev.swings(b), 8, 0.3, 0.4, 0.8).filter(f"confirm_bar <= {last}")
        levels = ev.level_table({"swing": ev.swings(b), "prev_day": ev.previous_day_levels(b)})
        return {tuple(r) for r in fea.sweep_features(done, b, levels, fea.coarse_context(b, ("4 hours", "12 hours"), 10), sessions).collect()}

    whole, prefix = rows(bars, 150), rows(bars.filter("bar <= 150"), 150)
    assert whole == prefix and whole


def test_unknown_inputs_raise(spark):
    with pytest.raises(ValueError, match="nothing"):
        fea.trend_inputs(ind.add_atr(series(spark, 30)), ["nothing"])


def test_scorers(spark):
    draw = random.Random(0)
    rows = [(i, draw.gauss(0, 1), draw.gauss(0, 1)) for i in range(300)]
    df = spark.createDataFrame([(i, a, None if i % 50 == 0 else b, int(a + 0.3 * b > 0), a if a > 0 else -1.0) for i, a, b in rows], "event_id long, a double, b double, label int, rule_score double")
    split = grp.time_split(df.withColumn("one", F.lit(1)), ["event_id"], keys=("one",))
    best, model, found = trainers.best_candidate(split, ["a", "b"])
    assert found[best] == max(found.values()) > 0.9
    calibrated = trainers.calibrated(model, split)
    assert calibrated.count() == 60 and calibrated.filter("calibrated not between 0 and 1").count() == 0
    scored = trainers.probabilities(df.select("event_id"), df.filter("event_id < 250"), ["a", "b"], trainers.fit(df, ["a", "b"]))
    assert scored.filter("model_prob is null").count() == 50
    odd = trainers.probabilities(df.select("event_id"), df, ["a"], lambda x: x[0] + 0.5)
    assert odd.filter("model_prob < 0 or model_prob > 1").count() == 0 and odd.filter("model_prob is null").count() > 0
    value, base, by = trainers.gate_pr_auc(split.filter("split = 'train'"), split.filter("split = 'test'"), ["a", "b"])
    assert by == "logistic" and value > base
    assert trainers.gate_pr_auc(split.filter("event_id < 10"), split.filter("split = 'test'"), ["a"])[2] == "rule_score"
    assert trainers.gate_pr_auc(split, split.filter("label = 1"), ["a"])[2] == "none"
