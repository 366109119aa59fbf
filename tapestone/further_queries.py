"""Further registered queries: projections, coarse levels, entries, grids, gates, folds, life cycles and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import indicators as ind
from .functions import projections as pro
from .operators import events as ev
from .operators import groups as grp
from .operators import outcomes as out
from .operators import reports as rep
from .queries import BARS, PF, RES, SCORED, SWEPT, TRADES, ATR, _full, _numbered, _outcomes, _reversal_sql, _swing_sql, bars_of, cooled_of, outcomes_of, query, results_of, rolled_of, scored_of
from .sources import bars as src

ID = ["symbol", "direction", "entry_bar"]
ORDER = ["entry_bar", "direction"]


# --- projections, filters and set operations

@query("prj1_directions", f"WITH {BARS}{_swing_sql(True)} SELECT symbol, bar, CASE kind WHEN 'L' THEN 'long' ELSE 'short' END AS direction FROM swings")
def _(s, d):
    word = F.when(F.col("kind") == "L", " Low").otherwise("SELL")
    return ev.swings(bars_of(s, d)).select("symbol", "bar", pro.normal_direction(word).alias("direction"))


@query("prj2_combined_score", f"{SCORED} SELECT lang, label, round(score, 6) AS score, round((least(1.0, CASE WHEN score * 60 > 1 THEN score * 60 / 100 ELSE score * 60 END) + score) / 2, 4) AS combined FROM z")
def _(s, d):
    return scored_of(s, d).withColumn("combined", pro.combined_score(F.col("score") * 60, F.col("score")))


@query("prj4_lots", f"{RES} SELECT symbol, direction, entry_bar, round(least(greatest(floor(10000.0 * 0.01 / (risk * 10) / 0.01) * 0.01, 0.01), 5.0), 6) AS lots FROM res")
def _(s, d):
    lots = pro.lot_size(F.lit(10000.0), 1.0, F.col("risk"), 10.0, 0.01, 0.01, 5.0)
    return results_of(s, d).select(*ID, lots.alias("lots"))


@query("prj6_outcome_codes", f"WITH RECURSIVE {BARS}{_outcomes('labels')} SELECT symbol, direction, entry_bar, CASE exit_reason WHEN 'tp' THEN 1.0 WHEN 'sl' THEN 0.0 WHEN 'time' THEN -1.0 END AS code FROM outcomes")
def _(s, d):
    return outcomes_of(s, d).select(*ID, pro.outcome_code(F.col("exit_reason")).alias("code"))


@query("flt7_last_actions", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def _(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", "ts")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc()))
    return e.withColumn("n", n).filter("n <= 5").select("user_id", "event_id")


@query("flt12_unavailable_features", "SELECT l_orderkey, l_linenumber, feature FROM (SELECT l_orderkey, l_linenumber, unnest([CASE WHEN coalesce(o_orderdate > o_orderdate + INTERVAL '60 days', true) THEN 'order' END, CASE WHEN coalesce(l_shipdate > o_orderdate + INTERVAL '60 days', true) THEN 'ship' END]) AS feature FROM lineitem JOIN orders ON o_orderkey = l_orderkey) WHERE feature IS NOT NULL")
def _(s, d):
    lines = s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_shipdate")
    orders = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", F.expr("o_orderdate + interval 60 days").alias("known_at"))
    return rep.unavailable(lines.join(orders, "l_orderkey"), {"order": "o_orderdate", "ship": "l_shipdate"}).select("l_orderkey", "l_linenumber", "feature")


@query("flt14_without_outcomes", f"{RES} SELECT symbol, direction, entry_bar, round(entry, 6) AS entry, round(risk, 6) AS risk FROM res")
def _(s, d):
    rows = results_of(s, d).select(*ID, "entry", "risk", "exit_reason", "exit_bar", "result_r", "mfe_r", "mae_r")
    return rep.without_outcomes(rows, ["result_r", "mfe_r", "mae_r"], ["exit_"])


@query("flt15_similar_scores", f"{SCORED} SELECT lang, label, round(score, 6) AS score FROM z WHERE abs(score - 0.1) <= 0.05")
def _(s, d):
    return scored_of(s, d).filter(F.abs(F.col("score") - 0.1) <= 0.05)


@query("set1_all_events", f"WITH {BARS}{SWEPT}{_swing_sql(True)} SELECT symbol, bar, direction, NULL AS kind FROM sweeps UNION ALL SELECT symbol, bar, NULL, kind FROM swings")
def _(s, d):
    sweeps = ev.sweep_rows(ev.sweep_flags(rolled_of(s, d))).select("symbol", "bar", "direction")
    return sweeps.unionByName(ev.swings(bars_of(s, d)).select("symbol", "bar", "kind"), allowMissingColumns=True)


@query("set2_last_duplicate", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def _(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    return e.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("set3_pending_orders", "SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def _(s, d):
    orders = s.read.parquet(f"{d}/orders.parquet").select("o_orderkey").distinct()
    done = s.read.parquet(f"{d}/lineitem.parquet").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return orders.join(done, "o_orderkey", "left_anti")


# --- indicators

@query("ind17_confirm_context", f"""WITH {BARS}{ATR}, c AS (SELECT *, count(volume) OVER b AS n, avg(volume) OVER b AS m, stddev_pop(volume) OVER b AS sd, count(atr) OVER l AS na, avg(atr) OVER l AS ma, min(low) OVER u AS lo, max(high) OVER u AS hi, avg(volume) OVER u AS mv, lag(close, 24) OVER w AS c24 FROM atr
 WINDOW w AS (PARTITION BY symbol ORDER BY bar), b AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), u AS (PARTITION BY symbol ORDER BY bar ROWS 24 PRECEDING), l AS (PARTITION BY symbol ORDER BY bar ROWS 200 PRECEDING))
SELECT symbol, bar, round(CASE WHEN n >= 5 AND sd > 0 THEN (volume - m) / sd ELSE 0 END, 6) AS volume_z, round(CASE WHEN bar >= 15 AND atr > 0 AND na >= 15 THEN atr / ma ELSE 1 END, 6) AS atr_ratio, round(coalesce(CASE WHEN atr > 0 THEN (close - c24) / atr ELSE 0 END, 0), 6) AS momentum,
 round(CASE WHEN atr > 0 THEN (hi - lo) / atr ELSE 0 END, 6) AS span, round(CASE WHEN hi > lo THEN (close - lo) / (hi - lo) ELSE 0.5 END, 6) AS place, round(CASE WHEN mv > 0 THEN volume / mv ELSE 1 END, 6) AS volume_ratio FROM c""")
def _(s, d):
    return ind.add_confirm_context(ind.add_atr(bars_of(s, d))).select("symbol", "bar", "volume_z", "atr_ratio", "momentum", "span", "place", "volume_ratio")


@query("tb7_trainer_sessions", f"WITH {BARS} SELECT symbol, bar, hour(ts) < 8 AS in_asia, hour(ts) BETWEEN 8 AND 15 AS in_london, hour(ts) BETWEEN 13 AND 20 AS in_ny FROM bars")
def _(s, d):
    return ind.add_sessions(bars_of(s, d), {"asia": (0, 8), "london": (8, 16), "ny": (13, 21)}).select("symbol", "bar", "in_asia", "in_london", "in_ny")


@query("fea8_medians", f"{RES}, h8 AS (SELECT symbol, direction, entry_bar, CASE WHEN entry_bar % 3 > 0 THEN mae_r END AS v FROM res), t AS (SELECT symbol, median(v) AS m FROM h8 WHERE entry_bar < 300 GROUP BY 1) SELECT h8.symbol, direction, entry_bar, round(coalesce(v, m), 6) AS mae_r FROM h8 LEFT JOIN t ON t.symbol = h8.symbol")
def _(s, d):
    rows = results_of(s, d).select(*ID, F.when(F.col("entry_bar") % 3 > 0, F.col("mae_r")).alias("mae_r"))
    return rep.fill_medians(rows, ["mae_r"], F.col("entry_bar") < 300, ["symbol"])


@query("fea9_standardised", f"{RES}, t AS (SELECT symbol, avg(mae_r) AS m, stddev_pop(mae_r) AS sd FROM res WHERE entry_bar < 300 GROUP BY 1) SELECT r.symbol, direction, entry_bar, round((mae_r - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 6) AS mae_r FROM res r LEFT JOIN t ON t.symbol = r.symbol")
def _(s, d):
    return rep.standardised(results_of(s, d).select(*ID, "mae_r"), ["mae_r"], F.col("entry_bar") < 300, ["symbol"])


# --- levels, sweeps and entries

COARSE = """, h4 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar FROM (SELECT symbol, time_bucket(INTERVAL '4 hours', ts) AS ts, max(high) AS high, min(low) AS low FROM bars GROUP BY 1, 2)),
cs AS (SELECT *, lead(ts, 2) OVER w + INTERVAL '4 hours' AS kts, low < min(low) OVER p AND low < min(low) OVER n AND count(*) OVER a = 5 AS l, high > max(high) OVER p AND high > max(high) OVER n AND count(*) OVER a = 5 AS h FROM h4
 WINDOW w AS (PARTITION BY symbol ORDER BY bar), p AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), n AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), a AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
csw AS (SELECT symbol, kts, bar AS coarse_bar, 'L' AS kind, low AS price FROM cs WHERE l UNION ALL SELECT symbol, kts, bar, 'H', high FROM cs WHERE h)"""


@query("lvl3_coarse_swings", f"WITH {BARS}{COARSE} SELECT c.symbol, coarse_bar, kind, round(price, 6) AS price, b.bar AS known_bar FROM csw c ASOF JOIN bars b ON b.symbol = c.symbol AND c.kts <= b.ts")
def _(s, d):
    bars = bars_of(s, d)
    return ev.coarse_swings(src.resample_bars(bars, "4 hours"), bars)


LIFE = f"""{_swing_sql(True)}, life AS (SELECT s.symbol, s.bar AS origin_bar, s.kind, s.price, s.known_bar, min(b.bar) FILTER (WHERE CASE s.kind WHEN 'L' THEN b.low < price AND b.close > price ELSE b.high > price AND b.close < price END) AS swept_bar,
 min(b.bar) FILTER (WHERE CASE s.kind WHEN 'L' THEN b.close < price ELSE b.close > price END) AS broken_bar FROM swings s JOIN bars b ON b.symbol = s.symbol AND b.bar BETWEEN s.known_bar + 1 AND s.known_bar + 96 GROUP BY ALL)"""


@query("lvl8_states_at_bars", f"WITH {BARS}{LIFE} SELECT l.symbol, origin_bar, kind, p.bar, CASE WHEN swept_bar <= p.bar THEN 'swept' WHEN broken_bar <= p.bar THEN 'invalidated' ELSE 'active' END AS status, p.bar - known_bar AS age FROM life l JOIN bars p ON p.symbol = l.symbol AND p.bar BETWEEN known_bar + 1 AND known_bar + 96")
def _(s, d):
    bars = bars_of(s, d)
    life = ev.level_lifecycle(ev.swings(bars), bars, 96, 0.5)
    return ev.states_at(life, bars, 96)


@query("lvl10_level_sweeps", f"""WITH {BARS}{ATR}{LIFE}, r AS (SELECT l.symbol, origin_bar, kind, swept_bar, CASE kind WHEN 'L' THEN price - low ELSE high - price END / nullif(atr, 0) AS depth, CASE kind WHEN 'L' THEN least(open, close) - low ELSE high - greatest(open, close) END / nullif(high - low, 0) AS wick,
 CASE kind WHEN 'L' THEN close - price ELSE price - close END / nullif(atr, 0) AS reclaim FROM life l JOIN atr a ON a.symbol = l.symbol AND a.bar = l.swept_bar)
SELECT symbol, origin_bar, kind, swept_bar, round(depth, 6) AS depth, round(wick, 6) AS wick, round(reclaim, 6) AS reclaim, coalesce(depth BETWEEN 0 AND 3 AND wick >= 0.3 AND reclaim > 0, false) AS passes FROM r""")
def _(s, d):
    bars = bars_of(s, d)
    return ev.level_sweeps(ev.level_lifecycle(ev.swings(bars), bars, 96, 0.5), ind.add_atr(bars))


@query("det8_run_anchors", f"""WITH {BARS}{SWEPT}, n AS (SELECT *, CASE WHEN bar - lag(bar) OVER (PARTITION BY symbol, direction ORDER BY bar) <= 1 THEN 0 ELSE 1 END AS fresh FROM sweeps), g AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol, direction ORDER BY bar) AS run FROM n)
SELECT symbol, direction, bar, min(bar) OVER w AS anchor_bar, round(CASE direction WHEN 'long' THEN min(low) OVER w ELSE max(high) OVER w END, 6) AS extreme FROM g WINDOW w AS (PARTITION BY symbol, direction, run ORDER BY bar)""")
def _(s, d):
    return ev.run_anchors(ev.sweep_rows(ev.sweep_flags(rolled_of(s, d)))).select("symbol", "direction", "bar", "anchor_bar", "extreme")


@query("det11_entries", f"WITH RECURSIVE {BARS}{TRADES} SELECT c.symbol, c.direction, c.bar, b.bar AS entry_bar, round(b.open + CASE c.direction WHEN 'long' THEN 0.02 ELSE -0.02 END, 6) AS entry FROM cooled c JOIN bars b ON b.symbol = c.symbol AND b.bar = c.bar + 1")
def _(s, d):
    return ev.entry_schedule(cooled_of(s, d), bars_of(s, d), cost=0.02).select("symbol", "direction", "bar", "entry_bar", "entry")


@query("det17_confirm_cooldown", f"""WITH RECURSIVE {BARS}{_reversal_sql(3)}, b17 AS (SELECT * FROM patterns QUALIFY row_number() OVER (PARTITION BY symbol, direction, confirm_bar ORDER BY depth DESC, start_bar, end_bar) = 1), o17 AS (SELECT *, row_number() OVER (PARTITION BY symbol, direction ORDER BY confirm_bar) AS n FROM b17),
g17 AS (SELECT symbol, direction, n, confirm_bar AS last, true AS taken FROM o17 WHERE n = 1 UNION ALL SELECT o.symbol, o.direction, o.n, CASE WHEN o.confirm_bar - g.last >= 10 THEN o.confirm_bar ELSE g.last END, o.confirm_bar - g.last >= 10 FROM g17 g JOIN o17 o ON o.symbol = g.symbol AND o.direction = g.direction AND o.n = g.n + 1)
SELECT o.symbol, o.direction, start_bar, end_bar, confirm_bar FROM o17 o JOIN g17 g ON g.symbol = o.symbol AND g.direction = o.direction AND g.n = o.n WHERE taken""")
def _(s, d):
    bars = bars_of(s, d)
    return ev.confirm_cooldown(ev.reversals(ev.swings(bars, strict=False), bars, 3, 0.3), 10).select("symbol", "direction", "start_bar", "end_bar", "confirm_bar")


# --- outcomes

REWARDS, HORIZONS = [1.0, 1.5, 2.0], [8, 16]


def _grid_sql(h: int) -> str:
    spread = ", t0 AS (SELECT * FROM trades), g0 AS (SELECT * EXCLUDE (target), entry + CASE direction WHEN 'long' THEN 1 ELSE -1 END * reward * risk AS target FROM t0, (SELECT unnest([1.0, 1.5, 2.0]) AS reward))"
    tail = _outcomes("fixed", h)[len(TRADES):].replace("FROM trades t", "FROM g0 t")
    return f"SELECT symbol, direction, entry_bar, round(abs(target - entry) / risk, 6) AS reward, {h} AS horizon, exit_reason, round(result_r, 6) AS result_r FROM (WITH RECURSIVE {BARS}{TRADES}{spread}{tail} SELECT * FROM outcomes)"


GRID = " UNION ALL ".join(_grid_sql(h) for h in HORIZONS)


@query("out5_outcome_grid", GRID)
def _(s, d):
    grid = out.outcome_grid(out.trade_levels(cooled_of(s, d)), bars_of(s, d), REWARDS, HORIZONS)
    return grid.select(*ID, "reward", "horizon", "exit_reason", "result_r")


@query("out4_outcome_table", f"SELECT symbol, direction, entry_bar, {', '.join(f'max(result_r) FILTER (WHERE reward = {r} AND horizon = {h}) AS result_r_{r:g}_{h}'.replace(f'_{r:g}_', '_' + f'{r:g}'.replace('.', 'p') + '_') for r in REWARDS for h in HORIZONS)} FROM ({GRID}) GROUP BY 1, 2, 3")
def _(s, d):
    grid = out.outcome_grid(out.trade_levels(cooled_of(s, d)), bars_of(s, d), REWARDS, HORIZONS)
    return out.grid_table(grid, REWARDS, HORIZONS)


@query("out11_entry_strategies")
def _(s, d):
    bars = bars_of(s, d)
    sweeps = ev.confirmations(cooled_of(s, d), bars)
    parts = []
    for name, at in (("after_sweep", "bar"), ("after_confirmation", "confirm_bar")):
        entered = ev.entry_schedule(sweeps.filter(f"{at} is not null"), bars, at, 0.02)
        stop = F.when(F.col("direction") == "long", F.col("low") - 0.1 * F.col("atr")).otherwise(F.col("high") + 0.1 * F.col("atr"))
        sign = F.when(F.col("direction") == "long", 1.0).otherwise(-1.0)
        trades = entered.withColumn("stop", stop).withColumn("risk", sign * (F.col("entry") - F.col("stop"))).filter("risk > 0").withColumn("target", F.col("entry") + sign * 1.5 * F.col("risk"))
        parts.append(out.barrier_outcomes(trades, bars, 16, "stored").withColumn("strategy", F.lit(name)))
    return rep.result_metrics(parts[0].unionByName(parts[1]), ["symbol", "strategy"])


# --- gates, folds and groups

@query("gat3_entry_drift", f"{RES}, c AS (SELECT symbol, arg_max(close, bar) AS last_close FROM bars GROUP BY 1) SELECT r.symbol, direction, entry_bar, NOT coalesce(abs(last_close - entry) > 2 * risk, false) AS fresh FROM res r JOIN c ON c.symbol = r.symbol")
def _(s, d):
    latest = bars_of(s, d).groupBy("symbol").agg(F.max_by("close", "bar").alias("last_close"))
    return grp.drift_gate(results_of(s, d).withColumn("atr", F.col("risk")), latest, 2.0).select(*ID, "fresh")


@query("gat4_regime_required", f"{RES} SELECT symbol, direction, entry_bar, CASE WHEN direction = 'long' AND NOT coalesce(mfe_r > 0.5, false) THEN 'hmm_unavailable' END AS discard_reason FROM res")
def _(s, d):
    return grp.regime_required(results_of(s, d), F.col("direction") == "long", F.coalesce(F.col("mfe_r") > 0.5, F.lit(False))).select(*ID, "discard_reason")


@query("gat5_measurement_gates", f"WITH {BARS}{_reversal_sql(3)} SELECT symbol, direction, start_bar, end_bar, end_bar - start_bar <= 6 AS len_ok, coalesce(depth, 0) >= 20 AS rule_ok, true AS prob_ok FROM patterns")
def _(s, d):
    bars = bars_of(s, d)
    found = ev.reversals(ev.swings(bars, strict=False), bars, 3, 0.3).withColumn("rule_score", F.col("depth"))
    return grp.measurement_gates(found, 6, 20.0).select("symbol", "direction", "start_bar", "end_bar", "len_ok", "rule_ok", "prob_ok")


@query("mod3_bar_split", f"""{RES}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY entry_bar, direction) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM res), o3 AS (SELECT *, k > n - greatest(1, CAST(round_even(n * 0.4, 0) AS BIGINT)) AS oos FROM n)
SELECT symbol, direction, entry_bar, CASE WHEN oos THEN 'oos' WHEN entry_bar + 16 + 8 + 4 <= min(entry_bar) FILTER (WHERE oos) OVER (PARTITION BY symbol) THEN 'train' ELSE 'dropped' END AS role FROM o3""")
def _(s, d):
    return grp.bar_split(results_of(s, d), 0.4, 16, 8, 4, ORDER).select(*ID, "role")


@query("mod4_step_folds", f"""{RES}, n AS (SELECT symbol, direction, entry_bar, row_number() OVER (PARTITION BY symbol ORDER BY entry_bar, direction) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n FROM res),
f AS (SELECT n.*, fold, 6 + fold * 3 AS e FROM n, (SELECT unnest(range(0, 100000)) AS fold) WHERE 6 + fold * 3 + 1 + 4 <= n), r AS (SELECT *, CASE WHEN k < e AND k + 2 < e + 1 AND k < e THEN 'train' WHEN k >= e + 1 AND k < e + 5 THEN 'test' END AS role FROM f) SELECT symbol, direction, entry_bar, fold, role FROM r WHERE role IS NOT NULL""")
def _(s, d):
    return grp.step_folds(results_of(s, d), 6, 3, 4, 2, 1, ORDER).select(*ID, "fold", "role")


@query("grp3_confluence")
def _(s, d):
    grouped = grp.correlated_groups(_numbered(s, d), 12, 2.0)
    return grp.confluence(grouped, F.col("depth"))


@query("agg9_confluence_buckets", f"{RES}, g AS (SELECT symbol, entry_bar // 24 AS cell, least(count(*), 4) AS n_patterns, min((entry_bar, direction)) AS rep FROM res GROUP BY 1, 2), t AS (SELECT n_patterns, r.mae_r <= 2 AS ok, x FROM g JOIN res r ON r.symbol = g.symbol AND (r.entry_bar, r.direction) = rep), u AS (SELECT n_patterns, CASE WHEN ok THEN x END AS x FROM t) SELECT n_patterns, count(*) AS groups, count(x) AS trades, round(avg(x), 4) AS expectancy_r, CASE WHEN count(x) > 0 THEN round({PF}, 4) END AS pf FROM u GROUP BY 1")
def _(s, d):
    first = F.min_by(F.struct("result_r", "mae_r"), F.struct("entry_bar", "direction")).alias("f")
    groups = results_of(s, d).groupBy("symbol", F.floor(F.col("entry_bar") / 24).alias("cell")).agg(F.least(F.count(F.lit(1)), F.lit(4)).alias("n_patterns"), first)
    return rep.confluence_buckets(groups.select("n_patterns", F.col("f.result_r").alias("net_r"), (F.col("f.mae_r") <= 2).alias("executed")))


SWEEP_GRID = [(b, r2) for b in (10, 20) for r2 in (0.1, 0.3)]
OOS_START = "2024-01-22 00:00:00"
AGG16 = " UNION ALL ".join(f"SELECT direction, {b} AS lookback, {r2} AS min_r2, count(*) FILTER (WHERE ok) AS kept, count(*) AS n, round(100.0 * count(*) FILTER (WHERE ok) / count(*), 1) AS kept_pct, count(*) FILTER (WHERE late) AS n_oos, count(*) FILTER (WHERE ok AND late) AS kept_oos, count(*) FILTER (WHERE ok AND late) >= 100 AS oos_ok FROM (SELECT direction, ts >= TIMESTAMP '{OOS_START}' AS late, coalesce(r2_{b} >= {r2} AND sign(sl_{b}) = CASE direction WHEN 'long' THEN 1 ELSE -1 END, false) AS ok FROM j) GROUP BY 1" for b, r2 in SWEEP_GRID)


@query("agg16_trend_parameters", f"WITH {BARS}{SWEPT}, c AS (SELECT symbol, bar, {', '.join(f'''{_full('regr_slope(close, CAST(bar AS DOUBLE)) @', -b, -1)} AS sl_{b}, {_full('regr_r2(close, CAST(bar AS DOUBLE)) @', -b, -1)} AS r2_{b}''' for b in (10, 20))} FROM bars), j AS (SELECT s.direction, s.ts, c.* FROM sweeps s JOIN c ON c.symbol = s.symbol AND c.bar = s.bar) {AGG16}")
def _(s, d):
    return rep.trend_parameters(ev.sweep_rows(ev.sweep_flags(rolled_of(s, d))), bars_of(s, d), SWEEP_GRID, OOS_START)


@query("agg21_balanced_sample", "WITH r AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS r FROM orders) SELECT o_orderkey, o_orderpriority, o_orderstatus, row_number() OVER (PARTITION BY o_orderpriority ORDER BY r, o_orderstatus) AS rank FROM r QUALIFY rank <= 30")
def _(s, d):
    orders = s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return grp.balanced_sample(orders, ["o_orderpriority"], "o_orderstatus", "o_orderkey", 30)


# --- statistics and life cycles

RATES = f"{RES}, w7 AS (SELECT symbol, count(*) AS n, avg(CASE WHEN x > 0 THEN 1.0 ELSE 0 END) FILTER (WHERE entry_bar < 300) AS a, avg(CASE WHEN x > 0 THEN 1.0 ELSE 0 END) FILTER (WHERE entry_bar >= 300) AS b FROM res GROUP BY 1), z7 AS (SELECT *, CASE WHEN a > 0 AND a < 1 AND b BETWEEN 0 AND 1 THEN (b - a) * 30 / sqrt(30 * a * (1 - a)) END AS z FROM w7), t7 AS (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS t FROM z7)"
TAIL = "exp(-z * z / 2) * 0.3989422804014327 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))"


@query("sta7_win_rate_drop", f"{RATES} SELECT symbol, round(a, 6) AS before, round(b, 6) AS after, round(CASE WHEN z > 0 THEN 1 - {TAIL} ELSE {TAIL} END, 6) AS p FROM t7")
def _(s, d):
    rates = rates_of(s, d)
    return rates.select("symbol", "before", "after", pro.win_rate_drop(F.col("before"), F.col("after")).alias("p"))


def rates_of(s, d):
    win, early = (F.col("result_r") > 0).cast("double"), F.col("entry_bar") < 300
    return results_of(s, d).groupBy("symbol").agg(F.avg(F.when(early, win)).alias("before"), F.avg(F.when(~early, win)).alias("after"))


@query("sta4_block_bootstrap")
def _(s, d):
    return rep.block_bootstrap_pf(results_of(s, d), ["symbol"], ORDER)


@query("sta5_kill_switch")
def _(s, d):
    return rep.kill_switch(results_of(s, d), ["symbol"], ORDER)


HALVES = f"{RES}, h10 AS (SELECT symbol, entry_bar < 300 AS old, count(x) AS n, {PF} AS pf FROM res GROUP BY 1, 2), m10 AS (SELECT n.symbol, n.n, n.pf AS live, o.pf AS past FROM h10 n LEFT JOIN h10 o ON o.symbol = n.symbol AND o.old WHERE NOT n.old)"


def halves_of(s, d):
    late = rep.result_metrics(results_of(s, d).withColumn("old", F.col("entry_bar") < 300), ["symbol", "old"])
    past = late.filter("old").select("symbol", F.col("pf").alias("past"))
    return late.filter("not old").select("symbol", "n", F.col("pf").alias("live")).join(past, "symbol", "left")


@query("sta10_shadow_gate", f"{HALVES} SELECT symbol, concat_ws('; ', CASE WHEN n < 8 THEN 'few events' END, CASE WHEN NOT coalesce(isfinite(live) AND isfinite(past) AND live >= past - 0.2, false) THEN 'profit factor' END, CASE WHEN n % 2 = 0 THEN 'drift' END) AS blocked, CASE WHEN n >= 8 AND live < 1 THEN 'profit factor' ELSE concat_ws('; ', CASE WHEN n % 2 = 0 THEN 'drift' END) END AS demoted FROM m10")
def _(s, d):
    drifted = F.col("n") % 2 == 0
    blocked = pro.shadow_reasons(F.col("n"), F.col("live"), F.col("past"), F.lit(0.2), drifted, F.lit(0), 8)
    demoted = pro.demotion_reasons(F.lit("live"), F.col("n"), F.col("live"), drifted, F.lit(None).cast("double"), 8, 0.05)
    return halves_of(s, d).select("symbol", blocked.alias("blocked"), demoted.alias("demoted"))


@query("sta11_order_steps", "SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n, coalesce(o_orderstatus || '-' || o_orderpriority IN ('F-1-URGENT'), false) AS ok FROM orders GROUP BY ALL")
def _(s, d):
    orders = s.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return orders.withColumn("ok", pro.valid_step(F.col("a"), F.col("b"), order=["O", "F", "1-URGENT", "2-HIGH"]))
