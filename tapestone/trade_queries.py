"""Registered queries of the lake, joins, groups, portfolios, reports, regimes, scorers and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import indicators as ind
from .functions import projections as pro
from .operators import events as ev
from .operators import features as fea
from .operators import groups as grp
from .operators import outcomes as out
from .operators import portfolio as port
from .operators import reports as rep
from .pattern_queries import atr_bars, content_id
from .plans.folders import saved, shared_folder
from .queries import ATR, BARS, COOLED, EPOCH, ORACLE, PF, QUERIES, RUNS, SCORED, SQL_EPOCH, SWEPT, TICKS, _outcomes, _recurrence, _reversal_sql, _swing_sql, bar_table, bars_of, cooled_of, outcomes_of, query, results_of, rolled_of, scored_of
from .sources import bars as src
from .sources import lake

SQL_ID = "CAST('0x' || substr(md5(symbol || ':' || direction || ':' || CAST({0} AS VARCHAR)), 1, 13) AS BIGINT)"
ENTRY_ID, BAR_ID = SQL_ID.format("entry_bar"), SQL_ID.format("bar")
POOL = f"""WITH RECURSIVE {BARS}{_outcomes('backtest')}, pool AS (SELECT o.symbol, o.direction, o.entry_bar, o.entry, o.stop, o.target, o.risk, o.exit_reason, o.exit_bar, o.result_r, o.result_r - (2 * (0.05 + 0.05) / o.risk) AS net_r, c.atr, c.depth, c.depth / 3 AS rule_score, b.ts,
 o.direction || CASE WHEN hour(b.ts) < 12 THEN '_am' ELSE '_pm' END AS pattern, CASE WHEN hour(b.ts) < 12 THEN 1.0 ELSE 0.5 END AS risk_fraction FROM outcomes o JOIN bars b ON b.symbol = o.symbol AND b.bar = o.entry_bar JOIN cooled c ON c.symbol = o.symbol AND c.direction = o.direction AND c.bar = o.entry_bar WHERE o.result_r IS NOT NULL),
pt AS (SELECT *, {ENTRY_ID} AS event_id FROM pool)"""


def pool_of(s, d):
    """Backtest trades of the sweeps as a table, each with a pattern named after its side and half of the day."""
    bars = bar_table(s, d)
    cooled = saved(cooled_of(s, d, bars), "events")
    done = out.net_results(out.barrier_outcomes(out.trade_levels(cooled), bars, 16, "backtest"), 0.05, 0.05).filter("result_r is not null")
    more = cooled.select("symbol", "direction", F.col("bar").alias("entry_bar"), "atr", "depth", (F.col("depth") / 3).alias("rule_score"), "ts")
    half = F.when(F.hour("ts") < 12, "am").otherwise("pm")
    rows = done.join(more, ["symbol", "direction", "entry_bar"]).withColumn("pattern", F.concat_ws("_", "direction", half))
    return saved(rows.withColumn("event_id", content_id("symbol", "direction", "entry_bar")), "pool")


# --- sources and the lake

EXPORT = f"WITH {BARS} SELECT symbol, {SQL_EPOCH}, round(open, 6) AS open, round(close, 6) AS close, volume FROM bars WHERE symbol = 'click'"


def _exported(s, d, comma: bool, volume: str):
    path = shared_folder(s, "export")
    one = bars_of(s, d).filter("symbol = 'click'").withColumn("ts", F.col("ts") + F.expr("interval 3 hours"))
    lake.write_export(one.withColumn("tickvol", F.col("volume")).withColumn("vol", F.col("volume") * 10), path, comma)
    read = src.read_export(s, path, "click", "H1", 3, volume)
    return read.select("symbol", F.unix_timestamp("ts").alias("epoch"), "open", "close", F.col("volume"))


@query("src1_export", EXPORT)
def _(s, d):
    return _exported(s, d, False, "tick")


@query("src2_real_volume", EXPORT.replace("AS close, volume FROM", "AS close, volume * 10 AS volume FROM"))
def _(s, d):
    return _exported(s, d, False, "real")


@query("src3_decimal_comma", EXPORT)
def _(s, d):
    return _exported(s, d, True, "tick")


@query("src5_normalised", f"WITH k AS (SELECT CAST(event_type AS VARCHAR) AS symbol, date_trunc('hour', ts) - INTERVAL '2 hours' AS ts, event_id, value FROM events) SELECT symbol, {SQL_EPOCH}, round(arg_min(value, event_id), 6) AS close, CAST(count(*) AS DOUBLE) AS rows_seen FROM k GROUP BY symbol, ts")
def _(s, d):
    ticks = src.ticks_of(s, d).withColumn("ts", F.date_trunc("hour", "ts"))
    raw = ticks.select("symbol", "ts", "seq", *[F.col("price").alias(c) for c in ("open", "high", "low", "close")], F.lit(7).alias("tickvol"), F.lit(9).alias("vol"))
    n = raw.groupBy("symbol", (F.col("ts") - F.expr("interval 2 hours")).alias("ts")).agg(F.count(F.lit(1)).cast("double").alias("rows_seen"))
    return lake.normalised(raw, "tick", 2).join(n, ["symbol", "ts"]).select("symbol", F.unix_timestamp("ts").alias("epoch"), "close", "rows_seen")


@query("src7_candles", f"WITH k AS (SELECT CAST(event_type AS VARCHAR) AS symbol, date_trunc('hour', ts) AS ts, event_id, value FROM events) SELECT symbol, {SQL_EPOCH}, round(arg_max(value, event_id), 6) AS open, round(arg_max(value + 1, event_id), 6) AS high FROM k GROUP BY symbol, ts")
def _(s, d):
    t = src.ticks_of(s, d)
    candle = F.to_json(F.struct(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), F.col("price").alias("open"), (F.col("price") + 1).alias("high"), F.col("price").alias("low"), F.col("price").alias("close"), F.lit(1.0).alias("volume")))
    raw = t.select("symbol", candle.alias("value"), F.col("seq").alias("offset"))
    return lake.candles_to_bars(raw.unionByName(raw.withColumn("value", F.concat(F.lit("x"), "value")))).select("symbol", F.unix_timestamp("ts").alias("epoch"), "open", "high")


@query("snk1_bar_table", f"WITH {BARS} SELECT symbol, bar, {SQL_EPOCH}, round(close, 6) AS close FROM bars")
def _(s, d):
    path = shared_folder(s, "bars")
    src.write_bars(bars_of(s, d).withColumn("timeframe", F.lit("H1")), path)
    return s.read.parquet(path).selectExpr("symbol", "bar", EPOCH, "close")


def _lake_events(s, d):
    rows = cooled_of(s, d).withColumn("event_id", content_id("symbol", "direction", "bar"))
    return saved(rows.select("event_id", F.concat(F.lit("sweep_"), "direction").alias("pattern"), "symbol", "direction", "bar", F.col("ts").alias("detect_time")), "lake-events")


@query("snk2_event_lake", f"WITH RECURSIVE {BARS}{COOLED} SELECT {BAR_ID} AS event_id, 'sweep_' || direction AS pattern, symbol, strftime(ts, '%Y-%m') AS month, bar FROM cooled")
def _(s, d):
    events, path = _lake_events(s, d), shared_folder(s, "lake")
    lake.append_events(events.filter("direction = 'long'"), path)
    lake.append_events(events, path, "skip")
    return s.read.parquet(path).select("event_id", "pattern", "symbol", F.col("month").cast("string").alias("month"), "bar")


@query("flt4_event_ids", f"WITH RECURSIVE {BARS}{COOLED} SELECT DISTINCT {BAR_ID} AS event_id FROM cooled")
def _(s, d):
    return lake.event_ids(_lake_events(s, d))


STORED = f"WITH RECURSIVE {BARS}{_outcomes('stored')}"


@query("snk3_tracked_outcomes", f"{STORED} SELECT {ENTRY_ID} AS event_id, symbol, exit_reason, exit_bar, round(result_r, 6) AS result_r FROM outcomes WHERE NOT truncated OR exit_reason IN ('tp', 'sl')")
def _(s, d):
    trades = out.trade_levels(cooled_of(s, d)).withColumn("event_id", content_id("symbol", "direction", "entry_bar"))
    trades = saved(trades.select("event_id", "symbol", "direction", "entry_bar", "entry", "stop", "target", "risk"), "trades")
    bars, path = saved(bars_of(s, d), "bars"), shared_folder(s, "outcomes")
    lake.track_outcomes(trades.filter("direction = 'long'"), path, bars, 16)
    lake.track_outcomes(trades, path, bars, 16)  # the job's next run: what is still pending
    return s.read.parquet(path).select("event_id", "symbol", "exit_reason", "exit_bar", "result_r")


@query("out8_pending_after_job", f"{STORED} SELECT {ENTRY_ID} AS event_id, symbol FROM outcomes WHERE truncated AND exit_reason NOT IN ('tp', 'sl') UNION ALL SELECT {SQL_ID.format('t.entry_bar').replace('symbol', 't.symbol').replace('direction', 't.direction')}, t.symbol FROM trades t WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = t.symbol AND b.bar > t.entry_bar)")
def _(s, d):
    trades = out.trade_levels(cooled_of(s, d)).withColumn("event_id", content_id("symbol", "direction", "entry_bar"))
    trades = saved(trades.select("event_id", "symbol", "direction", "entry_bar", "entry", "stop", "target", "risk"), "trades")
    path = shared_folder(s, "outcomes")
    lake.track_outcomes(trades, path, saved(bars_of(s, d), "bars"), 16)
    return lake.pending_events(trades, lake.stored(s, path)).select("event_id", "symbol")


@query("snk4_metric_snapshots", f"{POOL} SELECT symbol AS model_id, strftime(ts, '%Y-%m-%d') AS asof, count(*) AS n, round(sum(result_r), 6) AS total_r FROM pt GROUP BY 1, 2")
def _(s, d):
    rows = pool_of(s, d).groupBy(F.col("symbol").alias("model_id"), F.date_format("ts", "yyyy-MM-dd").alias("asof")).agg(F.count(F.lit(1)).alias("n"), F.sum("result_r").alias("total_r"))
    path = shared_folder(s, "metrics")
    lake.append_metrics(rows, path)
    lake.append_metrics(rows, path, "skip")
    return s.read.parquet(path).select("model_id", F.col("asof").cast("string").alias("asof"), "n", "total_r")


@query("snk5_regime_states", f"WITH {BARS} SELECT symbol, bar, CAST(close > open AS INT) AS state FROM bars WHERE symbol = 'view'")
def _(s, d):
    states, path = saved(bars_of(s, d).select("symbol", F.lit("H1").alias("timeframe"), "bar", (F.col("close") > F.col("open")).cast("int").alias("state")), "states"), shared_folder(s, "regimes")
    lake.publish_states(states.withColumn("state", F.lit(9)), path)
    lake.publish_states(states, path)
    return lake.read_states(s, path, "view", "H1").select("symbol", "bar", "state")


@query("prj3_event_atr", f"WITH {BARS}{ATR} SELECT symbol, bar, round(coalesce(atr, high - low), 6) AS event_atr FROM atr")
def _(s, d):
    b = ind.add_atr(bars_of(s, d))
    return b.select("symbol", "bar", pro.first_finite(F.when(F.col("atr").isNull(), float("nan")).otherwise(F.col("atr")), F.lit(float("inf")), F.col("high") - F.col("low")).alias("event_atr"))


@query("prj7_signal_rows", f"{POOL} SELECT symbol, direction, event_id, round(entry, 5) AS entry, round(stop, 5) AS stop, round(target, 5) AS target, round(rule_score, 4) AS rule_score, round(CASE WHEN depth > 1 THEN 0.25 ELSE 0.5 END, 4) AS model_prob FROM pt")
def _(s, d):
    return ev.signal_rows(pool_of(s, d).withColumn("model_prob", F.when(F.col("depth") > 1, 0.25)))


# --- joins

@query("j3_exact_bars", f"WITH {BARS} SELECT CAST(e.event_type AS VARCHAR) AS symbol, e.event_id, b.bar FROM events e JOIN bars b ON b.symbol = CAST(e.event_type AS VARCHAR) AND b.ts = date_trunc('hour', e.ts)")
def _(s, d):
    ticks = src.ticks_of(s, d).select("symbol", F.col("seq").alias("event_id"), F.date_trunc("hour", "ts").alias("ts"))
    return ev.bar_at(ticks, bars_of(s, d)).select("symbol", "event_id", "bar")


@query("j7_features_with_labels", f"{POOL} SELECT event_id, round(depth, 6) AS depth, round(rule_score, 6) AS rule_score, exit_reason, round(result_r, 6) AS result_r FROM pt")
def _(s, d):
    p = pool_of(s, d)
    return ev.labelled(p.select("event_id", "depth", "rule_score"), p.select("event_id", F.lit(0.0).alias("depth"), "exit_reason", "result_r"))


@query("j11_structure_boxes", f"WITH {BARS}{_reversal_sql(3)}, bx AS (SELECT DISTINCT symbol, start_bar, end_bar FROM patterns) SELECT x.symbol, start_bar, end_bar, round(min(b.low), 6) AS box_low, round(max(b.high), 6) AS box_high FROM bx x JOIN bars b ON b.symbol = x.symbol AND b.bar BETWEEN start_bar AND end_bar GROUP BY 1, 2, 3")
def _(s, d):
    bars = saved(bars_of(s, d), "bars")
    return ev.structure_box(ev.reversals(ev.swings(bars, strict=False), bars, 3, 0.3), bars)


COSTS = [("click", 0.1, 0.2, 0.0), ("view", 0.3, 0.1, 0.5)]


@query("j15_costs", f"{POOL}, k(symbol, half_spread, slippage, commission) AS (VALUES ('click', 0.1, 0.2, 0.0), ('view', 0.3, 0.1, 0.5)) SELECT p.event_id, p.symbol, CAST(coalesce(k.half_spread, 0.5) AS DOUBLE) AS half_spread, CAST(coalesce(k.slippage, 0.5) AS DOUBLE) AS slippage, CAST(coalesce(k.commission, 1.0) AS DOUBLE) AS commission FROM pt p LEFT JOIN k USING (symbol)")
def _(s, d):
    costs = s.createDataFrame(COSTS, "symbol string, half_spread double, slippage double, commission double")
    return port.with_costs(pool_of(s, d), costs, (0.5, 0.5, 1.0)).select("event_id", "symbol", "half_spread", "slippage", "commission")


OWNERS = [("LONG_AM", 1.0, "live"), ("SHORT_AM", 1.0, "live"), ("long_pm", 0.5, "shadow"), ("short_pm", 0.5, "live")]


def owned_of(s, d):
    return port.with_owner(pool_of(s, d), s.createDataFrame(OWNERS, "pattern string, risk_fraction double, lifecycle_state string"))


@query("j16_owners", f"{POOL} SELECT event_id, pattern, CAST(risk_fraction AS DOUBLE) AS risk_fraction, CASE WHEN pattern = 'long_pm' THEN 'shadow' ELSE 'live' END AS lifecycle_state FROM pt")
def _(s, d):
    return owned_of(s, d).select("event_id", "pattern", "risk_fraction", "lifecycle_state")


@query("j17_levels_near", f"WITH RECURSIVE {BARS}{COOLED}{_swing_sql(True)} SELECT c.symbol, c.direction, c.bar, count(s.bar) AS n_levels, round(min(abs(s.price - c.close)), 6) AS nearest FROM cooled c LEFT JOIN swings s ON s.symbol = c.symbol AND s.known_bar <= c.bar AND abs(s.price - c.close) <= c.atr GROUP BY 1, 2, 3")
def _(s, d):
    return ev.levels_near(saved(cooled_of(s, d), "events"), ev.swings(bars_of(s, d)), 10.0)


# --- groups and gates

IDS = f"ids AS (SELECT *, {BAR_ID} AS event_id FROM cooled)"
GROUPED = f"""WITH RECURSIVE {BARS}{COOLED}, {IDS}, near AS (SELECT x.event_id AS a, y.event_id AS b FROM ids x JOIN ids y ON x.symbol = y.symbol AND x.direction = y.direction AND x.event_id <> y.event_id AND abs(x.bar - y.bar) <= 12 AND abs(x.close - y.close) <= (x.atr + y.atr) / 2),
reach AS (SELECT event_id AS a, event_id AS b FROM ids UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b), grouped AS (SELECT i.*, g.group_id FROM ids i JOIN (SELECT a, min(b) AS group_id FROM reach GROUP BY 1) g ON g.a = i.event_id)"""
ORACLE["grp1_correlated_groups"] = f"{GROUPED} SELECT symbol, direction, group_id, count(*) AS members, min(bar) AS first_bar, max(bar) AS last_bar FROM grouped GROUP BY 1, 2, 3"
ORACLE["grp2_best_of_group"] = f"{GROUPED} SELECT symbol, direction, bar, group_id, CASE WHEN row_number() OVER (PARTITION BY group_id ORDER BY depth DESC, event_id) > 1 THEN 'correlated' END AS discard_reason FROM grouped"


ORACLE["grp3_confluence"] = GROUPED.replace("<= (x.atr + y.atr) / 2)", "<= 2 * (x.atr + y.atr) / 2)") + """, best AS (SELECT group_id, event_id AS best_id, bar AS b, close AS p, CASE WHEN atr > 0 THEN atr ELSE 1.0 END AS a, count(*) OVER (PARTITION BY group_id) AS n FROM grouped QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY depth DESC, event_id) = 1),
gap AS (SELECT k.group_id, k.best_id, k.n, coalesce(min(abs(g.bar - k.b)) FILTER (WHERE g.event_id <> k.best_id), 0) AS dt, coalesce(min(abs(g.close - k.p) / k.a) FILTER (WHERE g.event_id <> k.best_id), 0) AS dp FROM best k JOIN grouped g USING (group_id) GROUP BY 1, 2, 3)
SELECT group_id, best_id, n, round((CASE WHEN n > 1 THEN 1 ELSE 0 END + exp(-dt / 8.0) + exp(-dp)) / 3, 4) AS score FROM gap"""
ORACLE["out11_entry_strategies"] = f"""WITH RECURSIVE {BARS}{COOLED}, cf AS (SELECT e.symbol, e.bar, e.direction, min(b.bar) AS confirm_bar FROM cooled e JOIN bars b ON b.symbol = e.symbol AND b.bar BETWEEN e.bar + 1 AND e.bar + 8 AND CASE WHEN direction = 'long' THEN b.close > e.high ELSE b.close < e.low END GROUP BY ALL),
sg AS (SELECT 'after_sweep' AS strategy, e.symbol, e.direction, e.high, e.low, e.atr, e.bar AS at FROM cooled e UNION ALL SELECT 'after_confirmation', e.symbol, e.direction, e.high, e.low, e.atr, c.confirm_bar FROM cooled e JOIN cf c ON c.symbol = e.symbol AND c.bar = e.bar AND c.direction = e.direction),
en AS (SELECT g.*, n.bar AS entry_bar, CASE WHEN direction = 'long' THEN 1.0 ELSE -1.0 END AS sgn, n.open + CASE WHEN direction = 'long' THEN 0.02 ELSE -0.02 END AS entry, CASE WHEN direction = 'long' THEN g.low - 0.1 * atr ELSE g.high + 0.1 * atr END AS stop FROM sg g JOIN bars n ON n.symbol = g.symbol AND n.bar = g.at + 1),
tx AS (SELECT *, sgn * (entry - stop) AS risk, entry + sgn * 1.5 * sgn * (entry - stop) AS target FROM en WHERE sgn * (entry - stop) > 0),
nr AS (SELECT strategy, t.symbol, direction, sgn, entry_bar, entry, stop, risk, min(b.bar) FILTER (WHERE CASE WHEN sgn > 0 THEN b.low <= stop ELSE b.high >= stop END) AS sb, min(b.bar) FILTER (WHERE CASE WHEN sgn > 0 THEN b.high >= target ELSE b.low <= target END) AS tb, arg_max(b.close, b.bar) AS last FROM tx t JOIN bars b ON b.symbol = t.symbol AND b.bar BETWEEN entry_bar + 1 AND entry_bar + 16 GROUP BY ALL),
rs AS (SELECT symbol, strategy, CASE WHEN sb <= tb OR (sb IS NOT NULL AND tb IS NULL) THEN -1.0 WHEN tb IS NOT NULL THEN 1.5 ELSE sgn * (last - entry) / risk END AS x FROM nr)
SELECT symbol, strategy, count(x) AS n, round({PF}, 6) AS pf, round(sum(x), 6) AS total_r, round(avg(x), 6) AS expectancy, round(avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM rs GROUP BY 1, 2"""


@query("grp4_independent", f"WITH RECURSIVE {BARS}{COOLED} SELECT symbol, direction, bar, {BAR_ID} AS event_id, {BAR_ID} AS group_id, CAST(NULL AS VARCHAR) AS discard_reason FROM cooled")
def _(s, d):
    return grp.resolved_groups(cooled_of(s, d).withColumn("event_id", content_id("symbol", "direction", "bar")), "independent", F.col("depth")).select("symbol", "direction", "bar", "event_id", "group_id", "discard_reason")


@query("udx5_group_atr", GROUPED.replace("(x.atr + y.atr) / 2)", "(2 * (x.high - x.low) + 2 * (y.high - y.low)) / 2)") + " SELECT symbol, direction, bar, CASE WHEN row_number() OVER (PARTITION BY group_id ORDER BY depth DESC, event_id) > 1 THEN 'correlated' END AS discard_reason FROM grouped")
def _(s, d):
    rows = saved(cooled_of(s, d).withColumn("event_id", content_id("symbol", "direction", "bar")), "events")
    return grp.resolved_groups(rows, "dedup", F.col("depth"), atr=2 * (F.col("high") - F.col("low"))).select("symbol", "direction", "bar", "discard_reason")


@query("gat1_regime_gate", f"{POOL}, g AS (SELECT *, CASE WHEN result_r > 0 THEN 1 ELSE 0 END AS state, depth / 3 AS confidence FROM pt) SELECT event_id, CASE WHEN pattern LIKE '%pm' THEN 'no_rule' WHEN (CASE WHEN depth <= 2.5 THEN state END) IS NULL THEN 'no_regime' WHEN state NOT IN (1) THEN 'state' WHEN confidence < 0.2 THEN 'confidence' ELSE 'ok' END AS gate_reason FROM g")
def _(s, d):
    rules = s.createDataFrame([("long_am", [1], 0.2), ("short_am", [1], 0.2)], "pattern string, states array<int>, min_confidence double")
    rows = pool_of(s, d).withColumn("state", F.when(F.col("depth") <= 2.5, (F.col("result_r") > 0).cast("int"))).withColumn("confidence", F.col("depth") / 3)
    return grp.regime_gate(rows, rules, "pattern").select("event_id", "gate_reason")


@query("gat6_total_cap", f"{POOL} SELECT p.event_id, (SELECT count(*) FROM pt q WHERE q.entry_bar < p.entry_bar AND q.exit_bar > p.entry_bar) AS n_all, CASE WHEN (SELECT count(*) FROM pt q WHERE q.entry_bar < p.entry_bar AND q.exit_bar > p.entry_bar) >= 3 THEN 'max_total' END AS refused FROM pt p")
def _(s, d):
    return grp.totals_gate(pool_of(s, d), 3).select("event_id", "n_all", "refused")


@query("mod5_expanding_folds", f"WITH RECURSIVE {BARS}{COOLED}, n AS (SELECT symbol, bar, direction, row_number() OVER (PARTITION BY symbol ORDER BY bar, direction) - 1 AS place, count(*) OVER (PARTITION BY symbol) AS n FROM cooled), p AS (SELECT *, least(place // greatest(n // 4, 1), 3) AS s FROM n), f AS (SELECT unnest([0, 1, 2]) AS fold), r AS (SELECT symbol, bar, direction, fold, CASE WHEN s = fold + 1 THEN 'test' ELSE 'train' END AS role FROM p, f WHERE s <= fold + 1) SELECT * FROM r QUALIFY count(*) FILTER (WHERE role = 'train') OVER (PARTITION BY symbol, fold) >= 10")
def _(s, d):
    return grp.expanding_folds(cooled_of(s, d), 3, ["bar", "direction"]).select("symbol", "bar", "direction", "fold", "role")


ORACLE["mod2_purge_embargo"] = f"""WITH RECURSIVE {BARS}{COOLED}, n AS (SELECT symbol, bar, direction, row_number() OVER (PARTITION BY symbol ORDER BY bar, direction) AS place, count(*) OVER (PARTITION BY symbol) AS n FROM cooled),
p AS (SELECT *, CASE WHEN place <= round_even(n * 0.6, 0) THEN 'train' WHEN place <= round_even(n * 0.8, 0) THEN 'val' ELSE 'test' END AS split FROM n), e AS (SELECT symbol, min(bar) FILTER (WHERE split = 'val') AS v, max(bar) FILTER (WHERE split = 'train') AS t FROM p GROUP BY 1)
SELECT p.symbol, bar, direction, split, NOT coalesce((split = 'train' AND bar + 16 >= v) OR (split = 'val' AND bar <= t + 4), false) AS used FROM p JOIN e USING (symbol)"""


# --- portfolio

def _replay_sql(source: str, total: float, side: float, by: str = "1.0 * atr") -> str:
    live = "list_filter(g.open, lambda y: y.z > o.entry_bar)"
    whole = f"coalesce(list_sum(list_transform({live}, lambda y: y.r)), 0) + o.risk_fraction"
    near = f"coalesce(list_sum(list_transform(list_filter({live}, lambda y: y.d = o.direction AND abs(y.p - o.entry) <= o.reach), lambda y: y.r)), 0) + o.risk_fraction"
    why = f"CASE WHEN {whole} > {total} THEN 'max_total_risk' WHEN {near} > {side} THEN 'max_direction_cluster' END"
    row = "{'z': o.exit_bar, 'd': o.direction, 'p': o.entry, 'r': CAST(o.risk_fraction AS DOUBLE)}"
    return f"""rp_o AS (SELECT *, CASE WHEN atr > 0 THEN atr ELSE 1.0 END AS reach, row_number() OVER (PARTITION BY symbol ORDER BY entry_bar, event_id) AS n FROM {source}),
rp_g AS (SELECT symbol, n, event_id, CAST(NULL AS VARCHAR) AS why, [{row}] AS open FROM rp_o o WHERE n = 1
 UNION ALL SELECT o.symbol, o.n, o.event_id, {why}, CASE WHEN ({why}) IS NULL THEN list_append(g.open, {row}) ELSE g.open END FROM rp_g g JOIN rp_o o ON o.symbol = g.symbol AND o.n = g.n + 1),
replayed AS (SELECT p.*, g.why AS cap_reason, g.event_id IS NOT NULL AND g.why IS NULL AS executed FROM {source} p LEFT JOIN rp_g g ON g.event_id = p.event_id)"""


ORACLE["prt2_exposure_replay"] = f"""WITH RECURSIVE {BARS}{_outcomes('backtest')}, xo AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY entry_bar, event_id) AS n FROM (SELECT symbol, direction, entry_bar, exit_bar, {ENTRY_ID} AS event_id FROM outcomes)),
xg AS (SELECT symbol, n, true AS executed, [exit_bar] AS zs FROM xo WHERE n = 1 UNION ALL SELECT o.symbol, o.n, len(list_filter(g.zs, lambda z: z > o.entry_bar)) < 2, CASE WHEN len(list_filter(g.zs, lambda z: z > o.entry_bar)) < 2 THEN list_append(g.zs, o.exit_bar) ELSE g.zs END FROM xg g JOIN xo o ON o.symbol = g.symbol AND o.n = g.n + 1)
SELECT o.symbol, o.direction, o.entry_bar, o.exit_bar, g.executed FROM xo o JOIN xg g ON g.symbol = o.symbol AND g.n = o.n"""
CAPS = (1.5, 1.0)
REPLAY = f"{POOL}, {_replay_sql('pt', *CAPS)}"


@query("prt1_exposure_caps", f"{REPLAY} SELECT event_id, executed, cap_reason FROM replayed")
def _(s, d):
    return port.capped_replay(owned_of(s, d), *CAPS).select("event_id", "executed", "cap_reason")


GATED = f"{POOL}, ok AS (SELECT * FROM pt WHERE depth / 3 >= 0.05 AND entry_bar >= 20), {_replay_sql('ok', *CAPS)}, whole AS (SELECT p.*, CASE WHEN p.depth / 3 < 0.05 THEN 'low_probability' WHEN p.entry_bar < 20 THEN 'warm_up' ELSE r.cap_reason END AS cap_reason, coalesce(r.executed, false) AS executed FROM pt p LEFT JOIN replayed r ON r.event_id = p.event_id)"


def gated_of(s, d):
    gates = port.first_reason((F.col("rule_score") >= 0.05, "low_probability"), (F.col("entry_bar") >= 20, "warm_up"))
    return saved(port.capped_replay(owned_of(s, d).withColumn("refused", gates), *CAPS), "replayed")


@query("prt2_gated_replay", f"{GATED} SELECT event_id, executed, cap_reason FROM whole")
def _(s, d):
    return gated_of(s, d).select("event_id", "executed", "cap_reason")


@query("prt3_rejected", f"{GATED} SELECT event_id, symbol, pattern, cap_reason FROM whole WHERE NOT executed")
def _(s, d):
    return port.rejected(gated_of(s, d)).select("event_id", "symbol", "pattern", "cap_reason")


PF_X = "CASE WHEN count(x) = 0 THEN NULL WHEN coalesce(sum(x) FILTER (WHERE x < 0), 0) < 0 THEN coalesce(sum(x) FILTER (WHERE x > 0), 0) / abs(sum(x) FILTER (WHERE x < 0)) WHEN coalesce(sum(x) FILTER (WHERE x > 0), 0) > 0 THEN CAST('inf' AS DOUBLE) ELSE 0 END"


@query("agg10_pattern_report", f"""{GATED}, two AS (SELECT symbol, pattern, executed, CASE WHEN executed THEN net_r END AS x, entry_bar, event_id FROM whole UNION ALL SELECT symbol, '*', executed, CASE WHEN executed THEN net_r END, entry_bar, event_id FROM whole),
cu AS (SELECT symbol, pattern, sum(x) OVER w AS c, entry_bar, event_id FROM two WHERE executed WINDOW w AS (PARTITION BY symbol, pattern ORDER BY entry_bar, event_id ROWS UNBOUNDED PRECEDING)), dd AS (SELECT symbol, pattern, max(p - c) AS m FROM (SELECT *, greatest(max(c) OVER (PARTITION BY symbol, pattern ORDER BY entry_bar, event_id ROWS UNBOUNDED PRECEDING), 0) AS p FROM cu) GROUP BY 1, 2)
SELECT t.symbol, t.pattern, count(*) AS n_events, count(x) AS trades, round({PF_X}, 6) AS pf, round(avg(x), 6) AS expectancy_r, round(coalesce(sum(x), 0), 6) AS total_r, round(max(dd.m), 6) AS max_dd_r FROM two t LEFT JOIN dd USING (symbol, pattern) GROUP BY 1, 2""")
def _(s, d):
    return port.pattern_report(gated_of(s, d))


@query("agg10_oos_comparison", f"""{GATED}, done AS (SELECT * FROM whole WHERE executed), sp AS (SELECT symbol, max(entry_bar) AS hi, min(entry_bar) AS lo FROM done GROUP BY 1), late AS (SELECT d.* FROM done d JOIN sp USING (symbol) WHERE entry_bar >= hi - 0.3 * (hi - lo)), one AS (SELECT symbol, pattern, sum(net_r) AS r FROM late GROUP BY 1, 2)
SELECT l.symbol, round(sum(l.net_r), 6) AS portfolio_r, max(o.pattern) AS best_pattern, round(max(o.r), 6) AS best_r, sum(l.net_r) > max(o.r) AS portfolio_wins FROM late l JOIN (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY r DESC, pattern) = 1) o ON o.symbol = l.symbol GROUP BY 1""")
def _(s, d):
    return port.oos_comparison(gated_of(s, d))


# --- reports

@query("agg4_sampled_rolling_pf", f"""{POOL}, r AS (SELECT symbol, entry_bar, direction, CASE WHEN count(result_r) OVER w >= 4 THEN sum(CASE WHEN result_r > 0 THEN result_r ELSE 0 END) OVER w / nullif(abs(sum(CASE WHEN result_r < 0 THEN result_r ELSE 0 END) OVER w), 0) END AS pf FROM pt WINDOW w AS (PARTITION BY symbol ORDER BY entry_bar, direction ROWS 7 PRECEDING)),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY entry_bar, direction) - 1 AS place, count(*) OVER (PARTITION BY symbol) AS n FROM r WHERE pf IS NOT NULL) SELECT symbol, entry_bar, direction, round(pf, 6) AS rolling_pf FROM k WHERE n <= 5 OR list_contains(list_transform(range(0, 5), lambda i: CAST(round_even(i * (n - 1) / 4.0, 0) AS BIGINT)), place)""")
def _(s, d):
    rolling = rep.rolling_pf(pool_of(s, d), ["symbol"], ["entry_bar", "direction"], 8, 4)
    return port.sampled_rolling(rolling, ["symbol"], ["entry_bar", "direction"], "rolling_pf", 5).select("symbol", "entry_bar", "direction", "rolling_pf")


@query("agg6_classification_report", f"{SCORED}, h AS (SELECT lang, count(*) AS n, CAST(count(*) FILTER (WHERE score >= 0.2 AND label = 1) AS DOUBLE) AS tp, count(*) FILTER (WHERE score >= 0.2 AND label = 0) AS fp, count(*) FILTER (WHERE score < 0.2 AND label = 1) AS fn, count(*) FILTER (WHERE score < 0.2 AND label = 0) AS tn FROM z GROUP BY 1), p AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS re FROM h) SELECT lang, n, round((tp + tn) / n, 6) AS accuracy, round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1 FROM p")
def _(s, d):
    return rep.classification_report(scored_of(s, d), ["lang"], threshold=0.2)


@query("agg8_symmetric_shares", "WITH h AS (SELECT DISTINCT user_id AS g, CAST(event_type AS VARCHAR) AS i FROM events), n AS (SELECT i, count(*) AS n FROM h GROUP BY 1), b AS (SELECT x.i AS a, y.i AS b, count(*) AS c FROM h x JOIN h y USING (g) GROUP BY 1, 2) SELECT x.i AS a, y.i AS b, round(CASE WHEN x.i = y.i THEN 1 ELSE (coalesce(b.c, 0) / CAST(x.n AS DOUBLE) + coalesce(b.c, 0) / CAST(y.n AS DOUBLE)) / 2 END, 6) AS share FROM n x CROSS JOIN n y LEFT JOIN b ON b.a = x.i AND b.b = y.i")
def _(s, d):
    return rep.symmetric_co_occurrence(s.read.parquet(f"{d}/events.parquet"), "user_id", "event_type")


@query("agg13_asset_performance", f"{POOL} SELECT symbol, count(*) AS trades, round(avg(CASE WHEN net_r > 0 THEN 1.0 ELSE 0 END), 6) AS win_rate, round({PF.replace('(x', '(result_r').replace(' x ', ' result_r ')}, 6) AS pf, round(avg(net_r), 6) AS mean_r, round(CASE WHEN count(*) >= 4 THEN avg(net_r) - 1.96 * stddev_samp(net_r) / sqrt(count(*)) ELSE 0 END, 6) AS low, round(CASE WHEN count(*) >= 4 THEN avg(net_r) + 1.96 * stddev_samp(net_r) / sqrt(count(*)) ELSE 0 END, 6) AS high, avg(net_r) > 0.05 AS above_breakeven FROM pt GROUP BY 1")
def _(s, d):
    return rep.asset_performance(pool_of(s, d), 0.05)


_Q = ", ".join(f"round(quantile_cont({x}, {q}), 6) AS {n}_{m}" for n, x in (("target_atr", "abs(target - entry) / nullif(atr, 0)"), ("risk_atr", "risk / nullif(atr, 0)"), ("reward", "abs(target - entry) / nullif(risk, 0)")) for q, m in ((0.5, "median"), (0.9, "p90")))


@query("agg14_event_statistics", f"{POOL} SELECT symbol, count(*) AS n, round(count(*) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / (365.25 * 86400 * 1e6), 0), 6) AS per_year, {_Q}, {', '.join(f'count(*) FILTER (WHERE exit_reason = {chr(39)}{r}{chr(39)}) AS n_{r}' for r in ('tp', 'sl', 'time', 'ambiguous'))} FROM pt GROUP BY 1")
def _(s, d):
    return rep.event_statistics(pool_of(s, d))


ARMS = {"none": "true", "deep": "depth >= 0.5", "morning": "pattern LIKE '%am'", "both": "depth >= 0.5 AND pattern LIKE '%am'"}
_PFR = PF.replace("(x", "(result_r").replace(" x ", " result_r ")


@query("agg15_gate_arms", f"{POOL}, a AS (" + " UNION ALL ".join(f"SELECT '{n}' AS arm, * FROM pt WHERE {c}" for n, c in ARMS.items()) + f"), b AS (SELECT *, 'all' AS part FROM a UNION ALL SELECT *, CASE WHEN entry_bar >= 400 THEN 'oos' ELSE 'in_sample' END FROM a) SELECT arm, part, count(*) AS n, round({_PFR}, 6) AS pf, round(sum(result_r), 6) AS total_r FROM b GROUP BY 1, 2")
def _(s, d):
    return rep.gate_arms(pool_of(s, d), {n: F.expr(c) for n, c in ARMS.items()}, F.col("entry_bar") >= 400)


@query("agg17_best_gate", f"{POOL}, g AS (SELECT * FROM (VALUES ('long_am', ['long_am']), ('long_am+short_am', ['long_am', 'short_am']), ('long_pm+short_pm', ['long_pm', 'short_pm'])) v(states, sset), (VALUES (0.0), (0.1), (0.3)) c(least)), r AS (SELECT states, CAST(least AS DOUBLE) AS least, result_r FROM pt JOIN g ON list_contains(sset, pattern) AND rule_score >= least) SELECT states, least, count(*) AS n, round(round({_PFR}, 9), 6) AS pf FROM r GROUP BY 1, 2 HAVING count(*) >= 5 ORDER BY round({_PFR}, 9) DESC, n DESC, states, least LIMIT 1")
def _(s, d):
    sets = [["long_am"], ["long_am", "short_am"], ["long_pm", "short_pm"]]
    return rep.best_gate(pool_of(s, d), sets, [0.0, 0.1, 0.3], 5, "pattern", "rule_score")


@query("agg18_gate_audit", f"{GATED}, n AS (SELECT symbol, coalesce(cap_reason, 'ok') AS reason, count(*) AS n FROM whole GROUP BY 1, 2) SELECT symbol, reason, n, round(n / sum(n) OVER (PARTITION BY symbol), 6) AS share FROM n")
def _(s, d):
    return rep.gate_audit(gated_of(s, d).withColumn("reason", F.coalesce("cap_reason", F.lit("ok"))), "reason")


@query("agg18_state_power", f"{POOL} SELECT pattern, count(*) AS n, round({_PFR}, 6) AS pf, round(sum(result_r), 6) AS total_r, round(avg(result_r), 6) AS expectancy, round(avg(CASE WHEN result_r > 0 THEN 1.0 ELSE 0 END), 6) AS win_rate, CASE WHEN count(*) < 20 THEN 'too_few' WHEN {_PFR} > 1 THEN 'edge' ELSE 'none' END AS verdict FROM pt GROUP BY 1")
def _(s, d):
    return rep.state_power(pool_of(s, d), "pattern", least=20)


@query("agg19_threshold_table", f"{POOL}, t AS (SELECT unnest([0.0, 0.2, 0.5, 2.0]) AS threshold), j AS (SELECT t.threshold, p.result_r FROM t LEFT JOIN pt p ON p.rule_score >= t.threshold) SELECT CAST(threshold AS DOUBLE) AS threshold, count(result_r) AS n, round(CASE WHEN count(result_r) > 0 THEN {_PFR} END, 6) AS pf, round(avg(result_r), 6) AS expectancy, round(count(result_r) / CAST((SELECT count(*) FROM pt) AS DOUBLE), 6) AS kept FROM j GROUP BY threshold")
def _(s, d):
    return rep.threshold_table(pool_of(s, d), "rule_score", [0.0, 0.2, 0.5, 2.0])


@query("agg20_confluence_panel", f"{GROUPED}, z AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS k FROM grouped), m AS (SELECT unnest([1, 2, 3, 4]) AS n_patterns) SELECT n_patterns, count(z.depth) AS count, coalesce(round(avg(z.depth), 4), 0) AS avg_score FROM m LEFT JOIN z ON z.k = n_patterns GROUP BY 1")
def _(s, d):
    rows = saved(cooled_of(s, d).withColumn("event_id", content_id("symbol", "direction", "bar")), "events")
    return rep.confluence_panel(grp.correlated_groups(rows, 12, 1.0), score="depth")


@query("agg22_triage", f"""{POOL}, w AS (SELECT p.*, CASE WHEN p.direction = 'long' THEN (least(b.open, b.close) - b.low) / nullif(b.high - b.low, 0) ELSE (b.high - greatest(b.open, b.close)) / nullif(b.high - b.low, 0) END AS wick FROM pt p JOIN bars b ON b.symbol = p.symbol AND b.bar = p.entry_bar),
v AS (SELECT symbol, CASE WHEN exit_reason = 'tp' THEN 'correct' WHEN exit_reason = 'sl' AND coalesce(wick < 0.5 OR NOT (depth BETWEEN 0.1 AND 1.0) OR NOT (mfe > 0), true) THEN 'incorrect' ELSE 'ambiguous' END AS verdict FROM (SELECT *, result_r + 1 AS mfe FROM w)) SELECT stratum, verdict, count(*) AS n FROM (SELECT symbol AS stratum, verdict FROM v UNION ALL SELECT '*', verdict FROM v) GROUP BY 1, 2""")
def _(s, d):
    b = rolled_of(s, d).select("symbol", F.col("bar").alias("entry_bar"), "lower_wick", "upper_wick")
    rows = pool_of(s, d).join(b, ["symbol", "entry_bar"]).withColumn("wick", F.when(F.col("direction") == "long", F.col("lower_wick")).otherwise(F.col("upper_wick"))).withColumn("confirmed", F.col("result_r") + 1 > 0)
    return rep.triage_counts(rep.triage(rows), "symbol")


@query("agg23_split_adequacy", f"{POOL}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY entry_bar, event_id) AS place, count(*) OVER (PARTITION BY symbol) AS k FROM pt), c AS (SELECT symbol, count(*) FILTER (WHERE entry_bar >= 400) AS n_fixed, count(*) FILTER (WHERE place > k - floor(k * 0.4)) AS n_late FROM n GROUP BY 1) SELECT *, n_fixed >= 6 AND n_late >= 6 AS adequate FROM c")
def _(s, d):
    return rep.split_adequacy(pool_of(s, d), 400, 6)


@query("agg23_dropped_winners", f"{POOL}, f AS (SELECT event_id, result_r, rule_score, concat_ws('+', CASE WHEN NOT depth >= 0.5 THEN 'deep' END, CASE WHEN NOT pattern LIKE '%am' THEN 'morning' END) AS failed FROM pt) SELECT event_id, round(result_r, 6) AS result_r, failed FROM f WHERE failed <> '' AND result_r > 0 AND rule_score >= 0.05")
def _(s, d):
    gates = {n: F.expr(ARMS[n]) for n in ("deep", "morning")}
    return rep.dropped_winners(pool_of(s, d), gates, 0.05).select("event_id", "result_r", "failed")


STA8 = ("n_total >= 15", "positive_rate between 0.2 and 0.9", "pf > 0.8")


@query("sta8_research_gate", f"{POOL}, m AS (SELECT symbol, count(*) AS n_total, avg(CASE WHEN result_r > 0 THEN 1.0 ELSE 0 END) AS positive_rate, {_PFR} AS pf FROM pt GROUP BY 1) SELECT symbol, n_total, concat_ws('; ', CASE WHEN NOT n_total >= 15 THEN 'n_total >= 15' END, CASE WHEN NOT positive_rate BETWEEN 0.2 AND 0.9 THEN 'positive_rate between 0.2 and 0.9' END, CASE WHEN NOT pf > 0.8 THEN 'pf > 0.8' END) AS failed, n_total >= 15 AND positive_rate BETWEEN 0.2 AND 0.9 AND pf > 0.8 AS passed FROM m")
def _(s, d):
    m = rep.result_metrics(pool_of(s, d), ["symbol"]).withColumnsRenamed({"n": "n_total", "win_rate": "positive_rate"})
    return rep.research_gate(m, STA8).select("symbol", "n_total", "failed", "passed")


@query("sta10_promotion", f"{POOL}, m AS (SELECT symbol, pattern, count(*) AS n, {_PFR} AS pf, count(*) FILTER (WHERE result_r < 0) AS loss_run, CASE WHEN pattern LIKE 'long%' THEN 'shadow' ELSE 'live' END AS state, CASE WHEN symbol = 'view' THEN 'severe' ELSE 'none' END AS drift FROM pt GROUP BY 1, 2), r AS (SELECT *, concat_ws('+', CASE WHEN state = 'shadow' AND n < 3 THEN 'too_few_trades' END, CASE WHEN state = 'shadow' AND coalesce(pf, 0) < 1.1 THEN 'low_pf' END, CASE WHEN drift = 'severe' THEN 'severe_drift' END, CASE WHEN state = 'live' AND loss_run >= 2 THEN 'loss_run' END, CASE WHEN state = 'live' AND n >= 3 AND coalesce(pf, 0) < 0.8 THEN 'pf_under_floor' END) AS reasons FROM m) SELECT symbol, pattern, reasons, CASE WHEN state = 'shadow' AND reasons = '' THEN 'promote' WHEN state = 'live' AND (reasons LIKE '%severe_drift%' OR reasons LIKE '%pf_under_floor%') THEN 'degrade' WHEN state = 'live' AND reasons LIKE '%loss_run%' THEN 'pause' ELSE 'stay' END AS decision FROM r")
def _(s, d):
    m = rep.result_metrics(pool_of(s, d), ["symbol", "pattern"]).join(pool_of(s, d).groupBy("symbol", "pattern").agg(F.count_if(F.col("result_r") < 0).alias("loss_run")), ["symbol", "pattern"])
    m = m.withColumn("state", F.when(F.col("pattern").startswith("long"), "shadow").otherwise("live")).withColumn("drift", F.when(F.col("symbol") == "view", "severe").otherwise("none"))
    return rep.promotion(m, 3, 1.1, 2, 0.8).select("symbol", "pattern", "reasons", "decision")


@query("set4_in_order", f"{POOL} SELECT event_id, symbol, entry_bar, row_number() OVER (ORDER BY entry_bar, symbol, direction) AS place FROM pt ORDER BY place")
def _(s, d):
    rows = rep.in_order(pool_of(s, d), ["entry_bar", "symbol", "direction"])
    place = grp.placed_all(rows, ["entry_bar", "symbol", "direction"])
    return place.select("event_id", "symbol", "entry_bar", "place")


@query("str9_stage_counts", f"WITH RECURSIVE {BARS}{COOLED} SELECT symbol, count(*) AS trigger, count(*) FILTER (WHERE depth >= 0.2) AS found, count(*) FILTER (WHERE depth >= 0.2 AND direction = 'long') AS pass FROM cooled GROUP BY 1")
def _(s, d):
    return rep.stage_counts(cooled_of(s, d), {"trigger": F.lit(True), "found": F.col("depth") >= 0.2, "pass": F.col("direction") == "long"})


# --- plug-ins

@query("udx1_own_detector", f"WITH {BARS}, e AS (SELECT *, lag(open) OVER w AS po, lag(close) OVER w AS pc, lead(bar) OVER w AS nb, lead(open) OVER w AS no FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar)) SELECT symbol, 'engulfing' AS pattern, bar AS confirm_bar, round(no, 6) AS entry FROM e WHERE pc < po AND close > open AND close > po AND open < pc AND nb IS NOT NULL")
def _(s, d):
    from .operators import patterns as pat
    from .plans.layout import blocked, own_rows

    def engulfing(bars, params):
        held, w = blocked(bars, 1, 1)
        po, pc = F.lag("open").over(w), F.lag("close").over(w)
        hit = (pc < po) & (F.col("close") > F.col("open")) & (F.col("close") > po) & (F.col("open") < pc)
        rows = own_rows(held.withColumn("_hit", hit).withColumn("entry", F.lead("open").over(w))).filter("_hit and entry is not null")
        at = F.col("bar")
        none = F.lit(None).cast("double")
        return rows.select("symbol", F.lit("engulfing").alias("pattern"), F.lit("bullish").alias("direction"), at.alias("start_bar"), at.alias("neck_bar"), at.alias("end_bar"), at.alias("detect_bar"), at.alias("cross_bar"), at.alias("confirm_bar"), (at + 1).alias("entry_bar"), "entry",
                           F.col("low").alias("stop"), none.alias("target"), none.alias("neckline"), F.lit(1.0).alias("rule_score"), none.alias("depth_atr"), none.alias("offset_atr"), F.lit(1).alias("left_len"), F.lit(1).alias("right_len"), F.lit(None).cast("string").alias("discard_reason"))

    pat.register("engulfing", engulfing)
    return pat.detect_all(atr_bars(s, d), [{"detector": "engulfing", "cooldown": 0}]).select("symbol", "pattern", "confirm_bar", "entry")


@query("udx3_trend_provider", f"WITH {BARS}{SWEPT}, t AS (SELECT symbol, bar, CAST(sign(close - avg(close) OVER (PARTITION BY symbol ORDER BY bar ROWS 9 PRECEDING)) AS INT) AS trend FROM bars) SELECT s.symbol, s.bar, s.direction FROM sweeps s JOIN t ON t.symbol = s.symbol AND t.bar = s.bar WHERE t.trend = CASE WHEN s.direction = 'long' THEN 1 ELSE -1 END")
def _(s, d):
    from .plans.layout import blocked, own_rows

    held, w = blocked(bars_of(s, d), 10)
    own = own_rows(held.withColumn("trend", F.signum(F.col("close") - F.avg("close").over(w.rowsBetween(-9, 0))).cast("int")))
    return ev.with_trend(ev.sweep_rows(ev.sweep_flags(rolled_of(s, d))), own).select("symbol", "bar", "direction")


@query("mod10_scores_by_id", f"{POOL} SELECT event_id, round(CASE WHEN 1 / (1 + exp(-(depth - 0.5 * CASE WHEN result_r > 0 THEN 0 ELSE coalesce(atr, 0) END))) BETWEEN 0 AND 1 AND direction = 'long' THEN 1 / (1 + exp(-(depth - 0.5 * CASE WHEN result_r > 0 THEN 0 ELSE coalesce(atr, 0) END))) END, 6) AS model_prob FROM pt")
def _(s, d):
    from .operators import trainers

    p = pool_of(s, d)
    features = p.filter("direction = 'long'").select("event_id", "depth", F.when(F.col("result_r") > 0, float("nan")).otherwise(F.col("atr")).alias("atr"))
    return trainers.probabilities(p.select("event_id"), features, ["depth", "atr"], lambda x: 1 / (1 + F.exp(-(x[0] - 0.5 * x[1]))))


def _training_rows(s, d):
    rolled = rolled_of(s, d).select("symbol", F.col("bar").alias("entry_bar"), "body", "lower_wick", "upper_wick", "range_pos")
    rows = pool_of(s, d).withColumn("label", (F.col("result_r") > 0).cast("int")).join(rolled, ["symbol", "entry_bar"])
    return saved(grp.time_split(rows.withColumn("one", F.lit(1)), ["entry_bar", "event_id"], keys=("one",)), "training")


INPUT = ["depth", "body", "lower_wick", "upper_wick", "range_pos"]


@query("mod6_best_candidate")
def _(s, d):
    from .operators import trainers

    best, _, found = trainers.best_candidate(_training_rows(s, d), INPUT)
    return s.createDataFrame([(n, v, n == best) for n, v in found.items()], "candidate string, pr_auc double, chosen boolean")


@query("mod7_calibrated_test")
def _(s, d):
    from .operators import trainers

    split = _training_rows(s, d)
    return trainers.calibrated(trainers.fit(split.filter("split = 'train'"), INPUT), split).select("event_id", "label", "score", "calibrated")


@query("mod8_walk_forward")
def _(s, d):
    from .operators import trainers

    metrics = trainers.walk_forward_metrics(_training_rows(s, d).drop("split"), INPUT, 3, ["entry_bar", "event_id"], ["one"])
    return trainers.fold_summary(metrics, ["n", "roc_auc", "pr_auc", "brier"])


@query("mod9_gated_result")
def _(s, d):
    from .operators import trainers

    split = _training_rows(s, d)
    return trainers.gated_result(trainers.fit(split.filter("split = 'train'"), INPUT), split)


@query("mod11_gate_pr_auc")
def _(s, d):
    from .operators import trainers

    split = _training_rows(s, d)
    value, base, by = trainers.gate_pr_auc(split.filter("split = 'train'"), split.filter("split <> 'train'"), INPUT)
    return s.createDataFrame([(value, base, by)], "pr_auc double, base double, scorer string")


# --- regimes

INPUTS = ["mean_return_norm", "slope_norm"]


def fitted_of(s, d):
    from .operators import regimes

    rows = saved(fea.trend_inputs(ind.add_atr(bars_of(s, d)), INPUTS), "inputs")
    return rows, regimes.fit_regimes(rows, INPUTS, 2, 8, mixture_rounds=5)


@query("reg1_fitted_regimes")
def _(s, d):
    rows, params = fitted_of(s, d)
    return params.select("symbol", "n", "loglik", F.posexplode("means").alias("i", "mean"))


@query("reg2_ordered_regimes")
def _(s, d):
    from .operators import regimes

    return regimes.ordered_by_drift(fitted_of(s, d)[1]).select("symbol", F.col("means")[0].alias("low_drift"), F.col("means")[2].alias("high_drift"))


def states_of(s, d):
    from .operators import regimes

    rows, params = fitted_of(s, d)
    return saved(regimes.regime_states(rows, INPUTS, regimes.ordered_by_drift(params), 2, lag=1), "states")


@query("udx2_regime_estimator")
def _(s, d):
    from .operators.regime_models import RegimeEstimator

    rows = saved(fea.trend_inputs(ind.add_atr(bars_of(s, d)), INPUTS), "inputs")
    return RegimeEstimator(inputCols=INPUTS, states=2, rounds=2, mixtureRounds=2, lag=1).fit(rows).transform(rows).select("symbol", "bar", "state", "confidence", "stamp_bar")


@query("reg6_state_shares")
def _(s, d):
    from .operators import regimes

    return regimes.state_shares(states_of(s, d), F.floor(F.col("bar") / 168))


@query("reg4_default_state", f"WITH {BARS} SELECT symbol, bar, 0 AS state, 0.5 AS confidence FROM bars")
def _(s, d):
    from .operators import regimes

    rows = bars_of(s, d).select("symbol", "bar", "close")
    return regimes.regime_states(rows, ["close"], regimes.initial_parameters(rows, ["close"], 3), 3, least_bars=10**9).select("symbol", "bar", "state", "confidence")


@query("j5_state_at_confirmation", f"WITH RECURSIVE {BARS}{COOLED}, st AS (SELECT symbol, bar, CAST(close > open AS INT) AS state, bar - 1 AS stamp FROM bars), e AS (SELECT symbol, direction, bar, bar AS confirm_bar, bar - CASE WHEN direction = 'long' THEN 0 ELSE 4 END AS known_bar FROM cooled) SELECT e.symbol, e.direction, e.bar, coalesce(CASE WHEN x.stamp <= e.known_bar THEN x.state END, (SELECT arg_max(s.state, s.stamp) FROM st s WHERE s.symbol = e.symbol AND s.stamp <= e.known_bar)) AS hmm_state FROM e LEFT JOIN st x ON x.symbol = e.symbol AND x.bar = e.confirm_bar")
def _(s, d):
    from .operators import regimes

    states = saved(bars_of(s, d).select("symbol", "bar", (F.col("close") > F.col("open")).cast("int").alias("state"), F.lit(1.0).alias("confidence"), (F.col("bar") - 1).alias("stamp_bar")), "states")
    e = cooled_of(s, d).select("symbol", "direction", "bar", F.col("bar").alias("confirm_bar"), (F.col("bar") - F.when(F.col("direction") == "long", 0).otherwise(4)).alias("known_bar"))
    return regimes.state_of_events(e, states).select("symbol", "direction", "bar", "hmm_state")


@query("fea5_regime_columns")
def _(s, d):
    from .operators import regimes

    e = cooled_of(s, d).select("symbol", "direction", "bar", F.col("bar").alias("confirm_bar"), F.col("bar").alias("known_bar"))
    return regimes.regime_columns(regimes.state_of_events(e, states_of(s, d)), ["down", "up"]).select("symbol", "direction", "bar", "hmm_state", "hmm_confidence", "hmm_prob_down", "hmm_prob_up")


# --- streams: two runs over one folder, the second after more rows have come, from the first's checkpoint

def _in_two_runs(s, rows, first, make, sink):
    """Write the rows for which ``first`` holds, run the stream to the end, write the rest, and run it again."""
    from .streaming.signals import rocksdb

    source, state = shared_folder(s, "stream"), shared_folder(s, "stream-state")
    rows = saved(rows, "stream-rows")
    for part in (rows.filter(first), rows.filter(~first)):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = make(s.readStream.schema(rows.schema).parquet(source))
        with rocksdb(s):
            q = sink(stream.writeStream.option("checkpointLocation", state)).trigger(availableNow=True).start()
        q.awaitTermination()


def _to_table(s, rows, first, make):
    path = shared_folder(s, "stream-out")
    _in_two_runs(s, rows, first, make, lambda w: w.outputMode("append").format("parquet").option("path", path))
    return s.read.parquet(path)


@query("str2_replayed_ticks", f"WITH {BARS}, m AS (SELECT max(ts) AS m FROM events) SELECT symbol, {SQL_EPOCH}, round(close, 6) AS close, volume FROM bars, m WHERE bars.ts + INTERVAL '1 hour' <= m.m - INTERVAL '10 minutes'")
def _(s, d):
    from .streaming.bars import closed_bars

    ticks = src.ticks_of(s, d).withColumn("ts", F.col("ts").cast("timestamp"))
    twice = ticks.withColumn("again", F.lit(0)).unionByName(ticks.withColumn("again", F.lit(1)))
    table = _to_table(s, twice, F.col("ts") < F.lit("2024-01-16").cast("timestamp"), lambda t: closed_bars(t.drop("again"), "1 hour", "10 minutes"))
    return table.select("symbol", F.unix_timestamp("ts").alias("epoch"), "close", "volume")


@query("str3_latest_candles", f"WITH k AS (SELECT CAST(event_type AS VARCHAR) AS symbol, date_trunc('hour', ts) AS ts, event_id, value FROM events), m AS (SELECT max(date_trunc('hour', ts)) AS m FROM events) SELECT symbol, {SQL_EPOCH}, round(arg_max(value, event_id), 6) AS close FROM k, m WHERE k.ts + INTERVAL '1 hour' <= m.m - INTERVAL '10 minutes' GROUP BY symbol, ts")
def _(s, d):
    from .streaming.signals import latest_candles

    t = src.ticks_of(s, d)
    candles = t.select("symbol", F.date_trunc("hour", "ts").cast("timestamp").alias("ts"), "seq", *[F.col("price").alias(c) for c in ("open", "high", "low", "close")], "volume")
    table = _to_table(s, candles, F.col("ts") < F.lit("2024-01-16").cast("timestamp"), lambda c: latest_candles(c, "1 hour", "10 minutes"))
    return table.select("symbol", F.unix_timestamp("ts").alias("epoch"), "close")


@query("str4_incremental_sweeps", f"WITH {BARS}{SWEPT} SELECT symbol, bar, direction, round(level, 6) AS level, round(depth, 6) AS depth FROM sweeps")
def _(s, d):
    from .streaming.signals import incremental_sweeps

    table = _to_table(s, bars_of(s, d), F.col("bar") < 300, incremental_sweeps)
    return table.select("symbol", "bar", "direction", "level", "depth")


@query("str4_carried_state", f"WITH RECURSIVE {BARS}{COOLED}, {_recurrence(1 - 2 / 51, 'bars', 'close')}, a AS (SELECT *, min(bar) OVER (PARTITION BY symbol, direction, run) AS anchor FROM (SELECT *, sum(fresh) OVER (PARTITION BY symbol, direction ORDER BY bar) AS run FROM r1)) SELECT a.symbol, a.bar, a.direction, a.anchor, round(y.y, 6) AS ema, c.bar IS NOT NULL AS taken FROM a JOIN y ON y.symbol = a.symbol AND y.bar = a.bar LEFT JOIN cooled c ON c.symbol = a.symbol AND c.direction = a.direction AND c.bar = a.bar")
def _(s, d):
    from .streaming.signals import incremental_sweeps

    table = _to_table(s, bars_of(s, d), F.col("bar") < 300, incremental_sweeps)
    return table.select("symbol", "bar", "direction", "anchor", "ema", "taken")


FATES = f"WITH {BARS}{SWEPT}, h AS (SELECT s.symbol, s.bar, s.direction, min(b.bar) FILTER (WHERE CASE WHEN s.direction = 'long' THEN b.close > s.high ELSE b.close < s.low END) AS hit, max(b.bar) AS last FROM sweeps s JOIN bars b ON b.symbol = s.symbol AND b.bar BETWEEN s.bar + 1 AND s.bar + 8 GROUP BY 1, 2, 3)"


@query("str5_expiring_confirmations", f"{FATES} SELECT symbol, bar, direction, CASE WHEN hit IS NOT NULL THEN 'confirmed' ELSE 'expired' END AS status, coalesce(hit, last) AS at FROM h WHERE hit IS NOT NULL OR last = bar + 8")
def _(s, d):
    from .streaming.signals import pending_confirmations

    flagged = ev.sweep_flags(rolled_of(s, d)).select("symbol", "bar", "high", "low", "close", "sweep_long", "sweep_short")
    return _to_table(s, flagged, F.col("bar") < 300, pending_confirmations)


TIMED = f"WITH {BARS}{SWEPT}, f AS (SELECT *, ts + INTERVAL '8 hours 30 minutes' AS until FROM sweeps), h AS (SELECT s.symbol, s.bar, s.direction, s.until, min(b.bar) FILTER (WHERE b.ts <= s.until AND CASE WHEN s.direction = 'long' THEN b.close > s.high ELSE b.close < s.low END) AS hit, max(b.bar) FILTER (WHERE b.ts <= s.until) AS last FROM f s LEFT JOIN bars b ON b.symbol = s.symbol AND b.bar BETWEEN s.bar + 1 AND s.bar + 8 GROUP BY 1, 2, 3, 4), m AS (SELECT max(ts) AS m FROM bars)"


@query("str5_timed_confirmations", f"{TIMED} SELECT symbol, bar, direction, CASE WHEN hit IS NOT NULL THEN 'confirmed' ELSE 'expired' END AS status, coalesce(hit, CASE WHEN last = bar + 8 THEN last END) AS at FROM h, m WHERE hit IS NOT NULL OR last = bar + 8 OR until < m")
def _(s, d):
    from .streaming.signals import pending_confirmations

    flagged = ev.sweep_flags(rolled_of(s, d)).select("symbol", "bar", F.col("ts").cast("timestamp").alias("ts"), "high", "low", "close", "sweep_long", "sweep_short")
    return _to_table(s, flagged, F.col("ts") < F.lit("2024-01-16").cast("timestamp"), lambda b: pending_confirmations(b, patience="8 hours 30 minutes"))


@query("str6_signal_job", f"WITH RECURSIVE {BARS}{COOLED}, l AS (SELECT symbol, max(bar) AS last FROM bars GROUP BY 1) SELECT {BAR_ID} AS event_id, c.symbol, direction, bar, CASE WHEN direction = 'long' THEN 'signals' ELSE 'shadow' END AS sink FROM cooled c JOIN l ON l.symbol = c.symbol WHERE c.bar < l.last".replace(BAR_ID, BAR_ID.replace("symbol", "c.symbol")))
def _(s, d):
    from .streaming.signals import sent, signal_job

    def plan(ticks):
        bars = saved(src.bar_index(src.resample_ticks(ticks, "1 hour")), "bars")
        closed = bars.join(bars.groupBy("symbol").agg(F.max("bar").alias("_last")), "symbol").filter("bar < _last").drop("_last")
        events = ev.deduplicated_sweeps(ev.sweep_rows(ev.sweep_flags(ind.add_sweep_inputs(closed))), 4)
        rows = events.select(content_id("symbol", "direction", "bar").alias("event_id"), "symbol", "direction", "bar", F.when(F.col("direction") == "long", "live").otherwise("shadow").alias("lifecycle_state"))
        return saved(rows, "events")

    store, signals, shadow = (shared_folder(s, n) for n in ("tick-lake", "signals", "shadow"))
    _in_two_runs(s, src.ticks_of(s, d), F.col("ts") < F.lit("2024-01-16").cast("timestamp"), lambda t: t, lambda w: w.foreachBatch(signal_job(plan, store, signals, shadow)))
    return sent(s, signals, shadow).select("event_id", "symbol", "direction", "bar", "sink")


@query("str6_bounded_job", f"WITH RECURSIVE {BARS}{RUNS}, l AS (SELECT symbol, max(bar) AS last FROM bars GROUP BY 1) SELECT r.symbol, direction, {SQL_EPOCH.replace('ts', 'r.ts')}, round(level, 6) AS level, CASE WHEN direction = 'long' THEN 'signals' ELSE 'shadow' END AS sink FROM runs r JOIN l ON l.symbol = r.symbol WHERE r.bar < l.last")
def _(s, d):
    from .streaming.signals import sent, span_job

    def plan(ticks):
        bars = src.bar_index(src.resample_ticks(ticks, "1 hour"))
        events = ev.group_runs(ev.sweep_rows(ev.sweep_flags(ind.add_sweep_inputs(bars))))
        rows = events.withColumn("epoch", F.unix_timestamp("ts")).select(content_id("symbol", "direction", "epoch").alias("event_id"), "symbol", "direction", "ts", "level")
        return rows.withColumn("lifecycle_state", F.when(F.col("direction") == "long", "live").otherwise("shadow"))

    store, signals, shadow, marks = (shared_folder(s, n) for n in ("tick-lake", "signals", "shadow", "marks"))
    job = span_job(plan, store, signals, shadow, marks, "5 days", "1 hour")
    ticks = src.ticks_of(s, d).withColumn("ts", F.col("ts").cast("timestamp"))
    _in_two_runs(s, ticks, F.col("ts") < F.lit("2024-01-16").cast("timestamp"), lambda t: t, lambda w: w.foreachBatch(job))
    return sent(s, signals, shadow).select("symbol", "direction", F.unix_timestamp("ts").alias("epoch"), "level", "sink")


@query("str8_matured_by_stream", f"{STORED} SELECT {ENTRY_ID} AS event_id, symbol, exit_reason, exit_bar, round(result_r, 6) AS result_r FROM outcomes WHERE NOT truncated OR exit_reason IN ('tp', 'sl')")
def _(s, d):
    from .streaming.signals import outcome_job

    bars, events = bar_table(s, d), shared_folder(s, "events")
    trades = out.trade_levels(cooled_of(s, d, bars)).withColumn("event_id", content_id("symbol", "direction", "entry_bar"))
    trades.select("event_id", "symbol", "direction", "entry_bar", "entry", "stop", "target", "risk").write.parquet(events)
    path = shared_folder(s, "outcomes")
    _in_two_runs(s, bars, F.col("bar") < 300, lambda b: b, lambda w: w.foreachBatch(outcome_job(events, shared_folder(s, "bar-lake"), path, 16)))
    return s.read.parquet(path).select("event_id", "symbol", "exit_reason", "exit_bar", "result_r")


@query("str10_streaming_regimes", None)
def _(s, d):
    from .streaming.signals import streaming_states

    rows = ind.add_rolling(bars_of(s, d)).select("symbol", "bar", F.coalesce("log_return", F.lit(0.0)).alias("x"))
    return _to_table(s, rows, F.col("bar") < 300, lambda r: streaming_states(r, (-0.5, 0.0, 0.5), (1.0, 0.5, 1.0)))


@query("str11_repaired_bars", f"WITH {BARS}, e AS (SELECT CAST(event_type AS VARCHAR) AS symbol, date_trunc('hour', ts) AS ts, max(value) AS m FROM events GROUP BY 1, 2) SELECT b.symbol, bar, round(b.high, 6) AS high, volume FROM bars b JOIN e ON e.symbol = b.symbol AND e.ts = b.ts WHERE e.m > 120")
def _(s, d):
    from .streaming.signals import repaired

    # ticks over 120 stand for those that came too late for the stream
    ticks = src.ticks_of(s, d)
    stored = src.resample_ticks(ticks.filter("price <= 120"), "1 hour")
    return repaired(stored, bars_of(s, d))[1].select("symbol", "bar", "high", "volume")


def _late_stream(s, d):
    """Ticks and the stream's table of closed bars and late ticks: ticks over 120 come in the second run."""
    from .streaming.signals import bars_and_late

    ticks = src.ticks_of(s, d).withColumn("ts", F.col("ts").cast("timestamp"))
    early = (F.col("ts") < F.lit("2024-01-16").cast("timestamp")) & (F.col("price") <= 120)
    return ticks, _to_table(s, ticks, F.coalesce(early, F.lit(False)), lambda t: bars_and_late(t, "1 hour", "10 minutes"))


@query("str11_late_rows", f"WITH {TICKS}, m AS (SELECT symbol, max(ts) AS m FROM ticks WHERE ts < TIMESTAMP '2024-01-16' AND price <= 120 GROUP BY 1) SELECT t.symbol, t.seq, round(t.price, 6) AS price FROM ticks t JOIN m ON m.symbol = t.symbol WHERE NOT coalesce(t.ts < TIMESTAMP '2024-01-16' AND t.price <= 120, false) AND date_trunc('hour', t.ts) + INTERVAL '1 hour' <= m.m - INTERVAL '10 minutes'")
def _(s, d):
    return _late_stream(s, d)[1].filter("late").select("symbol", "seq", "price")


@query("str11_mended_stream", f"WITH {BARS}, m AS (SELECT symbol, max(ts) AS m FROM ticks GROUP BY 1) SELECT b.symbol, {SQL_EPOCH.replace('ts', 'b.ts')}, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM bars b JOIN m ON m.symbol = b.symbol WHERE b.ts + INTERVAL '1 hour' <= m.m - INTERVAL '10 minutes'")
def _(s, d):
    from .streaming.signals import window_repairs, with_repairs

    ticks, table = _late_stream(s, d)
    repairs = window_repairs(ticks, table.filter("late"), "1 hour")
    return with_repairs(table.filter("not late").select("symbol", "ts", *src.OHLCV), repairs).select("symbol", F.unix_timestamp("ts").alias("epoch"), *src.OHLCV)
