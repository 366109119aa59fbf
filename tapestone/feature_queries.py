"""Registered queries of contexts, confirmations, feature matrices and rule scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import indicators as ind
from .operators import events as ev
from .operators import features as fea
from .operators.clusters import equal_levels
from .further_queries import COARSE
from .pattern_queries import ALL, NAMED, atr_bars, named_events
from .plans.folders import saved
from .queries import ATR, BARS, COOLED, DAILY, SWEPT, W, _frame, _full, _swing_sql, bars_of, cooled_of, query
from .sources import bars as src

RULES, SPAN = ("4 hours", "12 hours"), 20
SESSIONS = {"asia": (0, 8), "london": (8, 16), "new_york": (13, 21)}
CONFIRM = {"max_wait": 8, "min_body": 0.3, "min_range": 0.4, "displacement": 0.8, "max_age": 60}
KEYS = ("symbol", "direction", "bar")


def _coarse_sql(rule: str, name: str) -> str:
    a = 1 - 2 / (SPAN + 1)
    return f"""{name}_b AS (SELECT symbol, time_bucket(INTERVAL '{rule}', ts) + INTERVAL '{rule}' AS at, arg_max(close, ts) AS c FROM bars GROUP BY 1, 2), {name}_j AS (SELECT b.symbol, b.bar, h.c FROM bars b ASOF LEFT JOIN {name}_b h ON b.symbol = h.symbol AND b.ts >= h.at),
{name} AS (SELECT symbol, bar, lag(c) OVER ({W}) AS x FROM {name}_j), {name}_k AS (SELECT symbol, bar, x, bar - min(bar) OVER (PARTITION BY symbol) AS k FROM {name} WHERE x IS NOT NULL),
{name}_e AS (SELECT symbol, k, bar, x AS y FROM {name}_k WHERE k = 0 UNION ALL SELECT n.symbol, n.k, n.bar, {a!r} * e.y + {1 - a!r} * n.x FROM {name}_e e JOIN {name}_k n ON n.symbol = e.symbol AND n.k = e.k + 1),
{name}_t AS (SELECT symbol, bar, CAST(sign(y - lag(y) OVER (PARTITION BY symbol ORDER BY bar)) AS DOUBLE) AS trend FROM {name}_e)"""


CONTEXT = f""", {_coarse_sql(RULES[0], 'h1')}, {_coarse_sql(RULES[1], 'h4')}{DAILY}, pday AS (SELECT symbol, day, lag(high) OVER (PARTITION BY symbol ORDER BY day) AS prev_day_high, lag(low) OVER (PARTITION BY symbol ORDER BY day) AS prev_day_low FROM days),
context AS (SELECT b.symbol, b.bar, h1.x / lag(h1.x) OVER (PARTITION BY b.symbol ORDER BY b.bar) - 1 AS h1_return, t.trend AS h1_trend, u.trend AS h4_trend, p.prev_day_high, p.prev_day_low FROM bars b JOIN h1 ON h1.symbol = b.symbol AND h1.bar = b.bar
 LEFT JOIN h1_t t ON t.symbol = b.symbol AND t.bar = b.bar LEFT JOIN h4_t u ON u.symbol = b.symbol AND u.bar = b.bar LEFT JOIN pday p ON p.symbol = b.symbol AND p.day = date_trunc('day', b.ts))"""


def context_of(s, d):
    return saved(fea.coarse_context(bars_of(s, d), RULES, SPAN), "context")


@query("tb5_coarse_context", f"WITH RECURSIVE {BARS}{CONTEXT} SELECT symbol, bar, round(h1_return, 6) AS h1_return, h1_trend, h4_trend, round(prev_day_high, 6) AS prev_day_high, round(prev_day_low, 6) AS prev_day_low FROM context")
def _(s, d):
    return fea.coarse_context(bars_of(s, d), RULES, SPAN)


@query("ind8_volume_percentile", f"WITH {BARS}, l AS (SELECT symbol, bar, volume, list(volume) OVER {_frame(-199, 0)} AS xs FROM bars) SELECT symbol, bar, CASE WHEN len(xs) = 200 THEN round((len(list_filter(xs, lambda x: x < volume)) + (len(list_filter(xs, lambda x: x = volume)) + 1) / 2.0) / 200, 6) END AS volume_pct FROM l")
def _(s, d):
    return ind.add_percentile(bars_of(s, d), "volume", 200, "volume_pct").select("symbol", "bar", "volume_pct")


INPUTS = f""", st AS (SELECT *, CASE WHEN close > 0 AND lag(close) OVER ({W}) > 0 THEN ln(close / lag(close) OVER ({W})) END AS step FROM atr),
inputs AS (SELECT symbol, bar, CASE WHEN count(step) OVER {_frame(-19, 0)} = 20 THEN sum(step) OVER {_frame(-19, 0)} END / CASE WHEN atr > 0 THEN atr * sqrt(20) END AS mean_return_norm, {_full('regr_slope(close, CAST(bar AS DOUBLE)) @', -19, 0)} * 19 / CASE WHEN atr > 0 THEN atr * sqrt(20) END AS slope_norm,
 {_full('CASE WHEN max(high) @ > min(low) @ THEN 2 * (close - min(low) @) / (max(high) @ - min(low) @) - 1 ELSE 0 END', -19, 0)} AS range_pos, atr / nullif(close, 0) AS atr_norm, {_full('(volume - avg(volume) @) / nullif(stddev_samp(volume) @, 0)', -19, 0)} AS volume_z20 FROM st)"""


@query("ind11_scaled_moves", f"WITH {BARS}{ATR}{INPUTS} SELECT symbol, bar, round(mean_return_norm, 6) AS mean_return_norm, round(slope_norm, 6) AS slope_norm FROM inputs")
def _(s, d):
    return fea.trend_inputs(ind.add_atr(bars_of(s, d)), ("mean_return_norm", "slope_norm"))


@query("ind14_regime_inputs", f"WITH {BARS}{ATR}{INPUTS} SELECT symbol, bar, round(range_pos, 6) AS range_pos, round(atr_norm, 6) AS atr_norm, round(volume_z20, 6) AS volume_z20, round((SELECT close FROM bars b WHERE b.symbol = inputs.symbol AND b.bar = inputs.bar), 6) AS close FROM inputs")
def _(s, d):
    return fea.trend_inputs(ind.add_atr(bars_of(s, d)), ("range_pos", "atr_norm", "volume_z20", "close"))


@query("ind16_close_location", f"WITH {BARS} SELECT symbol, bar, round((close - low) / nullif(high - low, 0), 6) AS close_location, round(abs(close - open), 6) AS body_size, round((high - greatest(open, close)) / nullif(least(open, close) - low, 0), 6) AS wick_balance FROM bars")
def _(s, d):
    return ind.add_anatomy(bars_of(s, d)).select("symbol", "bar", "close_location", "body_size", "wick_balance")


TREND_SWEEPS = f"{SWEPT}{CONTEXT}, v2 AS (SELECT s.* FROM sweeps s JOIN context c ON c.symbol = s.symbol AND c.bar = s.bar WHERE c.h1_trend = CASE WHEN s.direction = 'long' THEN 1 ELSE -1 END AND CASE WHEN s.direction = 'long' THEN s.close - s.level ELSE s.level - s.close END / nullif(s.atr, 0) >= 0)"
BAND = {"min_depth": 0.0, "max_depth": 3.0, "min_wick": 0.3}


@query("det2_sweeps_v2", f"WITH RECURSIVE {BARS}{TREND_SWEEPS} SELECT symbol, bar, direction, round(depth, 6) AS depth FROM v2")
def _(s, d):
    return fea.sweeps_in_coarse_trend(rolled_of_table(s, d), context_of(s, d), **BAND).select("symbol", "bar", "direction", "depth")


@query("det7_numbered_sweeps", f"WITH RECURSIVE {BARS}{COOLED} SELECT symbol, bar, direction, printf('%s-V2-%06d', symbol, row_number() OVER (PARTITION BY symbol ORDER BY bar, direction) - 1) AS event_id, round(level, 6) AS level, round(depth, 6) AS depth FROM cooled")
def _(s, d):
    return fea.numbered_events(cooled_of(s, d)).select("symbol", "bar", "direction", "event_id", "level", "depth")


def rolled_of_table(s, d):
    rolled = ind.add_sweep_inputs(bars_of(s, d))
    return saved(ind.add_percentile(ind.add_percentile(rolled, "atr", 200), "volume", 200, "volume_pct"), "rolled")


def _confirm_sql(source: str, out: str = "conf") -> str:
    c = CONFIRM
    pivot = lambda k: f"(SELECT arg_max(s.price, s.known_bar) FROM swings s WHERE s.symbol = e.symbol AND s.kind = '{k}' AND s.known_bar <= e.anchor_bar AND s.bar >= e.anchor_bar + 1 - {c['max_age']})"
    base = f"confirm_body >= {c['min_body']} AND "
    return f""", {out}_l AS (SELECT e.*, CASE WHEN direction = 'long' THEN {pivot('H')} ELSE {pivot('L')} END AS structure FROM {source} e),
{out}_n AS (SELECT e.symbol, e.direction, e.bar AS event, e.anchor_bar, e.structure, b.bar, b.close, b.volume, b.high - b.low AS size, b.atr, abs(b.close - b.open) / nullif(b.high - b.low, 0) AS confirm_body, (b.high - b.low) / nullif(b.atr, 0) AS confirm_range,
 CASE WHEN e.direction = 'long' THEN max(b.high) OVER w ELSE min(b.low) OVER w END AS extreme FROM {out}_l e JOIN atr b ON b.symbol = e.symbol AND b.bar BETWEEN e.anchor_bar AND e.anchor_bar + {c['max_wait']} WINDOW w AS (PARTITION BY e.symbol, e.direction, e.bar ORDER BY b.bar ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{out}_p AS (SELECT *, coalesce(CASE WHEN direction = 'long' THEN close > extreme ELSE close < extreme END, false) AS pe, coalesce(CASE WHEN direction = 'long' THEN close > structure ELSE close < structure END, false) AS ps FROM {out}_n WHERE bar > anchor_bar AND size > 0 AND atr IS NOT NULL),
{out}_t AS (SELECT *, CASE WHEN pe AND {base}confirm_range >= {c['min_range']} THEN 'close_break' WHEN pe AND {base}confirm_range >= {c['displacement']} THEN 'displacement' WHEN ps AND {base}confirm_range >= {c['min_range']} THEN 'structure_break' END AS confirm_type FROM {out}_p),
{out} AS (SELECT e.*, t.bar AS confirm_bar, t.bar - e.anchor_bar AS delay, t.confirm_range, t.confirm_body, t.volume AS confirm_volume, t.confirm_type, CASE WHEN t.confirm_type IS NOT NULL THEN 0.5 * least(greatest(t.confirm_body, 0), 1) + 0.5 * least(greatest(t.confirm_range, 0) / 2, 1) END AS strength
 FROM {source} e LEFT JOIN (SELECT * FROM {out}_t WHERE confirm_type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, direction, event ORDER BY bar) = 1) t ON t.symbol = e.symbol AND t.direction = e.direction AND t.event = e.bar)"""


ANCHORED = f"{COOLED}{_swing_sql(True)}, anchored AS (SELECT *, bar AS anchor_bar FROM cooled){_confirm_sql('anchored')}"


def confirmed_of(s, d, rolled=None):
    rolled = rolled_of_table(s, d) if rolled is None else rolled
    events = ev.deduplicated_sweeps(ev.sweep_rows(ev.sweep_flags(rolled)), 4).withColumn("anchor_bar", F.col("bar"))
    return fea.all_confirmations(saved(events, "events"), rolled, ev.swings(rolled), **CONFIRM)


@query("det10_all_confirmations", f"WITH RECURSIVE {BARS}{ANCHORED} SELECT symbol, direction, bar, confirm_bar, delay, round(confirm_range, 6) AS confirm_range, round(confirm_body, 6) AS confirm_body, confirm_type, round(strength, 6) AS strength FROM conf")
def _(s, d):
    return confirmed_of(s, d).select(*KEYS, "confirm_bar", "delay", "confirm_range", "confirm_body", "confirm_type", "strength")


#: Swings of the coarse bars; their CTE's name is taken by a context.
COARSE_LEVELS = COARSE.replace("h4 AS", "c4 AS").replace("FROM h4", "FROM c4") + ", h1w AS (SELECT c.symbol, kind, price, b.bar AS known_bar FROM csw c ASOF JOIN bars b ON b.symbol = c.symbol AND c.kts <= b.ts)"
LEVELS = COARSE_LEVELS + """, pfirst AS (SELECT symbol, date_trunc('day', ts) AS day, min(bar) AS known_bar FROM bars GROUP BY 1, 2),
levels AS (SELECT symbol, 'swing_' || kind || '_' || CAST(known_bar AS VARCHAR) AS level_id, 'swing' AS level_type, kind, price, known_bar, false AS is_h1 FROM swings
 UNION ALL SELECT symbol, 'h1_' || kind || '_' || CAST(known_bar AS VARCHAR), 'swing', kind, price, known_bar, true FROM h1w
 UNION ALL SELECT p.symbol, 'prev_day_' || k.kind || '_' || CAST(f.known_bar AS VARCHAR), 'prev_day', k.kind, CASE WHEN k.kind = 'H' THEN p.prev_day_high ELSE p.prev_day_low END, f.known_bar, false FROM pday p JOIN pfirst f ON f.symbol = p.symbol AND f.day = p.day, (SELECT unnest(['H', 'L']) AS kind) k WHERE p.prev_day_high IS NOT NULL),
lnear AS (SELECT e.symbol, e.direction, e.bar, l.level_id, l.level_type, l.kind, l.price, l.known_bar, l.is_h1 FROM conf e JOIN levels l ON l.symbol = e.symbol AND l.known_bar <= e.bar AND l.kind = CASE WHEN e.direction = 'long' THEN 'L' ELSE 'H' END AND abs(l.price - e.level) <= 2 * e.atr
 QUALIFY row_number() OVER (PARTITION BY e.symbol, e.direction, e.bar ORDER BY abs(l.price - e.level), l.known_bar, l.level_id) = 1),
lstate AS (SELECT n.symbol, n.direction, n.bar, count(*) FILTER (WHERE t) AS touches, max(b) FILTER (WHERE t) AS touched, bool_or(g AND b < bar) AS gone FROM (SELECT n.*, b.bar AS b, abs(CASE WHEN kind = 'L' THEN b.low ELSE b.high END - price) <= 0.1 * b.atr AS t, CASE WHEN kind = 'L' THEN b.low < price ELSE b.high > price END AS g FROM lnear n JOIN atr b ON b.symbol = n.symbol AND b.bar > n.known_bar AND b.bar <= n.bar) n GROUP BY 1, 2, 3),
lvl AS (SELECT n.*, coalesce(s.touches, 0) AS level_touch_count, n.bar - n.known_bar AS level_age_bars, n.bar - s.touched AS bars_since_last_touch, coalesce(s.gone, false) AS swept_before FROM lnear n LEFT JOIN lstate s ON s.symbol = n.symbol AND s.direction = n.direction AND s.bar = n.bar)"""


def levels_of(rolled):
    """Swings of the bars and of coarse bars, and the last days' highs and lows."""
    coarse = ev.coarse_swings(src.resample_bars(rolled, "4 hours"), rolled)
    return saved(ev.level_table({"swing": ev.swings(rolled), "h1": coarse, "prev_day": ev.previous_day_levels(rolled)}, ("h1",)), "levels")


@query("j9_levels_within_reach", f"WITH RECURSIVE {BARS}{ANCHORED}{CONTEXT}{LEVELS} SELECT symbol, direction, bar, level_id, level_type, round(price, 6) AS price, level_touch_count, level_age_bars, bars_since_last_touch, swept_before FROM lvl")
def _(s, d):
    rolled = rolled_of_table(s, d)
    return fea.nearest_levels(saved(confirmed_of(s, d, rolled), "confirmed"), levels_of(rolled), rolled).select(*KEYS, "level_id", "level_type", "price", "level_touch_count", "level_age_bars", "bars_since_last_touch", "swept_before")


FLOATS = ("range_atr", "body_ratio", "lower_wick_ratio", "upper_wick_ratio", "close_location", "penetration_atr", "reclaim_atr", "wick_ratio", "sweep_volume_zscore", "equal_level_dispersion_atr", "atr_percentile", "volume_zscore", "distance_to_previous_day_high_atr", "distance_to_previous_day_low_atr", "confirmation_range_atr", "confirmation_body_ratio", "confirmation_volume_zscore")
Z = f"{_full('(volume - avg(volume) @) / nullif(stddev_samp(volume) @, 0)', -50, -1)}"
SWEEP_MATRIX = f"""{LEVELS}, px AS (SELECT symbol, bar, ts, {Z} AS vz, list(atr) OVER {_frame(-199, 0)} AS xs, count(atr) OVER {_frame(-199, 0)} AS xn, list(volume) OVER {_frame(-199, 0)} AS vs, atr, volume FROM atr),
pc AS (SELECT *, CASE WHEN xn = 200 THEN (len(list_filter(xs, lambda x: x < atr)) + (len(list_filter(xs, lambda x: x = atr)) + 1) / 2.0) / 200 END AS pct, CASE WHEN len(vs) = 200 THEN (len(list_filter(vs, lambda x: x < volume)) + (len(list_filter(vs, lambda x: x = volume)) + 1) / 2.0) / 200 END AS vpct FROM px),
fea AS (SELECT e.symbol, e.direction, e.bar, (e.high - e.low) / nullif(e.atr, 0) AS range_atr, abs(e.close - e.open) / nullif(e.high - e.low, 0) AS body_ratio, (least(e.open, e.close) - e.low) / nullif(e.high - e.low, 0) AS lower_wick_ratio, (e.high - greatest(e.open, e.close)) / nullif(e.high - e.low, 0) AS upper_wick_ratio,
 (e.close - e.low) / nullif(e.high - e.low, 0) AS close_location, e.depth AS penetration_atr, CASE WHEN e.direction = 'long' THEN e.close - e.level ELSE e.level - e.close END / nullif(e.atr, 0) AS reclaim_atr, CASE WHEN e.direction = 'long' THEN least(e.open, e.close) - e.low ELSE e.high - greatest(e.open, e.close) END / nullif(e.high - e.low, 0) AS wick_ratio,
 p.vz AS sweep_volume_zscore, coalesce(l.level_type, 'rolling') AS level_type, l.level_age_bars, l.level_touch_count, l.bars_since_last_touch, CAST(NULL AS DOUBLE) AS equal_level_dispersion_atr, coalesce(l.level_type = 'prev_day', false) AS level_is_previous_day_high_low, coalesce(l.is_h1, false) AS level_is_h1_swing, coalesce(l.swept_before, false) AS level_already_partially_swept,
 p.pct AS atr_percentile, CASE WHEN p.pct < 0.33 THEN 'low' WHEN p.pct > 0.67 THEN 'high' WHEN p.pct IS NOT NULL THEN 'normal' END AS volatility_regime, p.vz AS volume_zscore, CAST(hour(p.ts) AS INT) AS hour_utc, CAST((isodow(p.ts) - 1) % 5 AS INT) AS day_of_week,
 hour(p.ts) < 8 AS session_asia, hour(p.ts) BETWEEN 13 AND 20 AS session_new_york, hour(p.ts) BETWEEN 8 AND 15 AS session_london, c.h1_trend, (e.close - c.prev_day_high) / nullif(e.atr, 0) AS distance_to_previous_day_high_atr, (e.close - c.prev_day_low) / nullif(e.atr, 0) AS distance_to_previous_day_low_atr,
 e.delay AS confirmation_delay_bars, e.confirm_range AS confirmation_range_atr, e.confirm_body AS confirmation_body_ratio, q.vz AS confirmation_volume_zscore, e.confirm_type, e.strength, e.confirm_volume, p.vpct AS volume_percentile, e.anchor_bar, e.confirm_bar
 FROM conf e LEFT JOIN lvl l ON l.symbol = e.symbol AND l.direction = e.direction AND l.bar = e.bar JOIN pc p ON p.symbol = e.symbol AND p.bar = e.bar LEFT JOIN context c ON c.symbol = e.symbol AND c.bar = e.bar LEFT JOIN pc q ON q.symbol = e.symbol AND q.bar = e.confirm_bar)"""


def _feature_list() -> str:
    return ", ".join(f"round({c}, 6) AS {c}" if c in FLOATS else c for c in fea.SWEEP_FEATURES)


def sweep_matrix_of(s, d, rolled, events):
    return fea.sweep_features(events, rolled, levels_of(rolled), context_of(s, d), SESSIONS)


@query("fea1_sweep_matrix", f"WITH RECURSIVE {BARS}{ANCHORED}{CONTEXT}{SWEEP_MATRIX} SELECT symbol, direction, bar, {_feature_list()} FROM fea")
def _(s, d):
    rolled = rolled_of_table(s, d)
    return sweep_matrix_of(s, d, rolled, saved(confirmed_of(s, d, rolled), "confirmed"))


SCORED_SWEEPS = """, sc0 AS (SELECT *, direction = 'long' AS lo, CASE WHEN direction = 'long' THEN close_location ELSE 1 - close_location END AS pl, least(abs(distance_to_previous_day_high_atr), abs(distance_to_previous_day_low_atr)) AS nd FROM fea),
sc AS (SELECT *, (CASE WHEN level_type = 'equal' THEN 8 ELSE 0 END + CASE WHEN level_touch_count >= 3 THEN 4 ELSE 0 END + CASE WHEN level_is_h1_swing OR level_is_previous_day_high_low THEN 5 ELSE 0 END + CASE WHEN bars_since_last_touch IS NULL THEN 3 ELSE 0 END) AS score_level,
 (CASE WHEN penetration_atr BETWEEN 0.10 AND 0.35 THEN 8 WHEN penetration_atr BETWEEN 0.05 AND 0.50 THEN 5 ELSE 0 END + CASE WHEN wick_ratio >= 0.70 THEN 7 WHEN wick_ratio >= 0.50 THEN 5 WHEN wick_ratio >= 0.35 THEN 3 ELSE 0 END + CASE WHEN range_atr >= 2 THEN 5 WHEN range_atr >= 1.5 THEN 3 WHEN range_atr >= 1 THEN 2 ELSE 0 END + CASE WHEN pl >= 0.7 THEN 5 WHEN pl >= 0.5 THEN 3 ELSE 0 END) AS score_sweep,
 (CASE WHEN reclaim_atr > 0 THEN 5 ELSE 0 END + CASE WHEN reclaim_atr >= 0.25 THEN 10 WHEN reclaim_atr >= 0.10 THEN 5 ELSE 0 END) AS score_reclaim,
 (CASE WHEN confirmation_delay_bars BETWEEN 1 AND 3 THEN 5 WHEN confirmation_delay_bars = 0 THEN 3 ELSE 0 END + CASE WHEN confirm_type IN ('structure_break', 'displacement') THEN 5 WHEN confirm_type = 'close_break' THEN 3 ELSE 0 END + CASE WHEN strength >= 0.7 THEN 5 WHEN strength >= 0.4 THEN 3 ELSE 0 END + CASE WHEN confirm_volume IS NULL THEN 0 WHEN volume_zscore > 1 THEN 5 WHEN volume_zscore > 0.5 THEN 3 WHEN confirm_volume > 0 THEN 2 ELSE 0 END) AS score_confirmation,
 (CASE WHEN (lo AND h1_trend > 0) OR (NOT lo AND h1_trend < 0) THEN 5 WHEN h1_trend <> 0 THEN 2 ELSE 0 END + CASE WHEN distance_to_previous_day_high_atr IS NULL OR distance_to_previous_day_low_atr IS NULL THEN 0 WHEN nd < 0.5 THEN 3 WHEN nd < 1 THEN 2 ELSE 0 END + CAST(session_london AS INT) + CAST(session_new_york AS INT)) AS score_context,
 (CASE WHEN volume_zscore > 2 THEN 5 WHEN volume_zscore > 1 THEN 3 WHEN volume_zscore > 0 THEN 1 ELSE 0 END + CASE WHEN volume_percentile >= 0.8 THEN 3 WHEN volume_percentile >= 0.6 THEN 2 ELSE 0 END + CASE volatility_regime WHEN 'high' THEN 2 WHEN 'normal' THEN 1 ELSE 0 END) AS score_volume FROM sc0),
scored AS (SELECT *, CAST(score_level + score_sweep + score_reclaim + score_confirmation + score_context + score_volume AS DOUBLE) AS rule_score FROM sc)"""
SCORES = tuple(f"score_{p}" for p in fea.SCORE_PARTS)


@query("fea4_rule_scores", f"WITH RECURSIVE {BARS}{ANCHORED}{CONTEXT}{SWEEP_MATRIX}{SCORED_SWEEPS} SELECT symbol, direction, bar, {', '.join(SCORES)}, rule_score FROM scored")
def _(s, d):
    rolled = rolled_of_table(s, d)
    events = saved(confirmed_of(s, d, rolled), "confirmed")
    more = events.select(*KEYS, "confirm_type", "strength", "confirm_volume").join(rolled.select("symbol", "bar", F.col("volume_pct").alias("volume_percentile")), ["symbol", "bar"])
    return fea.rule_scores(sweep_matrix_of(s, d, rolled, events).join(more, list(KEYS))).select(*KEYS, *SCORES, "rule_score")


SWEEP_EVENTS = f"""{TREND_SWEEPS}{_swing_sql(True)}, v_r AS (SELECT *, CASE WHEN bar - lag(bar) OVER (PARTITION BY symbol, direction ORDER BY bar) <= 1 THEN 0 ELSE 1 END AS fresh FROM v2), v_f AS (SELECT * FROM (SELECT *, sum(fresh) OVER (PARTITION BY symbol, direction ORDER BY bar) AS run FROM v_r) QUALIFY row_number() OVER (PARTITION BY symbol, direction, run ORDER BY bar) = 1),
v_o AS (SELECT *, row_number() OVER (PARTITION BY symbol, direction ORDER BY bar) AS n FROM v_f), v_g AS (SELECT symbol, direction, n, bar, bar AS last, true AS taken FROM v_o WHERE n = 1 UNION ALL SELECT o.symbol, o.direction, o.n, o.bar, CASE WHEN o.bar - g.last > 4 THEN o.bar ELSE g.last END, o.bar - g.last > 4 FROM v_g g JOIN v_o o ON o.symbol = g.symbol AND o.direction = g.direction AND o.n = g.n + 1),
s_r AS (SELECT symbol, direction, bar, CASE WHEN bar - lag(bar) OVER (PARTITION BY symbol, direction ORDER BY bar) <= 1 THEN 0 ELSE 1 END AS fresh FROM sweeps), s_g AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol, direction ORDER BY bar) AS run FROM s_r), s_a AS (SELECT symbol, direction, bar, min(bar) OVER (PARTITION BY symbol, direction, run) AS anchor_bar FROM s_g),
anchored AS (SELECT v.*, coalesce(a.anchor_bar, v.bar) AS anchor_bar FROM v_o v JOIN v_g g ON g.symbol = v.symbol AND g.direction = v.direction AND g.n = v.n AND g.taken LEFT JOIN s_a a ON a.symbol = v.symbol AND a.direction = v.direction AND a.bar = v.bar){_confirm_sql('anchored', 'conf0')}, conf AS (SELECT * FROM conf0 WHERE confirm_bar IS NOT NULL){SWEEP_MATRIX}{SCORED_SWEEPS},
entered AS (SELECT s.*, n.bar AS entry_bar, n.open AS entry, CASE WHEN s.lo THEN a.low - 0.1 * a.atr ELSE a.high + 0.1 * a.atr END AS stop FROM scored s JOIN bars n ON n.symbol = s.symbol AND n.bar = s.confirm_bar + 1 JOIN atr a ON a.symbol = s.symbol AND a.bar = s.anchor_bar)"""


@query("det15_sweep_events", f"WITH RECURSIVE {BARS}{SWEEP_EVENTS} SELECT symbol, direction, bar, anchor_bar, confirm_bar, confirm_type, entry_bar, round(entry, 6) AS entry, round(stop, 6) AS stop, round(entry + 1.5 * (entry - stop), 6) AS target, rule_score FROM entered")
def _(s, d):
    rolled = rolled_of_table(s, d)
    return fea.sweep_events(rolled, context_of(s, d), levels_of(rolled), ev.swings(rolled), SESSIONS, sweep=BAND, confirm=CONFIRM)


PATTERN_MATRIX = f"""WITH RECURSIVE {ALL}, ids AS (SELECT *, {NAMED} FROM found), b1 AS (WITH {BARS}{ATR} SELECT * FROM atr),
c AS (SELECT *, count(volume) OVER b AS n, avg(volume) OVER b AS m, stddev_pop(volume) OVER b AS sd, count(atr) OVER l AS na, avg(atr) OVER l AS ma, min(low) OVER u AS l24, max(high) OVER u AS h24, avg(volume) OVER u AS mv, lag(close, 24) OVER w AS c24 FROM b1
 WINDOW w AS (PARTITION BY symbol ORDER BY bar), b AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), u AS (PARTITION BY symbol ORDER BY bar ROWS 24 PRECEDING), l AS (PARTITION BY symbol ORDER BY bar ROWS 200 PRECEDING)),
pf AS (SELECT i.symbol, i.event_id, i.depth_atr, i.end_bar - i.start_bar AS pattern_length, 1 - least(abs(left_len - right_len) / CAST(greatest(left_len, right_len) AS DOUBLE), 1) AS symmetry_ratio, d.atr AS atr_level, CASE WHEN i.direction = 'bullish' THEN 1 ELSE -1 END * (d.close - i.neckline) / d.atr AS reclaim_atr,
 (d.high - d.low) / d.atr AS range_atr, coalesce((d.close - d.c24) / d.atr, 0) AS mom_24_atr, CASE WHEN d.h24 > d.l24 THEN (i.neckline - d.l24) / (d.h24 - d.l24) ELSE 0.5 END AS neck_pos_24, CASE WHEN d.h24 > d.l24 THEN (d.close - d.l24) / (d.h24 - d.l24) ELSE 0.5 END AS close_pos_24, (d.h24 - d.l24) / d.atr AS span_24_atr,
 CASE WHEN d.mv > 0 THEN d.volume / d.mv ELSE 1 END AS vol_ratio_24, CASE WHEN f.atr > 0 THEN CASE WHEN i.direction = 'bullish' THEN 1 ELSE -1 END * (f.close - i.neckline) / f.atr ELSE 0 END AS confirm_reclaim_atr, CASE WHEN f.n >= 5 AND f.sd > 0 THEN (f.volume - f.m) / f.sd ELSE 0 END AS confirm_vol_zscore,
 CASE WHEN f.high > f.low THEN (f.close - f.low) / (f.high - f.low) ELSE 0.5 END AS confirm_close_location, i.confirm_bar - i.detect_bar AS bars_confirm_delay, CASE WHEN d.bar >= 15 AND d.atr > 0 AND d.na >= 15 THEN d.atr / d.ma ELSE 1 END AS atr_ratio_200, hour(d.ts) AS hour_utc, isodow(d.ts) - 1 AS day_of_week, i.rule_score, i.offset_atr AS low_offset_atr
 FROM ids i JOIN c d ON d.symbol = i.symbol AND d.bar = i.detect_bar JOIN c f ON f.symbol = i.symbol AND f.bar = i.confirm_bar)"""
PF = ("depth_atr", "symmetry_ratio", "atr_level", "reclaim_atr", "range_atr", "mom_24_atr", "neck_pos_24", "close_pos_24", "span_24_atr", "vol_ratio_24", "confirm_reclaim_atr", "confirm_vol_zscore", "confirm_close_location", "atr_ratio_200", "rule_score", "low_offset_atr", "pattern_length", "bars_confirm_delay", "hour_utc", "day_of_week")


def pattern_matrix_of(s, d):
    bars = ind.add_confirm_context(atr_bars(s, d))
    return fea.pattern_features(named_events(s, d), saved(bars, "context-bars"), SESSIONS)


@query("fea2_pattern_matrix", f"{PATTERN_MATRIX} SELECT symbol, event_id, {', '.join(f'round(CAST({c} AS DOUBLE), 6) AS {c}' for c in PF)} FROM pf")
def _(s, d):
    return pattern_matrix_of(s, d).select("symbol", "event_id", *PF)


@query("fea3_gate_matrix", f"{PATTERN_MATRIX} SELECT symbol, event_id, {', '.join(f'round(CASE WHEN atr_level > 0 THEN CAST({c} AS DOUBLE) ELSE 0 END, 6) AS {c}' for c in fea.GATE_FEATURES)} FROM pf")
def _(s, d):
    return fea.gate_matrix(pattern_matrix_of(s, d))


@query("fea6_model_vectors", f"{PATTERN_MATRIX} SELECT symbol, event_id, round(depth_atr + 2 * rule_score, 6) AS weighted, 3 AS n, true AS missing_is_nan FROM pf")
def _(s, d):
    v = fea.model_vector(pattern_matrix_of(s, d), ("depth_atr", "hmm_state", "rule_score"))
    return v.select("symbol", "event_id", (F.col("vector")[0] + 2 * F.col("vector")[2]).alias("weighted"), F.size("vector").alias("n"), F.isnan(F.col("vector")[1]).alias("missing_is_nan"))


@query("fea7_flattened", f"WITH RECURSIVE {BARS}{COOLED} SELECT symbol, bar, direction, round(depth, 6) AS sweep_depth, round(level, 6) AS sweep_at_level, round(atr, 6) AS atr_value, direction AS direction_attr FROM cooled")
def _(s, d):
    sweep = F.struct("depth", F.struct("level").alias("at"))
    bag = cooled_of(s, d).select("symbol", "bar", "direction", F.struct(sweep.alias("sweep"), F.col("atr").alias("atr_value"), "direction").alias("attributes"))
    return fea.flattened(bag, "attributes")


@query("lvl4_equal_levels")
def _(s, d):
    return equal_levels(atr_bars(s, d), 0.1, 2, 200)
