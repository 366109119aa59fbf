"""Registered queries over any distance: whole level states, first sweeps, horizon labels and tie policies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import indicators as ind
from .operators import events as ev
from .operators import outcomes as out
from .queries import ATR, BARS, DAILY, TRADES, _cols, _outcomes, _swing_sql, bar_table, cooled_of, outcomes_of, query

LEVELS = f"""{_swing_sql(True)}, pd0 AS (SELECT symbol, day, lag(high) OVER (PARTITION BY symbol ORDER BY day) AS h, lag(low) OVER (PARTITION BY symbol ORDER BY day) AS l FROM days),
k0 AS (SELECT symbol, date_trunc('day', ts) AS day, min(bar) AS known_bar FROM bars GROUP BY 1, 2),
lv AS (SELECT symbol, concat('swing_', kind, '_', known_bar) AS level_id, 'swing' AS level_type, kind, price, bar AS origin_bar, known_bar FROM swings
 UNION ALL SELECT p.symbol, concat('prev_day_', u.kind, '_', known_bar), 'prev_day', u.kind, u.price, known_bar, known_bar FROM pd0 p JOIN k0 k ON k.symbol = p.symbol AND k.day = p.day, LATERAL (SELECT 'H' AS kind, p.h AS price UNION ALL SELECT 'L', p.l) u WHERE u.price IS NOT NULL),
st AS (SELECT l.*, max(b.bar) AS last_bar, min(b.bar) FILTER (WHERE t) AS first_touch_bar, max(b.bar) FILTER (WHERE t) AS last_touch_bar, count(*) FILTER (WHERE t) AS touch_count,
 min(b.bar) FILTER (WHERE b.bar >= known_bar AND atr IS NOT NULL AND CASE kind WHEN 'L' THEN low < price ELSE high > price END) AS swept_bar
 FROM lv l JOIN (SELECT *, bar AS b0 FROM atr) b ON b.symbol = l.symbol AND b.bar >= l.origin_bar, LATERAL (SELECT atr IS NOT NULL AND CASE kind WHEN 'L' THEN low <= price ELSE high >= price END AS t) x GROUP BY ALL)"""
STATE = "CASE WHEN swept_bar IS NOT NULL THEN 'swept' WHEN last_bar - origin_bar > 200 THEN 'invalidated' ELSE 'active' END"


def states_of(s, d) -> tuple[DataFrame, DataFrame]:
    """Swings and the last days' levels with their states, and the bars with ATR."""
    bars = ind.add_atr(bar_table(s, d))
    swing = ev.swings(bars).select("symbol", F.lit("swing").alias("level_type"), "kind", "price", F.col("bar").alias("origin_bar"), "known_bar")
    days = ev.previous_day_levels(bars).select("symbol", F.lit("prev_day").alias("level_type"), "kind", "price", F.col("known_bar").alias("origin_bar"), "known_bar")
    levels = swing.unionByName(days).withColumn("level_id", F.concat_ws("_", "level_type", "kind", F.col("known_bar").cast("string"))).withColumn("n_seed", F.lit(0))
    return ev.level_states(levels, bars).drop("n_seed"), bars


@query("lvl7_level_states", f"""WITH {BARS}{DAILY}{ATR}{LEVELS} SELECT symbol, level_id, level_type, kind, round(price, 6) AS price, origin_bar, known_bar, touch_count, first_touch_bar, last_touch_bar, last_bar - origin_bar AS age_bars,
 last_bar - last_touch_bar AS bars_since_last_touch, swept_bar, {STATE} AS sweep_state, CASE {STATE} WHEN 'active' THEN 'active' ELSE 'expired' END AS status, CASE {STATE} WHEN 'invalidated' THEN origin_bar + 201 END AS invalidated_bar FROM st""")
def _(s, d):
    return states_of(s, d)[0]


@query("lvl10_first_sweeps", f"""WITH {BARS}{DAILY}{ATR}{LEVELS}, r AS (SELECT l.symbol, l.level_id, l.kind, l.swept_bar, CASE kind WHEN 'L' THEN price - low ELSE high - price END / nullif(atr, 0) AS depth, CASE kind WHEN 'L' THEN least(open, close) - low ELSE high - greatest(open, close) END / nullif(high - low, 0) AS wick,
 CASE kind WHEN 'L' THEN close - price ELSE price - close END / nullif(atr, 0) AS reclaim FROM st l JOIN atr a ON a.symbol = l.symbol AND a.bar = l.swept_bar)
SELECT symbol, level_id, kind, swept_bar, round(depth, 6) AS depth, round(wick, 6) AS wick, round(reclaim, 6) AS reclaim, coalesce(depth BETWEEN 0 AND 3 AND wick >= 0.3 AND reclaim > 0, false) AS passes FROM r""")
def _(s, d):
    states, bars = states_of(s, d)
    return ev.level_sweeps(states.withColumn("origin_bar", F.col("level_id")), bars).withColumnRenamed("origin_bar", "level_id")


@query("out9_mfe_labels", f"""WITH RECURSIVE {BARS}{TRADES}, n AS (SELECT t.symbol, t.direction, t.entry_bar, b.bar AS b, CASE WHEN direction = 'long' THEN b.high - entry ELSE entry - b.low END / risk AS up, CASE WHEN direction = 'long' THEN entry - b.low ELSE b.high - entry END / risk AS down, CASE WHEN direction = 'long' THEN b.close - entry ELSE entry - b.close END / risk AS c
 FROM trades t JOIN bars b ON b.symbol = t.symbol AND b.bar BETWEEN t.entry_bar + 1 AND t.entry_bar + 72), m AS (SELECT symbol, direction, entry_bar, max(up) AS mfe, max(down) AS mae, arg_max(c, b) AS c FROM n GROUP BY 1, 2, 3 HAVING count(*) = 72)
SELECT symbol, direction, entry_bar, round(mfe, 6) AS mfe_r, round(mae, 6) AS mae_r, round(c, 6) AS close_r, CAST(mfe >= 1.25 AS INT) AS label, round(CASE WHEN mfe >= 1.25 THEN 1.25 WHEN mae >= 1 THEN -1 ELSE c END, 6) AS pnl_r FROM m""")
def _(s, d):
    bars = bar_table(s, d)
    return out.horizon_labels(out.trade_levels(cooled_of(s, d, bars)), bars)


for _policy in ("conservative", "optimistic"):
    query(f"out2_{_policy}", f"WITH RECURSIVE {BARS}{_outcomes(_policy)} SELECT symbol, direction, entry_bar, exit_reason, exit_bar, {_cols('', 'result_r, mfe_r, mae_r')}, truncated, bars_held FROM outcomes")(
        lambda s, d, policy=_policy: outcomes_of(s, d, policy).select("symbol", "direction", "entry_bar", "exit_reason", "exit_bar", "result_r", "mfe_r", "mae_r", "truncated", "bars_held")
    )


@query("out2_time_is_zero", f"WITH RECURSIVE {BARS}{_outcomes('labels')} SELECT symbol, direction, entry_bar, exit_reason, round(CASE WHEN exit_reason = 'time' THEN 0 ELSE result_r END, 6) AS result_r FROM outcomes")
def _(s, d):
    bars = bar_table(s, d)
    return out.barrier_outcomes(out.trade_levels(cooled_of(s, d, bars)), bars, 16, time_result="zero").select("symbol", "direction", "entry_bar", "exit_reason", "result_r")
