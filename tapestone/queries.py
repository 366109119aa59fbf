"""Registered queries over the given tables, and the same results as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import indicators as ind
from .functions.projections import score_bucket
from .operators import events as ev
from .operators import features as fea
from .operators import groups as grp
from .operators import outcomes as out
from .operators import patterns as pat
from .operators import reports as rep
from .plans import layout
from .plans.folders import saved
from .sources import bars as src
from .sources import lake

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TICKS = "ticks AS (SELECT CAST(event_type AS VARCHAR) AS symbol, ts, event_id AS seq, value AS price, 1.0 AS volume FROM events)"
BARS0 = TICKS + """, b0 AS (SELECT t.symbol, time_bucket(INTERVAL '1 hour', t.ts) AS bts, first(t.price ORDER BY t.ts, t.seq) AS open, max(t.price) AS high, min(t.price) AS low,
 last(t.price ORDER BY t.ts, t.seq) AS close, CAST(count(*) AS DOUBLE) AS volume FROM ticks t GROUP BY 1, 2)"""
BARS = BARS0 + ", bars AS (SELECT symbol, bts AS ts, open, high, low, close, volume, row_number() OVER (PARTITION BY symbol ORDER BY bts) - 1 AS bar FROM b0)"
W = "PARTITION BY symbol ORDER BY bar"
TR = ", tr AS (SELECT *, greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr FROM bars WINDOW w AS (" + W + "))"
ATR = TR + f", atr AS (SELECT *, CASE WHEN count(tr) OVER w = 14 THEN avg(tr) OVER w END AS atr FROM tr WINDOW w AS ({W} ROWS 13 PRECEDING))"


def _frame(a: int, b: int) -> str:
    side = lambda x: "CURRENT ROW" if x == 0 else f"{-x} PRECEDING" if x < 0 else f"{x} FOLLOWING"
    return f"({W} ROWS BETWEEN {side(a)} AND {side(b)})"


def _full(e: str, a: int, b: int) -> str:
    return f"CASE WHEN count(close) OVER {_frame(a, b)} = {b - a + 1} THEN {e.replace('@', 'OVER ' + _frame(a, b))} END"


ROLLED = ATR + f""", rolled AS (SELECT *, {_full('min(low) @', -20, -1)} AS prior_low, {_full('max(high) @', -20, -1)} AS prior_high,
 (least(open, close) - low) / nullif(high - low, 0) AS lower_wick, (high - greatest(open, close)) / nullif(high - low, 0) AS upper_wick, abs(close - open) / nullif(high - low, 0) AS body FROM atr)"""
SWEPT = ROLLED + """, flags AS (SELECT *, (prior_low - low) / nullif(atr, 0) AS dl, (high - prior_high) / nullif(atr, 0) AS ds FROM rolled),
sweeps AS (SELECT symbol, bar, ts, open, high, low, close, atr, 'long' AS direction, prior_low AS level, dl AS depth FROM flags WHERE dl > 0 AND dl <= 3 AND close > prior_low AND lower_wick >= 0.3
 UNION ALL SELECT symbol, bar, ts, open, high, low, close, atr, 'short', prior_high, ds FROM flags WHERE ds > 0 AND ds <= 3 AND close < prior_high AND upper_wick >= 0.3)"""
RUNS = SWEPT + """, r1 AS (SELECT *, CASE WHEN bar - lag(bar) OVER (PARTITION BY symbol, direction ORDER BY bar) <= 1 THEN 0 ELSE 1 END AS fresh FROM sweeps),
runs AS (SELECT * FROM (SELECT *, sum(fresh) OVER (PARTITION BY symbol, direction ORDER BY bar) AS run FROM r1) QUALIFY row_number() OVER (PARTITION BY symbol, direction, run ORDER BY bar) = 1)"""
COOLED = RUNS + """, o AS (SELECT *, row_number() OVER (PARTITION BY symbol, direction ORDER BY bar) AS n FROM runs),
greedy AS (SELECT symbol, direction, n, bar, bar AS last, true AS taken FROM o WHERE n = 1
 UNION ALL SELECT o.symbol, o.direction, o.n, o.bar, CASE WHEN o.bar - g.last > 4 THEN o.bar ELSE g.last END, o.bar - g.last > 4 FROM greedy g JOIN o ON o.symbol = g.symbol AND o.direction = g.direction AND o.n = g.n + 1),
cooled AS (SELECT runs.* FROM runs JOIN greedy g ON g.symbol = runs.symbol AND g.direction = runs.direction AND g.bar = runs.bar WHERE g.taken)"""
TRADES = COOLED + """, tr0 AS (SELECT *, bar AS entry_bar, close AS entry, CASE WHEN direction = 'long' THEN low - 0.1 * atr ELSE high + 0.1 * atr END AS stop FROM cooled),
trades AS (SELECT *, abs(entry - stop) AS risk, CASE WHEN direction = 'long' THEN entry + 1.5 * abs(entry - stop) ELSE entry - 1.5 * abs(entry - stop) END AS target FROM tr0 WHERE abs(entry - stop) > 0)"""


def _outcomes(preset: str, horizon: int = 16) -> str:
    first, more, tie, to_exit = out.PRESETS[preset]
    reason = {"ambiguous": "ambiguous", "stop": "sl", "target": "tp"}[tie]
    upto = "exit_bar" if to_exit else "last_bar"
    return TRADES + f""", near AS (SELECT t.*, b.bar AS b, b.close AS bc, CASE WHEN direction = 'long' THEN b.high - entry ELSE entry - b.low END / risk AS up, CASE WHEN direction = 'long' THEN entry - b.low ELSE b.high - entry END / risk AS down,
 CASE WHEN direction = 'long' THEN b.low <= stop ELSE b.high >= stop END AS s, CASE WHEN direction = 'long' THEN b.high >= target ELSE b.low <= target END AS g
 FROM trades t JOIN bars b ON b.symbol = t.symbol AND b.bar BETWEEN t.entry_bar + {first} AND t.entry_bar + {horizon + more}),
hits AS (SELECT symbol, direction, entry_bar, entry, stop, target, risk, min(b) FILTER (WHERE s) AS stop_bar, min(b) FILTER (WHERE g) AS target_bar, max(b) AS last_bar, arg_max(bc, b) AS last_close FROM near GROUP BY ALL),
ended AS (SELECT *, CASE WHEN stop_bar = target_bar THEN '{reason}' WHEN target_bar IS NOT NULL AND (stop_bar IS NULL OR target_bar < stop_bar) THEN 'tp' WHEN stop_bar IS NOT NULL THEN 'sl' ELSE 'time' END AS exit_reason, coalesce(least(stop_bar, target_bar), last_bar) AS exit_bar FROM hits),
paid AS (SELECT *, CASE exit_reason WHEN 'tp' THEN abs(target - entry) / risk WHEN 'sl' THEN -1.0 WHEN 'time' THEN (CASE WHEN direction = 'long' THEN last_close - entry ELSE entry - last_close END) / risk END AS result_r FROM ended),
outcomes AS (SELECT p.symbol, p.direction, p.entry_bar, p.entry, p.stop, p.target, p.risk, p.exit_reason, p.exit_bar, p.result_r, max(n.up) AS mfe_r, max(n.down) AS mae_r, p.last_bar < p.entry_bar + {horizon + more} AS truncated, p.exit_bar - p.entry_bar AS bars_held
 FROM paid p JOIN near n ON n.symbol = p.symbol AND n.direction = p.direction AND n.entry_bar = p.entry_bar AND n.b <= p.{upto} GROUP BY ALL)"""


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: layout.rounded(f(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def _cols(names: str, rounded: str = "") -> str:
    parts = [c.strip() for c in names.split(",") if c.strip()]
    return ", ".join(parts + [f"round({c.strip()}, 6) AS {c.strip()}" for c in rounded.split(",") if c.strip()])


def bars_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.bars_ev(spark, sf_dir, "1 hour")


def bar_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars as a table, for what reads them more than once."""
    return saved(bars_of(spark, sf_dir), "bars")


def rolled_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.add_sweep_inputs(bars_of(spark, sf_dir))


def cooled_of(spark: SparkSession, sf_dir: str, bars: DataFrame | None = None) -> DataFrame:
    rolled = ind.add_sweep_inputs(bars_of(spark, sf_dir) if bars is None else bars)
    return ev.deduplicated_sweeps(ev.sweep_rows(ev.sweep_flags(rolled)), 4)


def outcomes_of(spark: SparkSession, sf_dir: str, preset: str = "labels", horizon: int = 16) -> DataFrame:
    bars = bar_table(spark, sf_dir)
    return out.barrier_outcomes(out.trade_levels(cooled_of(spark, sf_dir, bars)), bars, horizon, preset)


EPOCH = "unix_timestamp(ts) as epoch"
SQL_EPOCH = "CAST(epoch(ts) AS BIGINT) AS epoch"


# --- time bucketing, sources, checks

@query("tb1_resample", f"WITH {BARS} SELECT symbol, bar, {SQL_EPOCH}, {_cols('', 'open, high, low, close, volume')} FROM bars")
def _(s, d):
    return bars_of(s, d).selectExpr("symbol", "bar", EPOCH, *src.OHLCV)


DAILY = ", days AS (SELECT symbol, date_trunc('day', ts) AS day, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2)"


@query("tb2_daily", f"WITH {BARS}{DAILY} SELECT symbol, CAST(epoch(day) AS BIGINT) AS epoch, {_cols('', 'open, high, low, close, volume')} FROM days")
def _(s, d):
    return src.resample_bars(bars_of(s, d), "1 day").selectExpr("symbol", EPOCH, *src.OHLCV)


@query("tb3_closed_higher_timeframe", f"""WITH {BARS}, h4 AS (SELECT symbol, time_bucket(INTERVAL '4 hours', ts) + INTERVAL '4 hours' AS at, arg_max(close, ts) AS htf_close FROM bars GROUP BY 1, 2),
j AS (SELECT b.symbol, b.bar, h.htf_close FROM bars b ASOF LEFT JOIN h4 h ON b.symbol = h.symbol AND b.ts >= h.at)
SELECT symbol, bar, round(lag(htf_close) OVER ({W}), 6) AS htf_close FROM j""")
def _(s, d):
    return fea.closed_coarse(bars_of(s, d), "4 hours", "htf_close")


@query("tb4_previous_day", f"WITH {BARS}{DAILY}, p AS (SELECT symbol, day, lag(high) OVER (PARTITION BY symbol ORDER BY day) AS prev_high, lag(low) OVER (PARTITION BY symbol ORDER BY day) AS prev_low FROM days) SELECT b.symbol, b.bar, round(prev_high, 6) AS prev_high, round(prev_low, 6) AS prev_low FROM bars b JOIN p ON p.symbol = b.symbol AND p.day = date_trunc('day', b.ts)")
def _(s, d):
    return fea.previous_day(bars_of(s, d)).select("symbol", "bar", F.col("prev_day_high").alias("prev_high"), F.col("prev_day_low").alias("prev_low"))


@query("tb6_sessions", f"""WITH {BARS}, h AS (SELECT symbol, bar, CAST(hour(ts) AS INT) AS hour, CAST((isodow(ts) - 1) % 5 AS INT) AS dow FROM bars)
SELECT symbol, bar, hour, dow, hour < 8 AS in_asia, hour >= 8 AND hour < 16 AS in_london, hour >= 22 OR hour < 2 AS in_late, CAST(hour < 8 AS INT) + CAST(hour >= 8 AND hour < 16 AS INT) + CAST(hour >= 22 OR hour < 2 AS INT) AS n_sessions, CAST((hour - CASE WHEN hour < 8 THEN 0 WHEN hour < 16 THEN 8 WHEN hour >= 22 THEN 22 END) * 60 AS INT) AS minutes_from_open FROM h""")
def _(s, d):
    return ind.add_sessions(bars_of(s, d), {"asia": (0, 8), "london": (8, 16), "late": (22, 2)}).select("symbol", "bar", "hour", "dow", "in_asia", "in_london", "in_late", "n_sessions", "minutes_from_open")


@query("src5_first_per_time", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY event_id) = 1")
def _(s, d):
    e = s.read.parquet(f"{d}/events.parquet").withColumn("day", F.date_trunc("day", "ts"))
    return src.first_per_time(e, "event_id", keys=("user_id", "day")).select("user_id", "event_id")


@query("src6_utc_offsets", f"""WITH {BARS}, d AS (SELECT symbol, CAST(ts AS DATE) AS day, hour(min(ts)) AS h FROM bars GROUP BY 1, 2), o AS (SELECT *, CASE h WHEN 1 THEN 3 WHEN 0 THEN 2 END AS o FROM d)
SELECT symbol, CAST(day AS VARCHAR) AS day, CAST(coalesce(last_value(o IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING), first_value(o IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS INT) AS utc_offset FROM o""")
def _(s, d):
    return src.infer_utc_offsets(bars_of(s, d)).withColumn("day", F.col("day").cast("string"))


@query("flt8_ohlc_counts", f"WITH {BARS} SELECT symbol, count(*) AS n, count(*) FILTER (WHERE high < greatest(open, close)) AS bad_high, count(*) FILTER (WHERE low > least(open, close)) AS bad_low, count(*) FILTER (WHERE high < low) AS bad_range, count(*) FILTER (WHERE open IS NULL) AS nulls, count(*) FILTER (WHERE high = low) AS flat FROM bars GROUP BY 1")
def _(s, d):
    return src.ohlc_counts(bars_of(s, d))


GAPS = f""", g0 AS (SELECT symbol, bar, lag(ts) OVER ({W}) AS previous, ts FROM bars), g AS (SELECT *, CAST((epoch(ts) - epoch(previous)) / 60 AS BIGINT) AS minutes FROM g0),
gaps AS (SELECT symbol, bar, minutes, CASE WHEN minutes >= 2880 THEN 'holiday' WHEN isodow(previous) >= 5 AND minutes >= 1440 THEN 'weekend' WHEN hour(previous) >= 20 THEN 'daily_break' ELSE 'short_gap' END AS kind FROM g WHERE minutes > 60)"""


@query("flt9_gaps", f"WITH {BARS}{GAPS} SELECT * FROM gaps")
def _(s, d):
    return src.gaps(bars_of(s, d), 60)


@query("flt10_gap_report", f"WITH {BARS}{GAPS} SELECT symbol, kind, count(*) AS n, max(minutes) AS longest, round(avg(minutes), 6) AS mean_minutes FROM gaps GROUP BY 1, 2")
def _(s, d):
    return src.gaps(bars_of(s, d), 60).groupBy("symbol", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("minutes").alias("longest"), F.avg("minutes").alias("mean_minutes"))


QUALITY = f"""WITH {BARS}{GAPS}, spr AS (SELECT symbol, floor(100 * round(high - low, 6)) AS x FROM bars),
days AS (SELECT symbol, CAST(ts AS DATE) AS day, hour(min(ts)) AS h FROM bars GROUP BY 1, 2), told AS (SELECT *, CASE h WHEN 1 THEN 3 WHEN 0 THEN 2 END AS o FROM days),
offs AS (SELECT symbol, coalesce(last_value(o IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING), first_value(o IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS o FROM told)
SELECT symbol, 'rows' AS section, 'bars' AS item, count(*) AS n, CAST(NULL AS DOUBLE) AS value FROM bars GROUP BY 1
UNION ALL SELECT symbol, 'rows', 'zero_volume', count(*) FILTER (WHERE volume <= 0), NULL FROM bars GROUP BY 1
UNION ALL SELECT symbol, 'gap', kind, count(*), CAST(max(minutes) AS DOUBLE) FROM gaps GROUP BY 1, 3
UNION ALL SELECT g.symbol, 'break_hour', CAST(hour(b.ts) AS VARCHAR), count(*), NULL FROM gaps g JOIN bars b ON b.symbol = g.symbol AND b.bar = g.bar - 1 WHERE kind = 'daily_break' GROUP BY 1, 3
UNION ALL SELECT symbol, 'offset', CAST(o AS VARCHAR), count(*), NULL FROM offs GROUP BY 1, 3
UNION ALL SELECT symbol, 'spread', item, count(x), CASE item WHEN 'min' THEN min(x) WHEN 'max' THEN max(x) WHEN 'mean' THEN round(avg(x), 3) WHEN 'median' THEN median(x) ELSE count(*) FILTER (WHERE x = 0) END FROM spr, (SELECT unnest(['min', 'max', 'mean', 'median', 'zero']) AS item) GROUP BY 1, 3"""


@query("flt10_quality_report", QUALITY)
def _(s, d):
    return src.quality_report(bars_of(s, d).withColumn("spread", F.floor(100 * F.round(F.col("high") - F.col("low"), 6))), 60, "spread")


@query("set5_largest_gaps", f"WITH {BARS}{GAPS} SELECT * FROM gaps ORDER BY minutes DESC, symbol, bar LIMIT 20")
def _(s, d):
    return src.gaps(bars_of(s, d), 60).orderBy(F.col("minutes").desc(), "symbol", "bar").limit(20)


@query("src4_window_with_halo", f"WITH {BARS}, e AS (SELECT symbol, min(bar) FILTER (WHERE ts >= TIMESTAMP '2024-01-10') AS lo, max(bar) FILTER (WHERE ts <= TIMESTAMP '2024-01-20') AS hi FROM bars GROUP BY 1) SELECT b.symbol, b.bar FROM bars b JOIN e ON e.symbol = b.symbol AND b.bar BETWEEN lo - 50 AND hi + 10")
def _(s, d):
    return src.read_window(bars_of(s, d), "2024-01-10", "2024-01-20", 50, 10).select("symbol", "bar")


@query("flt3_pending", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def _(s, d):
    done = s.read.parquet(f"{d}/lineitem.parquet").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("event_id"))
    return lake.pending_events(s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("event_id")), done).withColumnRenamed("event_id", "o_orderkey")


@query("flt2_outcomes_of_ids", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def _(s, d):
    ids = s.read.parquet(f"{d}/orders.parquet").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("event_id"))
    return lake.outcomes_of(s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("event_id"), "l_linenumber"), ids).withColumnRenamed("event_id", "l_orderkey")


@query("flt5_log_query", "SELECT event_id, event_type, user_id FROM events WHERE event_type IN (SELECT DISTINCT event_type FROM events ORDER BY 1 LIMIT 2) AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' AND CAST(user_id AS VARCHAR) LIKE '%7%'")
def _(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    kinds = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").limit(2).collect()]
    rows = lake.log_rows(e.withColumn("user", F.col("user_id").cast("string")), {"event_type": kinds}, ("user", "7"), ("ts", "2024-01-05", "2024-01-25"))
    return rows.select("event_id", "event_type", "user_id")


@query("flt6_last_trades", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3")
def _(s, d):
    return lake.last_of_each(s.read.parquet(f"{d}/orders.parquet"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 3).select("o_custkey", "o_orderkey")


# --- indicators

@query("ind2_atr", f"WITH {BARS}{ATR} SELECT symbol, bar, {_cols('', 'tr, atr')} FROM atr")
def _(s, d):
    return ind.add_atr(bars_of(s, d)).select("symbol", "bar", "tr", "atr")


def _recurrence(a: float, source: str, value: str) -> str:
    return f"y AS (SELECT symbol, bar, {value} AS y FROM {source} WHERE bar = 0 UNION ALL SELECT n.symbol, n.bar, {a!r} * y.y + {1 - a!r} * n.{value} FROM y JOIN {source} n ON n.symbol = y.symbol AND n.bar = y.bar + 1)"


@query("ind4_ema", f"WITH RECURSIVE {BARS}, {_recurrence(1 - 2 / 51, 'bars', 'close')} SELECT symbol, bar, round(y, 6) AS ema FROM y")
def _(s, d):
    return ind.add_ema(bars_of(s, d), 50).select("symbol", "bar", "ema")


@query("ind3_wilder_atr", f"WITH RECURSIVE {BARS}{TR}, {_recurrence(1 - 1 / 14, 'tr', 'tr')} SELECT symbol, bar, CASE WHEN bar >= 13 THEN round(y, 6) END AS watr FROM y")
def _(s, d):
    return ind.add_wilder_atr(bars_of(s, d)).select("symbol", "bar", "watr")


RANKED = f"l AS (SELECT symbol, bar, atr, list(atr) OVER w AS xs, count(atr) OVER w AS n FROM atr WINDOW w AS ({W} ROWS 199 PRECEDING)), p AS (SELECT symbol, bar, CASE WHEN n = 200 THEN (len(list_filter(xs, lambda x: x < atr)) + (len(list_filter(xs, lambda x: x = atr)) + 1) / 2.0) / 200 END AS pct FROM l)"


@query("ind5_percentile", f"WITH {BARS}{ATR}, {RANKED} SELECT symbol, bar, round(pct, 6) AS pct FROM p")
def _(s, d):
    return ind.add_percentile(ind.add_atr(bars_of(s, d)), "atr", 200).select("symbol", "bar", "pct")


@query("ind7_rolling", f"""WITH {BARS}{ATR} SELECT symbol, bar, round({_full('(volume - avg(volume) @) / nullif(stddev_samp(volume) @, 0)', -50, -1)}, 6) AS volume_z, round({_full('(volume - avg(volume) @) / nullif(stddev_samp(volume) @, 0)', -19, 0)}, 6) AS volume_z20,
 round(CASE WHEN close > 0 AND lag(close) OVER ({W}) > 0 THEN ln(close / lag(close) OVER ({W})) END, 6) AS log_return, round({_full('regr_slope(close, CAST(bar AS DOUBLE)) @', -19, 0)}, 6) AS slope20,
 round({_full('CASE WHEN max(high) @ > min(low) @ THEN 2 * (close - min(low) @) / (max(high) @ - min(low) @) - 1 ELSE 0 END', -19, 0)}, 6) AS range_pos FROM atr""")
def _(s, d):
    return rolled_of(s, d).select("symbol", "bar", "volume_z", "volume_z20", "log_return", "slope20", "range_pos")


@query("ind15_extremes_anatomy", f"WITH {BARS}{ROLLED} SELECT symbol, bar, {_cols('', 'prior_low, prior_high, lower_wick, upper_wick, body')} FROM rolled")
def _(s, d):
    return rolled_of(s, d).select("symbol", "bar", "prior_low", "prior_high", "lower_wick", "upper_wick", "body")


@query("ind21_trend_context", f"WITH {BARS}, c AS (SELECT symbol, bar, {_full('regr_slope(close, CAST(bar AS DOUBLE)) @', -20, -1)} AS sl, {_full('regr_r2(close, CAST(bar AS DOUBLE)) @', -20, -1)} AS r2 FROM bars) SELECT symbol, bar, round(sl, 6) AS ctx_slope, round(r2, 6) AS ctx_r2, CAST(CASE WHEN r2 >= 0.1 THEN sign(sl) ELSE 0 END AS INT) AS trend FROM c")
def _(s, d):
    return ind.add_trend_context(bars_of(s, d)).select("symbol", "bar", "ctx_slope", "ctx_r2", "trend")


@query("ind20_median_range", f"WITH {BARS} SELECT symbol, round(median(high - low), 6) AS median_range FROM bars GROUP BY 1")
def _(s, d):
    return pat.median_ranges(bars_of(s, d))


# --- levels and events

def _swing_sql(strict: bool) -> str:
    n = f"count(close) OVER {_frame(-2, 2)} = 5"
    if strict:
        low = f"low < min(low) OVER {_frame(-2, -1)} AND low < min(low) OVER {_frame(1, 2)}"
        high = f"high > max(high) OVER {_frame(-2, -1)} AND high > max(high) OVER {_frame(1, 2)}"
    else:
        low = f"low = min(low) OVER {_frame(-2, 2)} AND low < lag(low, 2) OVER ({W}) AND low < lead(low, 2) OVER ({W})"
        high = f"high = max(high) OVER {_frame(-2, 2)} AND high > lag(high, 2) OVER ({W}) AND high > lead(high, 2) OVER ({W})"
    return f""", sw0 AS (SELECT *, {n} AND {low} AS l, {n} AND {high} AS h FROM bars),
swings AS (SELECT symbol, bar, 'L' AS kind, low AS price, bar + 2 AS known_bar FROM sw0 WHERE l UNION ALL SELECT symbol, bar, 'H', high, bar + 2 FROM sw0 WHERE h)"""


for _name, _strict in (("lvl1_swing_levels", True), ("lvl2_pattern_swings", False)):
    query(_name, f"WITH {BARS}{_swing_sql(_strict)} SELECT symbol, bar, kind, round(price, 6) AS price, known_bar FROM swings")(lambda s, d, strict=_strict: ev.swings(bars_of(s, d), 2, 2, strict).drop("ts"))


@query("lvl5_previous_day_levels", f"WITH {BARS}{DAILY}, p AS (SELECT symbol, day, lag(high) OVER (PARTITION BY symbol ORDER BY day) AS h, lag(low) OVER (PARTITION BY symbol ORDER BY day) AS l FROM days), k AS (SELECT symbol, date_trunc('day', ts) AS day, min(bar) AS known_bar FROM bars GROUP BY 1, 2) SELECT k.symbol, known_bar, u.kind, round(u.price, 6) AS price FROM p JOIN k ON k.symbol = p.symbol AND k.day = p.day, LATERAL (SELECT 'H' AS kind, p.h AS price UNION ALL SELECT 'L', p.l) u WHERE u.price IS NOT NULL")
def _(s, d):
    return ev.previous_day_levels(bars_of(s, d)).select("symbol", "known_bar", "kind", "price")


@query("lvl7_lifecycle", f"""WITH {BARS}{_swing_sql(True)}, n AS (SELECT s.symbol, s.bar AS origin_bar, s.kind, s.price, s.known_bar, b.bar AS b, CASE WHEN kind = 'L' THEN abs(b.low - price) ELSE abs(b.high - price) END <= 0.5 AS t,
 CASE WHEN kind = 'L' THEN b.low < price AND b.close > price ELSE b.high > price AND b.close < price END AS sw, CASE WHEN kind = 'L' THEN b.close < price ELSE b.close > price END AS br FROM swings s JOIN bars b ON b.symbol = s.symbol AND b.bar BETWEEN s.known_bar + 1 AND s.known_bar + 48)
SELECT symbol, origin_bar, kind, round(price, 6) AS price, known_bar, count(*) FILTER (WHERE t) AS touch_count, coalesce(min(b) FILTER (WHERE sw), -1) AS swept_bar, coalesce(min(b) FILTER (WHERE br), -1) AS broken_bar,
 CASE WHEN bool_or(sw) THEN 'swept' WHEN bool_or(br) THEN 'invalidated' ELSE 'active' END AS status FROM n GROUP BY symbol, origin_bar, kind, price, known_bar""")
def _(s, d):
    bars = bars_of(s, d)
    return ev.level_lifecycle(ev.swings(bars), bars, 48, 0.5).fillna(-1, ["swept_bar", "broken_bar"])


@query("det1_sweeps", f"WITH {BARS}{SWEPT} SELECT symbol, bar, direction, round(level, 6) AS level, round(depth, 6) AS depth FROM sweeps")
def _(s, d):
    return ev.sweep_rows(ev.sweep_flags(rolled_of(s, d))).select("symbol", "bar", "direction", "level", "depth")


@query("det4_runs_deepest", f"WITH {BARS}{SWEPT}, r1 AS (SELECT *, CASE WHEN bar - lag(bar) OVER (PARTITION BY symbol, direction ORDER BY bar) <= 1 THEN 0 ELSE 1 END AS fresh FROM sweeps), r2 AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol, direction ORDER BY bar) AS run FROM r1) SELECT symbol, bar, direction, CAST(run AS BIGINT) AS run FROM r2 QUALIFY row_number() OVER (PARTITION BY symbol, direction, run ORDER BY depth DESC, bar) = 1")
def _(s, d):
    return ev.group_runs(ev.sweep_rows(ev.sweep_flags(rolled_of(s, d))), "deepest").select("symbol", "bar", "direction", "run")


@query("det6_deduplicated", f"WITH RECURSIVE {BARS}{COOLED} SELECT symbol, bar, direction FROM cooled")
def _(s, d):
    return cooled_of(s, d).select("symbol", "bar", "direction")


@query("det10_confirmations", f"WITH RECURSIVE {BARS}{COOLED}, c AS (SELECT e.symbol, e.bar, e.direction, min(b.bar) AS confirm_bar FROM cooled e JOIN bars b ON b.symbol = e.symbol AND b.bar BETWEEN e.bar + 1 AND e.bar + 8 AND CASE WHEN direction = 'long' THEN b.close > e.high ELSE b.close < e.low END GROUP BY ALL) SELECT e.symbol, e.bar, e.direction, coalesce(c.confirm_bar, -1) AS confirm_bar, coalesce(c.confirm_bar - e.bar, -1) AS delay FROM cooled e LEFT JOIN c ON c.symbol = e.symbol AND c.bar = e.bar AND c.direction = e.direction")
def _(s, d):
    return ev.confirmations(cooled_of(s, d), bars_of(s, d)).select("symbol", "bar", "direction", "confirm_bar", "delay").fillna(-1)


def _reversal_sql(n: int) -> str:
    last = n - 1
    leads = ", ".join(f"lead({c}, {i}) OVER w AS {c}{i}" for i in range(1, n) for c in ("bar", "kind", "price", "known_bar"))
    alternate = " AND ".join(f"kind{i} <> {'kind' if i == 1 else f'kind{i - 1}'}" for i in range(1, n))
    neck = "price1" if n == 3 else "CASE WHEN kind = 'L' THEN greatest(price1, price3) ELSE least(price1, price3) END"
    more = "" if n == 3 else " AND sgn * (price - price2) > 0 AND sgn * (price4 - price2) > 0"
    return f"""{_swing_sql(False)}, l AS (SELECT *, {leads} FROM swings WINDOW w AS (PARTITION BY symbol ORDER BY bar, kind DESC)),
m AS (SELECT *, CASE WHEN kind = 'L' THEN 1.0 ELSE -1.0 END AS sgn, {neck} AS neckline FROM l WHERE {alternate}), p AS (SELECT *, sgn * (neckline - price) AS depth FROM m),
pats AS (SELECT symbol, CASE WHEN kind = 'L' THEN 'bullish' ELSE 'bearish' END AS direction, bar AS start_bar, bar{last} AS end_bar, known_bar{last} AS detect_bar, neckline, depth FROM p WHERE depth > 0 AND abs(price{last} - price) <= 0.3 * depth{more}),
patterns AS (SELECT t.symbol, direction, start_bar, end_bar, detect_bar, neckline, depth, min(b.bar) AS confirm_bar FROM pats t JOIN bars b ON b.symbol = t.symbol AND b.bar BETWEEN detect_bar + 1 AND detect_bar + 12 AND CASE WHEN direction = 'bullish' THEN b.close > neckline ELSE b.close < neckline END GROUP BY ALL)"""


for _name, _n in (("det12_double_patterns", 3), ("det13_head_shoulders", 5)):
    query(_name, f"WITH {BARS}{_reversal_sql(_n)} SELECT symbol, direction, start_bar, end_bar, detect_bar, round(neckline, 6) AS neckline, round(depth, 6) AS depth, confirm_bar FROM patterns")(lambda s, d, n=_n: ev.reversals(ev.swings(b := bars_of(s, d), strict=False), b, n, 0.3))


@query("det16_suppressed_overlaps")
def _(s, d):
    bars = bars_of(s, d)
    return ev.suppress_overlaps(ev.reversals(ev.swings(bars, strict=False), bars, 3, 0.3)).select("symbol", "direction", "start_bar", "end_bar", "depth")


# --- joins

@query("j1_asof_backward", f"WITH {BARS}{_swing_sql(True)}, e AS (SELECT symbol, known_bar AS bar, max(price) AS level FROM swings WHERE kind = 'L' GROUP BY 1, 2) SELECT b.symbol, b.bar, round(e.level, 6) AS level FROM bars b ASOF LEFT JOIN e ON e.symbol = b.symbol AND b.bar >= e.bar")
def _(s, d):
    bars = bars_of(s, d)
    lows = ev.swings(bars).filter("kind = 'L'").groupBy("symbol", F.col("known_bar").alias("bar")).agg(F.max("price").alias("level"))
    return layout.asof_backward(bars.select("symbol", "bar", "close"), lows, "bar", ["level"]).select("symbol", "bar", "level")


@query("j2_asof_forward", f"WITH {BARS}, e AS (SELECT symbol, seq, ts FROM ticks) SELECT e.symbol, e.seq, coalesce(b.bar, -1) AS entry_bar FROM e ASOF LEFT JOIN bars b ON b.symbol = e.symbol AND e.ts <= b.ts")
def _(s, d):
    ticks = src.ticks_of(s, d).select("symbol", "ts", "seq")
    bars = bars_of(s, d).select("symbol", "ts", F.col("bar").alias("entry_bar"))
    return layout.asof_backward(ticks, bars, "ts", ["entry_bar"], forward=True).select("symbol", "seq", "entry_bar").fillna(-1)


@query("j8_events_with_outcomes", f"WITH RECURSIVE {BARS}{_outcomes('labels')} SELECT c.symbol, c.direction, c.bar, round(o.result_r, 6) AS result_r, o.exit_reason FROM cooled c LEFT JOIN outcomes o ON o.symbol = c.symbol AND o.direction = c.direction AND o.entry_bar = c.bar WHERE NOT o.truncated")
def _(s, d):
    o = outcomes_of(s, d).select("symbol", "direction", F.col("entry_bar").alias("bar"), "result_r", "exit_reason", "truncated")
    return cooled_of(s, d).select("symbol", "direction", "bar").join(o, ["symbol", "direction", "bar"], "left").filter("not truncated").drop("truncated")


@query("j9_nearest_level", f"WITH RECURSIVE {BARS}{COOLED}{_swing_sql(True)} SELECT c.symbol, c.bar, c.direction, arg_min(s.bar, (abs(c.close - s.price), s.bar)) AS level_bar, round(min(abs(c.close - s.price)), 6) AS distance FROM cooled c JOIN swings s ON s.symbol = c.symbol AND s.known_bar BETWEEN c.bar - 48 AND c.bar AND s.kind = CASE WHEN c.direction = 'long' THEN 'L' ELSE 'H' END GROUP BY 1, 2, 3")
def _(s, d):
    c = cooled_of(s, d).select("symbol", "direction", F.col("bar").alias("event_bar"), "close", (F.col("bar") - 48).alias("_from"), F.col("bar").alias("_to"))
    levels = ev.swings(bars_of(s, d)).select("symbol", F.col("known_bar").alias("k"), "kind", "price", F.col("bar").alias("level_bar"))
    near = layout.range_join(c.withColumn("_from", F.greatest(F.col("_from"), F.lit(0))), levels, "_from", "_to", 48, order="k").filter("kind = if(direction = 'long', 'L', 'H')")
    far = F.abs(F.col("close") - F.col("price"))
    return near.groupBy("symbol", F.col("event_bar").alias("bar"), "direction").agg(F.min_by("level_bar", F.struct(far, "level_bar")).alias("level_bar"), F.min(far).alias("distance"))


@query("j12_overlapping_events", f"WITH {BARS}{_reversal_sql(3)} SELECT symbol, direction, count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM patterns q WHERE q.symbol = p.symbol AND q.direction = p.direction AND (q.start_bar, q.end_bar) <> (p.start_bar, p.end_bar) AND q.start_bar <= p.end_bar AND p.start_bar <= q.end_bar)) AS overlapping FROM patterns p GROUP BY 1, 2")
def _(s, d):
    bars = bars_of(s, d)
    return ev.overlap_counts(ev.reversals(ev.swings(bars, strict=False), bars, 3, 0.3))


# --- outcomes, reports

for _name, _preset in (("out2_triple_barrier", "labels"), ("out7_stored_outcomes", "stored"), ("out9_fixed_horizon", "fixed"), ("out10_backtest_fills", "backtest")):
    query(_name, f"WITH RECURSIVE {BARS}{_outcomes(_preset)} SELECT symbol, direction, entry_bar, exit_reason, exit_bar, {_cols('', 'result_r, mfe_r, mae_r')}, truncated, bars_held FROM outcomes")(
        lambda s, d, preset=_preset: outcomes_of(s, d, preset).select("symbol", "direction", "entry_bar", "exit_reason", "exit_bar", "result_r", "mfe_r", "mae_r", "truncated", "bars_held")
    )

PF = "CASE WHEN count(x) = 0 THEN 0 WHEN coalesce(sum(x) FILTER (WHERE x < 0), 0) = 0 THEN CASE WHEN coalesce(sum(x) FILTER (WHERE x > 0), 0) > 0 THEN CAST('inf' AS DOUBLE) ELSE 0 END ELSE coalesce(sum(x) FILTER (WHERE x > 0), 0) / abs(sum(x) FILTER (WHERE x < 0)) END"
RES = f"WITH RECURSIVE {BARS}{_outcomes('labels')}, res AS (SELECT *, result_r AS x FROM outcomes WHERE result_r IS NOT NULL)"
METRICS = f"{RES} SELECT symbol, count(x) AS n, round({PF}, 6) AS pf, round(sum(x), 6) AS total_r, round(avg(x), 6) AS expectancy, round(avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM res GROUP BY symbol"


def results_of(s: SparkSession, d: str) -> DataFrame:
    return outcomes_of(s, d).filter("result_r is not null")


@query("agg2_result_metrics", METRICS)
def _(s, d):
    return rep.result_metrics(results_of(s, d), ["symbol"])


def flagship(s: SparkSession, d: str, rule: str = "1 hour") -> DataFrame:
    """Sweeps of bars of ``rule``, their barrier outcomes, and the report of each symbol."""
    bars = saved(src.bars_ev(s, d, rule), "bars")
    done = out.barrier_outcomes(out.trade_levels(cooled_of(s, d, bars)), bars, 16)
    return rep.result_metrics(done.filter("result_r is not null"), ["symbol"])


query("flagship", METRICS)(flagship)


@query("agg3_drawdown", f"{RES}, c AS (SELECT symbol, entry_bar, direction, sum(x) OVER w AS c FROM res WINDOW w AS (PARTITION BY symbol ORDER BY entry_bar, direction)), p AS (SELECT *, max(c) OVER (PARTITION BY symbol ORDER BY entry_bar, direction) AS p FROM c) SELECT symbol, round(max(p - c), 6) AS max_drawdown, round(arg_max(c, (entry_bar, direction)), 6) AS final_r FROM p GROUP BY 1")
def _(s, d):
    return rep.max_drawdown(results_of(s, d), ["symbol"], ["entry_bar", "direction"])


@query("agg4_rolling_pf", f"{RES} SELECT symbol, entry_bar, direction, round(CASE WHEN count(x) OVER w >= 10 THEN sum(CASE WHEN x > 0 THEN x ELSE 0 END) OVER w / nullif(abs(sum(CASE WHEN x < 0 THEN x ELSE 0 END) OVER w), 0) END, 6) AS rolling_pf FROM res WINDOW w AS (PARTITION BY symbol ORDER BY entry_bar, direction ROWS 19 PRECEDING)")
def _(s, d):
    return rep.rolling_pf(results_of(s, d), ["symbol"], ["entry_bar", "direction"]).select("symbol", "entry_bar", "direction", "rolling_pf")


SCORED = "WITH d AS (SELECT doc_id, lang, n_chars FROM documents), z AS (SELECT lang, CAST(quality AS INT) AS label, least(n_chars, 10000) / 10000.0 AS score FROM d JOIN labels USING (doc_id))"


def scored_of(s: SparkSession, d: str) -> DataFrame:
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "n_chars")
    return docs.join(s.read.parquet(f"{d}/labels.parquet"), "doc_id").select("lang", F.col("quality").cast("int").alias("label"), (F.least("n_chars", F.lit(10000)) / 10000.0).alias("score"))


@query("agg6_binary_metrics", f"""{SCORED}, s AS (SELECT lang, score, CAST(sum(label) AS DOUBLE) AS p, CAST(count(*) AS DOUBLE) AS m, sum(pow(score - label, 2)) AS se, sum(CASE WHEN CAST(score >= 0.5 AS INT) = label THEN 1.0 ELSE 0 END) AS hit FROM z GROUP BY 1, 2),
r AS (SELECT *, sum(p) OVER (PARTITION BY lang ORDER BY score DESC) AS tp, sum(m) OVER (PARTITION BY lang ORDER BY score DESC) AS above, sum(m) OVER (PARTITION BY lang ORDER BY score) - (m - 1) / 2 AS rk FROM s)
SELECT lang, CAST(sum(m) AS BIGINT) AS n, CAST(sum(p) AS BIGINT) AS positives, round((sum(p * rk) - sum(p) * (sum(p) + 1) / 2) / nullif(sum(p) * (sum(m) - sum(p)), 0), 6) AS roc_auc, round(sum(p * tp / above) / nullif(sum(p), 0), 6) AS pr_auc, round(sum(se) / sum(m), 6) AS brier, round(sum(hit) / sum(m), 6) AS accuracy FROM r GROUP BY 1""")
def _(s, d):
    return rep.binary_metrics(scored_of(s, d), ["lang"])


@query("agg7_calibration", f"{SCORED}, b AS (SELECT least(CAST(floor(score * 10) AS BIGINT), 9) AS bin, count(*) AS n, avg(score) AS ms, avg(CAST(label AS DOUBLE)) AS ml FROM z GROUP BY 1) SELECT bin, n, round(ms, 6) AS mean_score, round(ml, 6) AS mean_label, round((SELECT sum(abs(ms - ml) * n) / sum(n) FROM b), 6) AS ece FROM b")
def _(s, d):
    return rep.calibration(scored_of(s, d))


@query("agg8_co_occurrence", "WITH h AS (SELECT DISTINCT user_id AS g, event_type AS i FROM events), n AS (SELECT i, count(*) AS n FROM h GROUP BY 1) SELECT x.i AS a, y.i AS b, count(*) AS both, round(count(*) / max(n.n), 6) AS share FROM h x JOIN h y ON x.g = y.g JOIN n ON n.i = x.i GROUP BY 1, 2")
def _(s, d):
    return rep.co_occurrence(s.read.parquet(f"{d}/events.parquet"), "user_id", "event_type")


@query("agg11_score_buckets", f"{SCORED}, q AS (SELECT CASE WHEN score * 100 BETWEEN 0 AND 39 THEN '0-39' WHEN score * 100 BETWEEN 40 AND 49 THEN '40-49' WHEN score * 100 BETWEEN 50 AND 59 THEN '50-59' WHEN score * 100 BETWEEN 60 AND 69 THEN '60-69' WHEN score * 100 BETWEEN 70 AND 79 THEN '70-79' WHEN score * 100 BETWEEN 80 AND 100 THEN '80-100' ELSE 'unknown' END AS bucket, label FROM z) SELECT bucket, count(*) AS n, round(avg(label), 6) AS win_rate FROM q GROUP BY 1")
def _(s, d):
    x = F.col("score") * 100
    bucket = score_bucket(x)
    return scored_of(s, d).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("win_rate"))


@query("agg13_performance_interval", f"{RES} SELECT symbol, count(x) AS n, round(avg(x), 6) AS mean_r, round(CASE WHEN count(x) >= 4 THEN avg(x) - 1.96 * stddev_samp(x) / sqrt(count(x)) END, 6) AS low, round(CASE WHEN count(x) >= 4 THEN avg(x) + 1.96 * stddev_samp(x) / sqrt(count(x)) END, 6) AS high FROM res GROUP BY 1")
def _(s, d):
    half = 1.96 * F.stddev_samp("result_r") / F.sqrt(F.count("result_r"))
    enough = F.count("result_r") >= 4
    return results_of(s, d).groupBy("symbol").agg(F.count("result_r").alias("n"), F.avg("result_r").alias("mean_r"), F.when(enough, F.avg("result_r") - half).alias("low"), F.when(enough, F.avg("result_r") + half).alias("high"))


@query("agg15_gate_sweep", f"{RES}, arms AS (SELECT unnest([1.0, 1.5, 2.0, 3.0]) AS max_mae) SELECT max_mae, count(x) AS n, round({PF}, 6) AS pf FROM res, arms WHERE mae_r <= max_mae GROUP BY 1")
def _(s, d):
    arms = {str(m): F.col("mae_r") <= m for m in (1.0, 1.5, 2.0, 3.0)}
    swept = rep.gate_arms(results_of(s, d), arms, F.lit(False)).filter("part = 'all'")
    return swept.select(F.col("arm").cast("double").alias("max_mae"), "n", "pf")


@query("agg18_exit_audit", f"WITH RECURSIVE {BARS}{_outcomes('stored')} SELECT symbol, exit_reason, count(*) AS n, round(avg(result_r), 6) AS mean_r, round(avg(bars_held), 6) AS mean_bars FROM outcomes GROUP BY 1, 2")
def _(s, d):
    return outcomes_of(s, d, "stored").groupBy("symbol", "exit_reason").agg(F.count(F.lit(1)).alias("n"), F.avg("result_r").alias("mean_r"), F.avg("bars_held").alias("mean_bars"))


@query("sta1_psi", """WITH z AS (SELECT event_type AS symbol, value, ts < TIMESTAMP '2024-01-16' AS base FROM events), e AS (SELECT symbol, list_distinct(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edges FROM z WHERE base GROUP BY 1),
c AS (SELECT z.symbol, len(list_filter(edges, lambda x: x < value)) AS b, count(*) FILTER (WHERE base) AS e, count(*) FILTER (WHERE NOT base) AS a FROM z JOIN e ON e.symbol = z.symbol GROUP BY 1, 2),
p AS (SELECT symbol, greatest(e / sum(e) OVER (PARTITION BY symbol), 0.0001) AS e, greatest(a / sum(a) OVER (PARTITION BY symbol), 0.0001) AS a FROM c) SELECT symbol, round(sum((a - e) * ln(a / e)), 6) AS psi FROM p GROUP BY 1""")
def _(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("symbol"), "value", "ts")
    return rep.psi(e, "value", F.col("ts") < F.lit("2024-01-16").cast("timestamp"), ["symbol"])


@query("sta12_loss_runs", f"{RES}, l AS (SELECT symbol, entry_bar, direction, CAST(x < 0 AS INT) AS l, sum(CAST(x >= 0 AS INT)) OVER (PARTITION BY symbol ORDER BY entry_bar, direction) AS g FROM res), r AS (SELECT symbol, g, sum(l) AS run FROM l GROUP BY 1, 2) SELECT symbol, CAST(max(run) AS BIGINT) AS longest, CAST(arg_max(run, g) AS BIGINT) AS at_end FROM r GROUP BY 1")
def _(s, d):
    return rep.loss_runs(results_of(s, d), ["symbol"], ["entry_bar", "direction"])


@query("sta3_bootstrap_pf")
def _(s, d):
    return rep.bootstrap_pf(results_of(s, d).withColumn("row_id", F.xxhash64("symbol", "direction", "entry_bar")), ["symbol"], "row_id")


@query("mod1_time_split", f"WITH RECURSIVE {BARS}{COOLED}, n AS (SELECT symbol, bar, direction, row_number() OVER (PARTITION BY symbol ORDER BY bar, direction) AS place, count(*) OVER (PARTITION BY symbol) AS n FROM cooled) SELECT symbol, bar, direction, CASE WHEN place <= round_even(n * 0.6, 0) THEN 'train' WHEN place <= round_even(n * 0.8, 0) THEN 'val' ELSE 'test' END AS split FROM n")
def _(s, d):
    return grp.time_split(cooled_of(s, d), ["bar", "direction"]).select("symbol", "bar", "direction", "split")


@query("mod2_purge_embargo")
def _(s, d):
    return grp.purge_and_embargo(grp.time_split(cooled_of(s, d), ["bar", "direction"]), 16, 4).select("symbol", "bar", "direction", "split", "used")


@query("mod5_walk_forward", f"WITH RECURSIVE {BARS}{COOLED}, n AS (SELECT symbol, bar, direction, row_number() OVER (PARTITION BY symbol ORDER BY bar, direction) - 1 AS place, count(*) OVER (PARTITION BY symbol) AS n FROM cooled), p AS (SELECT *, least(place // greatest(n // 4, 1), 3) AS s FROM n), f AS (SELECT unnest([0, 1, 2]) AS fold) SELECT symbol, bar, direction, fold, CASE WHEN s = fold + 1 THEN 'test' ELSE 'train' END AS role FROM p, f WHERE s <= fold + 1")
def _(s, d):
    return grp.walk_forward(cooled_of(s, d), 3, ["bar", "direction"]).select("symbol", "bar", "direction", "fold", "role")


def _numbered(s: SparkSession, d: str) -> DataFrame:
    # ids by content, so that every use of the plan gives the same, and SQL too: 52 bits of an MD5
    text = F.concat_ws(":", "symbol", "direction", F.col("bar").cast("string"))
    return cooled_of(s, d).withColumn("event_id", F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long"))


@query("grp1_correlated_groups")
def _(s, d):
    g = grp.correlated_groups(_numbered(s, d), 12, 1.0)
    return g.groupBy("symbol", "direction", "group_id").agg(F.count(F.lit(1)).alias("members"), F.min("bar").alias("first_bar"), F.max("bar").alias("last_bar"))


@query("grp2_best_of_group")
def _(s, d):
    g = grp.correlated_groups(_numbered(s, d), 12, 1.0)
    return grp.best_of_group(g, F.col("depth")).select("symbol", "direction", "bar", "group_id", "discard_reason")


@query("gat2_probability_gate", f"WITH RECURSIVE {BARS}{COOLED} SELECT symbol, bar, direction, (CASE WHEN bar % 7 = 0 THEN true ELSE depth / 3 >= 0.2 END) AND body_share >= 0.3 AS passes FROM (SELECT *, abs(close - open) / nullif(high - low, 0) AS body_share FROM cooled)")
def _(s, d):
    e = cooled_of(s, d).withColumn("model_prob", F.when(F.col("bar") % 7 != 0, F.col("depth") / 3)).withColumn("rule_score", F.expr("abs(close - open) / nullif(high - low, 0)"))
    return grp.probability_gate(e, 0.2, 0.3).select("symbol", "bar", "direction", "passes")


@query("prt2_exposure_replay")
def _(s, d):
    text = F.concat_ws(":", "symbol", "direction", F.col("entry_bar").cast("string"))
    t = outcomes_of(s, d, "backtest").withColumn("event_id", F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long"))
    return grp.exposure_replay(t, 2).select("symbol", "direction", "entry_bar", "exit_bar", "executed")


# --- models, regimes, streams

@query("reg3_regime_filter")
def _(s, d):
    from .operators import models

    rows = ind.add_rolling(bars_of(s, d)).select("symbol", "bar", F.coalesce("log_return", F.lit(0.0)).alias("x"))
    return models.regime_filter(rows, (-0.5, 0.0, 0.5), (1.0, 0.5, 1.0))


def _labelled(s: SparkSession, d: str) -> DataFrame:
    rolled = rolled_of(s, d).select("symbol", F.col("bar").alias("entry_bar"), "body", "lower_wick", "upper_wick", "volume_z20", "range_pos", "slope20")
    return results_of(s, d).withColumn("label", (F.col("result_r") > 0).cast("int")).select("symbol", "direction", "entry_bar", "label").join(rolled, ["symbol", "entry_bar"])


@query("mod6_scored_events")
def _(s, d):
    from .operators import models

    split = grp.time_split(_labelled(s, d), ["entry_bar", "direction"], keys=("symbol",)).persist()
    model = models.fit_scorer(split.filter("split = 'train'"), ["body", "lower_wick", "upper_wick", "volume_z20", "range_pos", "slope20"])
    return models.score_rows(model, split).select("symbol", "direction", "entry_bar", "split", "label", "score")


@query("mod7_calibrated_labels")
def _(s, d):
    from .operators import models

    scored = scored_of(s, d)
    return models.calibrate(scored).transform(scored.select("lang", "label", "score")).groupBy("lang").agg(F.avg("prediction").alias("mean_calibrated"), F.avg("label").alias("mean_label"))


@query("str1_closed_bars", f"WITH {BARS}, m AS (SELECT max(ts) AS m FROM events) SELECT symbol, {SQL_EPOCH}, {_cols('', 'open, high, low, close, volume')} FROM bars, m WHERE bars.ts + INTERVAL '1 hour' <= m.m - INTERVAL '10 minutes'")
def _(s, d):
    from .plans.folders import shared_folder
    from .streaming.bars import closed_bars

    events = s.readStream.schema(s.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parquet*")
    ticks = events.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1.0).alias("volume"))
    path = shared_folder(s, "bars")
    stream = closed_bars(ticks, "1 hour", "10 minutes").writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{path}-state").start(path)
    stream.processAllAvailable()
    stream.stop()
    return s.read.parquet(path).selectExpr("symbol", EPOCH, *src.OHLCV)


from . import feature_queries, further_queries, more_queries, passage_queries, pattern_queries, trade_queries  # noqa: E402, F401  register their own queries
