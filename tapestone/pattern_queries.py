"""Registered queries of whole patterns: trades of doubles, heads, wedges and sweeps, lines and channels, suppression and the benchmark join."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import indicators as ind
from .operators import events as ev
from .operators import patterns as pat
from .plans.folders import saved
from .queries import ATR, BARS, ORACLE, _full, _reversal_sql, _swing_sql, bars_of, query

DOUBLE = {"left": 2, "right": 2, "min_apart": 1, "max_offset": 0.5, "min_depth": 0.5, "min_reward": 0.5, "max_length": 9, "min_score": 0.55, "trend": (20, 0.001, 0.01), "max_wait": 24}
HEADS = {"left": 2, "right": 2, "min_apart": 1, "max_shoulder": 1.5, "max_neck": 1.5, "min_head": 0.5, "min_head_ranges": 0.5, "min_bars": 4, "max_wait": 24}
WEDGE = {"left": 1, "right": 1, "min_apart": 1, "min_depth": 0.2, "min_ranges": 0.2, "min_bars": 4, "max_error": 2.0, "min_convergence": 0.01, "min_inside": 0.5, "max_wait": 24}
COLS = ("symbol", "pattern", "start_bar", "end_bar", "confirm_bar", "entry_bar", "entry", "stop", "target", "rule_score", "depth_atr", "offset_atr", "discard_reason")
PICK = "symbol, pattern, start_bar, end_bar, confirm_bar, entry_bar, round(entry, 6) AS entry, round(stop, 6) AS stop, round(target, 6) AS target, round(rule_score, 6) AS rule_score, round(depth_atr, 6) AS depth_atr, round(offset_atr, 6) AS offset_atr, discard_reason"


def atr_bars(s, d):
    """Bars with ATR as a table: the patterns read them several times."""
    return saved(ind.add_atr(bars_of(s, d)), "bars")


def _chain_sql(n: int, source: str = "swings") -> str:
    leads = ", ".join(f"lead({c}, {i}) OVER w AS {name}{i}" for i in range(n) for c, name in (("bar", "bar"), ("price", "price"), ("kind", "kind"), ("known_bar", "known")))
    return f"SELECT symbol, {leads} FROM {source} WINDOW w AS (PARTITION BY symbol ORDER BY bar, kind DESC)"


def _swings_sql(n: int) -> str:
    """Looser swings that reach ``n`` bars to either side."""
    if n == 2:
        return _swing_sql(False)
    w = "OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN {0} PRECEDING AND {0} FOLLOWING)".format(n)
    o = "OVER (PARTITION BY symbol ORDER BY bar)"
    return f""", sw0 AS (SELECT *, count(close) {w} = {2 * n + 1} AND low = min(low) {w} AND low < lag(low, {n}) {o} AND low < lead(low, {n}) {o} AS l, count(close) {w} = {2 * n + 1} AND high = max(high) {w} AND high > lag(high, {n}) {o} AND high > lead(high, {n}) {o} AS h FROM bars),
swings AS (SELECT symbol, bar, 'L' AS kind, low AS price, bar + {n} AS known_bar FROM sw0 WHERE l UNION ALL SELECT symbol, bar, 'H', high, bar + {n} FROM sw0 WHERE h)"""


def _entered_sql(source: str, out: str, level: str, wait: int) -> str:
    return f""", {out}0 AS (SELECT c.*, (SELECT min(b.bar) FROM bars b WHERE b.symbol = c.symbol AND b.bar BETWEEN c.end_bar + 1 AND c.end_bar + {wait} AND c.sgn * (b.close - ({level})) > 0) AS cross_bar FROM {source} c),
{out}1 AS (SELECT *, greatest(cross_bar, detect_bar) AS confirm_bar FROM {out}0 WHERE cross_bar IS NOT NULL),
{out}2 AS (SELECT e.*, b.close AS confirm_close, n.open AS nopen FROM {out}1 e JOIN bars b ON b.symbol = e.symbol AND b.bar = e.confirm_bar LEFT JOIN bars n ON n.symbol = e.symbol AND n.bar = e.confirm_bar + 1),
{out} AS (SELECT *, confirm_bar + CAST(nopen IS NOT NULL AS INT) AS entry_bar, coalesce(nopen, confirm_close) AS entry FROM {out}2)"""


SYM = "(1 - least(abs(left_len - right_len) / CAST(greatest(left_len, right_len) AS DOUBLE), 1))"
MED = ", med AS (SELECT symbol, median(high - low) AS median_range FROM bars GROUP BY 1)"


def _double_sql(p: dict) -> str:
    lookback, slope, r2 = p["trend"]
    return f"""{ATR}{_swings_sql(p['left'])}, c3 AS ({_chain_sql(3)}),
d0 AS (SELECT c.symbol, CASE WHEN kind0 = 'L' THEN 'bullish' ELSE 'bearish' END AS direction, CASE WHEN kind0 = 'L' THEN 1.0 ELSE -1.0 END AS sgn, bar0 AS start_bar, bar1 AS neck_bar, bar2 AS end_bar, known2 AS detect_bar, price1 AS neckline, price0, price2, bar1 - bar0 AS left_len, bar2 - bar1 AS right_len, a.atr AS atr_k
 FROM c3 c JOIN atr a ON a.symbol = c.symbol AND a.bar = c.known2 WHERE kind0 = kind2 AND kind0 <> kind1 AND bar0 < bar1 AND bar1 < bar2 AND a.atr > 0),
d1 AS (SELECT *, sgn * (neckline - CASE WHEN sgn > 0 THEN greatest(price0, price2) ELSE least(price0, price2) END) AS depth, CASE WHEN sgn > 0 THEN least(price0, price2) ELSE greatest(price0, price2) END AS extreme, abs(price0 - price2) / atr_k AS offset_atr FROM d0),
d2 AS (SELECT * FROM d1 WHERE least(left_len, right_len) >= {p['min_apart']} AND offset_atr <= {p['max_offset']} AND depth >= {p['min_depth']} * atr_k AND depth >= 0)
{_entered_sql('d2', 'd3', 'c.neckline', p['max_wait'])},
d4 AS (SELECT *, extreme - sgn * 0.5 * atr_k AS stop, abs(entry - (extreme - sgn * 0.5 * atr_k)) AS risk FROM d3),
d5 AS (SELECT *, entry + sgn * 1.5 * risk AS target, depth / atr_k AS depth_atr, least(1.0, 0.40 * least(depth / atr_k / {p['min_depth']}, 1) + 0.25 * {SYM} + 0.20 * (1 - least(offset_atr / {p['max_offset']}, 1)) + 0.15 * least(sgn * (confirm_close - neckline) / atr_k, 1)) AS rule_score FROM d4 WHERE risk > 0 AND 1.5 >= {p['min_reward']}),
ctx AS (SELECT symbol, bar, atr, {_full('regr_slope(close, CAST(bar AS DOUBLE)) @', -lookback, -1)} AS sl, {_full('regr_r2(close, CAST(bar AS DOUBLE)) @', -lookback, -1)} AS r2 FROM atr),
doubles AS (SELECT d.*, CASE WHEN direction = 'bullish' THEN 'double_bottom' ELSE 'double_top' END AS pattern, CASE WHEN end_bar - start_bar > {p['max_length']} THEN 'pattern_too_long' WHEN rule_score < {p['min_score']} THEN 'low_rule_score'
 WHEN NOT coalesce(-sgn * sl > 0 AND r2 >= {r2} AND CASE WHEN c.atr > 0 THEN abs(sl) / c.atr >= {slope} ELSE false END, false) THEN 'low_trend_context' END AS discard_reason FROM d5 d LEFT JOIN ctx c ON c.symbol = d.symbol AND c.bar = d.start_bar)"""


def _heads_sql(p: dict) -> str:
    order = " AND ".join(f"kind{i} <> kind{i - 1} AND bar{i} - bar{i - 1} >= 1" for i in range(1, 5))
    return f"""{ATR}{MED}{_swings_sql(p['left'])}, c5 AS ({_chain_sql(5)}),
h0 AS (SELECT c.symbol, CASE WHEN kind0 = 'L' THEN 'bullish' ELSE 'bearish' END AS direction, CASE WHEN kind0 = 'L' THEN 1.0 ELSE -1.0 END AS sgn, bar0 AS start_bar, bar1 AS neck_bar, bar4 AS end_bar, known4 AS detect_bar, CASE WHEN kind0 = 'L' THEN least(price1, price3) ELSE greatest(price1, price3) END AS neckline,
 bar2 - bar0 AS left_len, bar4 - bar2 AS right_len, price0, price1, price2, price3, price4, a.atr AS atr_k, m.median_range FROM c5 c JOIN atr a ON a.symbol = c.symbol AND a.bar = c.known4 JOIN med m ON m.symbol = c.symbol WHERE a.atr > 0 AND {order}),
h1 AS (SELECT *, sgn * (neckline - price2) AS depth, abs(price0 - price4) / atr_k AS offset_atr, abs(price1 - price3) / atr_k AS neck_offset FROM h0),
h2 AS (SELECT * FROM h1 WHERE sgn * (price0 - price2) > 0 AND sgn * (price4 - price2) > 0 AND depth >= {p['min_head']} * atr_k AND depth >= {p['min_head_ranges']} * median_range AND offset_atr <= {p['max_shoulder']} AND neck_offset <= {p['max_neck']} AND end_bar - start_bar >= {p['min_bars']})
{_entered_sql('h2', 'h3', 'c.neckline', p['max_wait'])},
h4 AS (SELECT *, price2 - sgn * 0.5 * atr_k AS stop, abs(entry - (price2 - sgn * 0.5 * atr_k)) AS risk FROM h3),
heads AS (SELECT *, CASE WHEN direction = 'bullish' THEN 'inverse_head_shoulders' ELSE 'head_shoulders' END AS pattern, entry + sgn * 1.5 * risk AS target, depth / atr_k AS depth_atr, CAST(NULL AS VARCHAR) AS discard_reason,
 least(1.0, 0.40 * least(depth / atr_k / {p['min_head']}, 1) + 0.20 * (1 - least(offset_atr / {p['max_shoulder']}, 1)) + 0.15 * (1 - least(neck_offset / {p['max_neck']}, 1)) + 0.15 * {SYM} + 0.10 * least(sgn * (confirm_close - neckline) / atr_k, 1)) AS rule_score FROM h4 WHERE risk > 0)"""


def _channel_sql(p: dict, atr: str = "atr", slack: float = 0.8, inside_from: int = 0) -> str:
    line = lambda n, b: f"({n}_slope * {b} + {n}_icept)"
    width = lambda b: f"({line('u', b)} - {line('l', b)})"
    return f""", lows AS (SELECT * FROM swings WHERE kind = 'L'), highs AS (SELECT * FROM swings WHERE kind = 'H'), c3l AS ({_chain_sql(3, 'lows')}),
w0 AS (SELECT c.symbol, CASE WHEN price0 > price2 THEN 'bullish' ELSE 'bearish' END AS direction, CASE WHEN price0 > price2 THEN 1.0 ELSE -1.0 END AS sgn, bar0 AS start_bar, bar1 AS mid_bar, bar2 AS end_bar, known2 AS detect_bar, price0, price1, price2, abs(price0 - price2) AS depth, a.atr AS atr_k, m.median_range
 FROM c3l c JOIN {atr} a ON a.symbol = c.symbol AND a.bar = c.known2 JOIN med m ON m.symbol = c.symbol WHERE a.atr > 0 AND bar1 - bar0 >= {p['min_apart']} AND bar2 - bar1 >= {p['min_apart']} AND ((price0 > price1 AND price1 > price2) OR (price0 < price1 AND price1 < price2))),
w1 AS (SELECT * FROM w0 WHERE depth >= {p['min_depth']} * atr_k AND depth >= {p['min_ranges']} * median_range AND end_bar - start_bar >= {p['min_bars']}),
hw AS (SELECT w.symbol, w.start_bar, w.end_bar, w.sgn, h.bar, h.price, lag(h.price) OVER (PARTITION BY w.symbol, w.start_bar, w.end_bar ORDER BY h.bar) AS before FROM w1 w JOIN highs h ON h.symbol = w.symbol AND h.bar > w.start_bar AND h.bar < w.end_bar),
up AS (SELECT symbol, start_bar, end_bar, regr_slope(price, CAST(bar AS DOUBLE)) AS u_slope, regr_intercept(price, CAST(bar AS DOUBLE)) AS u_icept, min(bar) AS first_high, max(bar) AS last_high, max(price) AS highest FROM hw GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND bool_and(coalesce(sgn * (before - price) > 0, true))),
pts AS (SELECT symbol, start_bar, end_bar, unnest([start_bar, mid_bar, end_bar]) AS bar, unnest([price0, price1, price2]) AS price FROM w1),
lo AS (SELECT symbol, start_bar, end_bar, regr_slope(price, CAST(bar AS DOUBLE)) AS l_slope, regr_intercept(price, CAST(bar AS DOUBLE)) AS l_icept FROM pts GROUP BY 1, 2, 3),
ue AS (SELECT u.symbol, u.start_bar, u.end_bar, max(abs(h.price - {line('u', 'h.bar')})) AS u_error FROM up u JOIN hw h USING (symbol, start_bar, end_bar) GROUP BY 1, 2, 3),
le AS (SELECT l.symbol, l.start_bar, l.end_bar, max(abs(p.price - {line('l', 'p.bar')})) AS l_error FROM lo l JOIN pts p USING (symbol, start_bar, end_bar) GROUP BY 1, 2, 3),
w2 AS (SELECT *, greatest(u_error, l_error) / atr_k AS line_error FROM w1 JOIN up USING (symbol, start_bar, end_bar) JOIN lo USING (symbol, start_bar, end_bar) JOIN ue USING (symbol, start_bar, end_bar) JOIN le USING (symbol, start_bar, end_bar)),
w3 AS (SELECT *, CASE WHEN {width('first_high')} > 0 THEN 1 - {width('last_high')} / {width('first_high')} ELSE 0 END AS convergence FROM w2 WHERE line_error <= {p['max_error']}),
ins AS (SELECT w.symbol, w.start_bar, w.end_bar, avg(CASE WHEN b.close BETWEEN {line('l', 'b.bar')} - {slack} * atr_k AND {line('u', 'b.bar')} + {slack} * atr_k THEN 1.0 ELSE 0.0 END) AS inside FROM w3 w JOIN bars b ON b.symbol = w.symbol AND b.bar >= w.start_bar + {inside_from} AND b.bar < w.end_bar GROUP BY 1, 2, 3),
chan AS (SELECT * FROM w3 JOIN ins USING (symbol, start_bar, end_bar) WHERE convergence >= {p['min_convergence']} AND {width('end_bar')} > 0 AND inside >= {p['min_inside']})"""


def _wedge_sql(p: dict) -> str:
    line = "(CASE WHEN c.sgn > 0 THEN c.u_slope * {0} + c.u_icept ELSE c.l_slope * {0} + c.l_icept END)"
    own = line.replace("c.", "")
    return f"""{ATR}{MED}{_swings_sql(p['left'])}{_channel_sql(p)}{_entered_sql('chan', 'w4', line.format('b.bar'), p['max_wait'])},
w5 AS (SELECT *, CASE WHEN sgn > 0 THEN least(price0, price1, price2) ELSE highest END - sgn * 0.5 * atr_k AS stop FROM w4),
wedged AS (SELECT *, CASE WHEN direction = 'bullish' THEN 'falling_wedge' ELSE 'rising_wedge' END AS pattern, entry + sgn * 1.5 * abs(entry - stop) AS target, depth / atr_k AS depth_atr, line_error AS offset_atr, CAST(NULL AS VARCHAR) AS discard_reason, CAST(NULL AS BIGINT) AS neck_bar, mid_bar - start_bar AS left_len, end_bar - mid_bar AS right_len, {own.format('detect_bar')} AS neckline,
 least(1.0, 0.35 * least(depth / atr_k / {p['min_depth']}, 1) + 0.25 * least(greatest(convergence, 0) / 0.3, 1) + 0.20 * least(inside, 1) + 0.20 * least(sgn * (confirm_close - {own.format('confirm_bar')}) / atr_k, 1)) AS rule_score FROM w5 WHERE abs(entry - stop) > 0)"""


@query("det12_double_trades", f"WITH {BARS}{_double_sql(DOUBLE)} SELECT {PICK} FROM doubles")
def _(s, d):
    return pat.double_patterns(atr_bars(s, d), **DOUBLE).select(*COLS)


@query("det13_head_shoulders_trades", f"WITH {BARS}{_heads_sql(HEADS)} SELECT {PICK} FROM heads")
def _(s, d):
    return pat.head_shoulders(atr_bars(s, d), **HEADS).select(*COLS)


@query("det14_wedges", f"WITH {BARS}{_wedge_sql(WEDGE)} SELECT {PICK} FROM wedged")
def _(s, d):
    return pat.wedges(atr_bars(s, d), **WEDGE).select(*COLS)


GEOMETRY = {k: v for k, v in WEDGE.items() if k != "max_wait"}


@query("ind22_trendlines", f"WITH {BARS}{ATR}{MED}{_swings_sql(1)}{_channel_sql(WEDGE)}, r AS (SELECT h.symbol, h.start_bar, h.end_bar, coalesce(regr_r2(h.price, CAST(h.bar AS DOUBLE)), 1.0) AS r2, count(*) AS n FROM hw h JOIN chan USING (symbol, start_bar, end_bar) GROUP BY 1, 2, 3) SELECT c.symbol, c.start_bar, c.end_bar, round(u_slope, 6) AS slope, round(u_icept, 6) AS intercept, round(r2, 6) AS r2, n, round(line_error, 6) AS line_error FROM chan c JOIN r USING (symbol, start_bar, end_bar)")
def _(s, d):
    return pat.channels(atr_bars(s, d), **GEOMETRY).select("symbol", "start_bar", "end_bar", F.col("upper_slope").alias("slope"), F.col("upper_icept").alias("intercept"), F.col("upper_r2").alias("r2"), F.col("upper_n").alias("n"), "line_error")


@query("ind23_channels", f"WITH {BARS}{ATR}{MED}{_swings_sql(1)}{_channel_sql(WEDGE)} SELECT symbol, start_bar, end_bar, direction, round((u_slope * detect_bar + u_icept) - (l_slope * detect_bar + l_icept), 6) AS width, round(convergence, 6) AS convergence, round(inside, 6) AS inside FROM chan")
def _(s, d):
    return pat.channels(atr_bars(s, d), **GEOMETRY).select("symbol", "start_bar", "end_bar", "direction", pat.channel_width(F.col("detect_bar")).alias("width"), "convergence", "inside")


@query("ind21_trend_gate", f"WITH {BARS}{ATR}, ctx AS (SELECT symbol, bar, atr, {_full('regr_slope(close, CAST(bar AS DOUBLE)) @', -20, -1)} AS sl, {_full('regr_r2(close, CAST(bar AS DOUBLE)) @', -20, -1)} AS r2 FROM atr), k AS (SELECT symbol, bar, r2 >= 0.05 AND CASE WHEN atr > 0 THEN abs(sl) / atr >= 0.01 ELSE false END AS ok, sl FROM ctx) SELECT symbol, bar, coalesce(-sl > 0 AND ok, false) AS before_bullish, coalesce(sl > 0 AND ok, false) AS before_bearish FROM k")
def _(s, d):
    rows = ind.add_trend_context(atr_bars(s, d), 20, 0.05)
    holds = lambda side: F.coalesce(pat.trend_holds(F.lit(side), 0.01, 0.05, F.col("atr")), F.lit(False))
    return rows.select("symbol", "bar", holds("bullish").alias("before_bullish"), holds("bearish").alias("before_bearish"))


def _nms_sql(source: str, score: str, out: str) -> str:
    """The best of overlapping spans of one direction, one after the other by score."""
    return f"""{out}_o AS (SELECT *, row_number() OVER (PARTITION BY symbol, direction ORDER BY {score} DESC, start_bar, end_bar) AS n FROM {source}),
{out}_g AS (SELECT symbol, direction, n, [{{'a': start_bar, 'z': end_bar}}] AS kept, true AS taken FROM {out}_o WHERE n = 1
 UNION ALL SELECT o.symbol, o.direction, o.n, CASE WHEN len(list_filter(g.kept, lambda k: k.a <= o.end_bar AND o.start_bar <= k.z)) > 0 THEN g.kept ELSE list_append(g.kept, {{'a': o.start_bar, 'z': o.end_bar}}) END, len(list_filter(g.kept, lambda k: k.a <= o.end_bar AND o.start_bar <= k.z)) = 0
 FROM {out}_g g JOIN {out}_o o ON o.symbol = g.symbol AND o.direction = g.direction AND o.n = g.n + 1),
{out} AS (SELECT o.* FROM {out}_o o JOIN {out}_g g ON g.symbol = o.symbol AND g.direction = o.direction AND g.n = o.n WHERE g.taken)"""


ORACLE["det16_suppressed_overlaps"] = f"WITH RECURSIVE {BARS}{_reversal_sql(3)}, {_nms_sql('patterns', 'depth', 'nms')} SELECT symbol, direction, start_bar, end_bar, round(depth, 6) AS depth FROM nms"


def _settled_sql(source: str, out: str, cooldown: int, score: str = "rule_score") -> str:
    return f"""{out}_h AS (SELECT * FROM {source} WHERE discard_reason IS NULL), {_nms_sql(f'{out}_h', score, f'{out}_k')},
{out}_b AS (SELECT *, row_number() OVER (PARTITION BY symbol, direction ORDER BY confirm_bar) AS m FROM (SELECT * FROM {out}_k QUALIFY row_number() OVER (PARTITION BY symbol, direction, confirm_bar ORDER BY {score} DESC, start_bar, end_bar) = 1)),
{out}_c AS (SELECT symbol, direction, m, confirm_bar AS last, true AS taken FROM {out}_b WHERE m = 1
 UNION ALL SELECT b.symbol, b.direction, b.m, CASE WHEN b.confirm_bar - g.last >= {cooldown} THEN b.confirm_bar ELSE g.last END, b.confirm_bar - g.last >= {cooldown} FROM {out}_c g JOIN {out}_b b ON b.symbol = g.symbol AND b.direction = g.direction AND b.m = g.m + 1),
{out} AS (SELECT b.* FROM {out}_b b JOIN {out}_c g ON g.symbol = b.symbol AND g.direction = b.direction AND g.m = b.m WHERE g.taken)"""


PLAN = [
    {"detector": "double", "params": {**DOUBLE, "max_length": 0, "min_score": 0.0, "trend": None}, "cooldown": 3, "state": "live"},
    {"detector": "head_shoulders", "params": HEADS, "cooldown": 5, "state": "shadow"},
    {"detector": "wedge", "params": WEDGE, "cooldown": 5, "state": "live"},
]
_WIDE = {**DOUBLE, "max_length": 10**9, "min_score": 0.0}
_EV = "symbol, direction, pattern, start_bar, neck_bar, end_bar, detect_bar, confirm_bar, entry_bar, entry, stop, target, neckline, rule_score, depth_atr, offset_atr, left_len, right_len"
#: The swings of the wedges reach one bar, those of the other patterns two: each family is its own WITH inside one.
ALL = f"""dbl AS (WITH {BARS}{_double_sql(_WIDE)} SELECT {_EV}, CAST(NULL AS VARCHAR) AS discard_reason FROM doubles),
hns AS (WITH {BARS}{_heads_sql(HEADS)} SELECT {_EV}, discard_reason FROM heads), wdg AS (WITH {BARS}{_wedge_sql(WEDGE)} SELECT {_EV}, discard_reason FROM wedged),
{_settled_sql('dbl', 'sd', 3)}, {_settled_sql('hns', 'sh', 5)}, {_settled_sql('wdg', 'sw', 5)},
found AS (SELECT {_EV}, 'live' AS lifecycle_state FROM sd UNION ALL SELECT {_EV}, 'shadow' FROM sh UNION ALL SELECT {_EV}, 'live' FROM sw)"""


def all_events(s, d):
    return pat.detect_all(atr_bars(s, d), PLAN)


@query("det21_all_detectors", f"WITH RECURSIVE {ALL} SELECT symbol, pattern, start_bar, end_bar, confirm_bar, round(rule_score, 6) AS rule_score, lifecycle_state FROM found")
def _(s, d):
    return all_events(s, d).select("symbol", "pattern", "start_bar", "end_bar", "confirm_bar", "rule_score", "lifecycle_state")


NAMED = "CAST('0x' || substr(md5(symbol || ':' || pattern || ':' || CAST(start_bar AS VARCHAR) || ':' || CAST(end_bar AS VARCHAR)), 1, 13) AS BIGINT) AS event_id"
OPPOSITE = f"""ids AS (SELECT *, {NAMED} FROM found), op_o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY rule_score DESC, event_id) AS n FROM ids),
op_g AS (SELECT symbol, n, [{{'a': start_bar, 'z': end_bar, 'k': neck_bar, 'd': direction}}] AS kept, true AS taken FROM op_o WHERE n = 1
 UNION ALL SELECT o.symbol, o.n, CASE WHEN len(list_filter(g.kept, lambda y: y.d <> o.direction AND y.a <= o.end_bar AND o.start_bar <= y.z AND (coalesce(o.neck_bar BETWEEN y.a AND y.z, false) OR coalesce(y.k BETWEEN o.start_bar AND o.end_bar, false)))) > 0 THEN g.kept ELSE list_append(g.kept, {{'a': o.start_bar, 'z': o.end_bar, 'k': o.neck_bar, 'd': o.direction}}) END,
 len(list_filter(g.kept, lambda y: y.d <> o.direction AND y.a <= o.end_bar AND o.start_bar <= y.z AND (coalesce(o.neck_bar BETWEEN y.a AND y.z, false) OR coalesce(y.k BETWEEN o.start_bar AND o.end_bar, false)))) = 0 FROM op_g g JOIN op_o o ON o.symbol = g.symbol AND o.n = g.n + 1),
single AS (SELECT o.* FROM op_o o JOIN op_g g ON g.symbol = o.symbol AND g.n = o.n WHERE g.taken)"""


def content_id(*cols: str):
    """An id by content that SQL can compute too: 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in cols])), 1, 13), 16, 10).cast("long")


def named_events(s, d):
    return saved(all_events(s, d), "events").withColumn("event_id", content_id("symbol", "pattern", "start_bar", "end_bar"))


@query("det18_one_reading", f"WITH RECURSIVE {ALL}, {OPPOSITE} SELECT symbol, pattern, direction, start_bar, end_bar, event_id FROM single")
def _(s, d):
    return pat.drop_opposite(named_events(s, d)).select("symbol", "pattern", "direction", "start_bar", "end_bar", "event_id")


@query("j13_opposite_overlaps", f"WITH RECURSIVE {ALL}, ids AS (SELECT *, {NAMED} FROM found) SELECT x.symbol, x.event_id AS bullish_id, y.event_id AS bearish_id, coalesce(x.neck_bar BETWEEN y.start_bar AND y.end_bar, false) OR coalesce(y.neck_bar BETWEEN x.start_bar AND x.end_bar, false) AS neck_inside FROM ids x JOIN ids y ON x.symbol = y.symbol AND x.direction = 'bullish' AND y.direction = 'bearish' AND x.start_bar <= y.end_bar AND y.start_bar <= x.end_bar")
def _(s, d):
    return ev.opposite_overlaps(named_events(s, d))


def _plain_sql() -> str:
    p = {"min_apart": 1, "min_depth": 3.0, "min_ranges": 3.0, "min_bars": 1, "max_error": 1e300, "min_convergence": 1e-12, "min_inside": 0.8}
    line = "(CASE WHEN c.sgn > 0 THEN c.u_slope * {0} + c.u_icept ELSE c.l_slope * {0} + c.l_icept END)"
    cross = lambda t, level, wait: f"(SELECT min(b.bar) FROM bars b WHERE b.symbol = c.symbol AND b.bar BETWEEN c.end_bar + 1 AND c.end_bar + {wait} AND c.sgn * (b.close - ({level})) > 0)"
    five = " AND ".join(f"kind{i} <> kind{i - 1} AND bar{i} > bar{i - 1}" for i in range(1, 5))
    return f"""{MED}{_swings_sql(1)}, unit AS (SELECT b.symbol, b.bar, m.median_range AS atr FROM bars b JOIN med m USING (symbol)), c3 AS ({_chain_sql(3)}), c5 AS ({_chain_sql(5)}){_channel_sql(p, 'unit', 0.8, 1)}, c2 AS ({_chain_sql(2, 'lows')}),
q3 AS (SELECT c.symbol, CASE WHEN kind0 = 'L' THEN 1.0 ELSE -1.0 END AS sgn, bar0 AS start_bar, bar2 AS end_bar, price1 AS neckline, price0, price2, median_range FROM c3 c JOIN med USING (symbol) WHERE kind0 = kind2 AND kind0 <> kind1 AND bar1 - bar0 >= 1 AND bar2 - bar1 >= 1),
x3 AS (SELECT c.symbol, CASE WHEN sgn > 0 THEN 'double_bottom' ELSE 'double_top' END AS pattern, sgn, start_bar, end_bar, {cross('q3', 'c.neckline', 14)} AS breakout_bar FROM q3 c WHERE sgn * (neckline - CASE WHEN sgn > 0 THEN greatest(price0, price2) ELSE least(price0, price2) END) >= 5 * median_range AND abs(price0 - price2) <= median_range),
q5 AS (SELECT c.symbol, CASE WHEN kind0 = 'L' THEN 1.0 ELSE -1.0 END AS sgn, bar0 AS start_bar, bar4 AS end_bar, CASE WHEN kind0 = 'L' THEN least(price1, price3) ELSE greatest(price1, price3) END AS neckline, price1, price2, price3, median_range FROM c5 c JOIN med USING (symbol) WHERE {five}),
x5 AS (SELECT c.symbol, CASE WHEN sgn > 0 THEN 'inverse_head_shoulders' ELSE 'head_shoulders' END AS pattern, sgn, start_bar, end_bar, {cross('q5', 'c.neckline', 15)} AS breakout_bar FROM q5 c WHERE sgn * (neckline - price2) >= 5 * median_range AND abs(price1 - price3) <= 0.8 * median_range),
xw AS (SELECT c.symbol, CASE WHEN sgn > 0 THEN 'falling_wedge' ELSE 'rising_wedge' END AS pattern, sgn, start_bar, end_bar, {cross('chan', line.format('b.bar'), 15)} AS breakout_bar FROM chan c),
q2 AS (SELECT c.symbol, 1.0 AS sgn, bar0 AS start_bar, bar1 AS end_bar, price0 AS neckline FROM c2 c JOIN med USING (symbol) JOIN bars b ON b.symbol = c.symbol AND b.bar = bar0 - 4 WHERE bar1 - bar0 >= 1 AND price0 - price1 >= 2 * median_range AND b.close - price0 >= 3 * median_range),
x2 AS (SELECT c.symbol, 'liquidity_sweep' AS pattern, sgn, start_bar, end_bar, {cross('q2', 'c.neckline', 10)} AS breakout_bar FROM q2 c),
plain AS (SELECT * FROM (SELECT * FROM x3 UNION ALL SELECT * FROM x5 UNION ALL SELECT * FROM xw UNION ALL SELECT * FROM x2) WHERE breakout_bar IS NOT NULL)"""


@query("det20_plain_detections", f"WITH {BARS}{_plain_sql()} SELECT symbol, pattern, CASE WHEN sgn > 0 THEN 'bullish' ELSE 'bearish' END AS direction, start_bar, end_bar, breakout_bar FROM plain")
def _(s, d):
    return pat.plain_detections(bars_of(s, d), 1)


@query("j14_detection_benchmark", f"""WITH RECURSIVE {ALL}, det AS (WITH {BARS}{_plain_sql()} SELECT symbol, pattern, CASE WHEN sgn > 0 THEN 'bullish' ELSE 'bearish' END AS direction, breakout_bar FROM plain),
t AS (SELECT symbol, pattern, direction, confirm_bar AS breakout_bar, rule_score < 0.7 AS noisy FROM found), h AS (SELECT t.*, EXISTS (SELECT 1 FROM det d WHERE d.symbol = t.symbol AND d.pattern = t.pattern AND d.direction = t.direction AND abs(d.breakout_bar - t.breakout_bar) <= 4) AS hit FROM t)
SELECT pattern, count(*) FILTER (WHERE NOT noisy) AS planted, round(avg(CASE WHEN NOT noisy THEN CAST(hit AS DOUBLE) END), 6) AS recall, round(avg(CASE WHEN noisy THEN CAST(hit AS DOUBLE) END), 6) AS recall_noisy,
 round(avg(CASE WHEN NOT noisy THEN CAST(hit AS DOUBLE) END) - avg(CASE WHEN noisy THEN CAST(hit AS DOUBLE) END), 6) AS drop, (SELECT avg(CASE WHEN EXISTS (SELECT 1 FROM det d WHERE d.symbol = b.symbol) THEN 1.0 ELSE 0.0 END) FROM (SELECT DISTINCT CAST(event_type AS VARCHAR) AS symbol FROM events) b) AS false_positive_share FROM h GROUP BY pattern""")
def _(s, d):
    truth = all_events(s, d).select("symbol", "pattern", "direction", F.col("confirm_bar").alias("breakout_bar"), (F.col("rule_score") < 0.7).alias("noisy"))
    return pat.benchmark_rates(truth, pat.plain_detections(bars_of(s, d), 1), bars_of(s, d).select("symbol"), 4)
