"""More registered queries: levels, gates, costs, reports and drift, beside those in ``queries``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import indicators as ind
from .operators import events as ev
from .operators import groups as grp
from .operators import outcomes as out
from .operators import reports as rep
from .plans import layout
from .queries import ATR, BARS, DAILY, PF, RANKED, RES, SWEPT, TRADES, bars_of, cooled_of, outcomes_of, query, results_of, rolled_of, _frame, _full, _outcomes, _swing_sql
from .sources import bars as src

@query("ind6_volatility_regime", f"WITH {BARS}{ATR}, {RANKED} SELECT symbol, bar, CASE WHEN pct < 0.33 THEN 'low' WHEN pct > 0.67 THEN 'high' WHEN pct IS NOT NULL THEN 'normal' END AS pct_regime FROM p")
def _(s, d):
    return ind.add_percentile(ind.add_atr(bars_of(s, d)), "atr", 200).select("symbol", "bar", "pct_regime")


@query("flt1_window_of_events", "SELECT event_id, event_type, user_id FROM events WHERE event_type = 'purchase' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'")
def _(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    return e.filter((F.col("event_type") == "purchase") & F.col("ts").between("2024-01-05", "2024-01-25")).select("event_id", "event_type", "user_id")


@query("flt13_timeline_verdicts", "SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE bad) AS n_bad, NOT bool_or(bad) AS batch_ok FROM (SELECT l_orderkey, o_orderdate IS NULL OR l_shipdate IS NULL OR coalesce(o_orderdate > l_shipdate, false) AS bad FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY 1")
def _(s, d):
    lines = s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_shipdate")
    orders = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    checked = ev.timeline_check(lines.join(orders, "l_orderkey"), ["o_orderdate", "l_shipdate"])
    return checked.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if("violation").alias("n_bad")).withColumn("batch_ok", F.col("n_bad") == 0)


@query("set6_tail_of_series", f"WITH {BARS} SELECT symbol, bar FROM bars QUALIFY bar > max(bar) OVER (PARTITION BY symbol) - 20")
def _(s, d):
    bars = bars_of(s, d).select("symbol", "bar")
    ends = bars.groupBy("symbol").agg(F.max("bar").alias("end"))
    return bars.join(ends, "symbol").filter("bar > end - 20").select("symbol", "bar")


@query("j4_nearest_bar", f"""WITH {BARS}, e AS (SELECT symbol, seq, ts FROM ticks), p AS (SELECT e.symbol, e.seq, e.ts, b.bar AS pb, b.ts AS pt FROM e ASOF LEFT JOIN bars b ON b.symbol = e.symbol AND e.ts >= b.ts),
f AS (SELECT p.*, n.bar AS nb, n.ts AS nt FROM p ASOF LEFT JOIN bars n ON n.symbol = p.symbol AND p.ts <= n.ts) SELECT symbol, seq, CASE WHEN nt IS NULL OR (pt IS NOT NULL AND epoch(ts) - epoch(pt) <= epoch(nt) - epoch(ts)) THEN pb ELSE nb END AS near_bar FROM f""")
def _(s, d):
    ticks = src.ticks_of(s, d).select("symbol", "ts", "seq")
    bars = bars_of(s, d).select("symbol", "ts", F.col("bar").alias("near_bar"))
    return layout.asof_nearest(ticks, bars, "ts", ["near_bar"]).select("symbol", "seq", "near_bar")


@query("lvl6_level_registry", f"""WITH {BARS}{_swing_sql(True)}{DAILY}, pd AS (SELECT symbol, day, lag(high) OVER (PARTITION BY symbol ORDER BY day) AS h, lag(low) OVER (PARTITION BY symbol ORDER BY day) AS l FROM days), k AS (SELECT symbol, date_trunc('day', ts) AS day, min(bar) AS known_bar FROM bars GROUP BY 1, 2),
pdl AS (SELECT k.symbol, known_bar, u.kind, u.price FROM pd JOIN k ON k.symbol = pd.symbol AND k.day = pd.day, LATERAL (SELECT 'H' AS kind, pd.h AS price UNION ALL SELECT 'L', pd.l) u WHERE u.price IS NOT NULL),
a AS (SELECT symbol, kind, price, known_bar, 'swing' AS source FROM swings UNION ALL SELECT symbol, kind, price, known_bar, 'day' FROM pdl)
SELECT symbol, kind, round(price, 6) AS price, known_bar, source FROM a QUALIFY row_number() OVER (PARTITION BY symbol, kind, price ORDER BY known_bar, source) = 1""")
def _(s, d):
    bars = bars_of(s, d)
    w = Window.partitionBy("symbol").orderBy("day")
    days = bars.groupBy("symbol", F.date_trunc("day", "ts").alias("day")).agg(F.max("high").alias("h"), F.min("low").alias("l"), F.min("bar").alias("known_bar"))
    days = days.withColumn("ph", F.lag("h").over(w)).withColumn("pl", F.lag("l").over(w)).selectExpr("symbol", "known_bar", "stack(2, 'H', ph, 'L', pl) as (kind, price)").filter("price is not null")
    return ev.level_registry({"swing": ev.swings(bars), "day": days})


@query("lvl9_latest_pivot", f"WITH {BARS}{_swing_sql(True)}, p AS (SELECT symbol, known_bar + 1 AS bar, bar AS pb, price FROM swings WHERE kind = 'L') SELECT b.symbol, b.bar, CASE WHEN b.bar - pb <= 30 THEN pb END AS pivot_bar, CASE WHEN b.bar - pb <= 30 THEN round(p.price, 6) END AS pivot_price FROM bars b ASOF LEFT JOIN p ON p.symbol = b.symbol AND b.bar >= p.bar")
def _(s, d):
    bars = bars_of(s, d)
    return ev.latest_pivot(bars, ev.swings(bars), "L", 30)


@query("det2_sweeps_in_trend", f"WITH {BARS}{SWEPT}, c AS (SELECT symbol, bar, {_full('regr_slope(close, CAST(bar AS DOUBLE)) @', -20, -1)} AS sl, {_full('regr_r2(close, CAST(bar AS DOUBLE)) @', -20, -1)} AS r2 FROM bars) SELECT s.symbol, s.bar, s.direction, round(s.depth, 6) AS depth FROM sweeps s JOIN c ON c.symbol = s.symbol AND c.bar = s.bar WHERE depth <= 1.5 AND r2 >= 0.1 AND sign(sl) = CASE WHEN direction = 'long' THEN 1 ELSE -1 END")
def _(s, d):
    sweeps = ev.sweep_rows(ev.sweep_flags(rolled_of(s, d), max_depth=1.5))
    return ev.with_trend(sweeps, ind.add_trend_context(bars_of(s, d))).select("symbol", "bar", "direction", "depth")


@query("out3_excursions", f"""WITH RECURSIVE {BARS}{TRADES}, n AS (SELECT t.symbol, t.direction, t.entry_bar, b.bar AS b, CASE WHEN direction = 'long' THEN 1.0 ELSE -1.0 END * (b.high - entry) / risk AS h, CASE WHEN direction = 'long' THEN 1.0 ELSE -1.0 END * (b.low - entry) / risk AS l, CASE WHEN direction = 'long' THEN 1.0 ELSE -1.0 END * (b.close - entry) / risk AS c
 FROM trades t JOIN bars b ON b.symbol = t.symbol AND b.bar BETWEEN t.entry_bar + 1 AND t.entry_bar + 12) SELECT symbol, direction, entry_bar, round(max(greatest(h, l)), 6) AS mfe_r, round(-min(least(h, l)), 6) AS mae_r, round(arg_max(c, b), 6) AS close_r, round(max(c), 6) AS best_close_r, round(min(c), 6) AS worst_close_r, count(*) AS n_bars FROM n GROUP BY 1, 2, 3""")
def _(s, d):
    return out.excursions(out.trade_levels(cooled_of(s, d)), bars_of(s, d), 12)


@query("out6_net_results", f"{RES} SELECT symbol, direction, entry_bar, round(0.04 / risk + 0.002, 6) AS cost_r, round(x - (0.04 / risk + 0.002), 6) AS net_r FROM res")
def _(s, d):
    return out.net_results(results_of(s, d), 0.01, 0.01, 0.002).select("symbol", "direction", "entry_bar", "cost_r", "net_r")


@query("gat6_risk_gate", f"""WITH RECURSIVE {BARS}{_outcomes('backtest')}, o2 AS (SELECT o.symbol, o.direction, o.entry_bar, (SELECT count(*) FROM outcomes q WHERE q.symbol = o.symbol AND q.exit_bar > o.entry_bar AND (q.entry_bar, q.direction) < (o.entry_bar, o.direction)) AS n_open, o.entry_bar - lag(o.entry_bar) OVER (PARTITION BY o.symbol ORDER BY o.entry_bar, o.direction) AS since FROM outcomes o)
SELECT *, CASE WHEN n_open >= 2 THEN 'max_open' WHEN since < 3 THEN 'too_soon' END AS refused FROM o2""")
def _(s, d):
    return grp.risk_gate(outcomes_of(s, d, "backtest"), 2, 3)


@query("agg5_equity", f"{RES} SELECT symbol, entry_bar, direction, round(1 + 0.01 * sum(x) OVER (PARTITION BY symbol ORDER BY entry_bar, direction ROWS UNBOUNDED PRECEDING), 6) AS equity FROM res")
def _(s, d):
    return rep.equity_curve(results_of(s, d), ["symbol"], ["entry_bar", "direction"]).select("symbol", "entry_bar", "direction", "equity")


@query("agg12_breakdown", f"{RES} SELECT symbol, direction, count(x) AS n, round({PF}, 6) AS pf, round(sum(x), 6) AS total_r, round(avg(x), 6) AS expectancy, round(avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM res GROUP BY 1, 2")
def _(s, d):
    return rep.result_metrics(results_of(s, d), ["symbol", "direction"])


@query("agg14_distributions", f"{RES} SELECT symbol, count(*) AS n, {', '.join(f'round(quantile_cont({c}, {v}), 6) AS {c}_{k}' for c in ('risk', 'mfe_r', 'mae_r') for v, k in ((0.5, 'median'), (0.9, 'p90')))} FROM res GROUP BY 1")
def _(s, d):
    return rep.distribution(results_of(s, d), ["risk", "mfe_r", "mae_r"], ["symbol"])


@query("agg17_best_threshold", f"{RES}, arms AS (SELECT unnest([0.5, 1.0, 1.5, 2.0, 3.0]) AS arm), b AS (SELECT symbol, arm, count(x) AS n, round({PF}, 9) AS pf FROM res, arms WHERE mae_r <= arm GROUP BY 1, 2 HAVING count(x) >= 5) SELECT symbol, arm, n, round(pf, 6) AS pf FROM b QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY pf DESC, n DESC, arm) = 1")
def _(s, d):
    return rep.best_threshold(results_of(s, d), "mae_r", [0.5, 1.0, 1.5, 2.0, 3.0], 5, ["symbol"])


@query("agg19_halves", f"{RES}, h AS (SELECT *, CAST(ntile(2) OVER (PARTITION BY symbol ORDER BY round(mae_r, 6), entry_bar, direction) AS INT) AS half FROM res) SELECT symbol, half, count(x) AS n, round({PF}, 6) AS pf, round(sum(x), 6) AS total_r, round(avg(x), 6) AS expectancy, round(avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM h GROUP BY 1, 2")
def _(s, d):
    return rep.halves(results_of(s, d), [F.round("mae_r", 6), "entry_bar", "direction"], ["symbol"])


@query("sta2_drift_report", """WITH z AS (SELECT u.feature, u.value, ts < TIMESTAMP '2024-01-16' AS base FROM events e, LATERAL (SELECT 'value' AS feature, e.value AS value UNION ALL SELECT 'user_id', CAST(e.user_id AS DOUBLE)) u), e AS (SELECT feature, list_distinct(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edges FROM z WHERE base GROUP BY 1),
c AS (SELECT z.feature, len(list_filter(edges, lambda x: x < value)) AS b, count(*) FILTER (WHERE base) AS e, count(*) FILTER (WHERE NOT base) AS a FROM z JOIN e ON e.feature = z.feature GROUP BY 1, 2),
p AS (SELECT feature, greatest(e / sum(e) OVER (PARTITION BY feature), 0.0001) AS e, greatest(a / sum(a) OVER (PARTITION BY feature), 0.0001) AS a FROM c), r AS (SELECT feature, sum((a - e) * ln(a / e)) AS psi FROM p GROUP BY 1)
SELECT feature, round(psi, 6) AS psi, CASE WHEN psi < 0.1 THEN 'none' WHEN psi < 0.25 THEN 'moderate' ELSE 'severe' END AS severity, psi >= 0.25 AS retrain FROM r""")
def _(s, d):
    return rep.drift_report(s.read.parquet(f"{d}/events.parquet"), ["value", "user_id"], F.col("ts") < F.lit("2024-01-16").cast("timestamp"))


@query("sta6_effective_sample", f"""WITH RECURSIVE {BARS}{SWEPT}, o6 AS (SELECT symbol, bar, row_number() OVER (PARTITION BY symbol ORDER BY bar) AS n FROM (SELECT DISTINCT symbol, bar FROM sweeps)),
g6 AS (SELECT symbol, n, bar AS last, true AS taken FROM o6 WHERE n = 1 UNION ALL SELECT o.symbol, o.n, CASE WHEN o.bar - g.last >= 8 THEN o.bar ELSE g.last END, o.bar - g.last >= 8 FROM g6 g JOIN o6 o ON o.symbol = g.symbol AND o.n = g.n + 1)
SELECT symbol, count(*) FILTER (WHERE taken) AS effective FROM g6 GROUP BY 1""")
def _(s, d):
    sweeps = ev.sweep_rows(ev.sweep_flags(rolled_of(s, d))).select("symbol", "bar").distinct()
    return layout.greedy_cooldown(sweeps, 8, ["symbol"], inclusive=True).groupBy("symbol").agg(F.count(F.lit(1)).alias("effective"))


@query("sta9_good_folds", f"{RES}, f AS (SELECT symbol, entry_bar // 48 AS fold, {PF} >= 0.8 AS good FROM res GROUP BY 1, 2), r AS (SELECT *, sum(CAST(NOT good AS INT)) OVER (PARTITION BY symbol ORDER BY fold) AS run FROM f), n AS (SELECT symbol, run, count(*) AS n, count(*) FILTER (WHERE good) AS good FROM r GROUP BY 1, 2) SELECT symbol, CAST(sum(n) AS BIGINT) AS folds, max(good) AS longest FROM n GROUP BY 1")
def _(s, d):
    return rep.longest_good_run(results_of(s, d), F.floor(F.col("entry_bar") / 48), ["symbol"])
