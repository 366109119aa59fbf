"""Portfolio replay: gates, exposure caps against what is still open, refused trades, and the report of a symbol."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.layout import placed


def with_costs(trades: DataFrame, costs: DataFrame, default: tuple[float, float, float]) -> DataFrame:
    """``half_spread``, ``slippage`` and ``commission`` of each trade's symbol; ``default`` where ``costs`` (symbol, the three) has none."""
    names = ("half_spread", "slippage", "commission")
    joined = trades.join(costs.select("symbol", *[F.col(n).alias(f"_{n}") for n in names]), "symbol", "left")
    return joined.select(*[c for c in trades.columns if c not in names], *[F.coalesce(F.col(f"_{n}"), F.lit(float(d))).alias(n) for n, d in zip(names, default, strict=True)])


def with_owner(events: DataFrame, assignments: DataFrame) -> DataFrame:
    """``risk_fraction`` and ``lifecycle_state`` of the assignment that owns an event's pattern (any case); 1 and null without one."""
    own = assignments.select(F.lower("pattern").alias("_p"), F.col("risk_fraction").alias("_r"), F.col("lifecycle_state").alias("_s"))
    joined = events.withColumn("_p", F.lower("pattern")).join(own, "_p", "left")
    kept = [c for c in events.columns if c not in ("risk_fraction", "lifecycle_state")]
    return joined.select(*kept, F.coalesce("_r", F.lit(1.0)).alias("risk_fraction"), F.col("_s").alias("lifecycle_state"))


def capped_replay(trades: DataFrame, most_total: float, most_side: float, reach: float = 1.0, order: Sequence[str] = ("entry_bar", "event_id")) -> DataFrame:
    """``trades`` with ``executed`` and ``cap_reason``: taken in ``order`` while the caps on the risk of open positions hold.

    ``most_total`` bounds a symbol's open risk, the new trade included; ``most_side`` that of its direction with entries
    within ``reach`` ATR of the new one (without an ATR, of 1). A position is closed for
    trades that enter at or after its ``exit_bar``. Trades with a ``refused`` reason take no part and keep
    it. A busy period ends where a trade enters after all before it have closed, and periods are folded by themselves.
    """
    rows = trades if "refused" in trades.columns else trades.withColumn("refused", F.lit(None).cast("string"))
    live = rows.filter("refused is null")
    w = Window.partitionBy("symbol").orderBy(*order)
    prior = F.max("exit_bar").over(w.rowsBetween(Window.unboundedPreceding, -1))
    live = live.withColumn("_new", F.coalesce((F.col("entry_bar") >= prior).cast("int"), F.lit(1))).withColumn("_period", F.sum("_new").over(w))
    near = F.when(F.col("atr") > 0, F.col("atr")).otherwise(1.0) * reach
    row = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)], F.col("event_id").alias("i"), F.col("entry_bar").alias("a"), F.col("exit_bar").alias("z"), F.col("direction").alias("d"), F.col("entry").alias("p"), F.col("risk_fraction").alias("r"), near.alias("w"))
    held = live.groupBy("symbol", "_period").agg(F.array_sort(F.collect_list(row)).alias("xs"))
    position = "struct<i:bigint,z:bigint,d:string,p:double,r:double,why:string>"
    still = "filter(acc, y -> y.why is null and y.z > x.a)"
    total = f"aggregate({still}, x.r, (s, y) -> s + y.r)"
    side = f"aggregate(filter({still}, y -> y.d = x.d and abs(y.p - x.p) <= x.w), x.r, (s, y) -> s + y.r)"
    why = f"case when {total} > {most_total} then 'max_total_risk' when {side} > {most_side} then 'max_direction_cluster' end"
    fold = f"aggregate(xs, cast(array() as array<{position}>), (acc, x) -> concat(acc, array(cast(named_struct('i', x.i, 'z', x.z, 'd', x.d, 'p', x.p, 'r', x.r, 'why', {why}) as {position}))))"
    done = held.select(F.explode(F.expr(fold)).alias("k")).select(F.col("k.i").alias("event_id"), F.col("k.why").alias("_why"), F.lit(True).alias("_in"))
    out = rows.join(done, "event_id", "left")
    return out.withColumn("cap_reason", F.coalesce("refused", "_why")).withColumn("executed", F.col("_in").isNotNull() & F.col("_why").isNull()).drop("_why", "_in", "refused")


def rejected(replayed: DataFrame) -> DataFrame:
    """The trades that were not executed, with their reason."""
    return replayed.filter(~F.col("executed"))


def first_reason(*gates: tuple[Column, str]) -> Column:
    """The name of the first gate whose condition doesn't hold (null counts as failing); null if all hold."""
    out = F.lit(None).cast("string")
    for holds, name in reversed(gates):
        out = F.when(~F.coalesce(holds, F.lit(False)), name).otherwise(out)
    return out


def pattern_report(replayed: DataFrame, result: str = "net_r", order: Sequence[str] = ("entry_bar", "event_id")) -> DataFrame:
    """(symbol, pattern, n_events, trades, pf, expectancy_r, total_r, max_dd_r) of each pattern, and of the portfolio under the pattern ``*``; only executed trades have results."""
    rows = replayed.withColumn("_x", F.when(F.col("executed"), F.col(result)))
    both = rows.select("symbol", "pattern", "executed", "_x", *order).unionByName(rows.select("symbol", F.lit("*").alias("pattern"), "executed", "_x", *order))
    keys = ["symbol", "pattern"]
    gain, loss = F.sum(F.when(F.col("_x") > 0, F.col("_x")).otherwise(0.0)), F.abs(F.sum(F.when(F.col("_x") < 0, F.col("_x")).otherwise(0.0)))
    pf = F.when(F.count("_x") == 0, None).when(loss > 0, gain / loss).when(gain > 0, float("inf")).otherwise(0.0)
    stats = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_events"), F.count("_x").alias("trades"), pf.alias("pf"), F.avg("_x").alias("expectancy_r"), F.coalesce(F.sum("_x"), F.lit(0.0)).alias("total_r"))
    path = both.filter("executed")
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    curve = path.withColumn("_c", F.sum("_x").over(w))
    curve = curve.withColumn("_p", F.greatest(F.max("_c").over(w), F.lit(0.0)))
    return stats.join(curve.groupBy(*keys).agg(F.max(F.col("_p") - F.col("_c")).alias("max_dd_r")), keys, "left")


def oos_comparison(replayed: DataFrame, result: str = "net_r", share: float = 0.3) -> DataFrame:
    """(symbol, portfolio_r, best_pattern, best_r, portfolio_wins) over the last ``share`` of each symbol's span of entries; of equal patterns the first name."""
    done = replayed.filter("executed")
    span = done.groupBy("symbol").agg(F.max("entry_bar").alias("_hi"), F.min("entry_bar").alias("_lo"))
    late = done.join(span, "symbol").filter(F.col("entry_bar") >= F.col("_hi") - share * (F.col("_hi") - F.col("_lo")))
    single = late.groupBy("symbol", "pattern").agg(F.sum(result).alias("r"))
    # of equal sums the first name: its negated place by name
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("r").desc(), "pattern"))
    best = single.withColumn("_n", rank).filter("_n = 1").select("symbol", F.col("pattern").alias("best_pattern"), F.col("r").alias("best_r"))
    whole = late.groupBy("symbol").agg(F.sum(result).alias("portfolio_r"))
    return whole.join(best, "symbol").withColumn("portfolio_wins", F.col("portfolio_r") > F.col("best_r"))


def sampled_rolling(rolling: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, points: int = 12) -> DataFrame:
    """At most ``points`` known values of each series, evenly spaced from the first to the last (halves round to even)."""
    known = placed(rolling.filter(F.col(value).isNotNull()), list(keys), list(order))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    known = known.withColumn("_n", n)
    step = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / (points - 1), 0).cast("long"))
    return known.filter((F.col("_n") <= points) | F.array_contains(step, F.col("place"))).drop("_n", "place")
