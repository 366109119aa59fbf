"""Forward outcomes of events: barriers, excursions and fills, as presets of one bucketed range join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.layout import range_join

#: name: (first bar after entry, last bar after entry less the horizon, tie, excursions up to the exit only)
PRESETS = {
    "labels": (0, -1, "ambiguous", True),
    "conservative": (0, -1, "stop", True),
    "optimistic": (0, -1, "target", True),
    "stored": (1, 0, "stop", False),
    "fixed": (1, 0, "target", False),
    "backtest": (1, 1, "target", True),
}


def trade_levels(events: DataFrame, buffer: float = 0.1, reward: float = 1.5) -> DataFrame:
    """Entry at the event's close, a stop beyond its extreme by ``buffer`` ATR, a target of ``reward`` risks."""
    long = F.col("direction") == "long"
    stop = F.when(long, F.col("low") - buffer * F.col("atr")).otherwise(F.col("high") + buffer * F.col("atr"))
    out = events.withColumn("entry_bar", F.col("bar")).withColumn("entry", F.col("close")).withColumn("stop", stop).withColumn("risk", F.abs(F.col("entry") - F.col("stop")))
    return out.filter("risk > 0").withColumn("target", F.when(long, F.col("entry") + reward * F.col("risk")).otherwise(F.col("entry") - reward * F.col("risk")))


def barrier_outcomes(trades: DataFrame, bars: DataFrame, horizon: int, preset: str = "labels", id_cols: tuple[str, ...] = ("symbol", "direction", "entry_bar"), own_horizon: str | None = None, time_result: str = "close") -> DataFrame:
    """Which barrier is touched first, the result in risks, and the excursions, by one of PRESETS.

    The window has ``horizon`` bars, or as many as the column ``own_horizon`` (one of ``id_cols``) says, at most ``horizon``.

    A trade's own columns are kept. Nothing touched means a time exit, at the last bar's close or, with ``time_result``
    "zero", without gain or loss; a window cut by the series' end is marked truncated.
    """
    first, more, tie, to_exit = PRESETS[preset]
    span = trades.select(*id_cols, "entry", "stop", "target", "risk", (F.col("entry_bar") + first).alias("_from"), (F.col("entry_bar") + (F.lit(horizon) if own_horizon is None else F.col(own_horizon)) + more).alias("_to"))
    near = range_join(span, bars.select("symbol", "bar", "high", "low", "close"), "_from", "_to", horizon + 2)
    long = F.col("direction") == "long"
    near = near.withColumn("_up", F.when(long, F.col("high") - F.col("entry")).otherwise(F.col("entry") - F.col("low")) / F.col("risk")).withColumn("_down", F.when(long, F.col("entry") - F.col("low")).otherwise(F.col("high") - F.col("entry")) / F.col("risk"))
    near = near.withColumn("_stop", F.when(long, F.col("low") <= F.col("stop")).otherwise(F.col("high") >= F.col("stop"))).withColumn("_target", F.when(long, F.col("high") >= F.col("target")).otherwise(F.col("low") <= F.col("target")))
    keys = [*id_cols, "entry", "stop", "target", "risk", "_to"]
    path = F.array_sort(F.collect_list(F.struct("bar", F.col("_up").alias("up"), F.col("_down").alias("down"))))
    out = near.groupBy(*keys).agg(F.min(F.when(F.col("_stop"), F.col("bar"))).alias("stop_bar"), F.min(F.when(F.col("_target"), F.col("bar"))).alias("target_bar"), F.max("bar").alias("last_bar"), F.max_by("close", "bar").alias("last_close"), path.alias("_path"))
    same = F.coalesce(F.col("stop_bar") == F.col("target_bar"), F.lit(False))
    wins = F.coalesce(F.col("target_bar") < F.col("stop_bar"), F.col("target_bar").isNotNull())
    reason = F.when(same, {"ambiguous": "ambiguous", "stop": "sl", "target": "tp"}[tie]).when(wins, "tp").when(F.col("stop_bar").isNotNull(), "sl").otherwise("time")
    out = out.withColumn("exit_reason", reason).withColumn("exit_bar", F.coalesce(F.least("stop_bar", "target_bar"), "last_bar"))
    mark = F.when(F.col("direction") == "long", F.col("last_close") - F.col("entry")).otherwise(F.col("entry") - F.col("last_close")) / F.col("risk")
    result = F.when(F.col("exit_reason") == "tp", F.abs(F.col("target") - F.col("entry")) / F.col("risk")).when(F.col("exit_reason") == "sl", -1.0).when(F.col("exit_reason") == "time", F.lit(0.0) if time_result == "zero" else mark)
    upto = F.col("exit_bar") if to_exit else F.col("last_bar")
    held = F.filter("_path", lambda p: p["bar"] <= upto)
    return (
        out.withColumn("result_r", result).withColumn("mfe_r", F.array_max(F.transform(held, lambda p: p["up"]))).withColumn("mae_r", F.array_max(F.transform(held, lambda p: p["down"])))
        .withColumn("truncated", F.col("last_bar") < F.col("_to")).withColumn("bars_held", F.col("exit_bar") - F.col("entry_bar")).drop("_path", "_to")
    )


def cost_in_r(half_spread: float, slippage: float, commission: float = 0.0):
    """Two-sided cost in risks."""
    return F.lit(2 * (half_spread + slippage)) / F.col("risk") + F.lit(commission)


def net_results(outcomes: DataFrame, half_spread: float, slippage: float, commission: float = 0.0) -> DataFrame:
    """``cost_r`` and ``net_r`` beside the gross result."""
    return outcomes.withColumn("cost_r", cost_in_r(half_spread, slippage, commission)).withColumn("net_r", F.col("result_r") - F.col("cost_r"))


def excursions(trades: DataFrame, bars: DataFrame, horizon: int, id_cols: tuple[str, ...] = ("symbol", "direction", "entry_bar")) -> DataFrame:
    """Greatest gain and loss, and the last, best and worst close, in risks over the ``horizon`` bars after entry."""
    span = trades.select(*id_cols, "entry", "risk", (F.col("entry_bar") + 1).alias("_from"), (F.col("entry_bar") + horizon).alias("_to"))
    near = range_join(span, bars.select("symbol", "bar", "high", "low", "close"), "_from", "_to", horizon)
    sign = F.when(F.col("direction") == "long", 1.0).otherwise(-1.0)
    r = lambda c: sign * (F.col(c) - F.col("entry")) / F.col("risk")
    return near.groupBy(*id_cols).agg(
        F.max(F.greatest(r("high"), r("low"))).alias("mfe_r"), (-F.min(F.least(r("high"), r("low")))).alias("mae_r"), F.max_by(r("close"), "bar").alias("close_r"),
        F.max(r("close")).alias("best_close_r"), F.min(r("close")).alias("worst_close_r"), F.count(F.lit(1)).alias("n_bars"),
    )


def horizon_labels(trades: DataFrame, bars: DataFrame, horizon: int = 72, target_r: float = 1.25, id_cols: tuple[str, ...] = ("symbol", "direction", "entry_bar")) -> DataFrame:
    """Excursions over the whole ``horizon`` bars after entry, ``label`` 1 if the gain reached ``target_r`` risks, and ``pnl_r``.

    The result is the target where it was reached, else -1 where the loss reached a risk, else the last close. Trades whose
    window the series' end cuts have no label and go.
    """
    told = excursions(trades.filter("risk > 0"), bars, horizon, id_cols).filter(F.col("n_bars") == horizon)
    won, lost = F.col("mfe_r") >= target_r, F.col("mae_r") >= 1
    return told.select(*id_cols, "mfe_r", "mae_r", "close_r", won.cast("int").alias("label"), F.when(won, F.lit(target_r)).when(lost, F.lit(-1.0)).otherwise(F.col("close_r")).alias("pnl_r"))


def outcome_grid(trades: DataFrame, bars: DataFrame, rewards: list[float], horizons: list[int], preset: str = "fixed") -> DataFrame:
    """One row for each trade, reward and horizon, by one join with the bars."""
    sign = F.when(F.col("direction") == "long", 1.0).otherwise(-1.0)
    cells = F.array(*[F.struct(F.lit(float(r)).alias("reward"), F.lit(h).alias("horizon")) for r in rewards for h in horizons])
    spread = trades.withColumn("_c", F.explode(cells)).select(*trades.columns, "_c.*").withColumn("target", F.col("entry") + sign * F.col("reward") * F.col("risk"))
    return barrier_outcomes(spread, bars, max(horizons), preset, ("symbol", "direction", "entry_bar", "reward", "horizon"), "horizon")


def grid_table(grid: DataFrame, rewards: list[float], horizons: list[int], value: str = "result_r", id_cols: tuple[str, ...] = ("symbol", "direction", "entry_bar")) -> DataFrame:
    """The grid with a column ``<value>_<reward>_<horizon>`` for each cell (a dot in a reward becomes ``p``)."""
    cell = lambda r, h: F.max(F.when((F.col("reward") == r) & (F.col("horizon") == h), F.col(value))).alias(f"{value}_{r:g}_{h}".replace(".", "p"))
    return grid.groupBy(*id_cols).agg(*[cell(r, h) for r in rewards for h in horizons])
