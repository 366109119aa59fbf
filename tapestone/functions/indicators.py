"""Indicators over bars, in halo blocks; recurrences by affine scans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.layout import affine_scan, blocked, own_rows, when_full


def _true_range(w: WindowSpec) -> Column:
    prior = F.lag("close").over(w)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prior), F.abs(F.col("low") - prior))


def _atr(w: WindowSpec, period: int) -> Column:
    frame = w.rowsBetween(1 - period, 0)
    return when_full(F.avg("tr").over(frame), F.count("tr").over(frame), period)


def true_range(bars: DataFrame) -> DataFrame:
    df, w = blocked(bars, 1)
    return own_rows(df.withColumn("tr", _true_range(w)))


def add_atr(bars: DataFrame, period: int = 14, out: str = "atr") -> DataFrame:
    """Simple mean of the true range over a full window, both in one layout: the halo's first row alone has no prior close."""
    df, w = blocked(bars, period + 1)
    return own_rows(df.withColumn("tr", _true_range(w)).withColumn(out, _atr(w, period)))


def add_ema(bars: DataFrame, span: int, value: str = "close", out: str = "ema") -> DataFrame:
    return affine_scan(bars, 1 - 2 / (span + 1), value, out)


def add_wilder_atr(bars: DataFrame, period: int = 14) -> DataFrame:
    """Exponential mean of the true range with weight 1/period, and its share of the close."""
    out = affine_scan(true_range(bars), 1 - 1 / period, "tr", "watr")
    return out.withColumn("watr", F.when(F.col("bar") >= period - 1, F.col("watr"))).withColumn("watr_norm", F.col("watr") / F.expr("nullif(close, 0)"))


def add_rolling(bars: DataFrame) -> DataFrame:
    """Volume z-scores, log returns, slopes, range position, prior extremes and candle anatomy, all with whole windows."""
    df, w = blocked(bars, 60)
    return own_rows(_rolling(df, w)).drop("_r")


def add_sweep_inputs(bars: DataFrame, period: int = 14) -> DataFrame:
    """What ``add_atr`` and ``add_rolling`` add, in one layout: the bars are shuffled and sorted once."""
    df, w = blocked(bars, 60)
    return own_rows(_rolling(df.withColumn("tr", _true_range(w)).withColumn("atr", _atr(w, period)), w)).drop("_r")


def _rolling(df: DataFrame, w: WindowSpec) -> DataFrame:
    df = df.withColumn("_r", F.col("high") - F.col("low"))
    f = lambda a, b: w.rowsBetween(a, b)
    full = lambda e, a, b: when_full(e, F.count("close").over(f(a, b)), b - a + 1)
    log_return = F.when((F.col("close") > 0) & (F.lag("close").over(w) > 0), F.log(F.col("close") / F.lag("close").over(w)))
    df = df.withColumn("log_return", log_return)
    std50, std20 = F.stddev_samp("volume").over(f(-50, -1)), F.stddev_samp("volume").over(f(-19, 0))
    hi, lo = F.max("high").over(f(-19, 0)), F.min("low").over(f(-19, 0))
    return (
        df.withColumn("volume_z", full((F.col("volume") - F.avg("volume").over(f(-50, -1))) / F.nullif(std50, F.lit(0.0)), -50, -1))
        .withColumn("volume_z20", full((F.col("volume") - F.avg("volume").over(f(-19, 0))) / F.nullif(std20, F.lit(0.0)), -19, 0))
        .withColumn("slope20", full(F.expr("regr_slope(close, cast(bar as double))").over(f(-19, 0)), -19, 0))
        .withColumn("range_pos", full(F.when(hi > lo, 2 * (F.col("close") - lo) / (hi - lo) - 1).otherwise(0.0), -19, 0))
        .withColumn("prior_low", full(F.min("low").over(f(-20, -1)), -20, -1))
        .withColumn("prior_high", full(F.max("high").over(f(-20, -1)), -20, -1))
        .withColumn("lower_wick", (F.least("open", "close") - F.col("low")) / F.nullif(F.col("_r"), F.lit(0.0)))
        .withColumn("upper_wick", (F.col("high") - F.greatest("open", "close")) / F.nullif(F.col("_r"), F.lit(0.0)))
        .withColumn("body", F.abs(F.col("close") - F.col("open")) / F.nullif(F.col("_r"), F.lit(0.0)))
    )


def window_ranks(values: np.ndarray, window: int) -> np.ndarray:
    """Average-tie rank of each value among the ``window`` that end with it, as a share; NaN without a full window."""
    out = np.full(len(values), np.nan)
    if len(values) >= window:
        held = np.lib.stride_tricks.sliding_window_view(values, window)
        last = held[:, -1:]
        rank = (held < last).sum(1) + ((held == last).sum(1) + 1) / 2
        out[window - 1 :] = np.where(np.isfinite(held).all(1), rank / window, np.nan)
    return out


def add_percentile(bars: DataFrame, value: str, window: int = 50, out: str = "pct") -> DataFrame:
    """Average-tie rank of a bar's value in its trailing window, as a share, and its regime; null without a full window of values.

    Halo blocks are ranked one by one in arrays of numbers; no row carries its window.
    """
    df, _ = blocked(bars.drop(out, f"{out}_regime"), window)

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("bar")
        values = pa.compute.cast(rows[value], pa.float64()).to_numpy(zero_copy_only=False)
        return rows.append_column("_rank", pa.array(window_ranks(values, window), from_pandas=True)).filter(rows["_own"])

    schema = T.StructType([*df.schema.fields, T.StructField("_rank", T.DoubleType())])
    ranked = df.groupBy("symbol", "_blk").applyInArrow(run, schema).withColumnRenamed("_rank", out)
    regime = F.expr(f"case when {out} is null then null when {out} < 0.33 then 'low' when {out} > 0.67 then 'high' else 'normal' end")
    return ranked.withColumn(f"{out}_regime", regime).drop("_own", "_blk")


def add_trend_context(bars: DataFrame, lookback: int = 20, min_r2: float = 0.1, out: str = "trend") -> DataFrame:
    """Slope and R2 of the closes before a bar; ``out`` is -1, 0 or 1: the slope's sign where R2 allows."""
    df, w = blocked(bars, lookback)
    frame = w.rowsBetween(-lookback, -1)
    n = F.count("close").over(frame)
    df = df.withColumn("ctx_slope", when_full(F.expr("regr_slope(close, cast(bar as double))").over(frame), n, lookback)).withColumn("ctx_r2", when_full(F.expr("regr_r2(close, cast(bar as double))").over(frame), n, lookback))
    return own_rows(df.withColumn(out, F.when(F.col("ctx_r2") >= min_r2, F.signum("ctx_slope")).otherwise(0.0).cast("int")))


def add_sessions(bars: DataFrame, sessions: dict[str, tuple[int, int]]) -> DataFrame:
    """A flag for each session's half-open UTC hours (which may wrap midnight), hour, weekday with weekends folded, the number of open sessions, and ``minutes_from_open``.

    These minutes count from the start of the earliest (by its hour) open session to the bar's hour, so they are below
    zero where only one that wraps midnight is open after it; null where none is.
    """
    out = bars.withColumn("hour", F.hour("ts")).withColumn("dow", F.weekday("ts"))
    out = out.withColumn("dow", F.when(F.col("dow") >= 5, F.col("dow") - 5).otherwise(F.col("dow")))
    for name, (a, b) in sessions.items():
        h = F.col("hour")
        out = out.withColumn(f"in_{name}", (h >= a) & (h < b) if a <= b else (h >= a) | (h < b))
    opened = F.array_min(F.array(*[F.when(F.col(f"in_{n}"), F.lit(a)) for n, (a, _) in sessions.items()]))
    return out.withColumn("n_sessions", sum(F.col(f"in_{n}").cast("int") for n in sessions)).withColumn("minutes_from_open", (F.col("hour") - opened) * 60)


def add_confirm_context(bars: DataFrame, back: int = 24, atr_back: int = 200) -> DataFrame:
    """Volume z-score against up to ``back`` earlier bars, ATR over its trailing mean, and momentum, span, place and volume over ``back`` bars.

    The z-score uses the population deviation and is 0 under five earlier bars or without spread; the ATR ratio is 1
    under fifteen known values; momentum is 0 before bar ``back``. ``bars`` has ``atr``.
    """
    df, w = blocked(bars, max(back, atr_back))
    before, upto, long = w.rowsBetween(-back, -1), w.rowsBetween(-back, 0), w.rowsBetween(-atr_back, 0)
    sd = F.stddev_pop("volume").over(before)
    z = F.when((F.count("volume").over(before) >= 5) & (sd > 0), (F.col("volume") - F.avg("volume").over(before)) / sd).otherwise(0.0)
    ratio = F.when((F.col("bar") >= 15) & (F.col("atr") > 0) & (F.count("atr").over(long) >= 15), F.col("atr") / F.avg("atr").over(long)).otherwise(1.0)
    low, high = F.min("low").over(upto), F.max("high").over(upto)
    per_atr = lambda x: F.when(F.col("atr") > 0, x / F.col("atr")).otherwise(0.0)
    mean = F.avg("volume").over(upto)
    df = df.withColumns({
        "volume_z": z, "atr_ratio": ratio, "momentum": F.coalesce(per_atr(F.col("close") - F.lag("close", back).over(w)), F.lit(0.0)), "span": per_atr(high - low),
        "place": F.when(high > low, (F.col("close") - low) / (high - low)).otherwise(0.5), "volume_ratio": F.when(mean > 0, F.col("volume") / mean).otherwise(1.0),
    })
    return own_rows(df)


def add_anatomy(bars: DataFrame) -> DataFrame:
    """``close_location`` in the bar's range, ``body_size``, and ``wick_balance`` (upper wick over lower); null where a divisor is 0."""
    low_wick = F.least("open", "close") - F.col("low")
    return bars.withColumns({
        "close_location": (F.col("close") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)), "body_size": F.abs(F.col("close") - F.col("open")),
        "wick_balance": (F.col("high") - F.greatest("open", "close")) / F.nullif(low_wick, F.lit(0.0)),
    })
