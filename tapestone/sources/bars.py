"""Bars: from tab-separated exports, candles and ticks; normalised, resampled, checked and written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.projections import half_up
from ..plans.layout import bar_index, blocked, own_rows

OHLCV = ("open", "high", "low", "close", "volume")


def read_export(spark: SparkSession, path: str, symbol: str, timeframe: str, utc_offset_hours: int = 0, volume: str = "tick") -> DataFrame:
    """A tab-separated export with <NAMES>, date and time columns; the decimal mark is voted column by column."""
    raw = spark.read.csv(path, sep="\t", header=True)
    raw = raw.toDF(*[c.strip("<>").lower() for c in raw.columns])
    numbers = [c for c in raw.columns if c not in ("date", "time")]
    votes = raw.agg(*[(F.count_if(F.col(c).rlike(r",\d+$")) > F.count_if(F.col(c).rlike(r"\.\d+$"))).alias(f"_comma_{c}") for c in numbers])
    raw = raw.crossJoin(votes)  # one row, which the reader's plan carries along
    comma = lambda c: F.regexp_replace(F.regexp_replace(c, r"\.", ""), ",", ".").try_cast("double")
    parsed = [F.when(F.col(f"_comma_{c}"), comma(c)).otherwise(F.regexp_replace(c, ",", "").try_cast("double")).alias(c) for c in numbers]
    ts = F.try_to_timestamp(F.concat_ws(" ", "date", "time"), F.lit("yyyy.MM.dd HH:mm:ss")) - F.expr(f"interval {utc_offset_hours} hours")
    held = "tickvol" if volume == "tick" and "tickvol" in raw.columns else "vol"
    return raw.select(F.lit(symbol).alias("symbol"), F.lit(timeframe).alias("timeframe"), ts.alias("ts"), *parsed).withColumn("volume", F.col(held)).select("symbol", "timeframe", "ts", *OHLCV)


def infer_utc_offsets(ticks: DataFrame) -> DataFrame:
    """(symbol, day, offset): a day's first bar at 01h means +3, at 00h +2; other days take the last known, else the next."""
    days = ticks.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.hour(F.min("ts")).alias("h"))
    days = days.withColumn("o", F.when(F.col("h") == 1, 3).when(F.col("h") == 0, 2))
    w = Window.partitionBy("symbol").orderBy("day")
    past = F.last("o", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    future = F.first("o", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return days.select("symbol", "day", F.coalesce(past, future).alias("utc_offset"))


def first_per_time(df: DataFrame, order: str, keep: str = "first", keys: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """One row for each key: the first or last by ``order``."""
    by = F.col(order).asc() if keep == "first" else F.col(order).desc()
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(by))).filter("_n = 1").drop("_n")


def ticks_of(spark: SparkSession, sf_dir: str, key: str = "event_type") -> DataFrame:
    """Ticks of the events table: symbol, ts, seq, price, volume."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col(key).cast("string").alias("symbol"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1.0).alias("volume"))


def resample_ticks(ticks: DataFrame, rule: str = "1 hour") -> DataFrame:
    """Bars of ticks in their order; buckets without ticks are absent."""
    at = F.struct("ts", "seq")
    out = ticks.groupBy("symbol", F.window("ts", rule).alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume")
    )
    return out.select("symbol", F.col("w.start").alias("ts"), *OHLCV)


def resample_bars(bars: DataFrame, rule: str) -> DataFrame:
    """Coarser bars of bars, stamped at their start."""
    out = bars.groupBy("symbol", F.window("ts", rule).alias("w")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")
    )
    return out.select("symbol", F.col("w.start").alias("ts"), F.col("w.end").alias("bucket_end"), *OHLCV)


def bars_ev(spark: SparkSession, sf_dir: str, rule: str = "1 hour", key: str = "event_type") -> DataFrame:
    """Indexed bars of the events table."""
    return bar_index(resample_ticks(ticks_of(spark, sf_dir, key), rule))


def write_bars(bars: DataFrame, path: str) -> None:
    bars.write.partitionBy("symbol", "timeframe").parquet(path)


def read_window(bars: DataFrame, start: str, end: str, warmup: int = 1500, extra: int = 72) -> DataFrame:
    """Bars from ``start`` to ``end`` with a halo of bars before and after, so that indicators and outcomes are whole."""
    edge = bars.groupBy("symbol").agg(F.min(F.when(F.col("ts") >= start, F.col("bar"))).alias("lo"), F.max(F.when(F.col("ts") <= end, F.col("bar"))).alias("hi"))
    return bars.join(edge, "symbol").filter(F.col("bar").between(F.col("lo") - warmup, F.col("hi") + extra)).drop("lo", "hi")


def ohlc_counts(bars: DataFrame) -> DataFrame:
    """Broken bars of each series, by rule."""
    return bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.expr("high < greatest(open, close)")).alias("bad_high"), F.count_if(F.expr("low > least(open, close)")).alias("bad_low"),
        F.count_if(F.expr("high < low")).alias("bad_range"), F.count_if(F.expr("open is null or high is null or low is null or close is null")).alias("nulls"), F.count_if(F.expr("high = low")).alias("flat"),
    )


def _gap_rows(bars: DataFrame, step_minutes: int) -> DataFrame:
    held, w = blocked(bars, 1)
    out = own_rows(held.withColumn("previous", F.lag("ts").over(w))).withColumn("minutes", ((F.unix_timestamp("ts") - F.unix_timestamp("previous")) / 60).cast("long")).filter(F.col("minutes") > step_minutes)
    return out.withColumn("kind", F.expr("case when minutes >= 2880 then 'holiday' when weekday(previous) >= 4 and minutes >= 1440 then 'weekend' when hour(previous) >= 20 then 'daily_break' else 'short_gap' end"))


def gaps(bars: DataFrame, step_minutes: int) -> DataFrame:
    """Bars that follow a gap, classified by its length, hour and weekday."""
    return _gap_rows(bars, step_minutes).select("symbol", "bar", "minutes", "kind")


def quality_report(bars: DataFrame, step_minutes: int, spread: str | None = None) -> DataFrame:
    """(symbol, section, item, n, value) on a series' quality; ``set5``'s largest gaps and ``flt8``'s counts are apart.

    ``rows``: bars, and those without volume; ``gap``: each kind's gaps and the longest in minutes; ``break_hour``: the
    UTC hour of the bar before each daily break; ``offset``: days of each inferred UTC offset (null, where none is);
    ``spread``, if the column is named: least, greatest, mean, median and zeros of its known values, which ``n`` counts.
    """
    section = lambda rows, name, item, n, value=None: rows.select("symbol", F.lit(name).alias("section"), item.cast("string").alias("item"), n.cast("long").alias("n"), (F.lit(None) if value is None else value).cast("double").alias("value"))
    n = F.col("count")
    found = _gap_rows(bars, step_minutes)
    kinds = found.groupBy("symbol", "kind").agg(F.count(F.lit(1)).alias("count"), F.max("minutes").alias("longest"))
    hours = found.filter("kind = 'daily_break'").groupBy("symbol", F.hour("previous").alias("hour")).count()
    offsets = infer_utc_offsets(bars).groupBy("symbol", "utc_offset").count()
    figures = {"bars": F.count(F.lit(1)), "zero_volume": F.count_if(F.col("volume") <= 0)}
    if spread:
        x = F.col(spread).cast("double")
        figures |= {"known": F.count(x), "min": F.min(x), "max": F.max(x), "mean": half_up(F.avg(x), 3), "median": F.percentile(x, F.lit(0.5)), "zero": F.count_if(x == 0)}
    whole = bars.groupBy("symbol").agg(*[v.alias(k) for k, v in figures.items()])
    tall = lambda items: F.explode(F.create_map(*[v for k in items for v in (F.lit(k), F.col(k).cast("double"))]))
    out = section(whole.select("symbol", tall(["bars", "zero_volume"])), "rows", F.col("key"), F.col("value"))
    out = out.unionByName(section(kinds, "gap", F.col("kind"), n, F.col("longest"))).unionByName(section(hours, "break_hour", F.col("hour"), n)).unionByName(section(offsets, "offset", F.col("utc_offset"), n))
    if spread:
        out = out.unionByName(section(whole.select("symbol", "known", tall(["min", "max", "mean", "median", "zero"])), "spread", F.col("key"), F.col("known"), F.col("value")))
    return out
