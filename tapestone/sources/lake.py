"""The event lake: append-only tables of events, outcomes, metrics and regime states, the reads from them, and the jobs that fill them."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import outcomes as out
from ..plans.folders import saved

CANDLE = "time string, open double, high double, low double, close double, volume double"


class RejectedRows(ValueError):
    """Rows that a table's guard turns away."""


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``; None if there is none yet, or only an empty first append of a partitioned one."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


#: Buckets of a table's id index; an append reads those of its own ids.
ID_BUCKETS = 64


def ids_known(rows: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """The keys among ``rows`` that the table at ``path`` has in any partition.

    Beside the table lie an index of its keys in buckets, each with the append it came by, and a marker of each append
    that ended. Keys of ended appends are in the table. An append that broke off may have left its rows or not, so its
    keys are looked up in the table itself, and so are all keys of a table that has no index yet.
    """
    spark, keys = rows.sparkSession, list(keys)
    table, index, ended = (stored(spark, p) for p in (path, f"{path}-ids", f"{path}-ended"))
    asked = rows.select(*keys).distinct()
    if table is None:
        return asked.limit(0)
    if index is None:
        return asked.join(table.select(*keys), keys, "left_semi")
    buckets = [r[0] for r in rows.select(id_bucket(keys)).distinct().collect()]  # ID_BUCKETS at most
    held = asked.join(index.filter(F.col("bucket").isin(buckets)).select(*keys, "append"), keys)
    if ended is None:
        return asked.join(held, keys, "left_semi").join(table.select(*keys), keys, "left_semi")
    ended = ended.select("append").distinct()
    sure = held.join(ended, "append", "left_semi").select(*keys)
    doubtful = saved(held.join(ended, "append", "left_anti").select(*keys), "doubtful")
    if doubtful.limit(1).count():
        sure = sure.unionByName(doubtful.join(table.select(*keys), keys, "left_semi"))
    return sure.distinct()


def id_bucket(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(ID_BUCKETS)).cast("int").alias("bucket")


def append_guarded(rows: DataFrame, path: str, keys: Sequence[str], partitions: Sequence[str] = (), required: Sequence[str] = (), known: str = "reject", everywhere: bool = False) -> int:
    """Append ``rows`` to the table at ``path``, partitioned by ``partitions``; returns how many went in.

    A null in ``required`` or a key, and a key twice in ``rows``, are rejected. A key that the table has is rejected too,
    or with ``known`` skip left out. Only the partitions that ``rows`` touches are read for that; with ``everywhere`` a key
    is unique in the whole table, by an index of ids beside it (see ``ids_known``), which is written before the rows
    and marked as ended after them, so that an append that breaks off can be sent again. One append runs at a time.
    """
    rows = saved(rows, "incoming")
    missing = F.lit(False)
    for c in (*keys, *required):
        missing = missing | F.col(c).isNull()
    if n := rows.filter(missing).count():
        raise RejectedRows(f"{n} rows lack one of {[*keys, *required]}")
    if n := rows.groupBy(*keys).count().filter("count > 1").count():
        raise RejectedRows(f"{n} keys {list(keys)} come more than once")
    table = stored(rows.sparkSession, path)
    if everywhere:
        held = ids_known(rows, path, keys)
    elif table is not None:
        if partitions:
            table = table.join(rows.select(*partitions).distinct(), list(partitions), "left_semi")
        held = table.select(*keys)
    if everywhere or table is not None:
        if known == "skip":
            rows = saved(rows.join(held, list(keys), "left_anti"), "new")
        elif n := rows.join(held, list(keys), "left_semi").count():
            raise RejectedRows(f"{n} keys {list(keys)} are stored already")
    if everywhere:
        number = uuid.uuid4().hex
        entries = rows.select(*keys)
        if table is not None and stored(rows.sparkSession, f"{path}-ids") is None:
            entries = entries.unionByName(table.select(*keys))  # of a table from before its index
        entries.withColumn("append", F.lit(number)).withColumn("bucket", id_bucket(keys)).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{path}-ids")
    rows.write.mode("append").partitionBy(*partitions).parquet(path)
    if everywhere:
        rows.sparkSession.range(1).select(F.lit(number).alias("append")).coalesce(1).write.mode("append").parquet(f"{path}-ended")
    return rows.count()


def month_of(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM")


def append_events(events: DataFrame, path: str, known: str = "reject") -> int:
    """Events by pattern, symbol and month of their detection; each needs a detection time."""
    return append_guarded(events.withColumn("month", month_of("detect_time")), path, ["event_id"], ["pattern", "symbol", "month"], ["detect_time"], known)


def append_outcomes(outcomes: DataFrame, path: str, known: str = "reject") -> int:
    """Outcomes by month of the exit, one for each event, whatever its month."""
    return append_guarded(outcomes.withColumn("month", month_of("exit_time")), path, ["event_id"], ["month"], ["exit_time"], known, everywhere=True)


def append_metrics(rows: DataFrame, path: str, known: str = "reject") -> int:
    """Snapshots of a model's metrics, one for each model and time ``asof``."""
    return append_guarded(rows, path, ["model_id", "asof"], ["model_id"], (), known)


def publish_states(states: DataFrame, path: str) -> None:
    """Regime states (symbol, timeframe, ts, ...): the series at hand replace those that were there."""
    states.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "timeframe").parquet(path)


def read_states(spark: SparkSession, path: str, symbol: str | None = None, timeframe: str | None = None) -> DataFrame:
    table = spark.read.parquet(path)
    for name, value in (("symbol", symbol), ("timeframe", timeframe)):
        if value is not None:
            table = table.filter(F.col(name) == value)
    return table


def event_ids(events: DataFrame) -> DataFrame:
    """All ids, once each, sorted."""
    return events.select("event_id").distinct().orderBy("event_id")


def outcomes_of(outcomes: DataFrame, ids: DataFrame) -> DataFrame:
    return outcomes.join(ids.select("event_id").distinct(), "event_id", "left_semi")


def pending_events(events: DataFrame, outcomes: DataFrame | None) -> DataFrame:
    """Events without an outcome."""
    return events if outcomes is None else events.join(outcomes.select("event_id"), "event_id", "left_anti")


def track_outcomes(events: DataFrame, path: str, bars: DataFrame, horizon: int) -> int:
    """The periodic job: outcomes of the pending events whose window has closed go to the table at ``path``; returns how many.

    ``events`` has event_id, symbol, direction, entry_bar, entry, stop, target and risk. Run again, it adds what has
    closed since and nothing twice.
    """
    due = saved(pending_events(events, stored(events.sparkSession, path)), "pending")
    done = out.barrier_outcomes(due, bars, horizon, "stored", ("event_id", "symbol", "direction", "entry_bar")).filter("not truncated or exit_reason in ('tp', 'sl')")
    ends = bars.select("symbol", F.col("bar").alias("exit_bar"), F.col("ts").alias("exit_time"))
    return append_outcomes(done.join(ends, ["symbol", "exit_bar"]), path)


def candles_to_bars(raw: DataFrame, symbol: str = "symbol", value: str = "value", offset: str = "offset") -> DataFrame:
    """Bars of candle messages (``value``: JSON with time, open, high, low, close, volume): unreadable ones go, and of one time the last by ``offset`` stands."""
    c = F.from_json(value, CANDLE)
    rows = raw.select(F.col(symbol).alias("symbol"), F.col(offset).alias("_o"), c.alias("c")).select("symbol", "_o", F.try_to_timestamp("c.time").alias("ts"), "c.open", "c.high", "c.low", "c.close", "c.volume")
    whole = rows.dropna(subset=["symbol", "ts", "open", "high", "low", "close"])
    last = whole.groupBy("symbol", "ts").agg(F.max_by(F.struct("open", "high", "low", "close", "volume"), "_o").alias("b"))
    return last.select("symbol", "ts", "b.*")


def normalised(bars: DataFrame, volume: str = "tick", utc_offset_hours: int = 0, order: str = "seq") -> DataFrame:
    """Bars with one ``volume`` (``tick``: tickvol, ``real``: vol, whichever there is), in UTC, the first by ``order`` of each time, as doubles."""
    wanted = ("tickvol", "vol") if volume == "tick" else ("vol", "tickvol")
    there = [F.col(c) for c in (*wanted, "volume") if c in bars.columns]
    if not there:
        raise ValueError("no volume column")
    shifted = bars.withColumn("volume", F.coalesce(*there)).withColumn("ts", F.col("ts") - F.expr(f"interval {utc_offset_hours} hours"))
    first = shifted.groupBy("symbol", "ts").agg(F.min_by(F.struct(*[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")]), order).alias("b"))
    return first.select("symbol", "ts", "b.*")


def log_rows(log: DataFrame, allowed: dict[str, Sequence[str]], text: tuple[str, str] | None = None, span: tuple[str, str, str] | None = None, limit: int | None = None, order: str | None = None) -> DataFrame:
    """Rows of a log whose columns are among the ``allowed`` values, whose ``text`` column holds a substring, and whose time lies in ``span`` (column, from, to, both included); the newest ``limit`` by ``order``."""
    for name, values in allowed.items():
        log = log.filter(F.col(name).isin(*values))
    if text:
        log = log.filter(F.contains(F.col(text[0]), F.lit(text[1])))
    if span:
        log = log.filter(F.col(span[0]).between(F.lit(span[1]).cast("timestamp"), F.lit(span[2]).cast("timestamp")))
    if limit is not None:
        log = log.orderBy(F.col(order).desc()).limit(limit)
    return log


def last_of_each(rows: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The ``n`` newest rows of each key by ``order``."""
    from pyspark.sql import Window

    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= n).drop("_n")


def write_export(bars: DataFrame, path: str, comma: bool = False) -> None:
    """A tab-separated export with <NAMES> in the header, dates and times apart, and numbers with a decimal comma if ``comma``."""
    number = lambda c: F.replace(F.format_string("%.6f", F.col(c).cast("double")), F.lit("."), F.lit(",")) if comma else F.format_string("%.6f", F.col(c).cast("double"))
    cols = [F.date_format("ts", "yyyy.MM.dd").alias("<DATE>"), F.date_format("ts", "HH:mm:ss").alias("<TIME>"), *[number(c).alias(f"<{c.upper()}>") for c in ("open", "high", "low", "close")]]
    more = [F.col(c).cast("long").cast("string").alias(f"<{c.upper()}>") for c in ("tickvol", "vol") if c in bars.columns]
    bars.select(*cols, *more).write.option("sep", "\t").option("header", True).csv(path)
