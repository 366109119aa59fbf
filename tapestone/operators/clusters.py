"""Equal-price levels of series too long for one task."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.folders import saved

STATE = "array<struct<low:double,high:double,first:bigint,last:bigint,n:int>>"
MADE = "array<struct<price:double,low:double,high:double,first:bigint,at:bigint>>"
RUN = f"symbol string, kind string, blk long, entry {STATE}, exit {STATE}, made {MADE}"


def equal_levels(bars: DataFrame, tolerance: float = 0.1, min_touches: int = 2, max_age: int = 200, block: int = 4096) -> DataFrame:
    """Levels of lows (L) and highs (H) that come back to one price, known at the touch that makes ``min_touches``.

    A bar's price joins the nearest live cluster within ``tolerance`` ATR (of two as near the earlier one), whose price
    becomes the middle of its extremes; else it opens one. A cluster untouched for over ``max_age`` bars is closed. A bar
    without a price or a positive ATR counts for nothing.

    A step depends on all before it, but only through the live clusters, ``max_age`` + 1 at most where every bar counts.
    So blocks of ``block`` bars run side by side, each from the clusters that the bars just before it make of nothing.
    Where a block's entry is not the exit of the block before, it runs again from that exit, until all seams agree:
    the result is then that of one pass. Each round settles one more block of a series at least, and blocks whose
    clusters don't outlive the block before settle at once. A task holds one block and one state.
    """
    warm = min(2 * max_age, block)

    def pass_over(live: list[dict], rows: Iterable[tuple]) -> tuple[list[dict], list[dict]]:
        """The clusters after ``rows``, and the levels made; one that is a level already is no longer told by its start or number."""
        live, made = [dict(c) for c in live], []
        for bar, price, atr in rows:
            if price is None or atr is None or price != price or not tolerance * atr > 0:
                continue
            reach = tolerance * atr
            best, gap = None, None
            for c in live:
                d = abs(price - (c["low"] + c["high"]) / 2)
                if d <= reach and (gap is None or d < gap):
                    best, gap = c, d
            if best is None:
                best = {"low": price, "high": price, "first": bar, "last": bar, "n": 1}
                live.append(best)
                fresh = True
            else:
                fresh = best["n"] < min_touches
                best.update(low=min(best["low"], price), high=max(best["high"], price), last=bar, n=min(best["n"] + 1, min_touches))
            if fresh and best["n"] == min_touches:
                made.append({"price": (best["low"] + best["high"]) / 2, "low": best["low"], "high": best["high"], "first": best["first"], "at": bar})
                best["first"] = -1
            live = [c for c in live if bar - c["last"] <= max_age]
        return live, made

    types = [pa.list_(pa.struct([("low", pa.float64()), ("high", pa.float64()), ("first", pa.int64()), ("last", pa.int64()), ("n", pa.int32())]))] * 2
    types.append(pa.list_(pa.struct([("price", pa.float64()), ("low", pa.float64()), ("high", pa.float64()), ("first", pa.int64()), ("at", pa.int64())])))

    def told(key: tuple, *values: list) -> pa.Table:
        names = [c.split()[0] for c in RUN.split(", ")]
        symbol, kind, blk = (k.as_py() for k in key)
        arrays = [pa.array([symbol], pa.string()), pa.array([kind], pa.string()), pa.array([blk], pa.int64()), *[pa.array([v], t) for v, t in zip(values, types, strict=True)]]
        return pa.table(dict(zip(names, arrays, strict=True)))

    def tuples(rows: pa.Table) -> list[tuple]:
        rows = rows.sort_by("bar")
        return list(zip(*[rows[c].to_pylist() for c in ("bar", "price", "atr")], strict=True))

    def first_run(key: tuple, rows: pa.Table) -> pa.Table:
        own = rows.filter(rows["own"])
        if not len(own):
            return told(key, [], [], []).slice(0, 0)
        entry, _ = pass_over([], tuples(rows.filter(pc.invert(rows["own"]))))
        return told(key, entry, *pass_over(entry, tuples(own)))

    def again(key: tuple, rows: pa.Table, entry: pa.Table) -> pa.Table:
        state = entry["into"][0].as_py()
        return told(key, state, *pass_over(state, tuples(rows)))

    sides = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("double").alias("price")) for k, c in (("L", "low"), ("H", "high"))])).alias("s")
    rows = bars.select("symbol", F.col("bar").cast("long").alias("bar"), F.col("atr").cast("double").alias("atr"), sides).select("symbol", "bar", "atr", "s.kind", "s.price")
    rows = saved(rows.withColumn("blk", F.floor(F.col("bar") / block)), "equal-rows")
    halo = rows.filter((F.col("blk") + 1) * block - F.col("bar") <= warm).withColumn("blk", F.col("blk") + 1)
    keys = ["symbol", "kind", "blk"]
    both = rows.withColumn("own", F.lit(True)).unionByName(halo.withColumn("own", F.lit(False)))
    runs = saved(both.groupBy(*keys).applyInArrow(first_run, RUN), "equal-runs")
    before = F.lag("blk").over(Window.partitionBy("symbol", "kind").orderBy("blk"))
    order = saved(runs.select(*keys, before.alias("prev")), "equal-order")  # numbers of blocks alone
    nothing = F.array().cast(STATE)
    while True:
        ends = runs.select("symbol", "kind", F.col("blk").alias("prev"), F.col("exit").alias("into"))
        due = runs.select(*keys, "entry").join(order, keys).join(ends, ["symbol", "kind", "prev"], "left").withColumn("into", F.coalesce("into", nothing))
        due = saved(due.filter(F.col("entry") != F.col("into")).select(*keys, "into"), "equal-due")
        if not due.limit(1).count():
            break
        own = rows.join(due.select(*keys), keys, "left_semi")
        mended = own.groupBy(*keys).cogroup(due.groupBy(*keys)).applyInArrow(again, RUN)
        runs = saved(runs.join(due.select(*keys), keys, "left_anti").unionByName(mended), "equal-runs")
    made = runs.select("symbol", "kind", F.explode("made").alias("m"))
    level = F.concat_ws("_", F.lit("equal"), "kind", F.col("m.first").cast("string"))
    return made.select("symbol", "kind", level.alias("level_id"), "m.price", F.col("m.low").alias("price_min"), F.col("m.high").alias("price_max"), F.col("m.first").alias("origin_bar"), F.col("m.at").alias("known_bar"), F.lit(min_touches).cast("long").alias("touch_count"))
