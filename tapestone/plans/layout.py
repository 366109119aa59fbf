"""Layouts for series too long for one task: blocked index, halo blocks, affine scans, bucketed range joins, islands."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .folders import saved

KEYS = ("symbol",)
#: Blocks that a scan composes before it goes from one such group to the next.
SUPER = 256
#: The width of a bucket of bar numbers in as-of joins, islands and running sums; of times it is a month.
BUCKET = 4096


def bar_index(df: DataFrame, keys: Sequence[str] = KEYS, order: str = "ts") -> DataFrame:
    """``bar``, the 0-based place by ``order`` in each series: rows are numbered within a month, months are added up."""
    month = F.date_trunc("month", F.col(order))
    df = df.withColumn("_month", month)
    per_month = df.groupBy(*keys, "_month").count()
    before = Window.partitionBy(*keys).orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_month.select(*keys, "_month", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_month").orderBy(order)) - 1
    return df.withColumn("_in", inside).join(starts, [*keys, "_month"]).withColumn("bar", (F.col("_start") + F.col("_in")).cast("long")).drop("_month", "_in", "_start")


def blocked(df: DataFrame, back: int = 0, ahead: int = 0, block: int = 4096, keys: Sequence[str] = KEYS, order: str = "bar") -> tuple[DataFrame, WindowSpec]:
    """Rows copied to the neighbouring blocks that need them, and a window within blocks; see ``own_rows``.

    Frames of up to ``back`` rows before and ``ahead`` rows after are then whole, and no task holds a whole series.
    """
    if max(back, ahead) >= block:
        raise ValueError("a frame must be shorter than a block")
    at, place = F.floor(F.col(order) / block), F.pmod(F.col(order), F.lit(block))
    copies = [at]
    if back:
        copies.append(F.when(place >= block - back, at + 1))
    if ahead:
        copies.append(F.when(place < ahead, at - 1))
    out = df.withColumn("_blk", F.explode(F.array_compact(F.array(*copies)))).withColumn("_own", F.col("_blk") == at)
    return out, Window.partitionBy(*keys, "_blk").orderBy(order)


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter("_own").drop("_own", "_blk")


def affine_scan(df: DataFrame, a: float, value: str, out: str, b: float | None = None, keys: Sequence[str] = KEYS, order: str = "bar", block: int = 512) -> DataFrame:
    """y[t] = a * y[t-1] + b * x[t], y[0] = x[0], over each series; ``b`` is 1 - a by default.

    A block is one affine map of what comes in, and so are ``SUPER`` blocks on end. The maps of a series are composed first,
    block after block inside each of these and then from one to the next; then each block is replayed with its own carry.
    """
    b = 1 - a if b is None else b
    step = f"if(e.o = 0, e.x, {a} * s + {b} * e.x)"
    blocks = df.groupBy(*keys, F.floor(F.col(order) / block).alias("_blk")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("x")))).alias("e"))
    blocks = blocks.withColumn("_map", F.expr(f"struct(if(e[0].o = 0, 0d, pow({a}, size(e))) as a, aggregate(e, 0d, (s, e) -> {step}) as b)"))
    compose = lambda s, m: F.struct((m["a"] * s["a"]).alias("a"), (m["a"] * s["b"] + m["b"]).alias("b"))
    blocks = blocks.withColumn("_sup", F.floor(F.col("_blk") / SUPER))
    none = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("_blk", "_map"))), lambda x: x["_map"])
    supers = blocks.groupBy(*keys, "_sup").agg(F.aggregate(in_order, none, compose).alias("_all"))
    before = Window.partitionBy(*keys).orderBy("_sup").rowsBetween(Window.unboundedPreceding, -1)
    supers = supers.select(*keys, "_sup", F.aggregate(F.collect_list("_all").over(before), F.lit(0.0), lambda s, m: m["a"] * s + m["b"]).alias("_into"))
    inside = Window.partitionBy(*keys, "_sup").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.join(supers, [*keys, "_sup"]).withColumn("_carry", F.aggregate(F.collect_list("_map").over(inside), F.col("_into"), lambda s, m: m["a"] * s + m["b"]))
    replay = f"aggregate(e, struct(_carry as s, cast(array() as array<double>) as ys), (acc, e) -> named_struct('s', {step.replace(' s ', ' acc.s ')}, 'ys', concat(acc.ys, array({step.replace(' s ', ' acc.s ')}))), acc -> acc.ys)"
    ys = blocks.withColumn("_ys", F.expr(replay)).select(*keys, F.explode(F.arrays_zip(F.col("e.o").alias("o"), F.col("_ys").alias("y"))).alias("z"))
    return df.join(ys.select(*keys, F.col("z.o").alias(order), F.col("z.y").alias(out)), [*keys, order])


def range_join(points: DataFrame, bars: DataFrame, start: str, end: str, width: int, keys: Sequence[str] = KEYS, order: str = "bar") -> DataFrame:
    """Each point with the bars in ``start``..``end`` (inclusive, at most ``width`` apart): an equi-join on buckets."""
    spread = F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))
    left = points.filter(F.col(start) <= F.col(end)).withColumn("_bucket", F.explode(spread))
    right = bars.withColumn("_bucket", F.floor(F.col(order) / width))
    return left.join(right, [*keys, "_bucket"]).filter(F.col(order).between(F.col(start), F.col(end))).drop("_bucket")


def _bucket(df: DataFrame, on: str) -> Column:
    return F.date_trunc("month", F.col(on)) if dict(df.dtypes)[on].startswith(("timestamp", "date")) else F.floor(F.col(on) / BUCKET)


def asof_backward(left: DataFrame, right: DataFrame, on: str, columns: Sequence[str], keys: Sequence[str] = KEYS, forward: bool = False) -> DataFrame:
    """``left`` with ``columns`` of the last ``right`` row at or before it (first at or after it if ``forward``).

    Both sides are cut into buckets of ``on``, each a union and one window; what no row of the bucket tells comes from the
    nearest bucket before (after) that has one, a row for each bucket. No task holds a whole series.
    """
    value = F.struct(*columns)
    own = [c for c in left.columns if c not in (*keys, on)]
    sides = left.select(*keys, on, F.lit(1).alias("_side"), F.struct(*own).alias("_row"), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("_v")).unionByName(
        right.select(*keys, on, F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*own).alias("v")).schema["v"].dataType).alias("_row"), value.alias("_v"))
    )
    sides = sides.withColumn("_bkt", _bucket(left, on))
    place = lambda c: F.col(c).desc() if forward else F.col(c)
    edges = sides.groupBy(*keys, "_bkt").agg((F.min_by if forward else F.max_by)("_v", F.when(F.col("_v").isNotNull(), F.col(on))).alias("_e"))
    carried = F.last("_e", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(place("_bkt")).rowsBetween(Window.unboundedPreceding, -1))
    carries = edges.select(*keys, "_bkt", carried.alias("_c"))
    w = Window.partitionBy(*keys, "_bkt").orderBy(place(on), "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = sides.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).filter("_row is not null").join(carries, [*keys, "_bkt"], "left")
    found = found.withColumn("_v", F.coalesce("_v", "_c"))
    return found.select(*keys, on, "_row.*", *[F.col(f"_v.{c}").alias(c) for c in columns])


def asof_nearest(left: DataFrame, right: DataFrame, on: str, columns: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """``left`` with ``columns`` of the ``right`` row nearest to it in ``on``, the earlier one of two as near."""
    placed = right.withColumn("_at", F.col(on))
    before = asof_backward(left, placed, on, [*columns, "_at"], keys).select(*left.columns, F.struct(*columns, "_at").alias("_before"))
    both = asof_backward(before, placed, on, [*columns, "_at"], keys, forward=True)
    timed = dict(left.dtypes)[on].startswith("timestamp")
    number = lambda c: F.unix_micros(F.col(c).cast("timestamp")) if timed else F.col(c)
    far = lambda at: F.abs(number(at) - number(on))
    earlier = F.coalesce(far("_before._at") <= far("_at"), F.col("_before._at").isNotNull())
    return both.select(*left.columns, *[F.when(earlier, F.col(f"_before.{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def running_sum(df: DataFrame, value: str, out: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``out``: the sum of ``value`` up to and with each row of its series, by sums inside buckets of the first ``order`` column and of buckets."""
    df = df.withColumn("_bkt", _bucket(df, order[0]))
    starts = df.groupBy(*keys, "_bkt").agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(*keys, "_bkt", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_into"))
    inside = Window.partitionBy(*keys, "_bkt").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(value).over(inside)).join(starts, [*keys, "_bkt"]).withColumn(out, F.col(out) + F.col("_into")).drop("_bkt", "_into")


def islands(df: DataFrame, gap: int, keys: Sequence[str], order: str = "bar") -> DataFrame:
    """``island``: a new one wherever a row is more than ``gap`` after the row before it in its series.

    A row's predecessor matters only within ``gap``, so halo blocks tell where islands begin; a running sum numbers them.
    """
    held, w = blocked(df, gap, keys=keys, order=order, block=max(BUCKET, 2 * gap + 1))
    new = (F.col(order) - F.lag(order).over(w) > gap).cast("int")
    return running_sum(own_rows(held.withColumn("_new", F.coalesce(new, F.lit(1)))), "_new", "island", keys, [order]).drop("_new")


def placed(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``place``, the 0-based place of each row of its series in ``order``: a running count."""
    return running_sum(df.withColumn("_one", F.lit(1)), "_one", "place", keys, order).withColumn("place", (F.col("place") - 1).cast("long")).drop("_one")


def _chosen(bars: np.ndarray, k: int, at: int) -> tuple[np.ndarray, int]:
    """The places of rising ``bars`` that are accepted from ``at`` on, each more than ``k`` after the last; and from where the next may be."""
    out, i = [], int(np.searchsorted(bars, at))
    while i < len(bars):
        out.append(i)
        at = int(bars[i]) + k + 1
        i = int(np.searchsorted(bars, at))
    return np.array(out, np.int64), at


def greedy_cooldown(df: DataFrame, k: int, keys: Sequence[str], order: str = "bar", inclusive: bool = False) -> DataFrame:
    """Rows accepted one after the other, each more than ``k`` (``inclusive``: at least k) after the last accepted one.

    All that a block needs to know of those before it is how far into it the last accepted row still reaches: one of
    0 to k. So a block is a map of these numbers; maps of 1, 2, 4, ... blocks on end are composed in as many rounds as a
    series has doublings, and then each block is replayed from its own number. A task holds the distinct ``order``
    values of one block (at least ``BUCKET`` and 2 k wide), however dense a series is. Rows of one ``order`` value stay or go together.
    """
    k = max(0, k - 1) if inclusive else k
    width = max(BUCKET, 2 * (k + 1))
    df = saved(df, "cooling")  # read twice
    places = df.filter(F.col(order).isNotNull()).select(*keys, F.col(order).cast("long").alias("_at")).distinct().withColumn("_blk", F.floor(F.col("_at") / width))
    named = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in places.select(*keys).schema)

    def maps(key: tuple, rows: pa.Table) -> pa.Table:
        bars, begin = np.sort(rows["_at"].to_numpy()), key[-1].as_py() * width
        reach = [max(0, _chosen(bars, k, begin + i)[1] - begin - width) for i in range(k + 1)]
        return pa.table({**{c: rows[c][:1] for c in keys}, "_blk": pa.array([key[-1].as_py()], pa.int64()), "map": pa.array([reach], pa.list_(pa.int32()))})

    blocks = saved(places.groupBy(*keys, "_blk").applyInArrow(maps, f"{named}, _blk long, map array<int>"), "cooling-maps")
    span = blocks.groupBy(*keys).agg((F.max("_blk") - F.min("_blk")).alias("n")).agg(F.max("n")).first()[0] or 0
    so_far = blocks  # of each block: what the last 2^r blocks, itself with them, make of a number; an absent block makes it 0
    for r in range(int(span).bit_length()):
        earlier = so_far.select(*keys, (F.col("_blk") + (1 << r)).alias("_blk"), F.col("map").alias("_before"))
        both = F.when(F.col("_before").isNotNull(), F.transform("_before", lambda x: F.get("map", x))).otherwise(F.transform("map", lambda x: F.get("map", F.lit(0))))
        so_far = saved(so_far.join(earlier, [*keys, "_blk"], "left").select(*keys, "_blk", both.alias("map")), "cooling-maps")
    into = so_far.select(*keys, (F.col("_blk") + 1).alias("_blk"), F.get("map", F.lit(0)).alias("_reach"))

    def replay(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_at")
        at = _chosen(rows["_at"].to_numpy(), k, key[-1].as_py() * width + (rows["_reach"][0].as_py() or 0))[0]
        return rows.select([*keys, "_at"]).take(pa.array(at))

    taken = places.join(into, [*keys, "_blk"], "left").groupBy(*keys, "_blk").applyInArrow(replay, f"{named}, _at long")
    return df.join(taken.withColumnRenamed("_at", order), [*keys, order], "left_semi")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """All double columns rounded."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def when_full(value: Column, count: Column, n: int) -> Column:
    return F.when(count >= n, value)
