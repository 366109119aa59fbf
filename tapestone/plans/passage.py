"""First and last passages and counts over any distance: pyramids of block extremes, and counts by bits of the bar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folders import saved
from .layout import KEYS

#: Children of a node, and parts that the rows of a node above the lowest are dealt to, as very many rows may ask one node.
FANOUT, SALTS = 64, 16


def pyramid(bars: DataFrame, value: Column, keys: Sequence[str] = KEYS, order: str = "bar") -> list[DataFrame]:
    """From the bars up, (keys, node, held): the least ``value`` of each child of a node, in order.

    ``order`` numbers the rows of a series from 0 without gaps. A null value is never reached. The last level has one node a series.
    """
    levels, rows = [], bars.select(*keys, F.col(order).cast("long").alias("at"), value.alias("v"))
    last = bars.agg(F.max(order)).first()[0] or 0
    while True:
        held = F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"])
        levels.append(saved(rows.groupBy(*keys, F.floor(F.col("at") / FANOUT).alias("node")).agg(held.alias("held")), "pyramid"))
        if last < FANOUT:
            return levels
        last //= FANOUT
        rows = levels[-1].select(*keys, F.col("node").alias("at"), F.array_min("held").alias("v"))


def _asked(rows: DataFrame, level: DataFrame, keys: Sequence[str], above: bool) -> DataFrame:
    """``rows`` with the node that each asks, where it is there."""
    if not above:
        return rows.join(level, [*keys, "node"], "left")
    dealt = level.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("_from", "_price"), F.lit(SALTS)).cast("int")).join(dealt, [*keys, "node", "_salt"], "left").drop("_salt")


def passages(rows: DataFrame, bars: DataFrame, value: Column, price: Column, start: Column, out: str, strict: bool = False, last: bool = False, keys: Sequence[str] = KEYS, order: str = "bar", levels: list[DataFrame] | None = None) -> DataFrame:
    """``out``: the first bar at ``start`` or later whose ``value`` is at most ``price`` (under it if ``strict``); null if none is.

    With ``last``, the last such bar at ``start`` or earlier. A row asks its own block of bars, then the blocks after it in
    the same node, and so on up a pyramid of least values; from the first node that reaches its price it goes
    down again, one equi-join a level. Rows that are settled take no further part, whatever the distance. ``levels`` is
    the pyramid of ``value``, if there is one already.
    """
    levels = levels or pyramid(bars, value, keys, order)

    def reached(place: Column | None) -> Column:
        """The child, from ``place`` on (any if None), that reaches the price."""
        reaches = lambda x: F.coalesce(x < F.col("_price") if strict else x <= F.col("_price"), F.lit(False))
        if last:
            part = F.col("held") if place is None else F.slice("held", F.lit(1), (place + 1).cast("int"))
            at = F.array_position(F.transform(F.reverse(part), reaches), True)
            return F.when(at > 0, F.size(part) - at)
        first = F.lit(0) if place is None else place
        at = F.array_position(F.transform(F.slice("held", (first + 1).cast("int"), F.lit(FANOUT)), reaches), True)
        return F.when(at > 0, first + at - 1)

    own = [c for c in rows.columns if c != out]
    names = [*own, "_price", "_from"]
    asking = rows.select(*own, price.cast("double").alias("_price"), start.cast("long").alias("_from")).withColumn("_pos", F.col("_from"))
    if last:  # from beyond the end of a series, from its end
        ends = bars.groupBy(*keys).agg(F.max(order).alias("_end"))
        asking = asking.join(ends, list(keys), "left").withColumn("_pos", F.least("_pos", "_end")).drop("_end")
    else:
        asking = asking.withColumn("_pos", F.greatest("_pos", F.lit(0)))
    lost, found = [], []
    for k, level in enumerate(levels):
        placed = asking.withColumn("node", F.floor(F.col("_pos") / FANOUT))
        told = saved(_asked(placed, level, keys, k > 0).withColumn("_hit", F.col("node") * FANOUT + reached(F.pmod("_pos", F.lit(FANOUT)))).drop("held"), "passages")
        found.append(told.filter("_hit is not null").select(*names, "_hit"))
        asking = told.filter("_hit is null").withColumn("_pos", F.col("node") + (-1 if last else 1)).select(*names, "_pos")
        lost = [asking]
        if not asking.limit(1).count():
            break
    down = None
    for k in range(len(found) - 1, -1, -1):
        here = found[k] if down is None else found[k].unionByName(down)
        if k == 0:
            down = here
            break
        below = _asked(here.withColumnRenamed("_hit", "node"), levels[k - 1], keys, k > 1)
        down = saved(below.withColumn("_hit", F.col("node") * FANOUT + reached(None)).select(*names, "_hit"), "passages")
    none = lost[0].select(*names, F.lit(None).cast("long").alias("_hit"))
    return down.unionByName(none).select(*own, F.col("_hit").cast("long").alias(out))


def counts_from(rows: DataFrame, bars: DataFrame, value: Column, price: Column, start: Column, out: str, unit: float, keys: Sequence[str] = KEYS, order: str = "bar") -> DataFrame:
    """``out``: how many bars at ``start`` or later have a ``value`` of at most ``price``.

    The bars from ``start`` on are those that share its leading bits up to one that is 0 in it and 1 in them, and ``start``
    itself: for each bit, rows and bars meet in such a node, and a running count by value tells the rest. Values are
    counted in buckets ``unit`` wide and then inside them, so that no task holds a series. ``rows`` has no repeats.
    """
    bits = max(1, int(bars.agg(F.max(order)).first()[0] or 0).bit_length())
    own = [c for c in rows.columns if c != out]
    asks = rows.select(*own, price.cast("double").alias("_v"), F.greatest(start.cast("long"), F.lit(0)).alias("_at"))
    points = bars.select(*keys, F.col(order).cast("long").alias("_at"), value.cast("double").alias("_v")).filter("_v is not null")

    def nodes(side: int) -> Column:
        """(bit, node) of the bits that are ``side`` in ``_at``; bit -1 is the bar itself."""
        of = lambda b: F.when(F.shiftright("_at", b).bitwiseAND(1) == side, F.struct(F.lit(b).alias("bit"), F.shiftright("_at", b + 1).alias("node")))
        return F.array_compact(F.array(F.struct(F.lit(-1).alias("bit"), F.col("_at").alias("node")), *[of(b) for b in range(bits)]))

    at = [*keys, "bit", "node"]
    spread = points.withColumn("_n", F.explode(nodes(1))).select(*keys, "_n.*", "_v").groupBy(*at, "_v").agg(F.count(F.lit(1)).alias("n"))
    asked = asks.withColumn("_n", F.explode(nodes(0))).select(*keys, "_n.*", "_v", F.struct(*own).alias("_row"))
    empty = F.lit(None).cast(asked.schema["_row"].dataType).alias("_row")
    both = spread.select(*at, "_v", "n", empty).unionByName(asked.select(*at, "_v", F.lit(0).cast("long").alias("n"), "_row")).withColumn("_b", F.floor(F.col("_v") / unit))
    before = Window.partitionBy(*at).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    into = both.groupBy(*at, "_b").agg(F.sum("n").alias("_s")).select(*at, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_into"))
    inside = Window.partitionBy(*at, "_b").orderBy("_v").rangeBetween(Window.unboundedPreceding, 0)
    told = both.withColumn("_c", F.sum("n").over(inside)).filter("_row is not null").join(into, [*at, "_b"])
    return told.groupBy("_row").agg(F.sum(F.col("_c") + F.col("_into")).alias(out)).select("_row.*", F.col(out).cast("long"))
