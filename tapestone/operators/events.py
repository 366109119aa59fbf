"""Levels, swings, sweeps, patterns, confirmations and de-duplication of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.projections import half_up
from ..plans.layout import asof_backward, bar_index, blocked, greedy_cooldown, islands, own_rows, range_join
from ..plans.passage import counts_from, passages, pyramid
from ..plans.winners import best_first


def swings(bars: DataFrame, left: int = 2, right: int = 2, strict: bool = True) -> DataFrame:
    """(symbol, bar, ts, kind, price, known_bar): confirmed lows (L) and highs (H).

    ``strict``: beyond all neighbours; otherwise equal to the window's extreme and beyond both edges only. A swing is
    known ``right`` bars later, and only if that bar exists.
    """
    df, w = blocked(bars, left, right)
    n = F.count("close").over(w.rowsBetween(-left, right))
    if strict:
        low = (F.col("low") < F.min("low").over(w.rowsBetween(-left, -1))) & (F.col("low") < F.min("low").over(w.rowsBetween(1, right)))
        high = (F.col("high") > F.max("high").over(w.rowsBetween(-left, -1))) & (F.col("high") > F.max("high").over(w.rowsBetween(1, right)))
    else:
        low = (F.col("low") == F.min("low").over(w.rowsBetween(-left, right))) & (F.col("low") < F.lag("low", left).over(w)) & (F.col("low") < F.lead("low", right).over(w))
        high = (F.col("high") == F.max("high").over(w.rowsBetween(-left, right))) & (F.col("high") > F.lag("high", left).over(w)) & (F.col("high") > F.lead("high", right).over(w))
    df = own_rows(df.withColumn("_l", low & (n == left + right + 1)).withColumn("_h", high & (n == left + right + 1)))
    rows = F.array(F.when(F.col("_l"), F.struct(F.lit("L").alias("kind"), F.col("low").alias("price"))), F.when(F.col("_h"), F.struct(F.lit("H").alias("kind"), F.col("high").alias("price"))))
    return df.select("symbol", "bar", "ts", F.explode(F.array_compact(rows)).alias("s"), (F.col("bar") + right).alias("known_bar")).select("symbol", "bar", "ts", "s.kind", "s.price", "known_bar")


def level_lifecycle(levels: DataFrame, bars: DataFrame, horizon: int, tolerance: float) -> DataFrame:
    """Touches, first sweep and state of each level over the ``horizon`` bars after it is known."""
    span = levels.withColumn("_from", F.col("known_bar") + 1).withColumn("_to", F.col("known_bar") + horizon)
    near = range_join(span.withColumnRenamed("bar", "origin_bar").drop("ts"), bars.select("symbol", "bar", "high", "low", "close"), "_from", "_to", horizon)
    touched = F.when(F.col("kind") == "L", F.abs(F.col("low") - F.col("price"))).otherwise(F.abs(F.col("high") - F.col("price"))) <= tolerance
    swept = F.when(F.col("kind") == "L", (F.col("low") < F.col("price")) & (F.col("close") > F.col("price"))).otherwise((F.col("high") > F.col("price")) & (F.col("close") < F.col("price")))
    broken = F.when(F.col("kind") == "L", F.col("close") < F.col("price")).otherwise(F.col("close") > F.col("price"))
    out = near.groupBy("symbol", "origin_bar", "kind", "price", "known_bar").agg(
        F.count_if(touched).alias("touch_count"), F.min(F.when(swept, F.col("bar"))).alias("swept_bar"), F.min(F.when(broken, F.col("bar"))).alias("broken_bar")
    )
    return out.withColumn("status", F.when(F.col("swept_bar").isNotNull(), "swept").when(F.col("broken_bar").isNotNull(), "invalidated").otherwise("active"))


def level_states(levels: DataFrame, bars: DataFrame, tolerance: float = 0.1, max_age: int = 200, unit: float = 0.25) -> DataFrame:
    """``levels`` (symbol, level_id, level_type, kind, price, origin_bar, known_bar, n_seed) with their state at the end of their series, however far that is.

    A low is touched by a bar whose low is at most its price, and swept by one whose low is under it, from ``known_bar`` on;
    highs likewise. Levels of type ``equal`` are touched ``tolerance`` ATR earlier and swept as much later. A swing is
    touched from its own bar on, a day's level once it is known, and an equal level has its ``n_seed`` first touches, up to
    the one that made it known, before those that follow. A bar without ATR counts for nothing. A level is swept
    by its first sweep, else invalidated when it is more than ``max_age`` bars old, else active. ``unit`` is the width
    of the price buckets in which touches are counted.
    """
    wide = F.col("level_type") == "equal"
    side = F.concat("kind", F.when(wide, "1").otherwise("0"))
    own = levels.withColumn("side", side).withColumn("_p", F.when(F.col("kind") == "L", F.col("price")).otherwise(-F.col("price")))
    own = own.withColumn("_since", F.when(wide, F.col("known_bar") + 1).when(F.col("level_type") == "prev_day", F.col("known_bar")).otherwise(F.col("origin_bar")))
    # highs are lows of the other sign
    sides = F.array(*[F.struct(F.lit(f"{kind}{i}").alias("side"), (F.col("low") if kind == "L" else -F.col("high")).alias("v"), (F.col("atr") * t).alias("r")) for kind in "LH" for i, t in enumerate((0.0, tolerance))])
    reach = bars.select("symbol", "bar", F.explode(sides).alias("s")).select("symbol", "bar", "s.side", (F.col("s.v") - F.col("s.r")).alias("touch"), (F.col("s.v") + F.col("s.r")).alias("pass"))
    keys, at = ("symbol", "side"), ["symbol", "level_id"]
    touch = pyramid(reach, F.col("touch"), keys)
    asks = own.select("symbol", "side", "level_id", "_p", "_since", "known_bar")
    touched = counts_from(asks, reach, F.col("touch"), F.col("_p"), F.col("_since"), "_n", unit, keys)
    firsts = passages(asks, reach, F.col("touch"), F.col("_p"), F.col("_since"), "_first", keys=keys, levels=touch)
    lasts = passages(asks, reach, F.col("touch"), F.col("_p"), F.lit((1 << 62)), "_last", last=True, keys=keys, levels=touch)
    swept = passages(asks, reach, F.col("pass"), F.col("_p"), F.col("known_bar"), "swept_bar", strict=True, keys=keys)
    out = own
    for part, c in ((touched, "_n"), (firsts, "_first"), (lasts, "_last"), (swept, "swept_bar")):
        out = out.join(part.select(*at, c), at, "left")
    ends = bars.groupBy("symbol").agg(F.max("bar").alias("_end"))
    out = out.join(ends, "symbol").filter(F.col("known_bar") <= F.col("_end"))
    again = F.when(F.col("_first").isNotNull(), F.col("_last"))  # the last touch of all is one since
    age = F.col("_end") - F.col("origin_bar")
    state = F.when(F.col("swept_bar").isNotNull(), "swept").when(age > max_age, "invalidated").otherwise("active")
    last = F.coalesce(again, F.when(wide, F.col("known_bar")))
    return out.select(
        *levels.columns, (F.coalesce("_n", F.lit(0)) + F.when(wide, F.col("n_seed")).otherwise(0)).cast("long").alias("touch_count"),
        F.when(wide, F.col("origin_bar")).otherwise(F.col("_first")).alias("first_touch_bar"), last.alias("last_touch_bar"), age.alias("age_bars"), (F.col("_end") - last).alias("bars_since_last_touch"),
        "swept_bar", state.alias("sweep_state"), F.when(state == "active", "active").otherwise("expired").alias("status"), F.when(state == "invalidated", F.col("origin_bar") + max_age + 1).alias("invalidated_bar"),
    )


def sweep_flags(rolled: DataFrame, min_wick: float = 0.3, max_depth: float = 3.0) -> DataFrame:
    """Bars whose low (high) passes the prior extreme and closes back inside: long and short flags, depth in ATR."""
    atr = F.expr("nullif(atr, 0)")
    below, above = (F.col("prior_low") - F.col("low")) / atr, (F.col("high") - F.col("prior_high")) / atr
    long = (below > 0) & (below <= max_depth) & (F.col("close") > F.col("prior_low")) & (F.col("lower_wick") >= min_wick)
    short = (above > 0) & (above <= max_depth) & (F.col("close") < F.col("prior_high")) & (F.col("upper_wick") >= min_wick)
    return rolled.withColumn("sweep_long", F.coalesce(long, F.lit(False))).withColumn("sweep_short", F.coalesce(short, F.lit(False))).withColumn("depth_long", below).withColumn("depth_short", above)


def sweep_rows(flagged: DataFrame) -> DataFrame:
    """One row for each flag; a bar may give both sides."""
    side = lambda name, level, depth: F.when(F.col(f"sweep_{name}"), F.struct(F.lit(name).alias("direction"), F.col(level).alias("level"), F.col(depth).alias("depth")))
    both = F.array_compact(F.array(side("long", "prior_low", "depth_long"), side("short", "prior_high", "depth_short")))
    return flagged.select("symbol", "bar", "ts", "open", "high", "low", "close", "atr", F.explode(both).alias("e")).select("symbol", "bar", "ts", "open", "high", "low", "close", "atr", "e.*")


def group_runs(rows: DataFrame, rule: str = "first") -> DataFrame:
    """One row for each run of consecutive bars of one side: its first bar, or its deepest (earliest on a tie)."""
    w = Window.partitionBy("symbol", "direction").orderBy("bar")
    run = rows.withColumn("_new", F.coalesce((F.col("bar") - F.lag("bar").over(w) > 1).cast("int"), F.lit(1))).withColumn("run", F.sum("_new").over(w)).drop("_new")
    order = [F.col("bar")] if rule == "first" else [F.col("depth").desc(), F.col("bar")]
    return run.withColumn("_n", F.row_number().over(Window.partitionBy("symbol", "direction", "run").orderBy(*order))).filter("_n = 1").drop("_n")


def deduplicated_sweeps(rows: DataFrame, cooldown: int, rule: str = "first") -> DataFrame:
    return greedy_cooldown(group_runs(rows, rule), cooldown, ("symbol", "direction"))


def confirmations(events: DataFrame, bars: DataFrame, max_wait: int = 8) -> DataFrame:
    """First bar, up to ``max_wait`` after the event, that closes beyond the event's own range on its side."""
    span = events.withColumn("_from", F.col("bar") + 1).withColumn("_to", F.col("bar") + max_wait).select("symbol", F.col("bar").alias("event_bar"), "direction", F.col("high").alias("event_high"), F.col("low").alias("event_low"), "_from", "_to")
    near = range_join(span, bars.select("symbol", "bar", "close"), "_from", "_to", max_wait)
    hit = F.when(F.col("direction") == "long", F.col("close") > F.col("event_high")).otherwise(F.col("close") < F.col("event_low"))
    found = near.filter(hit).groupBy("symbol", "event_bar", "direction").agg(F.min("bar").alias("confirm_bar"))
    return events.join(found.withColumnRenamed("event_bar", "bar"), ["symbol", "bar", "direction"], "left").withColumn("delay", F.col("confirm_bar") - F.col("bar"))


def reversals(swing: DataFrame, bars: DataFrame, n: int = 3, equality: float = 0.15, max_wait: int = 12) -> DataFrame:
    """Alternating runs of ``n`` swings (3: double, 5: head and shoulders) that cross their neckline in time.

    Outer extremes differ by at most ``equality`` of the depth; of five, the middle extreme is beyond both. The neckline
    is the nearest swing of the other kind, and the first close beyond it within ``max_wait`` bars confirms.
    """
    w = Window.partitionBy("symbol").orderBy("bar", F.col("kind").desc())
    df = swing
    for i in range(1, n):
        for c in ("bar", "kind", "price", "known_bar"):
            df = df.withColumn(f"{c}{i}", F.lead(c, i).over(w))
    last = n - 1
    alternate = F.lit(True)
    for i in range(1, n):
        alternate = alternate & (F.col(f"kind{i}") != (F.col("kind") if i == 1 else F.col(f"kind{i - 1}")))
    necks = [F.col(f"price{i}") for i in range(1, n, 2)]
    sign: Column = F.when(F.col("kind") == "L", 1.0).otherwise(-1.0)
    neck = (F.greatest(*necks) if len(necks) > 1 else necks[0]) if n == 3 else F.when(F.col("kind") == "L", F.greatest(*necks)).otherwise(F.least(*necks))
    depth = sign * (neck - F.col("price"))
    fits = alternate & (depth > 0) & (F.abs(F.col(f"price{last}") - F.col("price")) <= equality * depth)
    if n == 5:
        fits = fits & (sign * (F.col("price") - F.col("price2")) > 0) & (sign * (F.col("price4") - F.col("price2")) > 0)
    df = df.withColumn("neckline", neck).withColumn("depth", depth).filter(fits)
    df = df.select("symbol", F.when(F.col("kind") == "L", "bullish").otherwise("bearish").alias("direction"), F.col("bar").alias("start_bar"), F.col(f"bar{last}").alias("end_bar"), F.col(f"known_bar{last}").alias("detect_bar"), "neckline", "depth")
    df = df.withColumn("_from", F.col("detect_bar") + 1).withColumn("_to", F.col("detect_bar") + max_wait)
    near = range_join(df, bars.select("symbol", "bar", "close"), "_from", "_to", max_wait)
    crossed = F.when(F.col("direction") == "bullish", F.col("close") > F.col("neckline")).otherwise(F.col("close") < F.col("neckline"))
    return near.filter(crossed).groupBy("symbol", "direction", "start_bar", "end_bar", "detect_bar", "neckline", "depth").agg(F.min("bar").alias("confirm_bar"))


def suppress_overlaps(events: DataFrame, start: str = "start_bar", end: str = "end_bar", score: str = "depth") -> DataFrame:
    """Non-maximum suppression: of overlapping spans the best score stays, then the earliest start.

    Rows without a span or a score go. See ``best_first``: no task holds an island of overlapping spans.
    """
    keys = ["symbol", "direction", start, end, score]
    spans = events.select(*keys).dropna().distinct()

    def meets(cols: dict, i: int, those: object) -> object:
        return (cols[start][those] <= cols[end][i]) & (cols[start][i] <= cols[end][those])

    kept = best_first(spans, ["symbol", "direction"], start, end, [-F.col(score), F.col(start), F.col(end)], meets).filter("_kept")
    return events.join(kept.select(*keys), keys, "left_semi")


def latest_pivot(bars: DataFrame, swing: DataFrame, kind: str, max_age: int) -> DataFrame:
    """(symbol, bar, pivot_bar, pivot_price): the last swing of ``kind`` known before each bar, null if over ``max_age`` bars old."""
    pivots = swing.filter(F.col("kind") == kind).select("symbol", (F.col("known_bar") + 1).alias("bar"), F.col("bar").alias("pivot_bar"), F.col("price").alias("pivot_price"))
    found = asof_backward(bars.select("symbol", "bar", "close"), pivots, "bar", ["pivot_bar", "pivot_price"])
    fresh = F.col("bar") - F.col("pivot_bar") <= max_age
    return found.select("symbol", "bar", *[F.when(fresh, F.col(c)).alias(c) for c in ("pivot_bar", "pivot_price")])


def level_registry(sources: dict[str, DataFrame]) -> DataFrame:
    """Levels (symbol, kind, price, known_bar) of all sources; of equal symbol, kind and price the first known stays, then the first source name."""
    parts = [df.select("symbol", "kind", "price", "known_bar", F.lit(name).alias("source")) for name, df in sources.items()]
    levels = parts[0]
    for part in parts[1:]:
        levels = levels.unionByName(part)
    first = F.min(F.struct("known_bar", "source")).alias("first")
    return levels.groupBy("symbol", "kind", "price").agg(first).select("symbol", "kind", "price", "first.known_bar", "first.source")


def with_trend(sweeps: DataFrame, trend: DataFrame) -> DataFrame:
    """Long sweeps in a rising trend and short ones in a falling one; ``trend`` is (symbol, bar, trend)."""
    wanted = F.when(F.col("direction") == "long", 1).otherwise(-1)
    return sweeps.join(trend.select("symbol", "bar", "trend"), ["symbol", "bar"]).filter(F.col("trend") == wanted)


def timeline_check(events: DataFrame, stamps: list[str]) -> DataFrame:
    """``violation``: a stamp is missing, or earlier than the stamp named before it."""
    missing = F.greatest(*[F.col(c).isNull() for c in stamps]) if len(stamps) > 1 else F.col(stamps[0]).isNull()
    late = F.lit(False)
    for a, b in zip(stamps, stamps[1:], strict=False):
        late = late | F.coalesce(F.col(a) > F.col(b), F.lit(False))
    return events.withColumn("violation", missing | late)


def coarse_swings(coarse: DataFrame, bars: DataFrame, left: int = 2, right: int = 2) -> DataFrame:
    """Swings of closed coarse bars (with ``bucket_end``), known at the first fine bar that opens once the last coarse bar needed has closed."""
    numbered = bar_index(coarse)
    found = swings(numbered, left, right)
    ends = numbered.select("symbol", F.col("bar").alias("known_bar"), F.col("bucket_end").alias("at"))
    placed = found.join(ends, ["symbol", "known_bar"]).select("symbol", F.col("at").alias("ts"), F.col("bar").alias("coarse_bar"), "kind", "price")
    out = asof_backward(placed, bars.select("symbol", "ts", F.col("bar").alias("known_bar")), "ts", ["known_bar"], forward=True)
    return out.drop("ts").filter("known_bar is not null")


def states_at(lifecycle: DataFrame, probes: DataFrame, horizon: int) -> DataFrame:
    """The state of each level at each probed bar of the ``horizon`` bars after it is known, from its first sweep and first break."""
    span = lifecycle.withColumn("_from", F.col("known_bar") + 1).withColumn("_to", F.col("known_bar") + horizon)
    near = range_join(span, probes.select("symbol", "bar"), "_from", "_to", horizon)
    status = F.when(F.col("swept_bar") <= F.col("bar"), "swept").when(F.col("broken_bar") <= F.col("bar"), "invalidated").otherwise("active")
    return near.select("symbol", "origin_bar", "kind", "bar", status.alias("status"), (F.col("bar") - F.col("known_bar")).alias("age"))


def level_sweeps(lifecycle: DataFrame, bars: DataFrame, min_depth: float = 0.0, max_depth: float = 3.0, min_wick: float = 0.3) -> DataFrame:
    """The first sweep of each level with its depth, wick and reclaim, and whether the sweep rules would take it."""
    own = bars.select("symbol", F.col("bar").alias("swept_bar"), "open", "high", "low", "close", "atr")
    rows = lifecycle.filter("swept_bar is not null").join(own, ["symbol", "swept_bar"])
    low, atr, size = F.col("kind") == "L", F.expr("nullif(atr, 0)"), F.expr("nullif(high - low, 0)")
    depth = F.when(low, F.col("price") - F.col("low")).otherwise(F.col("high") - F.col("price")) / atr
    wick = F.when(low, F.least("open", "close") - F.col("low")).otherwise(F.col("high") - F.greatest("open", "close")) / size
    reclaim = F.when(low, F.col("close") - F.col("price")).otherwise(F.col("price") - F.col("close")) / atr
    rows = rows.select("symbol", "origin_bar", "kind", "swept_bar", depth.alias("depth"), wick.alias("wick"), reclaim.alias("reclaim"))
    passes = F.col("depth").between(min_depth, max_depth) & (F.col("wick") >= min_wick) & (F.col("reclaim") > 0)
    return rows.withColumn("passes", F.coalesce(passes, F.lit(False)))


def run_anchors(rows: DataFrame) -> DataFrame:
    """``anchor_bar``, the first bar of a row's run of consecutive sweeps, and ``extreme``, the furthest price since."""
    df = islands(rows, 1, ("symbol", "direction"))
    w = Window.partitionBy("symbol", "direction", "island").orderBy("bar")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    extreme = F.when(F.col("direction") == "long", F.min("low").over(upto)).otherwise(F.max("high").over(upto))
    return df.withColumn("anchor_bar", F.first("bar").over(upto)).withColumn("extreme", extreme).drop("island")


def entry_schedule(events: DataFrame, bars: DataFrame, at: str = "bar", cost: float = 0.0) -> DataFrame:
    """``entry_bar`` and ``entry``: the open of the bar after ``at``, worse by ``cost``; events without such a bar go."""
    opens = bars.select("symbol", (F.col("bar") - 1).alias(at), F.col("bar").alias("entry_bar"), F.col("open").alias("_open"))
    sign = F.when(F.col("direction") == "long", 1.0).otherwise(-1.0)
    return events.join(opens, ["symbol", at]).withColumn("entry", F.col("_open") + sign * cost).drop("_open")


def confirm_cooldown(events: DataFrame, k: int, at: str = "confirm_bar", score: str = "depth") -> DataFrame:
    """Of events that confirm at one bar the best (then the earliest start), and of those each at least ``k`` bars after the last kept."""
    keys = ["symbol", "direction"]
    best = F.row_number().over(Window.partitionBy(*keys, at).orderBy(F.col(score).desc(), "start_bar", "end_bar"))
    single = events.withColumn("_n", best).filter("_n = 1").drop("_n")
    return greedy_cooldown(single, k, keys, at, inclusive=True)


def opposite_overlaps(events: DataFrame, width: int = 64) -> DataFrame:
    """Pairs of a bullish and a bearish event of one symbol whose structures' spans meet, and whether a neckline of one lies in the other's span; spans meet in buckets of ``width`` bars, however long they are."""
    spans = events.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_bar") / width), F.floor(F.col("end_bar") / width))))
    side = lambda d, p: spans.filter(F.col("direction") == d).select("symbol", "_b", F.col("event_id").alias(f"{d}_id"), F.col("start_bar").alias(f"{p}a"), F.col("end_bar").alias(f"{p}z"), F.col("neck_bar").alias(f"{p}n"))
    both = side("bullish", "x").join(side("bearish", "y"), ["symbol", "_b"]).filter("xa <= yz and ya <= xz")
    # a pair counts in the first bucket that both reach
    both = both.filter(F.col("_b") == F.floor(F.greatest("xa", "ya") / width))
    return both.select("symbol", "bullish_id", "bearish_id", F.expr("coalesce(xn between ya and yz, false) or coalesce(yn between xa and xz, false)").alias("neck_inside"))


def previous_day_levels(bars: DataFrame) -> DataFrame:
    """(symbol, kind, price, known_bar): the last traded day's high and low, known at a day's first bar."""
    days = bars.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.max("high").alias("h"), F.min("low").alias("l"), F.min("bar").alias("known_bar"))
    w = Window.partitionBy("symbol").orderBy("day")
    prior = days.select("symbol", "known_bar", F.lag("h").over(w).alias("H"), F.lag("l").over(w).alias("L")).filter("H is not null")
    return prior.select("symbol", "known_bar", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("price")) for k in ("H", "L")])).alias("x")).select("symbol", "x.kind", "x.price", "known_bar")


def level_table(sources: dict[str, DataFrame], h1: tuple[str, ...] = ()) -> DataFrame:
    """Levels (symbol, kind, price, known_bar, and dispersion_atr where known) of all sources as rows with ``level_id`` and ``level_type``; those of ``h1`` are coarse swings."""
    out = None
    for name, df in sources.items():
        more = F.col("dispersion_atr") if "dispersion_atr" in df.columns else F.lit(None).cast("double")
        part = df.select("symbol", F.concat_ws("_", F.lit(name), "kind", F.col("known_bar").cast("string")).alias("level_id"), F.lit("swing" if name in h1 else name).alias("level_type"), "kind", "price", "known_bar", F.lit(name in h1).alias("is_h1"), more.alias("dispersion_atr"))
        out = part if out is None else out.unionByName(part)
    return out


def bar_at(rows: DataFrame, bars: DataFrame, ts: str = "ts", out: str = "bar", strict: bool = True) -> DataFrame:
    """``rows`` with the bar of exactly their time; without one, an error if ``strict``, else the row goes."""
    places = bars.select("symbol", F.col("ts").alias(ts), F.col("bar").alias(out))
    if not strict:
        return rows.join(places, ["symbol", ts])
    found = rows.join(places, ["symbol", ts], "left")
    absent = F.raise_error(F.concat_ws(" ", F.lit("no bar at"), F.col("symbol"), F.col(ts).cast("string"))).cast("long")
    return found.withColumn(out, F.coalesce(F.col(out), absent))


def labelled(features: DataFrame, labels: DataFrame, key: str = "event_id") -> DataFrame:
    """Features and labels of one event; a column that both have comes from the features."""
    more = [c for c in labels.columns if c == key or c not in features.columns]
    return features.join(labels.select(*more), key)


def structure_box(events: DataFrame, bars: DataFrame, start: str = "start_bar", end: str = "end_bar", width: int = 256) -> DataFrame:
    """(symbol, start, end, box_low, box_high): the price range of the bars between an event's anchors, both included."""
    keys = ["symbol", start, end]
    span = events.select(*keys).distinct().withColumn("_from", F.col(start)).withColumn("_to", F.col(end))
    return range_join(span, bars.select("symbol", "bar", "high", "low"), "_from", "_to", width).groupBy(*keys).agg(F.min("low").alias("box_low"), F.max("high").alias("box_high"))


def levels_near(events: DataFrame, levels: DataFrame, unit: float, within_atr: float = 1.0, price: str = "close") -> DataFrame:
    """(symbol, direction, bar, n_levels, nearest): levels known by an event's bar within ``within_atr`` ATR of its price, by buckets of price ``unit`` wide."""
    keys = ["symbol", "direction", "bar"]
    reach = F.col("atr") * within_atr
    spread = events.select(*keys, "atr", F.col(price).alias("_p")).filter("atr is not null").withColumn("_b", F.explode(F.sequence(F.floor((F.col("_p") - reach) / unit), F.floor((F.col("_p") + reach) / unit))))
    priced = levels.select("symbol", "known_bar", F.col("price").alias("_l")).withColumn("_b", F.floor(F.col("_l") / unit))
    near = spread.join(priced, ["symbol", "_b"]).filter((F.col("known_bar") <= F.col("bar")) & (F.abs(F.col("_l") - F.col("_p")) <= reach))
    found = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_levels"), F.min(F.abs(F.col("_l") - F.col("_p"))).alias("nearest"))
    return events.select(*keys).join(found, keys, "left").withColumn("n_levels", F.coalesce("n_levels", F.lit(0)))


def signal_rows(events: DataFrame, probability: float = 0.5) -> DataFrame:
    """The record that is sent for a group's representative: prices to five places, scores to four, a missing probability as ``probability``."""
    r = lambda c, n: half_up(F.col(c), n).alias(c)
    return events.select("symbol", "direction", "event_id", r("entry", 5), r("stop", 5), r("target", 5), r("rule_score", 4), half_up(F.coalesce("model_prob", F.lit(probability)), 4).alias("model_prob"))


def overlap_counts(events: DataFrame, keys: tuple[str, ...] = ("symbol", "direction")) -> DataFrame:
    """(keys, n, overlapping): events, and those whose span meets another's: one that starts before and ends no earlier than it starts, or one after that starts within it."""
    w = Window.partitionBy(*keys).orderBy("start_bar", "end_bar")
    before = F.max("end_bar").over(w.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("start_bar")
    after = F.lead("start_bar").over(w) <= F.col("end_bar")
    marked = events.withColumn("_o", F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False)))
    return marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("_o").alias("overlapping"))
