"""Whole reversal patterns: doubles, head and shoulders, wedges, and swept levels, with entry, stop, target, score and discards.

Each detector is a set of candidate rows (consecutive swings of a series side by side), filters on their geometry, one
bucketed range join to the bar that confirms, and two equi-joins to the bars of confirmation and entry. All give the
columns of ``EVENT``, so that they can be put one below the other.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..plans.folders import saved
from ..plans.layout import blocked, own_rows, placed, range_join
from ..plans.winners import best_first
from . import events as ev

EVENT = ("symbol", "pattern", "direction", "start_bar", "neck_bar", "end_bar", "detect_bar", "cross_bar", "confirm_bar", "entry_bar", "entry", "stop", "target", "neckline", "rule_score", "depth_atr", "offset_atr", "left_len", "right_len", "discard_reason")


def side() -> Column:
    """1 for bullish rows, -1 for bearish ones."""
    return F.when(F.col("direction") == "bullish", 1.0).otherwise(-1.0)


def swing_chains(swings: DataFrame, n: int, kinds: Sequence[str] = ("L", "H")) -> DataFrame:
    """Every swing of ``kinds`` with the ``n`` - 1 after it: bar0.., price0.., kind0.., known0.. (lows come first at one bar)."""
    own = swings.filter(F.col("kind").isin(*kinds)).withColumn("_low", F.col("kind") == "H")
    held, w = blocked(placed(own, ("symbol",), ["bar", "_low"]), 0, n - 1, order="place")
    next_to = [F.lead(c, i).over(w).alias(f"{name}{i}") for i in range(n) for c, name in (("bar", "bar"), ("price", "price"), ("kind", "kind"), ("known_bar", "known"))]
    return own_rows(held.select("symbol", "_own", "_blk", *next_to)).filter(F.col(f"bar{n - 1}").isNotNull())


def _atr_at(rows: DataFrame, bars: DataFrame, bar: str, out: str) -> DataFrame:
    return rows.join(bars.select("symbol", F.col("bar").alias(bar), F.col("atr").alias(out)), ["symbol", bar])


def _crossed(rows: DataFrame, bars: DataFrame, level: Column, max_wait: int) -> DataFrame:
    """``rows`` (by symbol, direction, start_bar, end_bar) with ``cross_bar``, the first of ``max_wait`` bars after the end that closes beyond ``level`` (which may use ``bar``)."""
    keys = ["symbol", "direction", "start_bar", "end_bar"]
    span = rows.withColumn("_from", F.col("end_bar") + 1).withColumn("_to", F.col("end_bar") + max_wait)
    beyond = side() * (F.col("close") - level) > 0
    found = range_join(span, bars.select("symbol", "bar", "close"), "_from", "_to", max_wait).filter(beyond).groupBy(*keys).agg(F.min("bar").alias("cross_bar"))
    return rows.join(found, keys)


def _entered(rows: DataFrame, bars: DataFrame) -> DataFrame:
    """With ``confirm_bar`` (the cross, once the last swing is known), its close and range, and the entry: the next bar's open, or at the series' end that close."""
    at = bars.select("symbol", F.col("bar").alias("confirm_bar"), F.col("close").alias("confirm_close"), (F.col("high") - F.col("low")).alias("confirm_range"))
    after = bars.select("symbol", (F.col("bar") - 1).alias("confirm_bar"), F.col("open").alias("_open"))
    rows = rows.withColumn("confirm_bar", F.greatest("cross_bar", "detect_bar")).join(at, ["symbol", "confirm_bar"]).join(after, ["symbol", "confirm_bar"], "left")
    return rows.withColumn("entry_bar", F.col("confirm_bar") + F.col("_open").isNotNull().cast("int")).withColumn("entry", F.coalesce("_open", "confirm_close")).drop("_open")


def _named(rows: DataFrame, names: tuple[str, str]) -> DataFrame:
    return rows.withColumn("pattern", F.when(F.col("direction") == "bullish", names[0]).otherwise(names[1]))


def _symmetry() -> Column:
    return 1.0 - F.least(F.abs(F.col("left_len") - F.col("right_len")) / F.greatest("left_len", "right_len"), F.lit(1.0))


def _share(x: Column, most: float) -> Column:
    return F.least(x / most, F.lit(1.0))


def double_patterns(
    bars: DataFrame, left: int = 3, right: int = 3, min_apart: int = 4, max_offset: float = 1.5, min_depth: float = 3.0, buffer: float = 0.5, reward: float = 1.5, fixed_target: float = 0.0,
    target_cap: float = 0.0, stop_mode: str = "extremes", min_reward: float = 1.0, max_length: int = 30, min_score: float = 0.0, trend: tuple[int, float, float] | None = None, max_wait: int = 60,
) -> DataFrame:
    """Double bottoms and tops of ``bars`` (with ``atr``): two like extremes around a neckline that a close then crosses.

    ``bars`` should be a table: each detector reads it several times. Distances are in ATR at the bar where the last swing is known. The stop lies ``buffer`` beyond both extremes, or with
    ``stop_mode`` neckline beyond the neckline where that is tighter and still on its side of the entry; the target is
    ``reward`` risks away, or ``fixed_target`` ATR, and never more than ``target_cap`` ATR. Candidates under
    ``min_reward`` go. Those too long, scored too low, or without the trend (lookback, least slope, least R2) that they
    reverse stay with a ``discard_reason``; see ``settled``.
    """
    rows = swing_chains(ev.swings(bars, left, right, strict=False), 3).filter("kind0 = kind2 and kind0 <> kind1 and bar0 < bar1 and bar1 < bar2")
    rows = rows.withColumn("direction", F.when(F.col("kind0") == "L", "bullish").otherwise("bearish")).withColumn("detect_bar", F.col("known2"))
    rows = _atr_at(rows, bars, "detect_bar", "atr_k").filter("atr_k > 0")
    inner, outer = (F.when(F.col("kind0") == "L", f("price0", "price2")).otherwise(g("price0", "price2")) for f, g in ((F.greatest, F.least), (F.least, F.greatest)))
    rows = rows.withColumns({
        "start_bar": F.col("bar0"), "neck_bar": F.col("bar1"), "end_bar": F.col("bar2"), "neckline": F.col("price1"), "left_len": F.col("bar1") - F.col("bar0"), "right_len": F.col("bar2") - F.col("bar1"),
        "depth": side() * (F.col("price1") - inner), "extreme": outer, "offset_atr": F.abs(F.col("price0") - F.col("price2")) / F.col("atr_k"),
    })
    rows = rows.filter((F.least("left_len", "right_len") >= min_apart) & (F.col("offset_atr") <= max_offset) & (F.col("depth") >= min_depth * F.col("atr_k")) & (F.col("depth") >= 0))
    rows = _entered(_crossed(rows, bars, F.col("neckline"), max_wait), bars)
    wide = F.col("extreme") - side() * buffer * F.col("atr_k")
    tight = F.col("neckline") - side() * buffer * F.col("atr_k")
    ok = (side() * (tight - wide) > 0) & (side() * (F.col("entry") - tight) > 0)
    rows = rows.withColumn("stop", F.when(ok, tight).otherwise(wide) if stop_mode == "neckline" else wide).withColumn("risk", F.abs(F.col("entry") - F.col("stop"))).filter("risk > 0")
    far = fixed_target * F.col("atr_k") if fixed_target > 0 else reward * F.col("risk")
    far = F.least(far, target_cap * F.col("atr_k")) if target_cap > 0 else far
    rows = rows.withColumn("_far", far).filter(F.col("_far") / F.col("risk") >= min_reward).withColumn("target", F.col("entry") + side() * F.col("_far")).withColumn("depth_atr", F.col("depth") / F.col("atr_k"))
    reclaim = side() * (F.col("confirm_close") - F.col("neckline")) / F.col("atr_k")
    # fixed weights: depth, symmetry, likeness of the extremes, reclaim
    rows = rows.withColumn("rule_score", F.least(F.lit(1.0), 0.40 * _share(F.col("depth_atr"), min_depth) + 0.25 * _symmetry() + 0.20 * (1.0 - _share(F.col("offset_atr"), max_offset)) + 0.15 * F.least(reclaim, F.lit(1.0))))
    reason = F.when(F.lit(max_length > 0) & (F.col("end_bar") - F.col("start_bar") > max_length), "pattern_too_long").when(F.col("rule_score") < min_score, "low_rule_score")
    if trend:
        lookback, least_slope, least_r2 = trend
        context = ind.add_trend_context(bars, lookback, least_r2).select("symbol", F.col("bar").alias("start_bar"), "ctx_slope", "ctx_r2", F.col("atr").alias("_atr0"))
        rows = rows.join(context, ["symbol", "start_bar"], "left")
        reason = reason.when(~F.coalesce(trend_holds(F.col("direction"), least_slope, least_r2, F.col("_atr0")), F.lit(False)), "low_trend_context")
    return _named(rows, ("double_bottom", "double_top")).withColumn("discard_reason", reason).select(*EVENT)


def trend_holds(direction: Column, least_slope: float, least_r2: float, atr: Column) -> Column:
    """Whether ``ctx_slope`` and ``ctx_r2`` are a trend that a pattern of ``direction`` reverses: null where they are missing."""
    against = F.when(direction == "bullish", -1.0).otherwise(1.0)
    steep = F.when(atr > 0, F.abs(F.col("ctx_slope")) / atr >= least_slope).otherwise(F.lit(False))
    return (against * F.col("ctx_slope") > 0) & (F.col("ctx_r2") >= least_r2) & steep


def head_shoulders(
    bars: DataFrame, left: int = 3, right: int = 3, min_apart: int = 2, max_shoulder: float = 1.5, max_neck: float = 1.5, min_head: float = 2.0, min_head_ranges: float = 4.0,
    min_bars: int = 12, buffer: float = 0.5, reward: float = 1.5, max_wait: int = 60,
) -> DataFrame:
    """Head and shoulders, upright and inverse: five alternating swings, the middle one beyond both outer ones.

    The neckline is the inner swing nearer to the head. The head is at least ``min_head`` ATR and ``min_head_ranges``
    median bar ranges off it; the stop lies beyond the head.
    """
    rows = swing_chains(ev.swings(bars, left, right, strict=False), 5)
    for i in range(1, 5):
        rows = rows.filter(f"kind{i} <> kind{i - 1} and bar{i} - bar{i - 1} >= {max(min_apart, 1)}")
    rows = rows.withColumn("direction", F.when(F.col("kind0") == "L", "bullish").otherwise("bearish")).withColumn("detect_bar", F.col("known4"))
    rows = _atr_at(rows, bars, "detect_bar", "atr_k").filter("atr_k > 0").join(median_ranges(bars), "symbol")
    neck = F.when(F.col("kind0") == "L", F.least("price1", "price3")).otherwise(F.greatest("price1", "price3"))
    rows = rows.withColumns({"start_bar": F.col("bar0"), "neck_bar": F.col("bar1"), "end_bar": F.col("bar4"), "neckline": neck, "left_len": F.col("bar2") - F.col("bar0"), "right_len": F.col("bar4") - F.col("bar2"), "head": F.col("price2")})
    rows = rows.withColumns({"depth": side() * (F.col("neckline") - F.col("head")), "offset_atr": F.abs(F.col("price0") - F.col("price4")) / F.col("atr_k"), "neck_offset": F.abs(F.col("price1") - F.col("price3")) / F.col("atr_k")})
    beyond = (side() * (F.col("price0") - F.col("head")) > 0) & (side() * (F.col("price4") - F.col("head")) > 0)
    deep = (F.col("depth") >= min_head * F.col("atr_k")) & (F.col("depth") >= min_head_ranges * F.col("median_range"))
    rows = rows.filter(beyond & deep & (F.col("offset_atr") <= max_shoulder) & (F.col("neck_offset") <= max_neck) & (F.col("end_bar") - F.col("start_bar") >= min_bars))
    rows = _entered(_crossed(rows, bars, F.col("neckline"), max_wait), bars)
    rows = rows.withColumn("stop", F.col("head") - side() * buffer * F.col("atr_k")).withColumn("risk", F.abs(F.col("entry") - F.col("stop"))).filter("risk > 0").withColumn("target", F.col("entry") + side() * reward * F.col("risk"))
    pierce = side() * (F.col("confirm_close") - F.col("neckline")) / F.col("atr_k")
    # fixed weights: head, shoulders, necklines, symmetry, pierce
    score = 0.40 * _share(F.col("depth") / F.col("atr_k"), min_head) + 0.20 * (1.0 - _share(F.col("offset_atr"), max_shoulder)) + 0.15 * (1.0 - _share(F.col("neck_offset"), max_neck)) + 0.15 * _symmetry() + 0.10 * F.least(pierce, F.lit(1.0))
    rows = rows.withColumn("rule_score", F.least(F.lit(1.0), score)).withColumn("depth_atr", F.col("depth") / F.col("atr_k")).withColumn("discard_reason", F.lit(None).cast("string"))
    return _named(rows, ("inverse_head_shoulders", "head_shoulders")).select(*EVENT)


def median_ranges(bars: DataFrame) -> DataFrame:
    """(symbol, median_range) over each series."""
    return bars.groupBy("symbol").agg(F.percentile(F.col("high") - F.col("low"), 0.5).alias("median_range"))


def fitted_line(points: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``<name>_slope``, ``<name>_icept``, ``<name>_r2`` of least squares through the points (bar, price) of each key, and their number; keys with one distinct bar go."""
    x = F.col("bar").cast("double")
    fit = points.groupBy(*keys).agg(F.regr_slope("price", x).alias(f"{name}_slope"), F.regr_intercept("price", x).alias(f"{name}_icept"), F.regr_r2("price", x).alias(f"{name}_r2"), F.count(F.lit(1)).alias(f"{name}_n"), F.countDistinct("bar").alias("_d"))
    return fit.filter("_d >= 2").drop("_d").withColumn(f"{name}_r2", F.coalesce(f"{name}_r2", F.lit(1.0)))


def line_errors(points: DataFrame, fits: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``<name>_error``: how far a point of each key is off its line at most."""
    off = F.abs(F.col("price") - (F.col(f"{name}_slope") * F.col("bar") + F.col(f"{name}_icept")))
    return points.join(fits, list(keys)).groupBy(*keys).agg(F.max(off).alias(f"{name}_error"))


def channels(
    bars: DataFrame, left: int = 3, right: int = 3, min_apart: int = 2, min_depth: float = 1.2, min_ranges: float = 2.0, min_bars: int = 8, max_error: float = 1.4,
    min_convergence: float = 0.05, min_inside: float = 0.70, inside_slack: float = 0.8,
) -> DataFrame:
    """Converging channels: three lows and the two or more highs between them, all falling (bullish) or all rising.

    With both lines, the widths' convergence from the first to the last high, and the share of closes inside the channel,
    ``inside_slack`` ATR wider on either side.
    """
    found = saved(ev.swings(bars, left, right, strict=False), "swings")
    lows = swing_chains(found, 3, ("L",)).filter(f"bar1 - bar0 >= {max(min_apart, 1)} and bar2 - bar1 >= {max(min_apart, 1)}")
    lows = lows.filter("(price0 > price1 and price1 > price2) or (price0 < price1 and price1 < price2)").withColumn("direction", F.when(F.col("price0") > F.col("price2"), "bullish").otherwise("bearish"))
    lows = lows.select("symbol", "direction", F.col("bar0").alias("start_bar"), F.col("bar1").alias("mid_bar"), F.col("bar2").alias("end_bar"), F.col("known2").alias("detect_bar"), "price0", "price1", "price2", F.abs(F.col("price0") - F.col("price2")).alias("depth"))
    lows = _atr_at(lows, bars, "detect_bar", "atr_k").filter("atr_k > 0").join(median_ranges(bars), "symbol")
    lows = lows.filter((F.col("depth") >= min_depth * F.col("atr_k")) & (F.col("depth") >= min_ranges * F.col("median_range")) & (F.col("end_bar") - F.col("start_bar") >= min_bars))
    keys = ["symbol", "start_bar", "end_bar"]
    lows = saved(lows, "channel-lows")
    at = found.filter("kind = 'H'").select("symbol", "bar", "price")
    longest = 512  # the width of the join's buckets, not a limit
    highs = range_join(lows.select(*keys, "direction", (F.col("start_bar") + 1).alias("_from"), (F.col("end_bar") - 1).alias("_to")), at, "_from", "_to", longest)
    step = F.lag("price").over(Window.partitionBy(*keys).orderBy("bar"))
    highs = highs.withColumn("_right", F.coalesce(side() * (step - F.col("price")) > 0, F.lit(True))).withColumn("_all", F.min(F.col("_right").cast("int")).over(Window.partitionBy(*keys))).filter("_all = 1").select(*keys, "bar", "price")
    highs = saved(highs, "channel-highs")
    upper = fitted_line(highs, keys, "upper")
    edges = highs.groupBy(*keys).agg(F.min("bar").alias("first_high"), F.max("bar").alias("last_high"), F.max("price").alias("highest"))
    points = lows.select(*keys, F.explode(F.array(*[F.struct(F.col(b).alias("bar"), F.col(p).alias("price")) for b, p in (("start_bar", "price0"), ("mid_bar", "price1"), ("end_bar", "price2"))])).alias("p")).select(*keys, "p.bar", "p.price")
    lower = fitted_line(points, keys, "lower")
    rows = lows.join(upper, keys).join(lower, keys).join(edges, keys).join(line_errors(highs, upper, keys, "upper"), keys).join(line_errors(points, lower, keys, "lower"), keys)
    rows = saved(rows, "channel-lines").withColumn("line_error", F.greatest("upper_error", "lower_error") / F.col("atr_k")).filter(F.col("line_error") <= max_error)
    width = lambda bar: channel_width(F.col(bar))
    rows = rows.withColumn("convergence", F.when(width("first_high") > 0, 1.0 - width("last_high") / width("first_high")).otherwise(0.0)).filter((F.col("convergence") >= min_convergence) & (width("end_bar") > 0))
    span = rows.select(*keys, "upper_slope", "upper_icept", "lower_slope", "lower_icept", "atr_k", F.col("start_bar").alias("_from"), (F.col("end_bar") - 1).alias("_to"))
    shares = closes_inside(span, bars, keys, inside_slack, longest)
    return rows.join(shares, keys).filter(F.col("inside") >= min_inside)


def line_at(name: str, bar: Column) -> Column:
    return F.col(f"{name}_slope") * bar + F.col(f"{name}_icept")


def channel_width(bar: Column) -> Column:
    return line_at("upper", bar) - line_at("lower", bar)


def closes_inside(spans: DataFrame, bars: DataFrame, keys: Sequence[str], slack: float, width: int) -> DataFrame:
    """``inside``: the share of closes from ``_from`` to ``_to`` between the lines, ``slack`` ATR wider on either side."""
    near = range_join(spans, bars.select("symbol", "bar", "close"), "_from", "_to", width)
    held = F.col("close").between(line_at("lower", F.col("bar")) - slack * F.col("atr_k"), line_at("upper", F.col("bar")) + slack * F.col("atr_k"))
    return near.groupBy(*keys).agg(F.avg(held.cast("double")).alias("inside"))


def wedges(bars: DataFrame, buffer: float = 0.5, reward: float = 1.5, max_wait: int = 60, min_depth: float = 1.2, **geometry: float) -> DataFrame:
    """Falling and rising wedges: a converging channel (``channels``) whose upper (lower) line a close then crosses."""
    rows = saved(channels(bars, min_depth=min_depth, **geometry), "channels")
    level = F.when(F.col("direction") == "bullish", line_at("upper", F.col("bar"))).otherwise(line_at("lower", F.col("bar")))
    rows = _entered(_crossed(rows, bars, level, max_wait), bars)
    line = lambda bar: F.when(F.col("direction") == "bullish", line_at("upper", F.col(bar))).otherwise(line_at("lower", F.col(bar)))
    edge = F.when(F.col("direction") == "bullish", F.least("price0", "price1", "price2")).otherwise(F.col("highest"))
    rows = rows.withColumn("stop", edge - side() * buffer * F.col("atr_k")).withColumn("risk", F.abs(F.col("entry") - F.col("stop"))).filter("risk > 0").withColumn("target", F.col("entry") + side() * reward * F.col("risk"))
    pierce = side() * (F.col("confirm_close") - line("confirm_bar")) / F.col("atr_k")
    # fixed weights: depth, convergence, share inside, pierce
    score = 0.35 * _share(F.col("depth") / F.col("atr_k"), min_depth) + 0.25 * _share(F.greatest(F.col("convergence"), F.lit(0.0)), 0.3) + 0.20 * F.least(F.col("inside"), F.lit(1.0)) + 0.20 * F.least(pierce, F.lit(1.0))
    rows = rows.withColumns({
        "rule_score": F.least(F.lit(1.0), score), "depth_atr": F.col("depth") / F.col("atr_k"), "offset_atr": F.col("line_error"), "neckline": line("detect_bar"), "neck_bar": F.lit(None).cast("long"),
        "left_len": F.col("mid_bar") - F.col("start_bar"), "right_len": F.col("end_bar") - F.col("mid_bar"), "discard_reason": F.lit(None).cast("string"),
    })
    return _named(rows, ("falling_wedge", "rising_wedge")).select(*EVENT)


def settled(events: DataFrame, cooldown: int, overlap: bool = True) -> DataFrame:
    """Events without a discard reason, the best of overlapping structures (if ``overlap``), and none within ``cooldown`` bars of the confirmation of one kept."""
    held = saved(events.filter("discard_reason is null"), "events")
    kept = ev.suppress_overlaps(held, score="rule_score") if overlap else held
    return ev.confirm_cooldown(kept, cooldown, score="rule_score")


def drop_opposite(events: DataFrame) -> DataFrame:
    """Of two readings of one structure in opposite directions the better score stays, then the smaller ``event_id``.

    They conflict where their spans meet and the neckline's bar of one lies in the other's span. An event without a span
    conflicts with none; one without a score comes first. See ``best_first``: no task holds an island of them.
    """
    a, z, n, d = "start_bar", "end_bar", "neck_bar", "direction"

    def meets(cols: dict, i: int, those: object) -> object:
        inner = ((cols[n][i] >= cols[a][those]) & (cols[n][i] <= cols[z][those])) | ((cols[n][those] >= cols[a][i]) & (cols[n][those] <= cols[z][i]))
        return (cols[d][those] != cols[d][i]) & (cols[a][those] <= cols[z][i]) & (cols[a][i] <= cols[z][those]) & inner

    spans = events.select("symbol", "event_id", a, z, F.col(n).cast("double").alias(n), d, "rule_score")
    order = [F.coalesce(-F.col("rule_score"), F.lit(float("-inf"))), F.col("event_id")]
    lost = best_first(spans, ["symbol"], a, z, order, meets, [n, d]).filter("not _kept")
    return events.join(lost.select("event_id"), "event_id", "left_anti")


def plain_detections(bars: DataFrame, look: int = 3, lookahead: int = 14, line_lookahead: int = 15) -> DataFrame:
    """(symbol, pattern, direction, start_bar, end_bar, breakout_bar): the same shapes by plain geometry, in median bar ranges in place of ATR.

    Doubles within 1 range and 5 deep, heads 5 beyond inner swings within 0.8, channels that narrow, 3 deep with 80 % of
    the closes inside, and lows that undercut the low before by 2 after a fall of 3.
    """
    unit = saved(median_ranges(bars), "ranges")
    bars = saved(bars, "bars")
    scaled = bars.drop("atr").join(unit.withColumnRenamed("median_range", "atr"), "symbol")
    found = saved(ev.swings(bars, look, look, strict=False), "swings")
    keys = ["symbol", "pattern", "direction", "start_bar", "end_bar"]

    three = swing_chains(found, 3).filter(f"kind0 = kind2 and kind0 <> kind1 and bar1 - bar0 >= {look} and bar2 - bar1 >= {look}").join(unit, "symbol")
    three = three.withColumn("direction", F.when(F.col("kind0") == "L", "bullish").otherwise("bearish")).withColumn("start_bar", F.col("bar0")).withColumn("end_bar", F.col("bar2")).withColumn("neckline", F.col("price1"))
    inner = F.when(F.col("kind0") == "L", F.greatest("price0", "price2")).otherwise(F.least("price0", "price2"))
    three = three.filter((side() * (F.col("price1") - inner) >= 5.0 * F.col("median_range")) & (F.abs(F.col("price0") - F.col("price2")) <= F.col("median_range")))
    doubles = _named(_crossed(three, bars, F.col("neckline"), lookahead), ("double_bottom", "double_top"))

    five = swing_chains(found, 5)
    for i in range(1, 5):
        five = five.filter(f"kind{i} <> kind{i - 1} and bar{i} > bar{i - 1}")
    five = five.join(unit, "symbol").withColumn("direction", F.when(F.col("kind0") == "L", "bullish").otherwise("bearish")).withColumn("start_bar", F.col("bar0")).withColumn("end_bar", F.col("bar4"))
    five = five.withColumn("neckline", F.when(F.col("kind0") == "L", F.least("price1", "price3")).otherwise(F.greatest("price1", "price3")))
    five = five.filter((side() * (F.col("neckline") - F.col("price2")) >= 5.0 * F.col("median_range")) & (F.abs(F.col("price1") - F.col("price3")) <= 0.8 * F.col("median_range")))
    heads = _named(_crossed(five, bars, F.col("neckline"), line_lookahead), ("inverse_head_shoulders", "head_shoulders"))

    narrow = channels(saved(scaled, "scaled-bars"), look, look, 1, 3.0, 3.0, 1, float("inf"), 1e-12, 0.0, 0.8)
    span = narrow.select("symbol", "start_bar", "end_bar", "upper_slope", "upper_icept", "lower_slope", "lower_icept", "atr_k", (F.col("start_bar") + 1).alias("_from"), (F.col("end_bar") - 1).alias("_to"))
    narrow = narrow.drop("inside").join(closes_inside(span, bars, ["symbol", "start_bar", "end_bar"], 0.8, 512), ["symbol", "start_bar", "end_bar"]).filter("inside >= 0.8")
    line = F.when(F.col("direction") == "bullish", line_at("upper", F.col("bar"))).otherwise(line_at("lower", F.col("bar")))
    wedged = _named(_crossed(narrow, bars, line, line_lookahead), ("falling_wedge", "rising_wedge"))

    two = swing_chains(found, 2, ("L",)).filter(f"bar1 - bar0 >= {look}").join(unit, "symbol").filter("price0 - price1 >= 2.0 * median_range")
    fall = bars.select("symbol", (F.col("bar") + 4).alias("bar0"), F.col("close").alias("_before"))
    two = two.join(fall, ["symbol", "bar0"]).filter("_before - price0 >= 3.0 * median_range").withColumn("direction", F.lit("bullish")).withColumn("start_bar", F.col("bar0")).withColumn("end_bar", F.col("bar1")).withColumn("neckline", F.col("price0"))
    swept = _crossed(two, bars, F.col("neckline"), 10).withColumn("pattern", F.lit("liquidity_sweep"))

    parts = [x.select(*keys, F.col("cross_bar").alias("breakout_bar")) for x in (doubles, heads, wedged, swept)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def matched_truth(truth: DataFrame, detections: DataFrame, tolerance: int = 2, keys: Sequence[str] = ("symbol", "pattern", "direction")) -> DataFrame:
    """``truth`` (keys, breakout_bar) with ``hit``: a detection of its keys breaks out within ``tolerance`` bars."""
    width = 2 * tolerance + 1
    span = truth.select(*keys, "breakout_bar").distinct().withColumn("_from", F.greatest(F.col("breakout_bar") - tolerance, F.lit(0))).withColumn("_to", F.col("breakout_bar") + tolerance)
    hits = range_join(span, detections.select(*keys, F.col("breakout_bar").alias("bar")), "_from", "_to", width, keys=keys).select(*keys, "breakout_bar").distinct()
    return truth.join(hits.withColumn("hit", F.lit(True)), [*keys, "breakout_bar"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def benchmark_rates(truth: DataFrame, detections: DataFrame, noise: DataFrame, tolerance: int = 2) -> DataFrame:
    """(pattern, planted, recall, recall_noisy, drop, false_positive_share): ``truth`` has ``noisy``, and ``noise`` is (symbol) of series without patterns."""
    hit = matched_truth(truth, detections, tolerance)
    rate = lambda c: F.avg(F.when(c, F.col("hit").cast("double")))
    rates = hit.groupBy("pattern").agg(F.count_if(~F.col("noisy")).alias("planted"), rate(~F.col("noisy")).alias("recall"), rate(F.col("noisy")).alias("recall_noisy"))
    flagged = noise.select("symbol").distinct().join(detections.select("symbol").distinct().withColumn("_f", F.lit(1.0)), "symbol", "left")
    share = flagged.agg(F.avg(F.coalesce("_f", F.lit(0.0))).alias("false_positive_share"))
    return rates.withColumn("drop", F.col("recall") - F.col("recall_noisy")).join(F.broadcast(share))


Detector = Callable[[DataFrame, Mapping], DataFrame]
#: Detectors by pattern family: a function of bars (with ``atr``) and parameters to EVENT rows.
DETECTORS: dict[str, Detector] = {
    "double": lambda bars, p: double_patterns(bars, **p),
    "head_shoulders": lambda bars, p: head_shoulders(bars, **p),
    "wedge": lambda bars, p: wedges(bars, **p),
}


def register(name: str, detector: Detector) -> None:
    """Add a detector of one's own; ``detect_all`` checks its columns."""
    DETECTORS[name] = detector


def detect_all(bars: DataFrame, assignments: Sequence[Mapping]) -> DataFrame:
    """All events of ``assignments`` ({detector, params, cooldown, state, timeframe}), stamped with their state and timeframe; a detector that gives an event known before it is confirmed loses all its events."""
    out, bars = None, saved(bars, "bars")
    for a in assignments:
        found = DETECTORS[a["detector"]](bars, a.get("params", {}))
        if missing := set(EVENT) - set(found.columns):
            raise ValueError(f"detector {a['detector']} lacks {sorted(missing)}")
        found = settled(found.select(*EVENT), a.get("cooldown", 3), a.get("overlap", True))
        early = F.coalesce(F.col("confirm_bar") < F.col("detect_bar"), F.lit(True)) | F.coalesce(F.col("entry_bar") < F.col("confirm_bar"), F.lit(True))
        bad = F.max(early.cast("int")).over(Window.partitionBy("symbol", "pattern"))
        found = found.withColumn("_bad", bad).filter("_bad = 0").drop("_bad").withColumn("lifecycle_state", F.lit(a.get("state", "live"))).withColumn("timeframe", F.lit(a.get("timeframe", "H1")))
        out = found if out is None else out.unionByName(found)
    return out
