"""Context of coarser bars, confirmations, point-in-time feature matrices and the rule score of sweep events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import indicators as ind
from ..plans.folders import saved
from ..plans.layout import affine_scan, asof_backward, blocked, own_rows, placed, range_join
from ..sources import bars as src
from . import events as ev

# The most that each part of the rule score gives, which are also its default weights.
SCORE_PARTS = {"level": 20, "sweep": 25, "reclaim": 15, "confirmation": 20, "context": 10, "volume": 10}
SWEEP_FEATURES = (
    "range_atr", "body_ratio", "lower_wick_ratio", "upper_wick_ratio", "close_location", "penetration_atr", "reclaim_atr", "wick_ratio", "sweep_volume_zscore", "level_type", "level_age_bars", "level_touch_count",
    "bars_since_last_touch", "equal_level_dispersion_atr", "level_is_previous_day_high_low", "level_is_h1_swing", "level_already_partially_swept", "atr_percentile", "volatility_regime", "volume_zscore", "hour_utc", "day_of_week",
    "session_asia", "session_london", "session_new_york", "h1_trend", "distance_to_previous_day_high_atr", "distance_to_previous_day_low_atr", "confirmation_delay_bars", "confirmation_range_atr", "confirmation_body_ratio", "confirmation_volume_zscore",
)


def per(x: Column, by: Column | str) -> Column:
    """``x`` over ``by``; null where that is 0."""
    return x / F.nullif(F.col(by) if isinstance(by, str) else by, F.lit(0.0))


def closed_coarse(bars: DataFrame, rule: str, out: str) -> DataFrame:
    """``out`` on every bar: the close of the last coarser bar that had ended by the bar before."""
    coarse = src.resample_bars(bars, rule).select("symbol", F.col("bucket_end").alias("ts"), F.col("close").alias(out))
    joined, w = blocked(asof_backward(bars.select("symbol", "ts", "bar"), coarse, "ts", [out]), 1)
    return own_rows(joined.withColumn(out, F.lag(out).over(w))).select("symbol", "bar", out)


def slope_sign(bars: DataFrame, value: str, span: int, out: str) -> DataFrame:
    """(symbol, bar, out): the sign of the one-bar change of the exponential mean of ``value``, from its first known bar on."""
    known = bars.filter(F.col(value).isNotNull())
    first = known.groupBy("symbol").agg(F.min("bar").alias("_first"))
    known = known.join(first, "symbol").select("symbol", "bar", value, (F.col("bar") - F.col("_first")).alias("_k"))
    smooth = affine_scan(known, 1 - 2 / (span + 1), value, "_y", order="_k")
    held, w = blocked(smooth, 1, order="_k")
    return own_rows(held.withColumn(out, F.signum(F.col("_y") - F.lag("_y").over(w)))).select("symbol", "bar", out)


def coarse_context(bars: DataFrame, rules: tuple[str, str] = ("1 hour", "4 hours"), span: int = 50) -> DataFrame:
    """(symbol, bar, h1_return, h1_trend, h4_trend, prev_day_high, prev_day_low) from closed coarser bars and the last traded day."""
    bars = saved(bars, "bars")
    out = bars.select("symbol", "bar", "ts")
    for name, rule in zip(("h1", "h4"), rules, strict=True):
        close = saved(closed_coarse(bars, rule, f"{name}_close"), name)
        out = out.join(close, ["symbol", "bar"]).join(slope_sign(close, f"{name}_close", span, f"{name}_trend"), ["symbol", "bar"], "left")
    held, w = blocked(out, 1)
    before = F.lag("h1_close").over(w)
    out = own_rows(held.withColumn("h1_return", F.col("h1_close") / before - 1))
    return out.join(previous_day(bars), ["symbol", "bar"], "left").select("symbol", "bar", "h1_return", "h1_trend", "h4_trend", "prev_day_high", "prev_day_low")


def previous_day(bars: DataFrame) -> DataFrame:
    """(symbol, bar, prev_day_high, prev_day_low): the extremes of the last day with bars before the bar's day."""
    days = bars.groupBy("symbol", F.to_date("ts").alias("_day")).agg(F.max("high").alias("h"), F.min("low").alias("l"))
    w = Window.partitionBy("symbol").orderBy("_day")
    days = days.select("symbol", "_day", F.lag("h").over(w).alias("prev_day_high"), F.lag("l").over(w).alias("prev_day_low"))
    return bars.select("symbol", "bar", F.to_date("ts").alias("_day")).join(days, ["symbol", "_day"]).drop("_day")


def sweeps_in_coarse_trend(rolled: DataFrame, context: DataFrame, min_depth: float = 0.05, max_depth: float = 0.20, min_wick: float = 0.35, min_reclaim: float = 0.0) -> DataFrame:
    """Sweep rows in a narrow depth band that the closed coarser bars' trend favours: long where it rises, short where it falls."""
    rows = ev.sweep_rows(ev.sweep_flags(rolled, min_wick, max_depth)).filter(F.col("depth") >= min_depth)
    side = F.when(F.col("direction") == "long", 1.0).otherwise(-1.0)
    rows = rows.withColumn("reclaim", per(side * (F.col("close") - F.col("level")), "atr")).filter(F.col("reclaim") >= min_reclaim)
    return rows.join(context.select("symbol", "bar", "h1_trend"), ["symbol", "bar"]).filter(F.col("h1_trend") == side)


def numbered_events(events: DataFrame, prefix: str = "V2") -> DataFrame:
    """``event_id``: the symbol, ``prefix`` and the event's place in its series by bar and direction."""
    return placed(events, ("symbol",), ["bar", "direction"]).withColumn("event_id", F.format_string(f"%s-{prefix}-%06d", "symbol", "place")).drop("place")


def all_confirmations(
    events: DataFrame, bars: DataFrame, pivots: DataFrame, max_wait: int = 3, min_body: float = 0.6, min_range: float = 0.8, displacement: float = 1.2, max_age: int = 100,
    kinds: Sequence[str] = ("close_break", "displacement", "structure_break"), anchor: str = "anchor_bar",
) -> DataFrame:
    """``events`` with the first of ``max_wait`` bars after the anchor that confirms them, by the first of ``kinds`` that it meets.

    close_break and displacement close beyond the extreme since the anchor, the latter over a longer bar; structure_break
    closes beyond the last pivot that was known at the anchor and is at most ``max_age`` bars old. Adds confirm_bar,
    delay, confirm_close, confirm_range, confirm_body, confirm_volume, confirm_type and strength (0..1), null without one.
    """
    keys = ["symbol", "direction", "bar"]
    level = lambda kind: ev.latest_pivot(bars, pivots, kind, max_age).select("symbol", (F.col("bar") - 1).alias(anchor), F.col("pivot_price").alias(f"_{kind}"))
    span = events.select(*keys, anchor).join(level("H"), ["symbol", anchor], "left").join(level("L"), ["symbol", anchor], "left").withColumnRenamed("bar", "_event")
    span = span.withColumn("_from", F.col(anchor)).withColumn("_to", F.col(anchor) + max_wait)
    near = range_join(span, bars.select("symbol", "bar", "open", "high", "low", "close", "volume", "atr"), "_from", "_to", max_wait + 1)
    before = Window.partitionBy("symbol", "direction", "_event").orderBy("bar").rowsBetween(Window.unboundedPreceding, -1)
    long, size = F.col("direction") == "long", F.col("high") - F.col("low")
    near = near.withColumns({
        "_extreme": F.when(long, F.max("high").over(before)).otherwise(F.min("low").over(before)), "_structure": F.when(long, F.col("_H")).otherwise(F.col("_L")),
        "confirm_body": per(F.abs(F.col("close") - F.col("open")), size), "confirm_range": per(size, "atr"),
    }).filter((F.col("bar") > F.col(anchor)) & (size > 0) & F.col("atr").isNotNull())
    past = lambda c: F.coalesce(F.when(long, F.col("close") > F.col(c)).otherwise(F.col("close") < F.col(c)), F.lit(False))
    body, whole = F.col("confirm_body") >= min_body, F.col("confirm_range") >= min_range
    meets = {"close_break": past("_extreme") & body & whole, "displacement": past("_extreme") & body & (F.col("confirm_range") >= displacement), "structure_break": past("_structure") & body & whole}
    kind = F.coalesce(*[F.when(meets[k], k) for k in kinds])
    strength = 0.5 * F.least(F.greatest("confirm_body", F.lit(0.0)), F.lit(1.0)) + 0.5 * F.least(F.greatest("confirm_range", F.lit(0.0)) / 2.0, F.lit(1.0))
    found = F.struct(F.col("bar").alias("confirm_bar"), (F.col("bar") - F.col(anchor)).alias("delay"), F.col("close").alias("confirm_close"), "confirm_range", "confirm_body", F.col("volume").alias("confirm_volume"), "confirm_type", strength.alias("strength"))
    first = near.withColumn("confirm_type", kind).filter("confirm_type is not null").groupBy("symbol", "direction", F.col("_event").alias("bar")).agg(F.min_by(found, "bar").alias("c"))
    return events.join(first.select(*keys, "c.*"), keys, "left")


def nearest_levels(events: DataFrame, levels: DataFrame, bars: DataFrame, most_atr: float = 2.0, touch_atr: float = 0.1) -> DataFrame:
    """(symbol, direction, bar) with the level that an event swept and its state then: one of its own ``level_id`` if known, else the nearest of its side.

    ``levels`` is (symbol, level_id, level_type, kind, price, known_bar, is_h1, dispersion_atr). All levels known by the
    event's bar count, however old; they meet by buckets of price that are ``most_atr`` mean ATRs wide, and only those
    within ``most_atr`` ATR of the event stay. The state counts bars after the level is known up to the event's: touches
    within ``touch_atr`` ATR, the last of them, and whether it was swept or broken before the event's bar.
    """
    keys = ["symbol", "direction", "bar"]
    unit = bars.groupBy("symbol").agg((F.greatest(F.avg("atr"), F.lit(1e-9)) * most_atr).alias("_unit"))
    probe = events.select(*keys, "level", "atr", *([F.col("level_id").alias("_wanted")] if "level_id" in events.columns else [F.lit(None).cast("string").alias("_wanted")])).join(unit, "symbol")
    reach = F.coalesce(F.col("atr"), F.lit(0.0)) * most_atr
    spread = probe.withColumn("_b", F.explode(F.sequence(F.floor((F.col("level") - reach) / F.col("_unit")), F.floor((F.col("level") + reach) / F.col("_unit")))))
    priced = levels.join(unit, "symbol").withColumn("_b", F.floor(F.col("price") / F.col("_unit"))).drop("_unit")
    near = spread.join(priced, ["symbol", "_b"]).filter((F.col("known_bar") <= F.col("bar")) & (F.col("kind") == F.when(F.col("direction") == "long", "L").otherwise("H")) & (F.abs(F.col("price") - F.col("level")) <= reach))
    named = probe.filter("_wanted is not null").join(levels.withColumnRenamed("level_id", "_wanted"), ["symbol", "_wanted"]).filter(F.col("known_bar") <= F.col("bar"))
    columns = [F.col(c) for c in ("level_type", "kind", "price", "known_bar", "is_h1", "dispersion_atr")]
    one = lambda df, i, exact: df.select(*keys, F.lit(exact).alias("_far"), F.abs(F.col("price") - F.col("level")).alias("_d"), F.struct(F.col(i).alias("level_id"), *columns).alias("v"))
    # an exact match comes first, then the nearest, then the first known
    both = one(near, "level_id", 1).unionByName(one(named, "_wanted", 0))
    chosen = saved(both.groupBy(*keys).agg(F.min_by("v", F.struct("_far", "_d", "v.known_bar", "v.level_id")).alias("v")).select(*keys, "v.*"), "nearest-levels")
    span = chosen.withColumnRenamed("bar", "_event").withColumn("_from", F.col("known_bar") + 1).withColumn("_to", F.col("_event"))
    over = range_join(span, bars.select("symbol", "bar", "high", "low", "close", F.col("atr").alias("_atr")), "_from", "_to", 512)
    low = F.col("kind") == "L"
    touch = F.when(low, F.abs(F.col("low") - F.col("price"))).otherwise(F.abs(F.col("high") - F.col("price"))) <= touch_atr * F.col("_atr")
    gone = F.when(low, F.col("low") < F.col("price")).otherwise(F.col("high") > F.col("price"))
    state = over.groupBy("symbol", "direction", F.col("_event").alias("bar")).agg(F.count_if(touch).alias("level_touch_count"), F.max(F.when(touch, F.col("bar"))).alias("_touched"), F.max((gone & (F.col("bar") < F.col("_event"))).cast("int")).alias("_gone"))
    out = chosen.join(state, keys, "left").withColumn("level_touch_count", F.coalesce("level_touch_count", F.lit(0)))
    return out.withColumn("level_age_bars", F.col("bar") - F.col("known_bar")).withColumn("bars_since_last_touch", F.col("bar") - F.col("_touched")).withColumn("swept_before", F.coalesce(F.col("_gone") > 0, F.lit(False))).drop("_touched", "_gone")


def sweep_features(events: DataFrame, bars: DataFrame, levels: DataFrame, context: DataFrame, sessions: Mapping[str, tuple[int, int]], volume: str = "volume_z", percentile: str = "pct") -> DataFrame:
    """The 32 point-in-time columns SWEEP_FEATURES of each sweep event, keyed by (symbol, direction, bar), from bars at or before it (and its confirmation).

    ``bars`` has atr, ``volume`` (a z-score) and ``percentile`` with its regime; ``events`` come from ``all_confirmations``.
    An event without a level has the level type ``rolling`` and no other level columns; confirmation columns are null
    without a confirmation.
    """
    keys = ["symbol", "direction", "bar"]
    level = nearest_levels(events, levels, bars).select(*keys, "level_type", "level_age_bars", "level_touch_count", "bars_since_last_touch", "dispersion_atr", "is_h1", "swept_before")
    at = ind.add_sessions(bars, dict(sessions)).select("symbol", "bar", F.col(volume).alias("_vz"), F.col(percentile).alias("_pct"), F.col(f"{percentile}_regime").alias("_regime"), "hour", "dow", *[f"in_{n}" for n in sessions])
    later = bars.select("symbol", F.col("bar").alias("confirm_bar"), F.col(volume).alias("_cvz"))
    rows = events.join(level, keys, "left").join(at, ["symbol", "bar"]).join(context.select("symbol", "bar", "h1_trend", "prev_day_high", "prev_day_low"), ["symbol", "bar"], "left").join(later, ["symbol", "confirm_bar"], "left")
    size, long = F.col("high") - F.col("low"), F.col("direction") == "long"
    low_wick, high_wick = per(F.least("open", "close") - F.col("low"), size), per(F.col("high") - F.greatest("open", "close"), size)
    yes = lambda c: F.coalesce(c, F.lit(False))
    made = {
        "range_atr": per(size, "atr"), "body_ratio": per(F.abs(F.col("close") - F.col("open")), size), "lower_wick_ratio": low_wick, "upper_wick_ratio": high_wick, "close_location": per(F.col("close") - F.col("low"), size),
        "penetration_atr": F.col("depth"), "reclaim_atr": per(F.when(long, F.col("close") - F.col("level")).otherwise(F.col("level") - F.col("close")), "atr"), "wick_ratio": F.when(long, low_wick).otherwise(high_wick),
        "sweep_volume_zscore": F.col("_vz"), "level_type": F.coalesce("level_type", F.lit("rolling")), "level_age_bars": F.col("level_age_bars"), "level_touch_count": F.col("level_touch_count"), "bars_since_last_touch": F.col("bars_since_last_touch"),
        "equal_level_dispersion_atr": F.col("dispersion_atr"), "level_is_previous_day_high_low": yes(F.col("level_type") == "prev_day"), "level_is_h1_swing": yes(F.col("is_h1")), "level_already_partially_swept": yes(F.col("swept_before")),
        "atr_percentile": F.col("_pct"), "volatility_regime": F.col("_regime"), "volume_zscore": F.col("_vz"), "hour_utc": F.col("hour"), "day_of_week": F.col("dow"),
        **{f"session_{n}": F.col(f"in_{n}") for n in sessions}, "h1_trend": F.col("h1_trend"),
        "distance_to_previous_day_high_atr": per(F.col("close") - F.col("prev_day_high"), "atr"), "distance_to_previous_day_low_atr": per(F.col("close") - F.col("prev_day_low"), "atr"),
        "confirmation_delay_bars": F.col("delay"), "confirmation_range_atr": F.col("confirm_range"), "confirmation_body_ratio": F.col("confirm_body"), "confirmation_volume_zscore": F.col("_cvz"),
    }
    if missing := set(SWEEP_FEATURES) - set(made):
        raise ValueError(f"no columns for {sorted(missing)}")
    return rows.select(*keys, *[made[n].alias(n) for n in SWEEP_FEATURES])


def _tier(value: Column, tiers: Sequence[tuple[float, float]]) -> Column:
    """The points of the first tier (least value, points) that is reached; 0 for none and for null."""
    out = F.lit(0.0)
    for least, points in reversed(tiers):
        out = F.when(value >= least, points).otherwise(out)
    return F.coalesce(out, F.lit(0.0))


def _above(value: Column, tiers: Sequence[tuple[float, float]]) -> Column:
    out = F.lit(0.0)
    for bound, points in reversed(tiers):
        out = F.when(value > bound, points).otherwise(out)
    return F.coalesce(out, F.lit(0.0))


def _points(when: Column, points: float) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), points).otherwise(0.0)


def rule_scores(rows: DataFrame, weights: Mapping[str, int] | None = None) -> DataFrame:
    """``score_<part>`` for each of SCORE_PARTS and ``rule_score`` (0 to 100): their weighted sum, scaled by the weights' total.

    ``rows`` has the sweep features, direction, confirm_type, strength, confirm_volume and volume_percentile; anything
    missing gives no points.
    """
    w = {**SCORE_PARTS, **{k: v for k, v in (weights or {}).items() if k in SCORE_PARTS and v >= 0}}
    c, long, short = F.col, F.col("direction") == "long", F.col("direction") == "short"
    depth, place = c("penetration_atr"), F.when(long, c("close_location")).otherwise(1.0 - c("close_location"))
    near_day = F.least(F.abs("distance_to_previous_day_high_atr"), F.abs("distance_to_previous_day_low_atr"))
    both_days = c("distance_to_previous_day_high_atr").isNotNull() & c("distance_to_previous_day_low_atr").isNotNull()
    aligned = (long & (c("h1_trend") > 0)) | (short & (c("h1_trend") < 0))
    sessions = c("session_london").cast("int") + c("session_new_york").cast("int")
    delay = c("confirmation_delay_bars")
    parts = {
        "level": _points(c("level_type") == "equal", 8) + _points(c("level_touch_count") >= 3, 4) + _points(c("level_is_h1_swing") | c("level_is_previous_day_high_low"), 5) + _points(c("bars_since_last_touch").isNull(), 3),
        "sweep": F.when(depth.between(0.10, 0.35), 8.0).when(depth.between(0.05, 0.50), 5.0).otherwise(0.0) + _tier(c("wick_ratio"), ((0.70, 7), (0.50, 5), (0.35, 3))) + _tier(c("range_atr"), ((2.0, 5), (1.5, 3), (1.0, 2))) + F.when(long | short, _tier(place, ((0.7, 5), (0.5, 3)))).otherwise(0.0),
        "reclaim": _above(c("reclaim_atr"), ((0.0, 5),)) + _tier(c("reclaim_atr"), ((0.25, 10), (0.10, 5))),
        "confirmation": F.coalesce(F.when(delay.between(1, 3), 5.0).when(delay == 0, 3.0), F.lit(0.0)) + F.coalesce(F.when(c("confirm_type").isin("structure_break", "displacement"), 5.0).when(c("confirm_type") == "close_break", 3.0), F.lit(0.0))
        + _tier(c("strength"), ((0.7, 5), (0.4, 3))) + F.when(c("confirm_volume").isNull(), 0.0).when(c("volume_zscore") > 1.0, 5.0).when(c("volume_zscore") > 0.5, 3.0).when(c("confirm_volume") > 0, 2.0).otherwise(0.0),
        "context": F.when(F.coalesce(aligned, F.lit(False)), 5.0).when(c("h1_trend") != 0, 2.0).otherwise(0.0) + F.when(both_days & (near_day < 0.5), 3.0).when(both_days & (near_day < 1.0), 2.0).otherwise(0.0) + F.coalesce(sessions, F.lit(0)).cast("double"),
        "volume": _above(c("volume_zscore"), ((2.0, 5), (1.0, 3), (0.0, 1))) + _tier(c("volume_percentile"), ((0.8, 3), (0.6, 2))) + F.when(c("volatility_regime") == "high", 2.0).when(c("volatility_regime") == "normal", 1.0).otherwise(0.0),
    }
    out = rows.withColumns({f"score_{n}": F.least(p, F.lit(float(SCORE_PARTS[n]))) for n, p in parts.items()})
    total = sum((c(f"score_{n}") * w[n] / SCORE_PARTS[n] for n in SCORE_PARTS), F.lit(0.0)) * (100.0 / sum(w.values()))
    return out.withColumn("rule_score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)), 2))


def sweep_events(rolled: DataFrame, context: DataFrame, levels: DataFrame, pivots: DataFrame, sessions: Mapping[str, tuple[int, int]], cooldown: int = 4, reward: float = 1.5, buffer: float = 0.1, sweep: Mapping | None = None, confirm: Mapping | None = None) -> DataFrame:
    """The sweep pattern as whole events: sweeps in the coarser trend, one for each run and cooldown, confirmed, scored, with entry, stop and target.

    The entry is the open after the confirmation; the stop lies ``buffer`` ATR beyond the extreme at the run's first bar.
    Events without a confirmation, or without a bar after it, go. ``rolled`` is a table with atr, volume_z, pct, pct_regime
    and, for the score, volume_pct.
    """
    rows = sweeps_in_coarse_trend(rolled, context, **(sweep or {}))
    anchors = ev.run_anchors(ev.sweep_rows(ev.sweep_flags(rolled))).select("symbol", "direction", "bar", "anchor_bar")
    kept = ev.deduplicated_sweeps(rows, cooldown).drop("h1_trend").join(anchors, ["symbol", "direction", "bar"], "left").withColumn("anchor_bar", F.coalesce("anchor_bar", "bar"))
    done = saved(all_confirmations(kept, rolled, pivots, **(confirm or {})).filter("confirm_bar is not null"), "confirmed")
    keys = ["symbol", "direction", "bar"]
    share = F.col("volume_pct") if "volume_pct" in rolled.columns else F.lit(None).cast("double")
    more = done.select(*keys, "confirm_type", "strength", "confirm_volume").join(rolled.select("symbol", "bar", share.alias("volume_percentile")), ["symbol", "bar"])
    scored = rule_scores(sweep_features(done, rolled, levels, context, sessions).join(more, keys))
    first = rolled.select("symbol", F.col("bar").alias("anchor_bar"), F.col("low").alias("_low"), F.col("high").alias("_high"), F.col("atr").alias("_atr"))
    out = ev.entry_schedule(done, rolled, at="confirm_bar").join(first, ["symbol", "anchor_bar"]).join(scored.select(*keys, "rule_score"), keys)
    long = F.col("direction") == "long"
    out = out.withColumn("stop", F.when(long, F.col("_low") - buffer * F.col("_atr")).otherwise(F.col("_high") + buffer * F.col("_atr")))
    out = out.withColumn("target", F.col("entry") + reward * (F.col("entry") - F.col("stop")))
    return out.select(*keys, "anchor_bar", "confirm_bar", "confirm_type", "entry_bar", "entry", "stop", "target", "rule_score")


def pattern_features(events: DataFrame, bars: DataFrame, sessions: Mapping[str, tuple[int, int]], extra: Sequence[str] = (), back: int = 24) -> DataFrame:
    """The matrix of pattern events at their detection and confirmation: geometry, place in the last ``back`` bars, the confirming bar, and the hour. Missing values are 0.

    ``bars`` comes from ``add_confirm_context``; ``events`` are EVENT rows of the pattern detectors.
    """
    at = ind.add_sessions(bars, dict(sessions))
    at = at.withColumn("weekday", F.weekday("ts"))
    detect = at.select(
        "symbol", F.col("bar").alias("detect_bar"), F.col("close").alias("dc"), (F.col("high") - F.col("low")).alias("dr"), F.col("atr").alias("da"), F.col("momentum").alias("mom_24_atr"), F.col("place").alias("close_pos_24"),
        F.col("span").alias("span_24_atr"), F.col("volume_ratio").alias("vol_ratio_24"), F.col("atr_ratio").alias("atr_ratio_200"), "hour", "weekday", *[f"in_{n}" for n in sessions],
    )
    confirm = at.select("symbol", F.col("bar").alias("confirm_bar"), F.col("open").alias("co"), F.col("high").alias("ch"), F.col("low").alias("cl"), F.col("close").alias("cc"), F.col("atr").alias("ca"), F.col("volume_z").alias("confirm_vol_zscore"))
    rows = events.join(detect, ["symbol", "detect_bar"]).join(confirm, ["symbol", "confirm_bar"])
    sign = F.when(F.col("direction") == "bullish", 1.0).otherwise(-1.0)
    by = lambda x, a: F.when(F.col(a) > 0, x / F.col(a)).otherwise(0.0)
    longer = F.greatest("left_len", "right_len")
    size = F.col("ch") - F.col("cl")
    made = {
        "depth_atr": F.col("depth_atr"), "low_offset_atr": F.col("offset_atr"), "symmetry_ratio": F.when(longer > 0, 1.0 - F.least(F.abs(F.col("left_len") - F.col("right_len")) / longer, F.lit(1.0))).otherwise(0.0),
        "pattern_length": F.col("end_bar") - F.col("start_bar"), "atr_level": F.col("da"), "reclaim_atr": by(sign * (F.col("dc") - F.col("neckline")), "da"), "range_atr": by(F.col("dr"), "da"), "mom_24_atr": F.col("mom_24_atr"),
        "neck_pos_24": F.when(F.col("span_24_atr") > 0, F.col("close_pos_24") - (F.col("dc") - F.col("neckline")) / (F.col("span_24_atr") * F.col("da"))).otherwise(0.5), "close_pos_24": F.col("close_pos_24"), "span_24_atr": F.col("span_24_atr"), "vol_ratio_24": F.col("vol_ratio_24"),
        "confirm_reclaim_atr": by(sign * (F.col("cc") - F.col("neckline")), "ca"), "confirm_range_atr": by(size, "ca"), "confirm_body_ratio": F.when(size > 0, F.abs(F.col("cc") - F.col("co")) / size).otherwise(0.0),
        "confirm_close_location": F.when(size > 0, (F.col("cc") - F.col("cl")) / size).otherwise(0.5), "confirm_vol_zscore": F.col("confirm_vol_zscore"), "bars_confirm_delay": F.col("confirm_bar") - F.col("detect_bar"),
        "atr_ratio_200": F.col("atr_ratio_200"), "hour_utc": F.col("hour"), "day_of_week": F.col("weekday"), **{f"session_{n}": F.col(f"in_{n}").cast("int") for n in sessions}, "rule_score": F.col("rule_score"), **{c: F.col(c) for c in extra},
    }
    return rows.select("symbol", "event_id", *[F.coalesce(F.nanvl(x.cast("double"), F.lit(None).cast("double")), F.lit(0.0)).alias(n) for n, x in made.items()])


GATE_FEATURES = ("depth_atr", "low_offset_atr", "symmetry_ratio", "pattern_length", "rule_score", "reclaim_atr", "range_atr", "mom_24_atr", "neck_pos_24", "close_pos_24", "span_24_atr", "vol_ratio_24")


def gate_matrix(features: DataFrame) -> DataFrame:
    """The twelve GATE_FEATURES of each event in order; all 0 where the detection bar has no ATR, so no row is lost."""
    valid = F.col("atr_level") > 0
    return features.select("symbol", "event_id", *[F.when(valid, F.col(c)).otherwise(0.0).alias(c) for c in GATE_FEATURES])


def model_vector(rows: DataFrame, names: Sequence[str], out: str = "vector") -> DataFrame:
    """``out``: an array of exactly ``names`` in order; a column that ``rows`` lacks, or a null, is NaN."""
    nan = F.lit(float("nan"))
    return rows.withColumn(out, F.array(*[F.coalesce(F.col(n).cast("double"), nan) if n in rows.columns else nan for n in names]))


def flattened(rows: DataFrame, bag: str, depth: int = 3) -> DataFrame:
    """The struct column ``bag`` as plain columns, nested names joined by ``_`` down to ``depth`` levels (what is deeper becomes JSON); a name that is taken gets ``_attr``."""
    def leaves(kind: T.StructType, path: str, name: str, level: int):
        for f in kind.fields:
            at, own = f"{path}.`{f.name}`", f"{name}_{f.name}" if name else f.name
            if isinstance(f.dataType, T.StructType) and level < depth:
                yield from leaves(f.dataType, at, own, level + 1)
            else:
                yield own, F.to_json(F.col(at)) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(at)

    taken = [c for c in rows.columns if c != bag]
    made = [value.alias(f"{name}_attr" if name in taken else name) for name, value in leaves(rows.schema[bag].dataType, f"`{bag}`", "", 1)]
    return rows.select(*taken, *made)


def trend_inputs(bars: DataFrame, names: Sequence[str] = ("mean_return_norm", "slope_norm", "range_pos", "atr_norm", "volume_z20"), window: int = 20) -> DataFrame:
    """(symbol, bar, names): the regime's input columns. A column of ``bars`` of that name wins; an unknown name raises.

    ``bars`` has atr. mean_return_norm is the sum of the last ``window`` log returns and slope_norm the least-squares move
    over as many closes, both over ATR times the root of ``window``.
    """
    held, w = blocked(bars, window + 1)
    frame, full = w.rowsBetween(1 - window, 0), F.count("close").over(w.rowsBetween(1 - window, 0)) == window
    scale = F.when(F.col("atr") > 0, F.col("atr") * float(window) ** 0.5)
    step = F.when((F.col("close") > 0) & (F.lag("close").over(w) > 0), F.log(F.col("close") / F.lag("close").over(w)))
    held = held.withColumn("_step", step)
    low, high = F.min("low").over(frame), F.max("high").over(frame)
    sd = F.stddev_samp("volume").over(frame)
    made = {
        "mean_return_norm": F.when(F.count("_step").over(frame) == window, F.sum("_step").over(frame)) / scale,
        "slope_norm": F.when(full, F.regr_slope("close", F.col("bar").cast("double")).over(frame)) * (window - 1) / scale,
        "range_pos": F.when(full, F.when(high > low, 2 * (F.col("close") - low) / (high - low) - 1).otherwise(0.0)),
        "atr_norm": F.col("atr") / F.nullif(F.col("close"), F.lit(0.0)),
        "volume_z20": F.when(full, (F.col("volume") - F.avg("volume").over(frame)) / F.nullif(sd, F.lit(0.0))),
    }
    if unknown := [n for n in names if n not in made and n not in bars.columns]:
        raise ValueError(f"no input columns {unknown}")
    chosen = {n: F.col(n) if n in bars.columns else made[n] for n in names}
    return own_rows(held.withColumns({f"_in_{n}": x for n, x in chosen.items()})).select("symbol", "bar", *[F.col(f"_in_{n}").alias(n) for n in names])
