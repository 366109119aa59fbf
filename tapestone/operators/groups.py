"""Correlated events, gates, exposure and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.projections import half_up
from ..plans.components import components
from ..plans.layout import placed, running_sum


def correlated_groups(events: DataFrame, window: int, price_atr: float, keys: Sequence[str] = ("symbol", "direction"), order: str = "bar", row_id: str = "event_id") -> DataFrame:
    """``group_id``, the smallest event reachable over pairs close in time and price.

    Events more than ``window`` after the one before start a new island, so pairs are sought inside islands, by buckets
    of the window's width; groups are their components, however long.
    """
    side = events.select(*keys, F.col(row_id).alias("a"), F.col(order).alias("t"), F.col("close").alias("p"), "atr").withColumn("b0", F.floor(F.col("t") / window))
    other = side.select(*keys, F.col("a").alias("b"), F.col("t").alias("t2"), F.col("p").alias("p2"), F.col("atr").alias("atr2"), F.explode(F.array(F.col("b0"), F.col("b0") + 1)).alias("b0"))
    near = side.join(other, [*keys, "b0"]).filter((F.abs(F.col("t") - F.col("t2")) <= window) & (F.col("a") != F.col("b")) & (F.abs(F.col("p") - F.col("p2")) <= price_atr * (F.col("atr") + F.col("atr2")) / 2))
    labels = components(near.select("a", "b")).select(F.col("node").alias(row_id), F.col("component").alias("group_id"))
    return events.join(labels, row_id, "left").withColumn("group_id", F.coalesce("group_id", row_id))


def best_of_group(grouped: DataFrame, priority: Column, row_id: str = "event_id") -> DataFrame:
    """``discard_reason`` is correlated for all but the group's best by priority, then id."""
    n = F.row_number().over(Window.partitionBy("group_id").orderBy(priority.desc(), row_id))
    return grouped.withColumn("_n", n).withColumn("discard_reason", F.when(F.col("_n") > 1, "correlated")).drop("_n")


def regime_gate(events: DataFrame, rules: DataFrame, key: str = "symbol") -> DataFrame:
    """``allowed`` and its reason; rules are (key, states array, min_confidence), one row for each key."""
    df = events.join(rules, key, "left")
    reason = F.when(F.col("states").isNull(), "no_rule").when(F.col("state").isNull(), "no_regime").when(~F.array_contains("states", F.col("state")), "state").when(F.col("confidence") < F.col("min_confidence"), "confidence").otherwise("ok")
    return df.withColumn("gate_reason", reason).withColumn("allowed", F.col("gate_reason").isin("ok", "no_rule")).drop("states", "min_confidence")


def probability_gate(events: DataFrame, min_prob: float, min_rule: float) -> DataFrame:
    """Both scores reach their thresholds; a missing probability passes."""
    return events.withColumn("passes", F.coalesce(F.col("model_prob") >= min_prob, F.lit(True)) & (F.col("rule_score") >= min_rule))


def exposure_replay(trades: DataFrame, max_open: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """``executed``: trades in entry order, each taken while fewer than ``max_open`` taken ones are still open.

    A busy period ends where a trade enters after all before it have closed; periods are folded by themselves.
    """
    w = Window.partitionBy(*keys).orderBy("entry_bar", "event_id")
    prior = F.max("exit_bar").over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = trades.withColumn("_new", F.coalesce((F.col("entry_bar") >= prior).cast("int"), F.lit(1))).withColumn("_period", F.sum("_new").over(w))
    row = F.struct(F.col("entry_bar").alias("a"), F.col("event_id").alias("i"), F.col("exit_bar").alias("z"))
    held = df.groupBy(*keys, "_period").agg(F.array_sort(F.collect_list(row)).alias("xs"))
    kept = held.select(F.explode(F.expr(f"aggregate(xs, cast(array() as array<struct<a:bigint,i:bigint,z:bigint>>), (acc, x) -> if(size(filter(acc, y -> y.z > x.a)) < {max_open}, concat(acc, array(x)), acc))")).alias("k")).select(F.col("k.i").alias("event_id"), F.lit(True).alias("executed"))
    return trades.join(kept, "event_id", "left").withColumn("executed", F.coalesce("executed", F.lit(False)))


def time_split(rows: DataFrame, order: Sequence[str], shares: tuple[float, float] = (0.6, 0.2), keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """train, val and test by row share in time order; boundaries round half to even."""
    w = Window.partitionBy(*keys)
    n, at = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(*order))
    a, b = F.bround(n * shares[0], 0), F.bround(n * (shares[0] + shares[1]), 0)
    return rows.withColumn("split", F.when(at <= a, "train").when(at <= b, "val").otherwise("test"))


def purge_and_embargo(split: DataFrame, horizon: int, embargo: int, order: str = "bar", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """``used`` is false for train rows whose outcome reaches validation, and validation rows just after train."""
    edge = split.groupBy(*keys).agg(F.min(F.when(F.col("split") == "val", F.col(order))).alias("_v"), F.max(F.when(F.col("split") == "train", F.col(order))).alias("_t"))
    df = split.join(edge, list(keys))
    bad = ((F.col("split") == "train") & (F.col(order) + horizon >= F.col("_v"))) | ((F.col("split") == "val") & (F.col(order) <= F.col("_t") + embargo))
    return df.withColumn("used", ~F.coalesce(bad, F.lit(False))).drop("_v", "_t")


def walk_forward(rows: DataFrame, folds: int, order: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """(fold, role) for each row: slice f + 1 tests what slices 0 to f train."""
    w = Window.partitionBy(*keys)
    part = F.least(F.floor((F.row_number().over(w.orderBy(*order)) - 1) / F.greatest(F.floor(F.count(F.lit(1)).over(w) / (folds + 1)), F.lit(1))), F.lit(folds))
    df = rows.withColumn("_s", part).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    return df.filter(F.col("_s") <= F.col("fold") + 1).withColumn("role", F.when(F.col("_s") == F.col("fold") + 1, "test").otherwise("train")).drop("_s")


def open_before(trades: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """``n_open``: earlier trades of the key still open at a trade's entry, and ``since``: bars since the last entry.

    Every trade exits after its entry; one that exits at a bar is closed for those which enter there. Entries and exits
    are one running sum, so no pair of trades is formed.
    """
    entries = trades.select(*keys, F.col("entry_bar").alias("_at"), F.lit(1).alias("_delta"), "direction", F.struct("entry_bar", "direction").alias("_own"))
    exits = trades.select(*keys, F.col("exit_bar").alias("_at"), F.lit(-1).alias("_delta"), "direction", F.lit(None).cast(entries.schema["_own"].dataType).alias("_own"))
    w = Window.partitionBy(*keys).orderBy("_at", "_delta", "direction").rowsBetween(Window.unboundedPreceding, -1)
    summed = entries.unionByName(exits).withColumn("n_open", F.coalesce(F.sum("_delta").over(w), F.lit(0))).filter("_own is not null")
    before = F.lag("entry_bar").over(Window.partitionBy(*keys).orderBy("entry_bar", "direction"))
    return summed.select(*keys, "_own.entry_bar", "_own.direction", "n_open").withColumn("since", F.col("entry_bar") - before)


def risk_gate(trades: DataFrame, max_open: int, min_bars: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Why a new signal is refused: ``max_open`` trades are open, or the last entry is under ``min_bars`` bars ago; null if it passes."""
    reason = F.when(F.col("n_open") >= max_open, "max_open").when(F.col("since") < min_bars, "too_soon")
    return open_before(trades, keys).withColumn("refused", reason)


def bar_split(rows: DataFrame, oos_share: float, horizon: int, purge: int, embargo: int, order: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """``role``: oos for the last share of rows, train for those whose horizon, purge and embargo end by the first oos bar, else dropped."""
    w = Window.partitionBy(*keys)
    n, at = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(*order))
    df = rows.withColumn("_oos", at > n - F.greatest(F.lit(1), F.bround(n * oos_share, 0)))
    df = df.withColumn("_edge", F.min(F.when(F.col("_oos"), F.col("entry_bar"))).over(w))
    role = F.when(F.col("_oos"), "oos").when(F.col("entry_bar") + horizon + purge + embargo <= F.col("_edge"), "train").otherwise("dropped")
    return df.withColumn("role", role).drop("_oos", "_edge")


def step_folds(rows: DataFrame, initial: int, step: int, size: int, horizon: int, embargo: int, order: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """(fold, role) rows: fold f trains on the first initial + f * step rows, less those whose horizon or embargo reaches its ``size`` test rows.

    Only folds whose test rows are all there; a row is repeated once for each fold that uses it.
    """
    w = Window.partitionBy(*keys)
    df = rows.withColumn("_at", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    folds = F.floor((F.col("_n") - initial - embargo - size) / step)
    df = df.filter(folds >= 0).withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), folds)))
    end = F.lit(initial) + F.col("fold") * step
    start = end + embargo
    train = (F.col("_at") < end) & (F.col("_at") + horizon < start) & (F.col("_at") < start - embargo)
    role = F.when(train, "train").when((F.col("_at") >= start) & (F.col("_at") < start + size), "test")
    return df.withColumn("role", role).filter("role is not null").drop("_at", "_n")


def drift_gate(events: DataFrame, latest: DataFrame, most_atr: float) -> DataFrame:
    """``fresh``: the latest close (symbol, last_close) is within ``most_atr`` ATR of the entry; without a close or an ATR it passes, without an entry it doesn't."""
    far = F.abs(F.col("_latest") - F.col("entry")) > most_atr * F.col("atr")
    fresh = F.when(F.col("entry").isNull() | F.isnan("entry"), False).when(F.col("atr") > 0, ~F.coalesce(far, F.lit(False))).otherwise(True)
    return events.join(latest.select("symbol", F.col("last_close").alias("_latest")), "symbol", "left").withColumn("fresh", fresh).drop("_latest")


def measurement_gates(events: DataFrame, max_length: int | None = None, least_score: float | None = None, least_prob: float | None = None) -> DataFrame:
    """``len_ok``, ``rule_ok``, ``prob_ok``: a gate without a limit, or a span or probability that is missing, passes; a missing score counts as 0."""
    yes = F.lit(True)
    length = yes if max_length is None else F.coalesce(F.col("end_bar") - F.col("start_bar") <= max_length, yes)
    rule = yes if least_score is None else F.coalesce(F.col("rule_score"), F.lit(0.0)) >= least_score
    prob = yes if least_prob is None else F.coalesce(F.col("model_prob") >= least_prob, yes)
    return events.withColumns({"len_ok": length, "rule_ok": rule, "prob_ok": prob})


def regime_required(events: DataFrame, needs_regime: Column, has_regime: Column) -> DataFrame:
    """``discard_reason`` where a model needs regime columns that an event lacks."""
    return events.withColumn("discard_reason", F.when(needs_regime & ~has_regime, "hmm_unavailable"))


def confluence(grouped: DataFrame, priority: Column, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), tau_bars: float = 8.0, tau_price: float = 1.0, most: int | None = None, row_id: str = "event_id") -> DataFrame:
    """One row for each group: its best event, its size and a score in 0..1 of size and of the nearest other event's gaps in bars and price."""
    best = grouped.groupBy("group_id").agg(F.max_by(F.struct(F.col(row_id).alias("best_id"), F.col("bar").alias("_b"), F.col("close").alias("_p"), F.col("atr").alias("_a")), F.struct(priority, -F.col(row_id))).alias("best"), F.count(F.lit(1)).alias("n"))
    best = best.select("group_id", "n", "best.*")
    other = F.col(row_id) != F.col("best_id")
    scale = F.when(F.col("_a") > 0, F.col("_a")).otherwise(1.0)
    gaps = grouped.join(best, "group_id").groupBy("group_id", "best_id", "n").agg(F.coalesce(F.min(F.when(other, F.abs(F.col("bar") - F.col("_b")))), F.lit(0)).alias("dt"), F.coalesce(F.min(F.when(other, F.abs(F.col("close") - F.col("_p")) / scale)), F.lit(0.0)).alias("dp"))
    size = F.when(F.col("n") > 1, (F.col("n") - 1) / F.greatest(F.lit(most) - 1 if most and most > 1 else F.col("n") - 1, F.lit(1))).otherwise(0.0)
    a, b, c = weights
    score = (a * size + b * F.exp(-F.col("dt") / tau_bars) + c * F.exp(-F.col("dp") / tau_price)) / (a + b + c)
    return gaps.select("group_id", "best_id", "n", half_up(score, 4).alias("score"))


def balanced_sample(rows: DataFrame, strata: Sequence[str], side: str, row_id: str, quota: int, seed: int = 42) -> DataFrame:
    """At most ``quota`` rows of each stratum, in turn from each side, by a seeded hash of the id."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string")))
    inside = F.row_number().over(Window.partitionBy(*strata, side).orderBy(draw, row_id))
    few = rows.withColumn("_r", inside).filter(F.col("_r") <= quota)
    turn = F.row_number().over(Window.partitionBy(*strata).orderBy("_r", side))
    return few.withColumn("rank", turn).filter(F.col("rank") <= quota).drop("_r")


def resolved_groups(events: DataFrame, mode: str, priority: Column, window: int = 12, price_atr: float = 1.0, row_id: str = "event_id", atr: Column | None = None) -> DataFrame:
    """Events by how correlated ones are treated: ``dedup`` (all but the best of a group get a discard reason), ``confluence`` (one row for each group), or ``independent`` (each its own group).

    ``atr`` resolves an event's ATR; by default it is the column ``atr``.
    """
    if mode == "independent":
        return events.withColumn("group_id", F.col(row_id)).withColumn("discard_reason", F.lit(None).cast("string"))
    if mode not in ("dedup", "confluence"):
        raise ValueError(f"no mode {mode}")
    grouped = correlated_groups(events if atr is None else events.withColumn("atr", atr), window, price_atr, row_id=row_id)
    return best_of_group(grouped, priority, row_id) if mode == "dedup" else confluence(grouped, priority, row_id=row_id)


def totals_gate(trades: DataFrame, most_total: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """``n_all``: earlier trades of all series still open at a trade's entry, and ``refused`` where that reaches ``most_total``.

    Entries and exits of all series are counted by bar first, so that one running sum over bars is enough.
    """
    moves = trades.select(F.col("entry_bar").alias("at"), F.lit(1).alias("delta")).unionByName(trades.select(F.col("exit_bar").alias("at"), F.lit(-1).alias("delta")))
    by_bar = moves.groupBy("at").agg(F.sum(F.when(F.col("delta") < 0, F.col("delta")).otherwise(0)).alias("out"), F.sum(F.when(F.col("delta") > 0, F.col("delta")).otherwise(0)).alias("in"))
    summed = running_sum(by_bar.withColumn("one", F.lit(1)).withColumn("net", F.col("in") + F.col("out")), "net", "open", ("one",), ["at"])
    # those that enter at the bar itself are no earlier trades
    return trades.join(summed.select(F.col("at").alias("entry_bar"), (F.col("open") - F.col("in")).alias("n_all")), "entry_bar").withColumn("refused", F.when(F.col("n_all") >= most_total, "max_total"))


def expanding_folds(rows: DataFrame, folds: int, order: Sequence[str], least_train: int = 10, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """``walk_forward``'s (fold, role) rows of those folds that train on ``least_train`` rows or more."""
    out = walk_forward(rows, folds, order, keys)
    trained = F.count_if(F.col("role") == "train").over(Window.partitionBy(*keys, "fold"))
    return out.withColumn("_n", trained).filter(F.col("_n") >= least_train).drop("_n")


def placed_all(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``place`` from 1 of each row of the whole table by ``order``, counted in buckets of its first column."""
    numbered = placed(rows.withColumn("_all", F.lit(1)), ("_all",), order)
    return numbered.withColumn("place", F.col("place") + 1).drop("_all")
