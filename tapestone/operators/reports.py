"""Aggregates over results and scores: profit factor, drawdown, binary metrics, calibration, drift, drift of losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indicators import add_trend_context
from ..functions.projections import half_up


def profit_factor(x: Column) -> Column:
    """Gains over losses; infinite without a loss, 0 for nothing."""
    gain, loss = F.sum(F.when(x > 0, x).otherwise(0.0)), F.abs(F.sum(F.when(x < 0, x).otherwise(0.0)))
    return F.when(F.count(x) == 0, 0.0).when(loss == 0, F.when(gain > 0, float("inf")).otherwise(0.0)).otherwise(gain / F.nullif(loss, F.lit(0.0)))


def result_metrics(trades: DataFrame, keys: Sequence[str], result: str = "result_r") -> DataFrame:
    x = F.col(result)
    return trades.groupBy(*keys).agg(F.count(x).alias("n"), profit_factor(x).alias("pf"), F.sum(x).alias("total_r"), F.avg(x).alias("expectancy"), F.avg((x > 0).cast("double")).alias("win_rate"))


def max_drawdown(trades: DataFrame, keys: Sequence[str], order: Sequence[str], result: str = "result_r") -> DataFrame:
    """Greatest fall of the running sum below its peak, which starts at the first value."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    curve = trades.withColumn("_c", F.sum(result).over(w)).withColumn("_p", F.max("_c").over(w))
    return curve.groupBy(*keys).agg(F.max(F.col("_p") - F.col("_c")).alias("max_drawdown"), F.max_by("_c", F.struct(*order)).alias("final_r"))


def rolling_pf(trades: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 20, least: int = 10, result: str = "result_r") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - n, 0)
    x = F.col(result)
    gain, loss = F.sum(F.when(x > 0, x).otherwise(0.0)).over(w), F.abs(F.sum(F.when(x < 0, x).otherwise(0.0)).over(w))
    return trades.withColumn("rolling_pf", F.when(F.count(x).over(w) >= least, gain / F.nullif(loss, F.lit(0.0))))


def binary_metrics(scored: DataFrame, keys: Sequence[str], label: str = "label", score: str = "score") -> DataFrame:
    """n, positives, ROC-AUC by mean ranks of ties, average precision, Brier, accuracy at one half; one row of sums for each score."""
    by_score = scored.groupBy(*keys, score).agg(F.sum(label).cast("double").alias("p"), F.count(F.lit(1)).cast("double").alias("m"), F.sum(F.pow(F.col(score) - F.col(label), F.lit(2.0))).alias("se"), F.sum(((F.col(score) >= 0.5).cast("int") == F.col(label)).cast("double")).alias("hit"))
    down = Window.partitionBy(*keys).orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, 0)
    ranked = by_score.withColumn("tp", F.sum("p").over(down)).withColumn("above", F.sum("m").over(down)).withColumn("rank", F.sum("m").over(up) - (F.col("m") - 1) / 2)
    out = ranked.groupBy(*keys).agg(F.sum("m").alias("n"), F.sum("p").alias("positives"), F.sum(F.col("p") * F.col("rank")).alias("ranks"), F.sum(F.col("p") * F.col("tp") / F.col("above")).alias("ap"), F.sum("se").alias("se"), F.sum("hit").alias("hit"))
    pos, neg = F.col("positives"), F.col("n") - F.col("positives")
    return out.select(*keys, F.col("n").cast("long").alias("n"), pos.cast("long").alias("positives"), ((F.col("ranks") - pos * (pos + 1) / 2) / F.nullif(pos * neg, F.lit(0.0))).alias("roc_auc"), (F.col("ap") / F.nullif(pos, F.lit(0.0))).alias("pr_auc"), (F.col("se") / F.col("n")).alias("brier"), (F.col("hit") / F.col("n")).alias("accuracy"))


def calibration(scored: DataFrame, label: str = "label", score: str = "score", bins: int = 10) -> DataFrame:
    """Counts, mean score and mean label of each bin, the right edge closed; ``ece`` is the whole table's error."""
    b = scored.groupBy(F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("mean_label"))
    gap = F.abs(F.col("mean_score") - F.col("mean_label")) * F.col("n")
    total = b.agg((F.sum(gap) / F.sum("n")).alias("ece"))
    return b.crossJoin(F.broadcast(total))


def co_occurrence(rows: DataFrame, group: str, item: str) -> DataFrame:
    """Share of the groups with ``a`` that also have ``b``."""
    held = rows.select(F.col(group).alias("g"), F.col(item).alias("i")).distinct()
    sizes = held.groupBy(F.col("i").alias("a")).agg(F.count(F.lit(1)).alias("n"))
    return _pairs(held).join(sizes, "a").select("a", "b", "both", (F.col("both") / F.col("n")).alias("share"))


def _pairs(held: DataFrame) -> DataFrame:
    """(a, b, both) of (g, i) rows: pairs are formed in the distinct item sets of groups, of which there are far fewer than groups."""
    sets = held.groupBy("g").agg(F.array_sort(F.collect_set("i")).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c"))
    return sets.select("c", "s", F.explode("s").alias("a")).select("c", "a", F.explode("s").alias("b")).groupBy("a", "b").agg(F.sum("c").alias("both"))


def psi(values: DataFrame, value: str, is_base: Column, keys: Sequence[str] = (), bins: int = 10, eps: float = 1e-4) -> DataFrame:
    """Population stability index of the rest against the base rows, over the base's quantile edges."""
    edges = values.filter(is_base).groupBy(*keys).agg(F.array_distinct(F.percentile(value, F.array(*[F.lit(i / bins) for i in range(1, bins)]))).alias("edges"))
    joined = values.join(F.broadcast(edges), list(keys)) if keys else values.crossJoin(F.broadcast(edges))
    bucket = F.size(F.filter("edges", lambda e: e < F.col(value)))
    counts = joined.withColumn("_b", bucket).withColumn("_base", is_base).groupBy(*keys, "_b", F.size("edges").alias("_e")).agg(F.count_if("_base").alias("e"), F.count_if(~F.col("_base")).alias("a"))
    w = Window.partitionBy(*keys)
    shares = counts.withColumn("e", F.greatest(F.col("e") / F.sum("e").over(w), F.lit(eps))).withColumn("a", F.greatest(F.col("a") / F.sum("a").over(w), F.lit(eps)))
    return shares.groupBy(*keys).agg(F.sum((F.col("a") - F.col("e")) * F.log(F.col("a") / F.col("e"))).alias("psi"))


def loss_runs(trades: DataFrame, keys: Sequence[str], order: Sequence[str], result: str = "result_r") -> DataFrame:
    """Longest run of losses, and the run of losses at the end."""
    w = Window.partitionBy(*keys).orderBy(*order)
    df = trades.withColumn("_l", (F.col(result) < 0).cast("int")).withColumn("_g", F.sum(1 - F.col("_l")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = df.groupBy(*keys, "_g").agg(F.sum("_l").alias("run"))
    return runs.groupBy(*keys).agg(F.max("run").alias("longest"), F.max_by("run", "_g").alias("at_end"))


def bootstrap_pf(trades: DataFrame, keys: Sequence[str], row_id: str, reps: int = 1000, result: str = "result_r", seed: int = 1) -> DataFrame:
    """5 % quantile of the profit factor over Poisson resamples, infinite for those without a loss: a row's count in a resample is drawn by its hash."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(row_id), F.col("rep")), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    # counts 0 to 5 of a Poisson law of mean 1
    count = sum(F.when(u > c, 1).otherwise(0) for c in (0.36788, 0.73576, 0.9197, 0.98101, 0.99634))
    drawn = trades.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("_x", F.col(result) * count)
    return drawn.groupBy(*keys, "rep").agg(profit_factor(F.col("_x")).alias("pf")).groupBy(*keys).agg(F.percentile("pf", 0.05).alias("pf_low"))


def equity_curve(trades: DataFrame, keys: Sequence[str], order: Sequence[str], risk: float = 0.01, result: str = "result_r") -> DataFrame:
    """``equity``: 1 and the running sum of results, each a share ``risk`` of the start."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return trades.withColumn("equity", 1.0 + risk * F.sum(result).over(w))


def distribution(rows: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Count, and exact median and 90 % quantile of each column."""
    parts = [F.percentile(c, q).alias(f"{c}_{name}") for c in columns for q, name in ((0.5, "median"), (0.9, "p90"))]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *parts)


def best_threshold(trades: DataFrame, column: str, arms: Sequence[float], floor: int, keys: Sequence[str], result: str = "result_r") -> DataFrame:
    """The arm with the best profit factor of the rows at or under it, among arms of at least ``floor`` rows; ties: more rows, then the lower arm."""
    held = F.filter(F.array(*[F.lit(float(a)) for a in arms]), lambda a: F.col(column) <= a)
    by_arm = trades.withColumn("arm", F.explode(held)).groupBy(*keys, "arm").agg(F.count(result).alias("n"), F.round(profit_factor(F.col(result)), 9).alias("pf")).filter(F.col("n") >= floor)
    best = F.max(F.struct("pf", "n", (-F.col("arm")).alias("lower"))).alias("best")
    return by_arm.groupBy(*keys).agg(best).select(*keys, (-F.col("best.lower")).alias("arm"), "best.n", "best.pf")


def halves(trades: DataFrame, order: Sequence[str | Column], keys: Sequence[str], result: str = "result_r") -> DataFrame:
    """Result metrics of the lower (1) and the upper (2) half by ``order``; the lower has the odd row."""
    return result_metrics(trades.withColumn("half", F.ntile(2).over(Window.partitionBy(*keys).orderBy(*order))), [*keys, "half"], result)


def longest_good_run(trades: DataFrame, fold: Column, keys: Sequence[str], least: float = 0.8, result: str = "result_r") -> DataFrame:
    """Folds, and the longest run of folds one after another whose profit factor reaches ``least``; folds without trades are left out."""
    folds = trades.groupBy(*keys, fold.alias("fold")).agg((profit_factor(F.col(result)) >= least).alias("good"))
    w = Window.partitionBy(*keys).orderBy("fold").rowsBetween(Window.unboundedPreceding, 0)
    runs = folds.withColumn("run", F.sum((~F.col("good")).cast("int")).over(w)).groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"))
    return runs.groupBy(*keys).agg(F.sum("n").alias("folds"), F.max("good").alias("longest"))


def drift_report(rows: DataFrame, columns: Sequence[str], is_base: Column) -> DataFrame:
    """Stability index of each column, its severity (under 0.1 none, under 0.25 moderate, else severe), and whether to retrain."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns]))
    long = rows.select(is_base.alias("_old"), cells.alias("_c")).select("_old", "_c.feature", "_c.value")
    out = psi(long, "value", F.col("_old"), ["feature"])
    return out.withColumn("severity", F.when(F.col("psi") < 0.1, "none").when(F.col("psi") < 0.25, "moderate").otherwise("severe")).withColumn("retrain", F.col("psi") >= 0.25)


def confluence_buckets(groups: DataFrame, n: str = "n_patterns", executed: str = "executed", result: str = "net_r") -> DataFrame:
    """For each number of agreeing patterns (at least 1): groups, executed trades, their mean net result and profit factor."""
    net = F.when(F.col(executed), F.col(result))
    return groups.groupBy(F.greatest(F.lit(1), F.col(n)).alias(n)).agg(F.count(F.lit(1)).alias("groups"), F.count(net).alias("trades"), half_up(F.avg(net), 4).alias("expectancy_r"), F.when(F.count(net) > 0, half_up(profit_factor(net), 4)).alias("pf"))


def block_bootstrap_pf(trades: DataFrame, keys: Sequence[str], order: Sequence[str], reps: int = 3000, seed: int = 42, result: str = "result_r") -> DataFrame:
    """5 % and 95 % quantiles of the profit factor over resamples of blocks of min(25, 2 sqrt n) trades in time order.

    A resample draws as many whole blocks as fit and one for the rest; each start is a seeded hash. Null under 100 finite resamples.
    """
    w = Window.partitionBy(*keys)
    rows = trades.withColumn("_at", F.row_number().over(w.orderBy(*order)) - 1).select(*keys, "_at", F.col(result).alias("_x"))
    sizes = trades.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("size", F.least(F.lit(25), F.greatest(F.lit(1), F.floor(2 * F.sqrt("n")))))
    draws = sizes.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / F.col("size")) - 1)))
    length = F.least(F.col("size"), F.col("n") - F.col("block") * F.col("size"))
    start = F.pmod(F.xxhash64(F.lit(seed), *keys, "rep", "block"), F.greatest(F.lit(1).cast("long"), F.col("n") - length + 1))
    drawn = draws.select(*keys, "rep", F.explode(F.sequence(start, start + length - 1)).alias("_at")).join(rows, [*keys, "_at"])
    gain, loss = F.sum(F.when(F.col("_x") > 0, F.col("_x")).otherwise(0.0)), F.abs(F.sum(F.when(F.col("_x") < 0, F.col("_x")).otherwise(0.0)))
    pfs = drawn.groupBy(*keys, "rep").agg((gain / F.nullif(loss, F.lit(0.0))).alias("pf"))
    enough = F.count("pf") >= 100
    return pfs.groupBy(*keys).agg(F.when(enough, F.percentile("pf", 0.05)).alias("pf_low"), F.when(enough, F.percentile("pf", 0.95)).alias("pf_high"))


def kill_switch(trades: DataFrame, keys: Sequence[str], order: Sequence[str], last: int = 60, least: int = 30, result: str = "result_r") -> DataFrame:
    """Metrics of the ``last`` trades, their bootstrapped profit factor, and ``stop``: enough trades and an upper quantile under 1."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]))
    recent = trades.withColumn("_n", n).filter(F.col("_n") <= last).drop("_n")
    out = result_metrics(recent, keys, result).join(block_bootstrap_pf(recent, keys, order, result=result), list(keys), "left")
    return out.withColumn("stop", F.coalesce((F.col("n") >= least) & (F.col("pf_high") < 1), F.lit(False)))


def fill_medians(rows: DataFrame, columns: Sequence[str], is_train: Column, keys: Sequence[str]) -> DataFrame:
    """Nulls replaced by the exact median of the train rows of the key."""
    medians = rows.filter(is_train).groupBy(*keys).agg(*[F.percentile(c, 0.5).alias(f"_m_{c}") for c in columns])
    return rows.join(medians, list(keys), "left").withColumns({c: F.coalesce(c, f"_m_{c}") for c in columns}).drop(*[f"_m_{c}" for c in columns])


def standardised(rows: DataFrame, columns: Sequence[str], is_train: Column, keys: Sequence[str]) -> DataFrame:
    """Columns less the train rows' mean, over their population deviation (1 where that is 0)."""
    parts = [p for c in columns for p in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))]
    stats = rows.filter(is_train).groupBy(*keys).agg(*parts)
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in columns}
    return rows.join(stats, list(keys), "left").withColumns(scaled).drop(*[f"_{k}_{c}" for c in columns for k in "ms"])


def without_outcomes(rows: DataFrame, names: Sequence[str], prefixes: Sequence[str]) -> DataFrame:
    """Rows without the columns that tell the outcome: by name, or by prefix."""
    return rows.drop(*[c for c in rows.columns if c in names or c.startswith(tuple(prefixes))])


def unavailable(events: DataFrame, stamps: dict[str, str], known: str = "known_at") -> DataFrame:
    """(event columns, feature): declared features whose stamp column is missing or later than ``known``."""
    late = [F.when(F.coalesce(F.col(c) > F.col(known), F.lit(True)), F.lit(f)) for f, c in stamps.items()]
    return events.withColumn("feature", F.explode(F.array_compact(F.array(*late))))


def classification_report(scored: DataFrame, keys: Sequence[str], label: str = "label", score: str = "score", threshold: float = 0.5) -> DataFrame:
    """n, accuracy, precision, recall and F1 at ``threshold``; a ratio without a denominator is 0."""
    said, true = F.col(score) >= threshold, F.col(label) == 1
    hits = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"), F.count_if(~said & ~true).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(b, F.lit(0)), F.lit(0.0))
    out = hits.withColumn("precision", ratio("tp", F.col("tp") + F.col("fp"))).withColumn("recall", ratio("tp", F.col("tp") + F.col("fn"))).withColumn("accuracy", (F.col("tp") + F.col("tn")) / F.col("n"))
    f1 = 2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))
    return out.select(*keys, "n", "accuracy", "precision", "recall", F.coalesce(f1, F.lit(0.0)).alias("f1"))


def symmetric_co_occurrence(rows: DataFrame, group: str, item: str) -> DataFrame:
    """(a, b, share): the mean of the shares of a's groups with b and of b's groups with a; 1 for an item with itself, 0 for a pair that never meets."""
    held = rows.select(F.col(group).alias("g"), F.col(item).alias("i")).distinct()
    sizes = held.groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    both = _pairs(held)
    every = sizes.select(F.col("i").alias("a"), F.col("n").alias("na")).crossJoin(sizes.select(F.col("i").alias("b"), F.col("n").alias("nb")))
    mean = F.when(F.col("a") == F.col("b"), 1.0).otherwise((F.coalesce("both", F.lit(0)) / F.col("na") + F.coalesce("both", F.lit(0)) / F.col("nb")) / 2)
    return every.join(both, ["a", "b"], "left").select("a", "b", mean.alias("share"))


def asset_performance(trades: DataFrame, breakeven: float, keys: Sequence[str] = ("symbol",), gross: str = "result_r", net: str = "net_r") -> DataFrame:
    """Trades, win rate, profit factor of the gross results, mean net result with its normal 95 % bounds (0 under four trades), and whether the mean is above ``breakeven``."""
    x = F.col(net)
    half = 1.96 * F.stddev_samp(x) / F.sqrt(F.count(x).cast("double"))
    bound = lambda sign: F.when(F.count(x) >= 4, F.avg(x) + sign * half).otherwise(0.0)
    return trades.groupBy(*keys).agg(F.count(x).alias("trades"), F.avg((x > 0).cast("double")).alias("win_rate"), profit_factor(F.col(gross)).alias("pf"), F.avg(x).alias("mean_r"), bound(-1).alias("low"), bound(1).alias("high"), (F.avg(x) > breakeven).alias("above_breakeven"))


def event_statistics(events: DataFrame, keys: Sequence[str] = ("symbol",), ts: str = "ts") -> DataFrame:
    """Events a year (of 365.25 days over the span of ``ts``), medians and 90 % quantiles of target, risk and reward in ATR and risks, and counts by exit."""
    years = (F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))) / (365.25 * 86400 * 1e6)
    target = F.abs(F.col("target") - F.col("entry"))
    shares = {"target_atr": target / F.nullif(F.col("atr"), F.lit(0.0)), "risk_atr": F.col("risk") / F.nullif(F.col("atr"), F.lit(0.0)), "reward": target / F.nullif(F.col("risk"), F.lit(0.0))}
    quantiles = [F.percentile(f"_{n}", q).alias(f"{n}_{name}") for n in shares for q, name in ((0.5, "median"), (0.9, "p90"))]
    exits = [F.count_if(F.col("exit_reason") == r).alias(f"n_{r}") for r in ("tp", "sl", "time", "ambiguous")]
    rows = events.withColumns({f"_{n}": x for n, x in shares.items()})
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / F.nullif(years, F.lit(0.0))).alias("per_year"), *quantiles, *exits)


def gate_arms(trades: DataFrame, arms: dict[str, Column], is_oos: Column, result: str = "result_r") -> DataFrame:
    """(arm, part, n, pf, total_r) of one pool of trades under each arm's gate (null: refused), for all, in-sample and out-of-sample rows."""
    passed = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in arms.items()]))
    parts = F.array(F.lit("all"), F.when(is_oos, "oos").otherwise("in_sample"))
    rows = trades.withColumn("arm", F.explode(passed)).withColumn("part", F.explode(parts))
    x = F.col(result)
    return rows.groupBy("arm", "part").agg(F.count(x).alias("n"), profit_factor(x).alias("pf"), F.sum(x).alias("total_r"))


def best_gate(trades: DataFrame, subsets: Sequence[Sequence[str]], confidences: Sequence[float], floor: int = 15, state: str = "state", confidence: str = "confidence", result: str = "result_r") -> DataFrame:
    """(states, least, n, pf) of the state subset and least confidence with the best profit factor among those that keep ``floor`` trades; ties: more trades, then the first names, then the lower confidence."""
    grid = F.array(*[F.struct(F.lit("+".join(sorted(s))).alias("states"), F.array(*[F.lit(x) for x in s]).alias("set"), F.lit(float(c)).alias("least")) for s in subsets for c in confidences])
    rows = trades.withColumn("g", F.explode(grid)).filter(F.array_contains("g.set", F.col(state)) & (F.col(confidence) >= F.col("g.least")))
    x = F.col(result)
    by = rows.groupBy("g.states", "g.least").agg(F.count(x).alias("n"), F.round(profit_factor(x), 9).alias("pf")).filter(F.col("n") >= floor)
    return by.orderBy(F.col("pf").desc(), F.col("n").desc(), "states", "least").limit(1)


def gate_audit(events: DataFrame, reason: str = "gate_reason", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """(keys, reason, n, share): how often each gate reason decided."""
    n = events.groupBy(*keys, reason).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def state_power(trades: DataFrame, state: str = "state", result: str = "result_r", least: int = 15) -> DataFrame:
    """Metrics of each state and ``verdict``: too_few under ``least`` trades, else edge or none by a profit factor over 1."""
    m = result_metrics(trades, [state], result)
    return m.withColumn("verdict", F.when(F.col("n") < least, "too_few").when(F.col("pf") > 1, "edge").otherwise("none"))


def threshold_table(trades: DataFrame, column: str, thresholds: Sequence[float], result: str = "result_r") -> DataFrame:
    """(threshold, n, pf, expectancy, kept) of the rows at or over each threshold; thresholds without rows have n 0."""
    total = trades.agg(F.count(result).alias("_all"))
    held = trades.withColumn("threshold", F.explode(F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.col(column) >= t)))
    x = F.col(result)
    rows = held.groupBy("threshold").agg(F.count(x).alias("n"), profit_factor(x).alias("pf"), F.avg(x).alias("expectancy"))
    every = trades.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    out = every.join(rows, "threshold", "left").join(F.broadcast(total))
    return out.select("threshold", F.coalesce("n", F.lit(0)).alias("n"), "pf", "expectancy", (F.coalesce("n", F.lit(0)) / F.nullif(F.col("_all"), F.lit(0))).alias("kept"))


def confluence_panel(events: DataFrame, group: str = "group_id", score: str = "rule_score", most: int = 4) -> DataFrame:
    """(n_patterns, count, avg_score): events and their mean rule score by the size of their group, 1 to ``most``; sizes that don't occur have 0."""
    sized = events.withColumn("n_patterns", F.count(F.lit(1)).over(Window.partitionBy(group)))
    stats = sized.groupBy("n_patterns").agg(F.count(F.lit(1)).alias("count"), half_up(F.avg(score), 4).alias("avg_score"))
    every = events.sparkSession.range(1, most + 1).select(F.col("id").alias("n_patterns"))
    return every.join(stats, "n_patterns", "left").select("n_patterns", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("avg_score", F.lit(0.0)).alias("avg_score"))


def triage(events: DataFrame, least_wick: float = 0.5, depth: tuple[float, float] = (0.1, 1.0)) -> DataFrame:
    """``verdict``: correct for a target hit, incorrect for a stop hit by a weak sweep (wick or depth out of bounds, or unconfirmed), else ambiguous."""
    weak = (F.col("wick") < least_wick) | ~F.col("depth").between(*depth) | ~F.col("confirmed")
    return events.withColumn("verdict", F.when(F.col("exit_reason") == "tp", "correct").when((F.col("exit_reason") == "sl") & F.coalesce(weak, F.lit(True)), "incorrect").otherwise("ambiguous"))


def triage_counts(judged: DataFrame, stratum: str) -> DataFrame:
    """(stratum, verdict, n) with the row ``*`` for all strata."""
    both = judged.withColumn("stratum", F.explode(F.array(F.col(stratum), F.lit("*"))))
    return both.groupBy("stratum", "verdict").agg(F.count(F.lit(1)).alias("n"))


def split_adequacy(trades: DataFrame, boundary: int, floor: int, keys: Sequence[str] = ("symbol",), at: str = "entry_bar", order: Sequence[str] = ("entry_bar", "event_id"), share: float = 0.4) -> DataFrame:
    """Rows after a fixed ``boundary`` and in the last ``share`` of each series' rows, and whether both reach ``floor``."""
    w = Window.partitionBy(*keys)
    place, n = F.row_number().over(w.orderBy(*order)), F.count(F.lit(1)).over(w)
    marked = trades.withColumn("_late", place > n - F.floor(n * share))
    counts = marked.groupBy(*keys).agg(F.count_if(F.col(at) >= boundary).alias("n_fixed"), F.count_if("_late").alias("n_late"))
    return counts.withColumn("adequate", (F.col("n_fixed") >= floor) & (F.col("n_late") >= floor))


def dropped_winners(trades: DataFrame, gates: dict[str, Column], least_score: float, score: str = "rule_score", result: str = "result_r") -> DataFrame:
    """Winning rows of at least ``least_score`` that some gate refused, with ``failed``, the gates' names in order joined by +, best result first."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in gates.items()]))
    rows = trades.withColumn("failed", F.array_join(failed, "+")).filter((F.col("failed") != "") & (F.col(result) > 0) & (F.col(score) >= least_score))
    return rows.orderBy(F.col(result).desc())


RESEARCH_GATES = ("n_total >= 300", "n_oos >= 100", "positive_rate between 0.10 and 0.90", "ess_ratio >= 0.60", "pf_low > 1.0", "pr_auc >= 1.05 * positive_rate", "longest_run >= 3")


def research_gate(metrics: DataFrame, gates: Sequence[str] = RESEARCH_GATES) -> DataFrame:
    """``failed``, the gates that the metrics don't pass (null fails), joined by ``; ``, and ``passed``."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(g), F.lit(False)), F.lit(g)) for g in gates]))
    return metrics.withColumn("failed", F.array_join(failed, "; ")).withColumn("passed", F.size(failed) == 0)


def promotion(metrics: DataFrame, least_trades: int = 30, least_pf: float = 1.1, most_loss_run: int = 6, floor_pf: float = 0.8) -> DataFrame:
    """``decision`` and ``reasons`` for models (state, n, pf, loss_run, drift): shadow goes live with enough trades, profit and no severe drift; live is paused by a run of losses, and degraded by a low profit factor or severe drift."""
    shadow, live = F.col("state") == "shadow", F.col("state") == "live"
    reasons = F.array_compact(F.array(
        F.when(shadow & (F.col("n") < least_trades), "too_few_trades"), F.when(shadow & (F.coalesce("pf", F.lit(0.0)) < least_pf), "low_pf"), F.when(F.col("drift") == "severe", "severe_drift"),
        F.when(live & (F.col("loss_run") >= most_loss_run), "loss_run"), F.when(live & (F.col("n") >= least_trades) & (F.coalesce("pf", F.lit(0.0)) < floor_pf), "pf_under_floor"),
    ))
    has = lambda r: F.array_contains(reasons, r)
    decision = F.when(shadow & (F.size(reasons) == 0), "promote").when(live & (has("severe_drift") | has("pf_under_floor")), "degrade").when(live & has("loss_run"), "pause").otherwise("stay")
    return metrics.withColumn("reasons", F.array_join(reasons, "+")).withColumn("decision", decision)


def stage_counts(events: DataFrame, stages: dict[str, Column], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Per series, how many events reach each stage; an event counts at a stage only if it passed those before."""
    reached, out = F.lit(True), []
    for name, passes in stages.items():
        reached = reached & F.coalesce(passes, F.lit(False))
        out.append(F.count_if(reached).alias(name))
    return events.groupBy(*keys).agg(*out)


def in_order(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` sorted by ``order``, which must be a whole tie-break, with their place: two runs give the same order."""
    return rows.orderBy(*order)


def trend_parameters(events: DataFrame, bars: DataFrame, grid: Sequence[tuple[int, float]], oos_start: str, floor: int = 100) -> DataFrame:
    """(direction, lookback, min_r2, kept, n, kept_pct, n_oos, kept_oos, oos_ok) for each pair of ``grid``.

    An event is kept if the closes of the ``lookback`` bars before it run its way with at least ``min_r2``; those from
    ``oos_start`` on are out of sample, and ``oos_ok`` says whether ``floor`` of them are kept.
    """
    rows = events.select("symbol", "bar", "ts", "direction")
    for i, (lookback, least) in enumerate(grid):
        rows = rows.join(add_trend_context(bars, lookback, least).select("symbol", "bar", F.col("trend").alias(f"t{i}")), ["symbol", "bar"])
    way, late = F.when(F.col("direction") == "long", 1).otherwise(-1), F.col("ts") >= F.lit(oos_start).cast("timestamp")
    counts = [F.count(F.lit(1)).alias("n"), F.count_if(late).alias("n_oos")]
    for i in range(len(grid)):
        counts += [F.count_if(F.col(f"t{i}") == way).alias(f"k{i}"), F.count_if((F.col(f"t{i}") == way) & late).alias(f"o{i}")]
    cells = [F.struct(F.lit(b).alias("lookback"), F.lit(r2).alias("min_r2"), F.col(f"k{i}").alias("kept"), F.col(f"o{i}").alias("kept_oos")) for i, (b, r2) in enumerate(grid)]
    told = rows.groupBy("direction").agg(*counts).select("direction", "n", "n_oos", F.explode(F.array(*cells)).alias("c"))
    share = half_up(F.lit(100.0) * F.col("c.kept") / F.col("n"), 1)
    return told.select("direction", "c.lookback", "c.min_r2", "c.kept", "n", share.alias("kept_pct"), "n_oos", "c.kept_oos", (F.col("c.kept_oos") >= floor).alias("oos_ok"))
