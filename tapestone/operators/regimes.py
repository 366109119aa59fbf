"""Regimes: a Gaussian hidden Markov model fitted by EM over blocks of each series, its causal filter, and their use on events.

States have full covariance matrices. The fit starts at a mixture of Gaussians, itself fitted by EM, whose sums need no
order of the rows.

A block of bars is a product of K x K matrices in the log semiring. Blocks are multiplied by themselves, the products of
a series (a row for each block) give every block what comes in from both sides, and the statistics of a round are sums
over blocks. Only the parameters, a row for each series, go from round to round.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.folders import saved
from ..plans.layout import asof_backward

#: trans, means and vars hold (k, k), (k, d) and the covariances (k, d, d) row by row.
PARAMS = "symbol string, k long, start array<double>, trans array<double>, means array<double>, vars array<double>, shift array<double>, scale array<double>, n long, loglik double"
TINY = 1e-300


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def log_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of stacks of matrices (n, K, K) in the log semiring."""
    return log_sum(a[:, :, :, None] + b[:, None, :, :], 2)


def running_products(steps: np.ndarray) -> np.ndarray:
    """Products of the first 1, 2, .. matrices of a stack, in as many vectorised passes as its length has bits."""
    out, shift = steps.copy(), 1
    while shift < len(out):
        out[shift:] = log_product(out[:-shift], out[shift:])
        shift *= 2
    return out


def log_density(x: np.ndarray, means: np.ndarray, covariances: np.ndarray) -> np.ndarray:
    """(n, K): the log density of each row under each state's Gaussian, by the Cholesky factor of its covariance matrix."""
    roots = np.linalg.cholesky(covariances)
    away = np.linalg.solve(roots, (x[None] - means[:, None]).transpose(0, 2, 1))
    size = 2 * np.log(np.diagonal(roots, axis1=1, axis2=2)).sum(1)
    return -0.5 * ((away**2).sum(1) + size[:, None] + x.shape[1] * np.log(2 * np.pi)).T


class _Model:
    """One series' parameters, and the step matrices of some of its rows."""

    def __init__(self, row) -> None:
        self.k = int(row["k"])
        self.d = len(row["shift"])
        self.start, self.trans = np.log(np.array(row["start"]) + TINY), np.log(np.array(row["trans"]).reshape(self.k, self.k) + TINY)
        self.means, self.vars = np.array(row["means"], float).reshape(self.k, self.d), np.array(row["vars"], float).reshape(self.k, self.d, self.d)
        self.shift, self.scale = np.array(row["shift"], float), np.array(row["scale"], float)

    def rows(self, x: Sequence) -> np.ndarray:
        return (np.array([[np.nan if v is None else v for v in r] for r in x], float).reshape(-1, self.d) - self.shift) / self.scale

    def steps(self, x: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
        """A matrix for each row: transition and density. A row with a missing value changes nothing; the series' first row starts afresh."""
        valid = np.isfinite(x).all(1)
        density = np.where(valid[:, None], log_density(np.where(np.isfinite(x), x, 0.0), self.means, self.vars), 0.0)
        same = np.where(np.eye(self.k, dtype=bool), 0.0, -np.inf)
        out = np.where(valid[:, None, None], self.trans[None] + density[:, None, :], same[None])
        if first and valid.any():
            at = int(np.argmax(valid))
            out[at] = np.broadcast_to(self.start, (self.k, self.k)) + density[at][None, :]
        return out, valid


def _blocked(rows: DataFrame, names: Sequence[str], block: int) -> DataFrame:
    """Blocks of rows in order, with their place in the series; the series' first block with a whole row is marked."""
    x = F.array(*[F.col(n).cast("double") for n in names])
    own = rows.select("symbol", F.col("bar").cast("long").alias("bar"), x.alias("x"), F.floor(F.col("bar") / block).alias("blk"))
    whole = ~F.exists("x", lambda v: v.isNull() | F.isnan(v))
    first = own.groupBy("symbol").agg(F.min(F.when(whole, F.col("blk"))).alias("first_blk"))
    return own.join(first, "symbol")


def _products(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("bar")
    head = frame.iloc[0]
    model = _Model(head)
    steps, _ = model.steps(model.rows(frame["x"]), head["blk"] == head["first_blk"])
    return pd.DataFrame({"symbol": [head["symbol"]], "blk": [head["blk"]], "m": [running_products(steps)[-1].ravel().tolist()]})


def _carries(frame: pd.DataFrame) -> pd.DataFrame:
    """What comes into each block from before (normalised) and from after, and the series' log likelihood up to it."""
    frame = frame.sort_values("blk")
    k = int(len(frame["m"].iloc[0]) ** 0.5)
    stack = np.array(frame["m"].tolist()).reshape(-1, k, k)
    ahead = running_products(stack)
    uniform = np.full(k, -np.log(k))
    into = [uniform, *log_sum(uniform[None, :, None] + ahead[:-1], 1)]
    back = np.concatenate([running_products(stack[::-1].transpose(0, 2, 1))[::-1][1:], np.where(np.eye(k, dtype=bool), 0.0, -np.inf)[None]])
    after = log_sum(back.transpose(0, 2, 1), 2)
    total = float(log_sum(log_sum(uniform[None, :, None] + ahead[-1:], 1), 1)[0])
    return pd.DataFrame({"symbol": frame["symbol"], "blk": frame["blk"], "into": [list(map(float, v)) for v in into], "after": [list(map(float, v)) for v in after], "loglik": total})


def outer_sums(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each state the sum of its weight times a row's outer product with itself."""
    return np.concatenate([((x * w[:, None]).T @ x).ravel() for w in weights.T])


def _statistics(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("bar")
    head = frame.iloc[0]
    model = _Model(head)
    x = model.rows(frame["x"])
    steps, valid = model.steps(x, head["blk"] == head["first_blk"])
    into, after, total = np.array(head["into"]), np.array(head["after"]), head["loglik"]
    alpha = log_sum(into[None, :, None] + running_products(steps), 1)
    back = running_products(steps[::-1].transpose(0, 2, 1))[::-1].transpose(0, 2, 1)
    beta = np.concatenate([log_sum(back[1:] + after[None, None, :], 2), after[None]])
    gamma = np.exp(alpha + beta - total) * valid[:, None]
    before = np.concatenate([into[None], alpha[:-1]])
    xi = np.exp(before[:, :, None] + steps + beta[:, None, :] - total)
    moved = valid.copy()
    started = np.zeros(model.k)
    if head["blk"] == head["first_blk"] and valid.any():
        at = int(np.argmax(valid))
        moved[at] = False
        started = gamma[at]
    x = np.where(np.isfinite(x), x, 0.0)
    sums = {"start": started, "xi": xi[moved].sum(0).ravel(), "g": gamma.sum(0), "gx": (gamma.T @ x).ravel(), "gxx": outer_sums(gamma, x)}
    return pd.DataFrame({"symbol": [head["symbol"]], **{n: [list(map(float, v))] for n, v in sums.items()}, "loglik": [total]})


def _with(rows: DataFrame, params: DataFrame) -> DataFrame:
    return rows.join(params.drop("loglik", "n"), "symbol")


def _mixture_statistics(frame: pd.DataFrame) -> pd.DataFrame:
    """A block's sums where each row is drawn by itself: the states' weights, first and second moments."""
    head = frame.iloc[0]
    model = _Model(head)
    x = model.rows(frame["x"])
    x = x[np.isfinite(x).all(1)]
    joint = log_density(x, model.means, model.vars) + model.start
    own = log_sum(joint, 1)
    gamma = np.exp(joint - own[:, None])
    sums = np.concatenate([gamma.sum(0), (gamma.T @ x).ravel(), outer_sums(gamma, x), [own.sum()]])
    return pd.DataFrame({"symbol": [head["symbol"]], "v": [sums.tolist()]})


def mixture_expectation(blocks: DataFrame, params: DataFrame) -> DataFrame:
    """(symbol, v): a mixture round's sums, with the log likelihood at the end."""
    sums = _with(blocks, params).groupBy("symbol", "blk").applyInPandas(_mixture_statistics, "symbol string, v array<double>")
    long = sums.select("symbol", F.posexplode("v").alias("i", "v")).groupBy("symbol", "i").agg(F.sum("v").alias("v"))
    return long.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("v"))


def expectation(blocks: DataFrame, params: DataFrame) -> DataFrame:
    """A round's sums for each series: start, transitions, and the states' weights, first moments and outer products."""
    own = _with(blocks, params)
    maps = saved(own.groupBy("symbol", "blk").applyInPandas(_products, "symbol string, blk long, m array<double>"), "block-products")
    carries = maps.groupBy("symbol").applyInPandas(_carries, "symbol string, blk long, into array<double>, after array<double>, loglik double")
    sums = own.join(carries, ["symbol", "blk"]).groupBy("symbol", "blk").applyInPandas(_statistics, "symbol string, start array<double>, xi array<double>, g array<double>, gx array<double>, gxx array<double>, loglik double")
    names = ("start", "xi", "g", "gx", "gxx")
    long = sums.select("symbol", "loglik", F.posexplode(F.concat(*names)).alias("i", "v")).groupBy("symbol", "i").agg(F.sum("v").alias("v"), F.first("loglik").alias("loglik"))
    return long.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("v"), F.first("loglik").alias("loglik"))


def _gaussians(g: np.ndarray, gx: np.ndarray, gxx: np.ndarray, k: int, d: int, floor: float, full: bool) -> dict:
    """Means and covariances of the sums; ``floor`` is added to the variances."""
    g = g + TINY
    means = gx.reshape(k, d) / g[:, None]
    spread = gxx.reshape(k, d, d) / g[:, None, None] - means[:, :, None] * means[:, None, :]
    own = np.eye(d)
    spread = np.where(own > 0, np.maximum(spread, 0.0), spread if full else 0.0)
    return {"means": means.ravel(), "vars": (spread + floor * own).ravel()}


def _maximise(floor: float, full: bool):
    def run(row, k: int, d: int) -> dict:
        start, xi, g, gx, gxx = np.split(np.array(row), np.cumsum([k, k * k, k, k * d]))
        xi = xi.reshape(k, k) + 1e-9
        return {"start": (start + TINY) / (start + TINY).sum(), "trans": (xi / xi.sum(1, keepdims=True)).ravel(), **_gaussians(g, gx, gxx, k, d, floor, full)}

    return run


def initial_parameters(rows: DataFrame, names: Sequence[str], k: int, stay: float = 0.9) -> DataFrame:
    """PARAMS for each series: columns standardised over its whole rows, states at the quantiles of the first column."""
    whole = rows.dropna(subset=list(names))
    for n in names:
        whole = whole.filter(~F.isnan(n))
    cuts = F.array(*[F.lit((i + 0.5) / k) for i in range(k)])
    stats = whole.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(n) for n in names]).alias("shift"), F.array(*[F.when(F.stddev_pop(n) > 1e-12, F.stddev_pop(n)).otherwise(1.0) for n in names]).alias("scale"), F.percentile_approx(names[0], cuts, 10000).alias("q"),
    )
    zeros = [F.lit(0.0)] * (len(names) - 1)
    means = F.flatten(F.array(*[F.array((F.col("q")[i] - F.col("shift")[0]) / F.col("scale")[0], *zeros) for i in range(k)]))
    move = [F.lit(stay if i == j else (1 - stay) / max(k - 1, 1)) for i in range(k) for j in range(k)]
    return stats.select(
        "symbol", F.lit(k).cast("long").alias("k"), F.array(*[F.lit(1.0 / k)] * k).alias("start"), F.array(*move).alias("trans"), means.alias("means"), F.array(*[F.lit(float(i == j)) for _ in range(k) for i in range(len(names)) for j in range(len(names))]).alias("vars"),
        "shift", "scale", F.col("n").cast("long").alias("n"), F.lit(float("-inf")).alias("loglik"),
    )


def fit_mixture(blocks: DataFrame, params: DataFrame, d: int, rounds: int, tolerance: float, floor: float, full: bool) -> DataFrame:
    """``params`` with the start, means and covariances of a mixture of Gaussians: EM from ``params`` until no series' mean log likelihood moves by ``tolerance``."""
    now = params
    for _ in range(rounds):
        joined = saved(now.withColumnRenamed("loglik", "before").join(mixture_expectation(blocks, now), "symbol"), "mixture-sums")

        def better(frames):
            for frame in frames:
                out = []
                for row in frame.to_dict("records"):
                    k, v = int(row["k"]), np.array(row["v"])
                    g, gx, gxx, total = np.split(v, np.cumsum([k, k * d, k * d * d]))
                    made = _gaussians(g, gx, gxx, k, d, floor, full)
                    out.append({**row, "start": (g / g.sum()).tolist(), "means": made["means"].tolist(), "vars": made["vars"].tolist(), "loglik": float(total[0])})
                yield pd.DataFrame(out, columns=[c.split()[0] for c in PARAMS.split(", ")])

        now = saved(joined.mapInPandas(better, PARAMS), "mixture")
        moved = joined.select("symbol", "before", "n").join(now.select("symbol", "loglik"), "symbol").filter(F.abs(F.col("loglik") - F.col("before")) >= tolerance * F.col("n"))
        if not moved.limit(1).count():
            break
    return now.withColumn("loglik", F.lit(float("-inf")))


def fit_regimes(rows: DataFrame, names: Sequence[str], k: int = 3, rounds: int = 50, tolerance: float = 1e-4, least_rows: int = 50, block: int = 1024, floor: float = 1e-3, full: bool = True, mixture_rounds: int = 20) -> DataFrame:
    """PARAMS of each series of at least ``least_rows`` whole rows: EM until no series' log likelihood moves by ``tolerance``, or ``rounds`` rounds.

    States start at a mixture of Gaussians (``mixture_rounds`` at most, 0 for none). Covariances are full, or diagonal without
    ``full``. ``rows`` is (symbol, bar, names), a null or NaN being a missing row; shorter series have no parameters (see
    ``regime_states``).
    """
    blocks = saved(_blocked(rows, names, block), "regime-blocks")
    params = saved(initial_parameters(rows, names, k).filter(F.col("n") >= least_rows), "parameters")
    step, d = _maximise(floor, full), len(names)
    params = fit_mixture(blocks, params, d, mixture_rounds, 1e-6, floor, full)

    def better(frame: pd.DataFrame) -> pd.DataFrame:
        made = [step(v, k, d) for v in frame["v"]]
        for c in ("start", "trans", "means", "vars"):
            frame[c] = [m[c].tolist() for m in made]
        return frame[[c.split()[0] for c in PARAMS.split(", ")]]

    for _ in range(rounds):
        sums = expectation(blocks, params)
        joined = params.select("symbol", "k", "shift", "scale", "n", F.col("loglik").alias("before")).join(sums, "symbol")
        joined = saved(joined, "round-sums")
        moved = joined.filter(F.abs(F.col("loglik") - F.col("before")) >= tolerance).limit(1).count()
        params = saved(joined.drop("before").mapInPandas(lambda it: (better(f) for f in it), PARAMS), "parameters")
        if not moved:
            break
    return params


def ordered_by_drift(params: DataFrame, least_share: float = 0.0) -> DataFrame:
    """PARAMS with the states in rising order of their first mean; a series one of whose states moves to nothing else, is hardly ever entered (under ``least_share`` of moves) or has lost its spread raises."""
    def run(frames):
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                k, d = int(row["k"]), len(row["shift"])
                means, trans = np.array(row["means"]).reshape(k, d), np.array(row["trans"]).reshape(k, k)
                order = np.argsort(means[:, 0], kind="stable")
                entered = (trans - np.diag(np.diag(trans))).sum(0)
                spreads = np.array(row["vars"]).reshape(k, d, d)
                if not np.isfinite(means).all() or (k > 1 and entered.min() < least_share) or np.linalg.eigvalsh(spreads).min() <= 0:
                    raise ValueError(f"degenerate regimes of {row['symbol']}")
                row["start"] = np.array(row["start"])[order].tolist()
                row["trans"] = trans[np.ix_(order, order)].ravel().tolist()
                row["means"], row["vars"] = means[order].ravel().tolist(), spreads[order].ravel().tolist()
                out.append(row)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PARAMS.split(", ")])

    return params.mapInPandas(run, PARAMS)


def _filtered(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("bar")
    head = frame.iloc[0]
    model = _Model(head)
    steps, _ = model.steps(model.rows(frame["x"]), head["blk"] == head["first_blk"])
    alpha = log_sum(np.array(head["into"])[None, :, None] + running_products(steps), 1)
    probs = np.exp(alpha - log_sum(alpha, 1)[:, None])
    return pd.DataFrame({"symbol": frame["symbol"], "bar": frame["bar"], "probs": [list(map(float, p)) for p in probs]})


def regime_states(rows: DataFrame, names: Sequence[str], params: DataFrame, k: int = 3, least_bars: int = 50, lag: int = 0, block: int = 1024) -> DataFrame:
    """(symbol, bar, state, confidence, probs, stamp_bar): the state of each bar from rows up to it.

    A row with a missing value keeps the last posterior. A series without parameters or of under ``least_bars`` bars is in
    state 0 with a probability of one half. ``stamp_bar`` is ``lag`` bars before the bar, 0 at least.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    blocks = saved(_blocked(rows, names, block).withColumn("n_bars", n), "regime-rows")
    own = _with(blocks.filter(F.col("n_bars") >= least_bars), params)
    maps = saved(own.groupBy("symbol", "blk").applyInPandas(_products, "symbol string, blk long, m array<double>"), "block-products")
    carries = maps.groupBy("symbol").applyInPandas(_carries, "symbol string, blk long, into array<double>, after array<double>, loglik double").select("symbol", "blk", "into")
    found = own.join(carries, ["symbol", "blk"]).groupBy("symbol", "blk").applyInPandas(_filtered, "symbol string, bar long, probs array<double>")
    half = F.array(F.lit(0.5), *[F.lit(0.5 / (k - 1))] * (k - 1)) if k > 1 else F.array(F.lit(1.0))
    out = blocks.select("symbol", "bar").join(found, ["symbol", "bar"], "left").withColumn("probs", F.coalesce("probs", half))
    top = F.array_max("probs")
    return out.select("symbol", "bar", (F.array_position("probs", top) - 1).alias("state"), top.alias("confidence"), "probs", F.greatest(F.col("bar") - lag, F.lit(0)).alias("stamp_bar"))


def state_of_events(events: DataFrame, states: DataFrame, known: str = "known_bar", confirm: str = "confirm_bar") -> DataFrame:
    """``events`` with ``hmm_state`` and ``hmm_confidence`` (and ``hmm_probs``, if there): of the confirmation's bar where its stamp is no later than ``known``, else of the last stamp by then."""
    values = [c for c in ("state", "confidence", "probs") if c in states.columns]
    at = states.select("symbol", F.col("bar").alias(confirm), F.struct(*values).alias("_at"), F.col("stamp_bar").alias("_stamp"))
    exact = events.join(at, ["symbol", confirm], "left").withColumn("_at", F.when(F.col("_stamp") <= F.col(known), F.col("_at"))).drop("_stamp")
    last = states.select("symbol", F.col("stamp_bar").alias(known), F.struct(*values).alias("_last"))
    both = asof_backward(exact, last, known, ["_last"]).withColumn("_s", F.coalesce("_at", "_last"))
    return both.drop("_at", "_last").select(*events.columns, *[F.col(f"_s.{v}").alias(f"hmm_{v}") for v in values])


def regime_columns(events: DataFrame, names: Sequence[str]) -> DataFrame:
    """``hmm_prob_<name>`` for each state from ``hmm_probs``; null without a state."""
    return events.select("*", *[F.col("hmm_probs")[i].alias(f"hmm_prob_{n}") for i, n in enumerate(names)])


def state_shares(states: DataFrame, window: Column, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """(keys, window, state, n, share): how often each state occurs in each window."""
    n = states.groupBy(*keys, window.alias("window"), "state").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "window")))
