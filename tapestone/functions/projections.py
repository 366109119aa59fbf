"""Columns of one row: vocabularies, scores, lots, buckets, transitions and the normal law's lower tail."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words for the two directions, score buckets, codes of outcomes, the order of a model's states.
LONG_WORDS = ("bullish", "long", "buy", "low")
SHORT_WORDS = ("bearish", "short", "sell", "high")
SCORE_BUCKETS = ((0, 39), (40, 49), (50, 59), (60, 69), (70, 79), (80, 100))
OUTCOME_CODES = {"tp": 1.0, "sl": 0.0, "time": -1.0}
STATES = ("trained", "validated", "shadow", "live", "degraded", "retired")


def half_up(value: Column, places: int) -> Column:
    """A double rounded by its own arithmetic, as SQL engines do: scaled, rounded half away from zero, scaled back. Spark's ``round`` takes the number's decimal text instead and differs where that or the product is a tie."""
    return F.round(value * 10**places) / 10**places


def normal_direction(word: Column) -> Column:
    """``long`` or ``short`` for any known word, in any case; null for others."""
    low = F.lower(F.trim(word))
    return F.when(low.isin(*LONG_WORDS), "long").when(low.isin(*SHORT_WORDS), "short")


def score_bucket(score: Column) -> Column:
    """The bucket's name; scores between two buckets, outside all of them or null are ``unknown``."""
    out = F.lit("unknown")
    for low, high in SCORE_BUCKETS:
        out = F.when(score.between(low, high), f"{low}-{high}").otherwise(out)
    return out


def outcome_code(reason: Column) -> Column:
    """1, 0 or -1; null for an ambiguous or unknown outcome."""
    out = F.lit(None).cast("double")
    for name, code in OUTCOME_CODES.items():
        out = F.when(reason == name, code).otherwise(out)
    return out


def unit_score(score: Column, scale: float | None = None) -> Column:
    """A rule score in 0..1; without a scale, magnitudes over 1 are taken as 0..100. Null and NaN give 0."""
    known = F.when(score.isNull() | F.isnan(score), 0.0).otherwise(score)
    divisor = F.lit(scale) if scale else F.when(F.abs(known) > 1, 100.0).otherwise(1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), known / divisor))


def combined_score(score: Column, probability: Column, scale: float | None = None) -> Column:
    return half_up((unit_score(score, scale) + probability) / 2, 4)


def first_finite(*columns: Column) -> Column:
    """The first column that is neither null, NaN nor infinite."""
    inf = F.lit(float("inf"))
    return F.coalesce(*[F.when(~F.isnan(c) & (F.abs(c) < inf), c) for c in columns])


def lot_size(balance: Column, risk_percent: float, stop_distance: Column, contract: float, step: float, least: float, most: float) -> Column:
    """Lots that lose ``risk_percent`` of the balance at the stop, rounded down to ``step`` and held in ``least``..``most``."""
    raw = balance * (risk_percent / 100) / (stop_distance * contract)
    lots = F.round(F.least(F.greatest(F.floor(raw / step) * step, F.lit(least)), F.lit(most)), 10)
    return F.when((balance > 0) & (stop_distance > 0), lots)


def normal_tail(z: Column) -> Column:
    """The standard normal law's mass below ``z``, to 1e-7: a rational approximation, as SQL has no error function."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    # Coefficients of the published approximation (Abramowitz and Stegun, 26.2.17).
    p = F.lit(0.0)
    for c in (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530):
        p = (p + c) * t
    upper = F.exp(-z * z / 2) * 0.3989422804014327 * p
    return F.when(z > 0, 1 - upper).otherwise(upper)


def win_rate_drop(before: Column, after: Column, n: int = 30) -> Column:
    """How likely ``n`` trades win at most as often as ``after`` if they win as before; null for rates outside their range."""
    ok = (before > 0) & (before < 1) & after.between(0, 1)
    return F.when(ok, normal_tail((after - before) * n / F.sqrt(n * before * (1 - before))))


def valid_step(state: Column, target: Column, retrain: bool = False, order: Sequence[str] = STATES) -> Column:
    """Whether a model may go from a state to another: to itself or the next one; ``retrain``: back to validated."""
    if retrain:
        return (state == target) | (state.isin("shadow", "live", "degraded") & (target == "validated"))
    held = F.array(*[F.lit(s) for s in order])
    a, b = F.array_position(held, state), F.array_position(held, target)
    return (state == target) | ((a > 0) & (b == a + 1))


def shadow_reasons(n_events: Column, live_pf: Column, past_pf: Column, past_std: Column, drifted: Column, n_violations: Column, min_events: int) -> Column:
    """Why a shadow model isn't promoted, joined by ``; ``; empty if it is. A profit factor that is null or infinite proves nothing."""
    inf = F.lit(float("inf"))
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < inf), F.lit(False))
    std = F.when(finite(past_std), past_std).otherwise(0.0)
    pf_ok = finite(live_pf) & finite(past_pf) & F.coalesce(live_pf >= past_pf - std, F.lit(False))
    tests = ((n_events < min_events, "few events"), (~pf_ok, "profit factor"), (F.coalesce(drifted, F.lit(False)), "drift"), (n_violations > 0, "causality"))
    return F.array_join(F.array_compact(F.array(*[F.when(test, name) for test, name in tests])), "; ")


def demotion_reasons(state: Column, n_trades: Column, pf_low: Column, drifted: Column, drop_p: Column, min_trades: int, p_value: float) -> Column:
    """Why a model is degraded: a low profit factor ends the search; else drift and a drop of the win rate."""
    live = state == "live"
    low_pf = F.coalesce(live & (n_trades >= min_trades) & (pf_low < 1), F.lit(False))
    drift = F.when(state.isin("live", "shadow") & drifted, "drift")
    drop = F.when(live & (drop_p < p_value), "win rate")
    return F.when(low_pf, "profit factor").otherwise(F.array_join(F.array_compact(F.array(drift, drop)), "; "))
