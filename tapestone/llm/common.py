"""Shared helpers: folders that all executors see, caches of a Python worker, joins with hot keys."""

from __future__ import annotations

import sys
from collections.abc import Callable
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.folders import saved, shared_folder  # noqa: F401

def per_worker(key: Any, make: Callable[[], Any]) -> Any:
    """A value that one Python worker makes once and keeps from task to task."""
    kept = sys.__dict__.setdefault("_tapestone_kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def byte_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in pc.cast(column, pa.binary()).to_pylist()]


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], size: str, n_rows: int, most: int = 1000, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right``, whose ``size`` says how many left rows each key has (they sum to ``n_rows`` at most).

    Keys with at least ``n_rows / most`` rows are ``most`` at most, so that side is broadcast with a proven bound;
    all other keys are joined by a shuffle in which no key is large.
    """
    limit = max(1000, n_rows // most)
    heavy = right.filter(F.col(size) >= limit)
    light = right.filter(F.col(size) < limit)
    # left rows of heavy keys don't enter the shuffle
    marked = left.join(F.broadcast(heavy.select(*keys).withColumn("_tp_heavy", F.lit(True))), keys, "left")
    cold = marked.filter(F.col("_tp_heavy").isNull()).drop("_tp_heavy").join(light, keys, how)
    hot = left.join(F.broadcast(heavy), keys, "inner")
    return cold.unionByName(hot)


def ascii_space_free(text: Column) -> Column:
    """``text`` without the characters 0x09-0x0D and 0x20."""
    for c in (" ", "\t", "\n", "\x0b", "\x0c", "\r"):
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def id_uniform(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) that the seed and the columns decide: the first 13 hexadecimal digits of an MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _nth_of_id(rows: DataFrame, tie: str, k: int, few: int) -> int:
    """The ``tie`` (an integer) in place ``k`` of ``rows`` by it rising; 0 if it is null there. Twelve bits are settled in a pass, so ids of any size stay apart."""
    place = F.col(tie).cast("long").bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order is then the order of the ids
    left, prefix, bits, above = rows.filter(F.col(tie).isNotNull()), 0, 0, 0
    while bits < 64:
        step = min(12, 64 - bits)
        bits += step
        part = F.shiftrightunsigned(place, 64 - bits) if bits < 64 else place
        found = left.groupBy(part.bitwiseAND((1 << step) - 1).alias("part")).count().collect()
        for row in sorted(found, key=lambda r: r["part"]):
            if above + row["count"] >= k:
                break
            above += row["count"]
        else:
            return 0
        prefix = prefix << step | row["part"]
        held = prefix - (1 << 64) if prefix >= 1 << 63 else prefix
        left = left.filter(part == F.lit(held))
        if row["count"] <= few and bits < 64:
            return sorted(r[0] for r in left.select(F.col(tie).cast("long")).collect())[k - above - 1]
    return (prefix ^ (1 << 63)) - (1 << 64) if prefix ^ (1 << 63) >= 1 << 63 else prefix ^ (1 << 63)


def kth_greatest(keys: DataFrame, key: str, tie: str, k: int, bins: int = 4096, few: int = 4096) -> tuple[float, int] | None:
    """The (key, tie) of the row in place ``k`` by key falling, then tie (an integer) rising, null last; None if there are fewer rows.

    Histograms of ``bins`` counts narrow the range until it holds ``few`` rows or one key; only those are fetched.
    """
    span = keys.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if span["n"] < k or k < 1:
        return None
    lo, hi, above, inside = span["lo"], span["hi"], 0, span["n"]
    while inside > few and hi > lo:
        width = (hi - lo) / bins
        in_range = keys.filter(F.col(key).between(lo, hi))
        histogram = in_range.groupBy(F.least(F.floor((F.col(key) - lo) / width), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()
        for row in sorted(histogram, key=lambda r: -r["bin"]):
            if above + row["n"] >= k:
                break
            above += row["n"]
        lo, hi, inside = row["lo"], row["hi"], row["n"]
    left = keys.filter(F.col(key).between(lo, hi))
    if inside <= few:
        rows = sorted(((-r[0], r[1] is None, r[1] or 0) for r in left.select(key, tie).collect()))
        return -rows[k - above - 1][0], rows[k - above - 1][2]
    return hi, _nth_of_id(left, tie, k - above, few)


def quoted(name: str) -> str:
    """A column's name as an identifier, whatever characters it has."""
    return f"`{name.replace('`', '``')}`"


def sheltered(docs: DataFrame, *used: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with all columns but the ``used`` ones under private names, and the names that they had: an operator can't clash with them."""
    held = {c: c if c in used else f"_tp_held_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(quoted(c)).alias(h) for c, h in held.items()]), {h: c for c, h in held.items()}
