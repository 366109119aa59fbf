"""Best-first selection among spans that clash, without a task that holds an island of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folders import saved, shared_folder

Columns = dict[str, np.ndarray]


def best_first(rows: DataFrame, keys: Sequence[str], start: str, end: str, order: Sequence[Column], clash: Callable[[Columns, int, np.ndarray], np.ndarray], columns: Sequence[str] = (), block: int = 4096) -> DataFrame:
    """``rows`` with ``_kept``: in ``order`` (ascending) a row is kept if it clashes with none kept before it; ``order`` should tell rows apart.

    ``clash(cols, i, those)`` tells which of the places ``those`` clash with place ``i``, from the arrays ``start``, ``end``
    and ``columns``; only rows of one series whose spans share a bar may. In a round, each block of bars settles in order
    what lies inside it: a row that clashes with a kept one is dropped, one whose better clashing rows are all
    dropped is kept, and the rest waits, as do rows that reach over the block's edge. Every second round the blocks lie
    half a block on, so that the best row left is always settled within two rounds, and a chain of
    dependent rows takes as many rounds as the half blocks it runs through. A task holds the rows of one block,
    ``block`` or twice the longest span wide. Rows without a span clash with nothing.
    """
    held = saved(rows.withColumn("_id", F.monotonically_increasing_id()), "spans")
    ranks = [f"_o{i}" for i in range(len(order))]
    names = {start: "_a", end: "_z"}
    left = held.select(*keys, "_id", F.col(start).cast("long").alias("_a"), F.col(end).cast("long").alias("_z"), *[o.alias(r) for o, r in zip(order, ranks, strict=True)], *[c for c in columns if c not in (*keys, start, end)]).filter("_a <= _z")
    longest = left.agg(F.max(F.col("_z") - F.col("_a"))).first()[0] or 0
    width, fates = max(block, 2 * (longest + 1)), shared_folder(rows.sparkSession, "fates")

    def settling(shift: int) -> Callable[[tuple, pa.Table], pa.Table]:
        def settle(key: tuple, table: pa.Table) -> pa.Table:
            table = table.sort_by([(r, "ascending") for r in ranks])
            cols = {c: table[names.get(c, c)].to_numpy(zero_copy_only=False) for c in (start, end, *columns)}
            begin = key[-1].as_py() * width - shift
            inside = (cols[start] >= begin) & (cols[end] < begin + width)
            n = len(table)
            kept, waiting, lost = np.empty(n, np.int64), np.empty(n, np.int64), []
            k = w = 0
            for i in range(n):
                if clash(cols, i, kept[:k]).any():
                    lost.append(i)
                elif inside[i] and not clash(cols, i, waiting[:w]).any():
                    kept[k], k = i, k + 1
                else:
                    waiting[w], w = i, w + 1
            at = np.r_[kept[:k], np.array(lost, np.int64)]
            return pa.table({"_id": table["_id"].take(pa.array(at)).combine_chunks(), "_kept": pa.array(np.arange(len(at)) < k)})

        return settle

    left, turn = saved(left, "spans-left"), 0
    while left.limit(1).count():
        shift = (turn % 2) * (width // 2)
        blocks = F.sequence(F.floor((F.col("_a") + shift) / width), F.floor((F.col("_z") + shift) / width))
        done = saved(left.withColumn("_blk", F.explode(blocks)).groupBy(*keys, "_blk").applyInArrow(settling(shift), "_id long, _kept boolean").distinct(), "settled")
        done.write.mode("append").parquet(fates)
        left, turn = saved(left.join(done, "_id", "left_anti"), "spans-left"), turn + 1
    told = rows.sparkSession.read.schema("_id long, _kept boolean").parquet(fates) if turn else held.select("_id", F.lit(True).alias("_kept")).limit(0)
    return held.join(told, "_id", "left").withColumn("_kept", F.coalesce("_kept", F.lit(True))).drop("_id")
