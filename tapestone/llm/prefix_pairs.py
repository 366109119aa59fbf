"""Pairs of sets that may be alike, without holding all members of a group against each other.

Each set's shingles are put in one order, those that few sets have first. Of two sets that meet in ``percent`` of their
union, the first common shingle stands so early in both that enough can follow it; only such shingles are joined on.
Texts of one template share frequent shingles, which stand late, and so they meet only if they are alike beyond it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

SLOTS, CHUNK, SPLIT = 1 << 19, 1 << 16, 2000
Sets = Callable[[pa.RecordBatch], Iterator[np.ndarray]]


def _slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(20)) % np.uint64(SLOTS)


def _occurrences(sets: Sets):
    """How many sets have a shingle in each slot, told once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for shingles in sets(batch):
                np.add.at(counts, _slots(shingles), 1)
        at = np.flatnonzero(counts)
        for i in range(0, len(at), CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + CHUNK]), pa.array(counts[at[i : i + CHUNK]])], ["slot", "n"])

    return run


def prefix_lengths(n: int, percent: int) -> tuple[int, int]:
    """How many of ``n`` ordered shingles can be the first common one with a set at least as large, and with any set."""
    return n + (-2 * percent * n) // (100 + percent) + 1, n + (-percent * n) // 100 + 1


def _postings(sets: Sets, percent: int, counts: np.ndarray):
    """The first shingles of each set by rising count, except those in no other set: ``left`` is how many of the set stand from there on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, components = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for rep, component, shingles in zip(ids, components, sets(batch), strict=True):
                often = counts[_slots(shingles)]
                few, many = prefix_lengths(len(shingles), percent)
                first = np.lexsort((shingles, often))[:many]
                places = np.flatnonzero(often[first] > 1)
                for i in range(0, len(places), CHUNK):
                    at = places[i : i + CHUNK]
                    same = lambda v: pa.array(np.full(len(at), v, np.int64))
                    columns = [pa.array(shingles[first[at]].view(np.int64)), same(rep), same(component), same(len(shingles)), pa.array(len(shingles) - at), pa.array(at < few)]
                    yield pa.RecordBatch.from_arrays(columns, ["token", "rep", "component", "n", "left", "early"])

    return run


def prefix_pairs(texts: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """Distinct pairs a < b of different components of ``texts`` (rep, component, text) whose sets can meet in ``percent`` of their union.

    ``sets`` gives the sorted shingles of each row. None of the pairs that do is left out, as any one order of shingles
    serves; counts in ``SLOTS`` slots (their only size, whatever the input's) make it a good one. A shingle's largest
    component isn't held against itself, and a shingle that many sets begin with is split over tasks.
    """
    counted = texts.mapInArrow(_occurrences(sets), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS, np.int32)
    counts[counted["slot"].to_numpy()] = np.minimum(counted["n"].to_numpy(), np.iinfo(np.int32).max)
    postings = saved(texts.mapInArrow(_postings(sets, percent, counts), "token long, rep long, component long, n long, left long, early boolean"), "postings")

    several = postings.groupBy("token").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.max("early").alias("begun")).filter("begun and least <> most")
    shared = saved(postings.join(several.select("token"), "token", "left_semi"), "shared-postings")
    sizes = shared.groupBy("token", "component").agg(F.count(F.lit(1)).alias("c"))
    majors = sizes.groupBy("token").agg(F.max(F.struct("c", "component")).alias("most"), F.sum("c").alias("c"))
    majors = majors.select("token", F.col("most.component").alias("major"), F.ceil(F.col("c") / SPLIT).cast("int").alias("splits"))
    placed = saved(shared.join(majors, "token").withColumn("in_major", F.col("component") == F.col("major")), "placed-postings")

    # the smaller set begins with the token early; members of the major component look for others only
    wanted = F.when(F.col("in_major"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    begun = placed.filter("early").withColumn("in_major", F.explode(wanted)).withColumn("split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)))
    side = lambda d, s: d.select("token", "in_major", "split", *[F.col(c).alias(f"{c}_{s}") for c in ("rep", "component", "n", "left")])
    met = placed.withColumn("split", F.pmod(F.xxhash64("rep"), F.col("splits")).cast("int"))
    both = side(begun, "x").join(side(met, "y"), ["token", "in_major", "split"])
    ordered = "(n_x < n_y or (n_x = n_y and rep_x < rep_y)) and component_x <> component_y"
    enough = f"{100 + percent} * least(left_x, left_y) >= {percent} * (n_x + n_y)"
    return both.filter(f"{ordered} and {enough}").select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b")).distinct()
