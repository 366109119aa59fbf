"""Two-pass external shuffle into shards of equal row counts.

Pass 1 scatters the records by a seeded hash, uniformly, into buckets that fit in a task's memory. Pass 2 shuffles each
bucket by Fisher-Yates and writes it. The written buckets, one after the other, are one random order of the corpus;
shards are equal cuts of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved

FIXED_WIDTH = ("bigint", "int", "smallint", "tinyint", "double", "float", "boolean", "date", "timestamp", "timestamp_ntz")
ADDED = ("bucket", "bucket_slot", "shard", "slot")


def _fisher_yates(seed: int, order: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        del held
        bucket = TaskContext.get().partitionId()
        # rows arrive in any order; sorted, a repeated attempt gives the same permutation
        table = table.take(pa.compute.sort_indices(table, sort_keys=[(c, "ascending") for c in order]))
        moves = np.random.default_rng([seed, bucket])
        at = np.arange(table.num_rows)
        moves.shuffle(at)  # numpy's shuffle is Fisher-Yates
        table = table.take(pa.array(at))
        n = table.num_rows
        table = table.append_column("bucket", pa.array(np.full(n, bucket, np.int32)))
        table = table.append_column("bucket_slot", pa.array(np.arange(n, dtype=np.int64)))
        yield from table.to_batches(max_chunksize=4096)

    return run


def _sort_columns(docs: DataFrame, *first: str) -> list[str]:
    """The columns that Arrow can order, ``first`` ones ahead: rows alike in all of these may change places."""
    ordered = [c for c, t in docs.dtypes if t in (*FIXED_WIDTH, "string", "binary")]
    return [*(c for c in first if c in ordered), *(c for c in ordered if c not in first)]


def shuffle_into_shards(docs: DataFrame, n_shards: int = 8, seed: int = 17, bucket_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``shard`` (0 to ``n_shards`` - 1) and ``slot``, gapless from 0 in each shard.

    Shard sizes differ by one row at most. ``bucket`` and ``bucket_slot`` tell the place in pass 2's files. The hash takes
    the row's place in its input partition too, so rows repeated without bound still spread; ``docs`` must therefore be a
    scan, a table or a checkpoint, whose rows have fixed places, so that a task repeated after a lost executor deals
    alike. Null ids and null texts are dealt like others; existing columns of the added names are replaced; an empty
    table gives an empty result.
    """
    docs = docs.drop(*ADDED)
    spark = docs.sparkSession
    wide = [c for c, t in docs.dtypes if t not in FIXED_WIDTH]
    # text counts as it is, any other column that has no fixed width as JSON
    sized = [F.octet_length(F.col(f"`{c}`").cast("string") if t in ("string", "binary") else F.to_json(F.struct(f"`{c}`"))) for c, t in docs.dtypes if c in wide]
    size = sum((F.coalesce(x, F.lit(0)) for x in sized), F.lit(16 * len(docs.columns)))
    n_bytes = docs.agg(F.sum(size).alias("b")).first()["b"] or 0
    n_buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // bucket_bytes))
    dealt = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.monotonically_increasing_id()), F.lit(n_buckets)).cast("int")
    schema = T.StructType([*docs.schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("bucket_slot", T.LongType())])
    # the bucket is the partition, so that no bucket meets another
    buckets = saved(docs.repartitionById(n_buckets, dealt).mapInArrow(_fisher_yates(seed, _sort_columns(docs, id_col, text_col)), schema), "shards")

    sizes = buckets.groupBy("bucket").count()
    n_rows = sizes.agg(F.sum("count")).first()[0] or 0
    base, more = divmod(n_rows, n_shards)
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each bucket: n_buckets rows, which the corpus size over bucket_bytes bounds
    starts = sizes.select("bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_tp_start"))
    place = F.col("_tp_start") + F.col("bucket_slot")
    edge = more * (base + 1)
    shard = F.when(place < edge, F.floor(place / (base + 1))).otherwise(more + F.floor((place - edge) / max(base, 1))).cast("int")
    first = F.when(F.col("shard") < more, F.col("shard") * F.lit(base + 1)).otherwise(edge + (F.col("shard") - more) * F.lit(base))
    return (
        buckets.join(F.broadcast(starts), "bucket")
        .withColumn("_tp_place", place).withColumn("shard", shard)
        .withColumn("slot", (F.col("_tp_place") - first).cast("long"))
        .drop("_tp_place", "_tp_start")
    )


def write_shards(sharded: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """One folder for each shard, whose files in name order hold its rows in slot order."""
    part = F.floor(F.col("slot") / rows_per_file)
    (
        sharded.withColumn("part", part).repartition("shard", "part").sortWithinPartitions("shard", "part", "slot")
        .write.partitionBy("shard", "part").parquet(path)
    )
