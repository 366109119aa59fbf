"""Exact duplicates by an extendible-hash index on shared files.

Keys are 64-bit hashes of the normalised text. The directory starts as one bucket; a bucket with more distinct keys than
its capacity splits by further leading bits of the key, and the directory doubles to the depth of its deepest bucket.
Owner tasks hold contiguous ranges of buckets, that is, of keys: there the bytes of texts with one key are compared, and
each different text is a link of the key's chain. The index is written bucket by bucket, and rows find their entry in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_space_free, join_hot, saved

#: 2^17 cells: a proven bound of the directory that tasks receive.
MAX_DEPTH = 17


def _prefix(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, int]:
    """The directory over distinct ``key`` values: (cell, bucket, local_depth) rows, and the global depth.

    Only overfull buckets split, and only their keys are counted again, by as many bits as the fullest surely needs. A
    bucket at ``max_depth`` takes any number of keys. ``bucket`` is the first cell that the bucket has in the directory.
    """
    depth, full, parts = 0, keys, []
    counts = keys.agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.lit(0).cast("long").alias("prefix"), "n")
    while True:
        counts = saved(counts, "bucket-counts")
        fullest = counts.agg(F.max("n")).first()[0] or 0
        last = fullest <= capacity or depth >= max_depth
        settled = counts if last else counts.filter(F.col("n") <= capacity)
        parts.append(settled.select("prefix", F.lit(depth).alias("local_depth")))
        if last:
            break
        overfull = counts.filter(F.col("n") > capacity).select("prefix")  # 2^max_depth rows at most
        full = full.withColumn("prefix", _prefix(F.col("key"), depth)).join(F.broadcast(overfull), "prefix", "left_semi").select("key")
        depth = min(max_depth, depth + max(1, (fullest // capacity).bit_length() - 1))
        counts = full.groupBy(_prefix(F.col("key"), depth).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    buckets = parts[0]
    for part in parts[1:]:
        buckets = buckets.unionByName(part)
    first = F.expr(f"shiftleft(prefix, {depth} - local_depth)")
    cells = F.sequence(F.lit(0).cast("long"), F.expr(f"shiftleft(1L, {depth} - local_depth) - 1"))
    spread = buckets.select(first.alias("bucket"), "local_depth", F.explode(cells).alias("at"))
    return saved(spread.select((F.col("bucket") + F.col("at")).alias("cell"), "bucket", "local_depth"), "directory"), depth


def find_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 20_000, hash_key: Column | None = None) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256, bucket, chain.

    Texts are equal when identical after their ASCII white space goes; null counts as empty, and all empty texts are
    equal. Of equal texts the row with the most code points stays, then the smallest id. Rows with the id that stays
    are all kept if an id is repeated; a null id loses against any other. ``chain`` is the text's place among the different
    texts of one key (1 but for colliding hashes). The key is ``hash_key``, an expression over the
    normalised text ``norm``, by default its 64-bit xxHash; a weak one gives the same groups by longer chains. Two texts
    of one key that differ in bytes but share their SHA-256 raise. An empty table gives an empty result; other columns
    are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(text).alias("points"), ascii_space_free(text).alias("norm"))
    read = read.withColumn("key", F.xxhash64("norm") if hash_key is None else hash_key.cast("long"))
    rows = saved(read.select("doc_id", "key", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.octet_length("norm").alias("bytes")), "exact-rows")
    counted = saved(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "exact-keys")
    n_rows, n_bytes, n_keys = *rows.agg(F.count(F.lit(1)), F.sum("bytes")).first(), counted.count()
    # at most a quarter of the directory's cells on average, so that its depth stays under the bound
    cells, depth = directory(counted.select("key"), max(capacity, -(-n_keys * 4 >> MAX_DEPTH)))

    # an owner has all buckets that begin in its equal part of the directory
    n_owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(n_bytes or 0) // (64 << 20)))
    owner = F.expr(f"cast(bucket * {n_owners} div {1 << depth} as int)")
    located = read.withColumn("cell", _prefix(F.col("key"), depth)).join(F.broadcast(cells.select("cell", "bucket")), "cell")
    # keys with a thousandth of all rows, 1,000 at most: their copies meet before the shuffle, a row from each task
    limit = max(1000, n_rows // 1000)
    hot = F.broadcast(counted.filter(F.col("n") >= limit).select("key", F.lit(True).alias("hot")))
    best = F.struct("points", (-F.col("doc_id")).alias("minus"))
    cold = located.join(hot, "key", "left").filter("hot is null").select("bucket", "key", "norm", F.lit(1).cast("long").alias("n"), best.alias("best"))
    met = located.join(hot, "key").groupBy("bucket", "key", "norm").agg(F.count(F.lit(1)).alias("n"), F.max(best).alias("best"))
    owned = cold.unionByName(met).withColumn("owner", owner).repartitionById(n_owners, F.col("owner"))
    compared = owned.groupBy("owner", "bucket", "key", "norm").agg(F.sum("n").alias("group_size"), F.max("best").alias("best"))
    entries = compared.select("owner", "bucket", "key", "norm", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "group_size", (-F.col("best.minus")).alias("keep_id"))
    of_key = Window.partitionBy("owner", "bucket", "key").orderBy("text_sha256", "norm")
    entries = entries.withColumn("chain", F.row_number().over(of_key)).withColumn("before", F.lag("text_sha256").over(of_key) == F.col("text_sha256"))
    checked = F.when(F.col("before"), F.raise_error(F.lit("two texts share key and SHA-256"))).otherwise(F.col("text_sha256"))
    index = saved(entries.select("key", checked.alias("text_sha256"), "chain", "group_size", "keep_id", "bucket"), "exact-index", by="bucket")
    placed = join_hot(rows.select("doc_id", "key", "text_sha256"), index, ["key", "text_sha256"], "group_size", n_rows)
    return placed.select(F.col("doc_id").alias(id_col), "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256", "bucket", "chain")
