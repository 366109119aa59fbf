"""Hard negatives: rows of another label whose score stands in a window under that of a positive.

Rows are put along a Hilbert curve through the dimensions that vary most and cut into blocks, a row of a Parquet table
each, with the least and greatest value of every dimension (the zone map). Anchors that lie near each other on the curve
are a batch. A batch first reads the blocks around it, which tells for each window of an anchor how good the last place
already is. Interval arithmetic over the zone maps then bounds the scores in every other block, and only the blocks that
some window can still take a row from are read. Scores are integers and exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Dimensions of the curve and bits of each, blocks around a batch, anchors of a batch, zone maps that are tested at once.
CURVE_DIMS, CURVE_BITS, NEAR, BATCH, PAGE = 8, 7, 8, 512, 256
LONG = np.iinfo(np.int64)
BLOCK = "block long, kind string, n int, n_anchors int, labels array<long>, own_labels binary, ids binary, anchors binary, vectors binary, low array<long>, high array<long>"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of the rows of ``cells`` (n, dims; each below 2^bits) along the Hilbert curve, by Gray codes of rotated axes."""
    x = [c.copy() for c in cells.T.astype(np.int64)]
    for bit in range(bits - 1, 0, -1):
        at, below = 1 << bit, (1 << bit) - 1
        for axis in x:
            up = (axis & at) != 0
            swap = np.where(up, 0, (x[0] ^ axis) & below)
            x[0] ^= np.where(up, below, swap)
            if axis is not x[0]:
                axis ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> bit) & 1, (1 << bit) - 1, 0)
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            key = key << 1 | ((axis ^ turn) >> bit & 1)
    return key


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of a and b; beyond 64 bits they stop at the limits."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    most = max(1, a.shape[1]) * max(abs(int(a.min(initial=0))), int(a.max(initial=0))) * max(abs(int(b.min(initial=0))), int(b.max(initial=0)))
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, LONG.min, LONG.max).astype(np.int64)


def intervals(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds (least, greatest) of the inner products of the rows of ``a`` with any vector between the rows of ``low`` and ``high``, with room for rounding."""
    up, down = np.maximum(a, 0).astype(np.float64), np.minimum(a, 0).astype(np.float64)
    low, high = low.astype(np.float64), high.astype(np.float64)
    room = 1e-9 * (np.abs(a.astype(np.float64)) @ np.maximum(np.abs(low), np.abs(high)).T)
    return up @ low.T + down @ high.T - room, up @ high.T + down @ low.T + room


def _matrix(raw: bytes, kind: str, n: int) -> np.ndarray:
    flat = np.frombuffer(raw, kind)
    return flat.reshape(n, len(flat) // n).astype(np.int64)


def _key(dims: list[int], mean: np.ndarray, spread: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2).to_pylist()
            picked = np.array([[v[d] if d < len(v) else 0 for d in dims] for v in vectors], np.float64).reshape(len(vectors), len(dims))
            cells = np.clip(((picked - mean) / spread + 2) * (1 << CURVE_BITS) / 4, 0, (1 << CURVE_BITS) - 1).astype(np.int64)
            keys = hilbert_keys(cells, CURVE_BITS) if dims else np.zeros(len(vectors), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys)], [*batch.schema.names, "key"])

    return run


def _cut(dim: int, rows: int):
    def packed(block: int, held: list[tuple]) -> pa.RecordBatch:
        held.sort(key=lambda r: r[0])  # places of equal scores are then places of the smaller ids
        vectors = np.zeros((len(held), dim), np.int64)
        for i, r in enumerate(held):
            vectors[i, : len(r[2])] = r[2]
        low, high = vectors.min(0), vectors.max(0)
        kind = next(k for k in ("<i2", "<i4", "<i8") if low.min(initial=0) >= np.iinfo(k).min and high.max(initial=0) <= np.iinfo(k).max)
        labels, ids, anchors = (np.array([r[i] for r in held], t) for i, t in ((1, "<i8"), (0, "<i8"), (3, "u1")))
        values = [block, kind, len(held), int(anchors.sum()), np.unique(labels), labels.tobytes(), ids.tobytes(), anchors.tobytes(), vectors.astype(kind).tobytes(), low, high]
        longs = pa.list_(pa.int64())
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), longs, pa.binary(), pa.binary(), pa.binary(), pa.binary(), longs, longs]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in BLOCK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 24, []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                held.append(row)
                if len(held) == rows:
                    yield packed(number, held)
                    number, held = number + 1, []
        if held:
            yield packed(number, held)

    return run


def hilbert_blocks(vectors: DataFrame, anchor: Column, scale: int, block_rows: int) -> DataFrame:
    """The blocks of ``vectors`` (vec_id, label, embedding), written."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    used = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(whole)
    limit = float(1 << 62)
    scaled = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(limit)), F.lit(-limit))))
    used = used.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), scaled.alias("q"), F.coalesce(anchor, F.lit(False)).cast("int").alias("anchor"))
    # a row for each dimension reaches the driver
    stats = sorted(used.select(F.posexplode("q").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("spread")).collect(), key=lambda r: (-r["spread"], r["at"]))
    told = [r for r in stats[:CURVE_DIMS] if r["spread"] > 0]
    keyed = used.mapInArrow(_key([r["at"] for r in told], np.array([r["mean"] for r in told]), np.array([r["spread"] for r in told])), "vec_id long, label long, q array<long>, anchor int, key long")
    # the id parts rows of one place on the curve, such as copies
    ordered = keyed.repartitionByRange("key", "vec_id").sortWithinPartitions("key", "vec_id")
    return saved(ordered.mapInArrow(_cut(len(stats), block_rows), BLOCK), "blocks")


def _anchors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            at = np.flatnonzero(np.frombuffer(row["anchors"], "u1"))
            q = _matrix(row["vectors"], row["kind"], row["n"])[at].astype("<i8")
            labels, ids = (np.frombuffer(row[c], "<i8")[at] for c in ("own_labels", "ids"))
            columns = [pa.array(x) for x in (np.full(len(at), row["block"]), at.astype(np.int32), ids, labels)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([v.tobytes() for v in q], pa.binary())], ["block", "slot", "anchor_id", "label", "q"])


class Batch:
    """Anchors of a packed row: their keys, labels, vectors and windows."""

    def __init__(self, anchors: list[dict]) -> None:
        self.anchors = sorted(anchors, key=lambda a: (a["block"], a["slot"]))
        self.labels = np.array([a["label"] for a in self.anchors], np.int64)
        self.q = _matrix(b"".join(a["q"] for a in self.anchors), "<i8", len(anchors))


def _score(same: bool, k: int):
    """The first ``k`` rows of one block in each window of one batch."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        row = table.to_pylist()[0]
        batch, vectors = Batch(row["anchors"]), _matrix(row["vectors"], row["kind"], row["n"])
        labels, ids = np.frombuffer(row["own_labels"], "<i8"), np.frombuffer(row["ids"], "<i8")
        scores, out = products(batch.q, vectors), []
        columns = {label: np.flatnonzero((labels == label) == same) for label in set(batch.labels.tolist())}
        for i, a in enumerate(batch.anchors):
            at = columns[a["label"]]
            if same and a["block"] == row["block"]:
                at = at[at != a["slot"]]  # not the anchor itself
            order = at[np.argsort(-scores[i, at], kind="stable")]
            falling = -scores[i, order]
            for w in a["windows"]:
                first, last = np.searchsorted(falling, -w["high"], "left"), np.searchsorted(falling, -w["low"], "right")
                for j in order[first : min(last, first + k)]:
                    out.append((a["block"], a["slot"], w["w"], int(scores[i, j]), int(ids[j])))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], ["block", "slot", "w", "score", "id"])

    return run


FOUND = "block long, slot int, w int, score long, id long"


def _needed(same: bool):
    """The blocks of one page of zone maps that a window of one batch can take a row from."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        row = table.to_pylist()[0]
        batch, zones = Batch(row["anchors"]), [z for z in row["zones"] if z["region"] != row["region"]]
        low, high = (np.array([z[c] for z in zones], np.int64).reshape(len(zones), batch.q.shape[1]) for c in ("low", "high"))
        least, greatest = intervals(batch.q, low, high)
        # a block of one label has no row of another
        fits = np.array([[(label in z["labels"]) if same else (z["labels"] != [label]) for z in zones] for label in batch.labels.tolist()], bool).reshape(len(batch.anchors), len(zones))
        wanted = np.zeros(len(zones), bool)
        for i, a in enumerate(batch.anchors):
            for w in a["windows"]:
                wanted |= fits[i] & (greatest[i] >= w["low"]) & (least[i] <= w["high"])
        return pa.table({"batch": pa.array([row["batch"]] * int(wanted.sum()), pa.int64()), "block": pa.array([z["block"] for z, x in zip(zones, wanted, strict=True) if x], pa.int64())})

    return run


def needed_blocks(batches: DataFrame, blocks: DataFrame, same: bool) -> DataFrame:
    """(batch, block) of the blocks outside a batch's own region that interval arithmetic can't rule out."""
    pages = max(1, -(-blocks.count() // PAGE))
    zone = F.struct("block", F.floor(F.col("block") / NEAR).alias("region"), "labels", "low", "high")
    paged = blocks.groupBy(F.pmod(F.xxhash64("block"), F.lit(pages)).alias("page")).agg(F.collect_list(zone).alias("zones"))  # about PAGE zone maps
    tested = batches.withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pages - 1).cast("long")))).join(paged, "page")
    return tested.groupBy("batch", "page").applyInArrow(_needed(same), "batch long, block long")


def top_in_windows(anchors: DataFrame, blocks: DataFrame, k: int, same: bool) -> DataFrame:
    """(block, slot, w, score, id, place) of the first ``k`` rows of the anchor's label (``same``) or of others in each of its windows, by score falling, then id.

    ``anchors``: batch, region, block, slot, anchor_id, label, q, windows (w, low, high; inclusive).
    """

    def packed(rows: DataFrame) -> DataFrame:
        return saved(rows.groupBy("batch", "region").agg(F.collect_list(F.struct("block", "slot", "label", "q", "windows")).alias("anchors")), "batches")

    def scored(pairs: DataFrame, batches: DataFrame) -> DataFrame:
        read = blocks.select("block", "kind", "n", "own_labels", "ids", "vectors")
        return saved(pairs.join(read, "block").join(batches.select("batch", "anchors"), "batch").groupBy("batch", "block").applyInArrow(_score(same, k), FOUND), "in-windows")

    order = Window.partitionBy("block", "slot", "w").orderBy(F.col("score").desc(), "id")
    batches = packed(anchors)
    around = batches.select("batch", "region").join(blocks.select("block", F.floor(F.col("block") / NEAR).alias("region")), "region").select("batch", "block")
    near = scored(around, batches)
    last = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") == k).select("block", "slot", "w", F.col("score").alias("least"))
    lasts = last.groupBy("block", "slot").agg(F.map_from_entries(F.collect_list(F.struct("w", "least"))).alias("lasts"))
    # a row as good as the last one so far may still come before it by its id
    raised = F.transform("windows", lambda w: F.struct(w["w"].alias("w"), F.greatest(w["low"], F.coalesce(F.try_element_at("lasts", w["w"]), w["low"])).alias("low"), w["high"].alias("high")))
    far_batches = packed(anchors.join(lasts, ["block", "slot"], "left").withColumn("windows", raised).drop("lasts"))
    far = scored(saved(needed_blocks(far_batches, blocks, same), "needed"), far_batches)
    return near.unionByName(far).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def mine_hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, block_rows: int = 2048) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` has vec_id, label and embedding; ``anchor`` says which rows are anchors. A component x counts as
    floor(scale * x), a score is the inner product. An anchor's positives are its first ``positives`` other rows of the
    same label; for each, the first ``negatives`` rows of other labels that score ``low`` to ``high`` percent of the positive.
    Higher scores come first, ties by the smaller id. Rows with a null id, label, vector or component, or one
    that isn't finite, take no part. Rows of one id are rows of their own, so that a copy of an anchor is
    a positive. A shorter vector counts as filled up with zeros. Scores beyond 64 bits stop at the limits. Other columns
    are ignored; an empty table gives an empty result. Every pair of an anchor and a row is scored or ruled out by a bound.
    """
    blocks = hilbert_blocks(vectors, anchor, scale, block_rows)
    region = F.floor(F.col("block") / NEAR)
    found = blocks.filter("n_anchors > 0").mapInArrow(_anchors_of, "block long, slot int, anchor_id long, label long, q binary").withColumn("region", region)
    parts = blocks.groupBy(region.alias("region")).agg(F.ceil(F.sum("n_anchors") / BATCH).alias("parts")).filter("parts > 0")
    batch = F.col("region") * 4096 + F.pmod(F.xxhash64("block", "slot"), F.col("parts"))
    anchors = saved(found.join(parts, "region").withColumn("batch", batch).drop("parts"), "anchors")

    everywhere = F.array(F.struct(F.lit(0).alias("w"), F.lit(int(LONG.min) + 1).alias("low"), F.lit(int(LONG.max)).alias("high")))
    pairs = saved(top_in_windows(anchors.withColumn("windows", everywhere), blocks, positives, True), "positives")
    whole = F.col("score").cast("decimal(19,0)")
    window = F.struct(F.col("place").alias("w"), F.ceil(whole * low / 100).cast("long").alias("low"), F.floor(whole * high / 100).cast("long").alias("high"))
    windows = pairs.filter("score >= 0").groupBy("block", "slot").agg(F.array_sort(F.collect_list(window)).alias("windows"))
    hard = top_in_windows(anchors.join(windows, ["block", "slot"]), blocks, negatives, False)
    names = anchors.select("block", "slot", "anchor_id").join(pairs.select("block", "slot", F.col("place").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["block", "slot"])
    told = hard.select("block", "slot", "w", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return names.join(told, ["block", "slot", "w"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def oracle(positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> str:
    return f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {positives})
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND {low} * positive_score <= 100 * s.score AND 100 * s.score <= {high} * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER w <= {negatives}"""
