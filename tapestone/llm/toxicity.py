"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

A text's features count each hashed n-gram in its distinct words, so that words repeated in a long text count once.
Blocks of texts are hashed as one array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_texts, id_uniform, kth_greatest, saved

GRAMS, BITS, BLOCK, FIT_AT_ONCE = (3, 4, 5), 18, 1 << 20, 256


def word_list(text: bytes) -> bytes:
    """The distinct lower-cased (ASCII) words without outer punctuation, each between the marks 2 and 3."""
    words = {w.strip(b".,;:!?()\"'#*$%&|<>-\x02\x03") for w in text.lower().split()}
    return b"\x02" + b"\x03\x02".join(sorted(words)) + b"\x03"


def blocks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The word lists of some texts as one array of bytes, and where each begins; BLOCK bytes or one text at a time."""
    held, size = [], 0
    for text in texts:
        words = word_list(text)
        if held and size + len(words) > BLOCK:
            yield _block(held)
            held, size = [], 0
        held.append(words)
        size += len(words)
    if held:
        yield _block(held)


def _block(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held[:-1])])


def gram_buckets(chars: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: where an n-gram inside one marked word begins, and its bucket; bytes stand for characters."""
    wide, ends = chars.astype(np.uint64), chars == 3
    h = np.full(len(chars), 0x9E3779B97F4A7C15, np.uint64)
    inside = np.ones(len(chars), bool)
    for n in range(1, GRAMS[-1] + 1):
        last = len(chars) - n + 1
        if last <= 0:
            return
        h, inside = (h[:last] ^ wide[n - 1 :]) * np.uint64(0x100000001B3), inside[:last]
        if n > 1:
            inside = inside & ~ends[n - 2 : n - 2 + last]
        if n in GRAMS:
            at = np.flatnonzero(inside)
            mixed = (h[at] ^ (h[at] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            yield at, (mixed >> np.uint64(64 - BITS)).astype(np.int64)


def grams_of(text: bytes) -> np.ndarray:
    """The buckets of all n-grams of one text's distinct words."""
    found = [b for _, b in gram_buckets(np.frombuffer(word_list(text), np.uint8))]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def gram_counts(labelled: DataFrame) -> np.ndarray:
    """(2, 2^BITS): for each label and n-gram, how many words of how many documents hold it. Of all labelled rows.

    Each task sends one sparse row of sums for each label, so what reaches the driver is bounded by the buckets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            marks, texts = np.array(batch.column(1).to_pylist()), byte_texts(batch.column(0))
            for label in (0, 1):
                for chars, _ in blocks([t for t, m in zip(texts, marks, strict=True) if m == label]):
                    for _, buckets in gram_buckets(chars):
                        total[label] += np.bincount(buckets, minlength=1 << BITS)
        label, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[label, bucket])], ["label", "bucket", "n"])

    sums = labelled.select("text", "label").mapInArrow(run, "label int, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((2, 1 << BITS))
    out[sums["label"].to_numpy(), sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return out


def log_count_ratio(counts: np.ndarray, alpha: float = 1.0, errors: float = 3.0) -> np.ndarray:
    """Log ratio of each n-gram's shares in label 1 and label 0; 0 where it is within ``errors`` standard errors of 0."""
    smooth = counts + alpha
    shares = smooth / smooth.sum(1, keepdims=True)
    ratio = np.log(shares[1] / shares[0])
    return np.where(np.abs(ratio) > errors * np.sqrt((1 / smooth).sum(0)), ratio, 0.0)


def fit_linear(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, ratio: np.ndarray, l2: float, steps: int, positive_share: float = 0.25) -> tuple[np.ndarray, float]:
    """Logistic regression over ``ratio`` times features by Adam; returns weights for plain features, and a bias.

    A row is its distinct buckets and their counts (32-bit numbers, as they fill the driver's memory). Gradients are summed
    over ``FIT_AT_ONCE`` rows at a time, so that a step needs little memory of its own.
    """
    there = np.zeros(len(ratio), bool)
    for buckets, _ in rows:
        there[buckets] = True
    used = np.flatnonzero(there)
    place = np.cumsum(there, dtype=np.int32) - 1
    parts = []
    for at in range(0, len(rows), FIT_AT_ONCE):
        some = rows[at : at + FIT_AT_ONCE]
        row_of = np.repeat(np.arange(len(some), dtype=np.int32), [len(r[0]) for r in some])
        parts.append((slice(at, at + len(some)), row_of, place[np.concatenate([r[0] for r in some])], np.concatenate([r[1] for r in some])))
    scale = ratio[used]
    weight, bias = np.zeros(len(used)), float(np.log((labels.mean() + 1e-6) / (1 - labels.mean() + 1e-6)))
    m, v, mb, vb = np.zeros_like(weight), np.zeros_like(weight), 0.0, 0.0
    # the sample has as many of either label, the corpus does not
    importance = np.where(labels == 1, positive_share / max(labels.sum(), 1), (1 - positive_share) / max((1 - labels).sum(), 1))
    for step in range(1, steps + 1):
        plain, slope, total = scale * weight, l2 * weight, 0.0
        for at, row_of, columns, counts in parts:
            z = np.bincount(row_of, plain[columns] * counts, at.stop - at.start) + bias
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[at]) * importance[at]
            slope += np.bincount(columns, error[row_of] * counts, len(used)) * scale
            total += error.sum()
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        mb, vb = 0.9 * mb + 0.1 * total, 0.99 * vb + 0.01 * total**2
        fix, fix2 = 1 - 0.9**step, 1 - 0.99**step
        weight -= 0.05 * (m / fix) / (np.sqrt(v / fix2) + 1e-8)
        bias -= 0.05 * (mb / fix) / (np.sqrt(vb / fix2) + 1e-8)
    out = np.zeros(len(ratio))
    out[used] = scale * weight
    return out, bias


class Model:
    """Weights of n-grams and a bias."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights.astype(np.float32), bias

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = []
        for chars, starts in blocks(texts):
            parts = np.zeros(len(chars))
            for at, buckets in gram_buckets(chars):
                parts[at] += self.weights[buckets]
            out.append(np.add.reduceat(parts, starts))
        z = np.concatenate(out) + self.bias if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = 4000, l2: float = 0.01, steps: int = 150, seed: int = 3) -> Model:
    """A model from the rows of ``docs`` that ``labels`` marks 0 or 1.

    Log-count ratios cover all labelled rows. The linear fit takes at most ``fit_rows`` rows, half of each label where
    there are as many, those whose seeded hash is least. An id with several labels counts as the greatest; without both
    labels every text scores one half.
    """
    known = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("_tp_id")).agg(F.max(label_col).cast("int").alias("label"))
    texts = docs.select(F.col(id_col).cast("long").alias("_tp_id"), F.col(text_col).alias("text")).filter("_tp_id is not null")
    # one shuffle of the texts at every size; labelled rows are then read three times
    labelled = saved(texts.join(known.hint("merge"), "_tp_id"), "labelled")
    counts = gram_counts(labelled)
    if not counts.sum(1).all():
        return Model(np.zeros(1 << BITS), 0.0)
    ratio = log_count_ratio(counts)
    telling = ratio != 0

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(g[telling[g]].astype(np.int32), return_counts=True) for g in map(grams_of, byte_texts(batch.column(0)))]
            columns = [pa.array([f[i].astype(np.int32).tobytes() for f in found], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(1), batch.column(2)], ["grams", "counts", "label", "at"])

    drawn = labelled.withColumn("_tp_u", id_uniform(seed, F.col("_tp_id")))
    held = []
    for label in (0, 1):
        own = drawn.filter(F.col("label") == label)
        # the edge comes from numbers alone, and only texts under it are read; a repeated id gives one of its texts
        edge = kth_greatest(own.select((-F.col("_tp_u")).alias("u"), "_tp_id").distinct(), "u", "_tp_id", fit_rows // 2)
        least = own if edge is None else own.filter(F.col("_tp_u") <= -edge[0])
        single = least.groupBy("_tp_id").agg(F.min("text").alias("text"), F.first("label").alias("label"), F.first("_tp_u").alias("_tp_u"))
        held.append(single.select("text", "label", "_tp_u").mapInArrow(features, "grams binary, counts binary, label int, at double").toArrow())
    table = pa.concat_tables(held).combine_chunks()
    del held
    # the same order whatever the tasks' order, so that a fit repeats
    table = table.take(pa.compute.sort_indices(table, sort_keys=[("label", "ascending"), ("at", "ascending"), ("grams", "ascending")]))
    marks = table["label"].to_numpy()
    sample = [(np.frombuffer(g.as_buffer(), np.int32), np.frombuffer(c.as_buffer(), np.int32)) for g, c in zip(table["grams"], table["counts"], strict=True)]
    weights, bias = fit_linear(sample, marks.astype(np.float64), ratio, l2, steps)
    return Model(weights, bias)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``toxicity`` (0 to 1); null and empty texts get the bias's score.

    A column of that name is replaced; repeated and null ids are scored row by row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS numbers, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(shared.value.scores(byte_texts(batch.column(text_col))), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, "toxicity"])

    docs = docs.drop("toxicity")
    schema = T.StructType([*docs.schema.fields, T.StructField("toxicity", T.DoubleType())])
    return docs.mapInArrow(run, schema)
