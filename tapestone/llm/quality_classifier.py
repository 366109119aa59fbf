"""Importance resampling: documents drawn by the ratio of two hashed n-gram models, target text over raw text.

A document's log weight is the sum, over its hashed words and word pairs, of the log ratio of their shares in the two
models. Gumbel noise added to it and the greatest keys taken draws without replacement in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, id_uniform, kth_greatest, per_worker, saved

KEPT_WORDS, LONGEST = 400_000, 40


def buckets_of(text: bytes, n_buckets: int, kept: dict[bytes, int]) -> np.ndarray:
    """Buckets of the words and word pairs of a text, A-Z in lower case."""
    words = text.lower().split()
    hashes = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = kept.get(w)
        if h is None:
            h = xxhash.xxh64_intdigest(w)
            if len(kept) < KEPT_WORDS and len(w) <= LONGEST:
                kept[w] = h
        hashes[i] = h
    pairs = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (hashes[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    pairs = (pairs ^ (pairs >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (np.concatenate([hashes, pairs]) % np.uint64(n_buckets)).astype(np.int64)


def model_counts(texts: DataFrame, n_buckets: int) -> np.ndarray:
    """Counts by bucket over all rows of ``texts``; each task sends one row of sums for each bucket that it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = per_worker("resampling words", dict)
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for text in byte_texts(batch.column(0)):
                total += np.bincount(buckets_of(text, n_buckets, kept), minlength=n_buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    sums = texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(n_buckets)
    out[sums["bucket"]] = sums["n"]
    return out


def _weigh(ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = per_worker("resampling words", dict)
        for batch in batches:
            found = [buckets_of(t, len(ratio), kept) for t in byte_texts(batch.column(1))]
            weights = [float(ratio[b].sum()) for b in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([(len(b) + 1) // 2 for b in found], pa.int64()), pa.array(weights, pa.float64())], ["doc_id", "n_words", "log_weight"])

    return run


def gumbel(uniform: Column) -> Column:
    return -F.log(-F.log(F.greatest(uniform, F.lit(1e-15))))


def resample_by_importance(docs: DataFrame, labels: DataFrame, share: float = 0.5, n_buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", temperature: float = 1.0, alpha: float = 1.0, length_power: float = 0.0, seed: int = 5) -> DataFrame:
    """(id, n_words, log_weight, gumbel_key, selected) for each row; the ``share`` of rows with the greatest keys is selected.

    The raw model counts all rows, the target model those that ``labels`` marks 1. log_weight is the sum of the log ratios
    of a document's n-grams, so the draw is in proportion to p_target / p_raw; ``length_power`` divides it by the number
    of n-grams to that power (0: not at all). Texts that are null or empty weigh 0; an id with several labels counts as
    the least; repeated rows share their draw, and ties go to the smaller id, a null one last; without a row marked 1 the
    target model is even; an empty table gives an empty result; other columns are ignored.
    """
    marks = labels.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(label_col).cast("int").alias("_tp_label")).filter("_tp_label = 1").select("doc_id")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    raw = model_counts(texts, n_buckets)
    # one shuffle of the texts at every size: the marked ids grow with the labels and are no broadcast
    target = model_counts(texts.filter("doc_id is not null").join(marks.hint("merge"), "doc_id", "left_semi"), n_buckets)
    ratio = np.log((target + alpha) / (target + alpha).sum()) - np.log((raw + alpha) / (raw + alpha).sum())
    weighed = texts.mapInArrow(_weigh(ratio), "doc_id long, n_words long, log_weight double")
    if length_power:
        weighed = weighed.withColumn("log_weight", F.col("log_weight") / F.pow(F.greatest(2 * F.col("n_words") - 1, F.lit(1)), F.lit(length_power)))
    keyed = saved(weighed.withColumn("gumbel_key", F.col("log_weight") / temperature + gumbel(id_uniform(seed, F.coalesce(F.col("doc_id"), F.lit(-1))))), "gumbel")
    k = round(share * keyed.count())
    edge = kth_greatest(keyed, "gumbel_key", "doc_id", k)
    if edge is None:
        selected = F.lit(k > 0)
    else:
        selected = (F.col("gumbel_key") > edge[0]) | ((F.col("gumbel_key") == edge[0]) & F.coalesce(F.col("doc_id") <= edge[1], F.lit(False)))
    return keyed.select(F.col("doc_id").alias(id_col), "n_words", "log_weight", "gumbel_key", selected.alias("selected"))
