"""Near duplicates: MinHash bands propose pairs, odd sketches weed them out, whole shingle sets confirm them.

Texts of the same word sequence are one class from the start. In each band bucket all members are held against the
smallest one; what these links join is one component. In buckets that then still hold several components, members
outside the largest meet a few delegates of it; those still in several components meet where their rarest shingles do
(``prefix_pairs``), so no pair of a bucket is left out, and texts of one template, whose rare shingles are their own,
aren't all held against each other. Before the exact check, parity bitmaps of whole sets stand in for the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.components import components
from .common import byte_texts, join_hot, per_worker, saved
from .prefix_pairs import prefix_pairs

KEPT_WORDS, LONGEST, CHUNK = 400_000, 40, 8192
SIGNATURE = "doc_id long, n_shingles long, sequence binary, bands array<long>, sketch array<long>"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingle_set(words: list[bytes], k: int, kept: dict[bytes, int]) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``k``-word shingles; of fewer words, the whole sequence as one."""
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = kept.get(w)
        if h is None:
            h = xxhash.xxh64_intdigest(w)
            if len(kept) < KEPT_WORDS and len(w) <= LONGEST:
                kept[w] = h
        hashes[i] = h
    width = min(k, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for j in range(width):
        out = _mix(out * np.uint64(0x100000001B3) ^ hashes[j : len(words) - width + 1 + j])
    return np.unique(out)


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.lower().split()


class Signer:
    """MinHash bands and odd sketch of shingle sets."""

    def __init__(self, bands: int, rows: int, bits: int, seed: int) -> None:
        draw = np.random.default_rng(seed)
        self.a = draw.integers(0, 1 << 63, bands * rows, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
        self.b = draw.integers(0, 1 << 63, bands * rows, np.uint64)[:, None]
        self.bands, self.rows, self.bits = bands, rows, bits

    def __call__(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least = np.full(self.bands * self.rows, np.iinfo(np.uint64).max)
        for at in range(0, len(shingles), CHUNK // 8):
            least = np.minimum(least, (self.a * shingles[at : at + CHUNK // 8] + self.b).min(1))
        samples = _mix(least ^ _mix(np.arange(len(least), dtype=np.uint64)))
        key = np.arange(self.bands, dtype=np.uint64)
        for r in range(self.rows):
            key = _mix(key * np.uint64(0x100000001B3) ^ samples[r :: self.rows])
        flips = np.bincount((samples % np.uint64(self.bits)).astype(np.int64), minlength=self.bits) & 1
        sketch = np.packbits(flips.astype(np.uint8)).view(np.int64)
        return key.view(np.int64), sketch


def _sign(k: int, signer: Signer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = per_worker("minhash words", dict)
        for batch in batches:
            n, sequences, bands, sketches = [], [], [], []
            for text in byte_texts(batch.column(1)):
                words = words_of(text)
                shingles = shingle_set(words, k, kept)
                n.append(len(shingles))
                sequences.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                band, sketch = signer(shingles) if words else (None, None)
                bands.append(band)
                sketches.append(sketch)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sequences, pa.binary()), pa.array(bands, longs), pa.array(sketches, longs)], ["doc_id", "n_shingles", "sequence", "bands", "sketch"])

    return run


def _parities(k: int, bits: int):
    """Odd sketches of whole sets: XOR tells the size of the symmetric difference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = per_worker("minhash words", dict)
        for batch in batches:
            sizes, sketches = [], []
            for text in byte_texts(batch.column(1)):
                shingles = shingle_set(words_of(text), k, kept)
                flips = np.bincount((_mix(shingles) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
                sizes.append(len(shingles))
                sketches.append(np.packbits(flips.astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(sketches, pa.list_(pa.int64()))], ["doc_id", "n", "parity"])

    return run


def _sets(k: int):
    """The shingle sets of the last column's texts."""

    def of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        kept = per_worker("minhash words", dict)
        return (shingle_set(words_of(text), k, kept) for text in byte_texts(batch.column(batch.num_columns - 1)))

    return of


def _confirm(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = per_worker("minhash words", dict)
        last: tuple[bytes, np.ndarray] = (b"", np.zeros(0, np.uint64))
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            linked = []
            for left, right in zip(byte_texts(batch.column(2)), byte_texts(batch.column(3)), strict=True):
                if left != last[0]:
                    last = left, shingle_set(words_of(left), k, kept)
                other = shingle_set(words_of(right), k, kept)
                both = len(np.intersect1d(last[1], other, assume_unique=True))
                linked.append(100 * both >= percent * (len(last[1]) + len(other) - both))
            at = [i for i, x in enumerate(linked) if x]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in at], pa.int64()), pa.array([b[i] for i in at], pa.int64())], ["a", "b"])

    return run


def bits_apart(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)


def sketch_similarity(x: Column, y: Column, bits: int, samples: int) -> Column:
    """The Jaccard similarity that the bits which differ between two odd sketches of MinHash samples tell."""
    share = F.least(2.0 * bits_apart(x, y) / bits, F.lit(0.999))
    return 1.0 + F.log1p(-share) * (bits / (4.0 * samples))


def merged(joined: DataFrame, links: DataFrame) -> DataFrame:
    """``joined`` (node, component) after more links: only components that these touch are labelled anew."""
    at = lambda side: joined.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
    placed = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select("a", "b", F.coalesce("c_a", "a").alias("p"), F.coalesce("c_b", "b").alias("q"))
    again = components(placed.filter("p <> q").select(F.col("p").alias("a"), F.col("q").alias("b")).distinct())
    nodes = joined.unionByName(placed.select(F.col("a").alias("node"), F.col("p").alias("component"))).unionByName(placed.select(F.col("b").alias("node"), F.col("q").alias("component"))).distinct()
    named = again.select(F.col("node").alias("component"), F.col("component").alias("least"))
    return saved(nodes.join(named, "component", "left").select("node", F.coalesce("least", "component").alias("component")), "components")


def find_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, bands: int = 32, rows: int = 5, bits: int = 512, slack: float = 0.16, parity_bits: int = 2048, parity_slack: float = 0.04, delegates: int = 3, seed: int = 11) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of ``docs``.

    Sets are the distinct ``k``-word shingles of the lower-cased whole text. Texts whose sets meet in at least
    ``percent`` of their union are linked (and those of the same words); component_id is the smallest id reachable. Two
    texts at the threshold meet in a band with a probability of 1 - (1 - s^rows)^bands, over 0.99999 by default. A pair
    goes on unless its sketches put it more than ``slack``, five standard errors, below the threshold, and then to the
    exact check unless its whole sets' parities, where these are not full, put it more than ``parity_slack`` below.
    Null and empty texts have no shingles and link with nothing. Rows of one id count as one document; a null id is a
    row by itself, with a null component, and kept. An empty table gives an empty result; other columns are ignored.
    """
    samples, least = bands * rows, percent / 100 - slack
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = saved(texts.mapInArrow(_sign(k, Signer(bands, rows, bits, seed)), SIGNATURE), "signatures")
    known = signed.filter("doc_id is not null and n_shingles > 0")
    classes = saved(known.groupBy("sequence").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")

    banded = classes.select("rep", F.explode("bands").alias("key"))
    # written, so that the joins with it have plain shuffles on both sides, in which large partitions can be split
    centres = saved(banded.groupBy("key").agg(F.min("rep").alias("centre"), F.count(F.lit(1)).alias("members")).filter("members > 1"), "centres")
    facts = classes.select("rep", "n", "sketch").dropDuplicates(["rep"])
    members = saved(banded.join(centres, "key").select("key", "rep", "centre", "members"), "members")

    def plausible(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sizes allow the similarity and whose sketches don't deny it."""
        of = lambda side: facts.select(F.col("rep").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}"))
        sized = pairs.join(of("a"), "a").join(of("b"), "b").filter(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
        return sized.filter(sketch_similarity(F.col("sketch_a"), F.col("sketch_b"), bits, samples) >= least).select("a", "b")

    starred = members.filter("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    first_pairs = saved(plausible(starred), "pairs")
    # whoever may be held against another, now or later: both sides of the first pairs, and members of larger buckets
    ids = [first_pairs.select(F.col("a").alias("doc_id")), first_pairs.select(F.col("b").alias("doc_id")), members.filter("members > 2").select(F.col("rep").alias("doc_id"))]
    wanted = ids[0].unionByName(ids[1]).unionByName(ids[2]).distinct()
    # texts are shuffled once, whatever the number of ids: their set grows with the corpus and is no broadcast
    held = saved(texts.join(wanted.hint("merge"), "doc_id").dropDuplicates(["doc_id"]), "pair-texts")
    parity = saved(held.mapInArrow(_parities(k, parity_bits), "doc_id long, n long, parity array<long>"), "parities")

    def alike() -> Column:
        """Whether the parities of sides a and b, unless they are full, allow the similarity."""
        apart = bits_apart(F.col("parity_a"), F.col("parity_b"))
        differ = F.log1p(-F.least(2.0 * apart / parity_bits, F.lit(0.9))) * (-parity_bits / 2.0)
        both = F.col("n_a") + F.col("n_b")
        return (apart > 0.42 * parity_bits) | ((both - differ) / (both + differ) >= percent / 100 - parity_slack)

    def confirmed(pairs: DataFrame) -> DataFrame:
        of = lambda side: parity.select(F.col("doc_id").alias(side), F.col("n").alias(f"n_{side}"), F.col("parity").alias(f"parity_{side}"))
        close = pairs.join(of("b"), "b").join(of("a"), "a").filter(alike()).select("a", "b")
        of = lambda side: held.select(F.col("doc_id").alias(side), F.col("text").alias(f"text_{side}"))
        both = close.join(of("b"), "b").join(of("a"), "a").select("a", "b", "text_a", "text_b")
        return saved(both.mapInArrow(_confirm(k, percent), "a long, b long"), "links")

    links = confirmed(first_pairs)
    joined = components(links)

    def left_apart(joined: DataFrame) -> DataFrame:
        """Members of buckets with several components; ``major`` is the largest component of the bucket."""
        placed = members.filter("members > 2").join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        counts = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
        mixed = counts.groupBy("key").agg(F.max(F.struct("c", "component")).alias("most"), F.count(F.lit(1)).alias("several")).filter("several > 1").select("key", F.col("most.component").alias("major"), F.col("most.c").alias("majors"))
        mixed = saved(mixed, "mixed")
        return saved(placed.join(mixed, "key").filter("rep <> centre").join(facts, "rep").join(parity.select(F.col("doc_id").alias("rep"), "parity"), "rep"), "apart")

    def across(apart: DataFrame, some: Column) -> DataFrame:
        """Plausible pairs of one bucket and two components: the first outside the largest, the other one of ``some``."""
        sides = ("rep", "component", "n", "sketch", "parity")
        minor = apart.filter("component <> major").select(F.col("key").alias("key_a"), *(F.col(c).alias(f"{c}_a") for c in sides))
        other = apart.filter(some).select("key", *(F.col(c).alias(f"{c}_b") for c in sides))
        near = sketch_similarity(F.col("sketch_a"), F.col("sketch_b"), bits, samples) >= least
        sizes = F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
        on = (F.col("key_a") == F.col("key")) & (F.col("component_a") != F.col("component_b")) & sizes & near & alike()
        return minor.join(other, on).select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct()

    apart = left_apart(joined)
    if apart.limit(1).count():
        # about so many members of the largest component stand for it in each bucket, others in another bucket
        chosen = (F.col("component") == F.col("major")) & (F.pmod(F.xxhash64("rep", "key"), F.ceil(F.col("majors") / delegates)) == 0)
        met = saved(across(apart, chosen).join(starred, ["a", "b"], "left_anti"), "delegates")
        more_links = confirmed(met)
        if more_links.limit(1).count():
            joined = merged(joined, more_links)
            apart = left_apart(joined)
        if apart.limit(1).count():
            loose = apart.select("rep", "component").distinct().join(held.withColumnRenamed("doc_id", "rep"), "rep").select("rep", "component", "text")
            rest = plausible(prefix_pairs(saved(loose, "loose-texts"), _sets(k), percent))
            rest = rest.join(starred, ["a", "b"], "left_anti").join(met, ["a", "b"], "left_anti")
            last_links = confirmed(saved(rest, "rest"))
            if last_links.limit(1).count():
                joined = merged(joined, last_links)

    found = classes.select("sequence", "copies", "rep").join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("sequence", "copies", F.coalesce("component", "rep").alias("component_id"))
    plain = signed.select("doc_id", "n_shingles", "sequence")
    placed_rows = join_hot(plain.filter("doc_id is not null and n_shingles > 0"), found, ["sequence"], "copies", signed.count())
    alone = plain.filter("doc_id is null or n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    out = placed_rows.select("doc_id", "n_shingles", "component_id").unionByName(alone.select("doc_id", "n_shingles", "component_id"))
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
