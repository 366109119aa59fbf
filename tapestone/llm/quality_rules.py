"""Quality rules: statistics of each document, and an isolation forest over them.

The forest's trees split a sample of rule statistics at random; a document that random splits isolate early is
anomalous. The least score that counts as anomalous comes from labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, id_uniform, kth_greatest, saved

# Fixed values.
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_distinct")
FEATURES = ("word_length", "symbol_share", "upper_share", "distinct_share")

_UPPER, _SYMBOL = (bytes(1 if 65 <= i < 91 else 0 for i in range(256)), bytes(1 if i in SYMBOLS else 0 for i in range(256)))


def repeated_words(codes: np.ndarray, n: int = 8) -> int:
    """How many words stand in ``n``-word windows (a power of two) that occur twice or more."""
    if len(codes) <= n:
        return 0
    width, windows = 1, codes
    while width < n:  # windows of twice the width are pairs of windows; ranks keep them exact
        pairs = windows[:-width].astype(np.int64) * (int(windows.max()) + 1) + windows[width:]
        windows = np.unique(pairs, return_inverse=True)[1]
        width *= 2
    often = np.bincount(windows) > 1
    if not often.any():
        return 0
    covered = np.zeros(len(codes) + 1, np.int64)
    at = np.flatnonzero(often[windows])
    np.add.at(covered, at, 1)
    np.add.at(covered, at + n, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def statistics(text: bytes) -> tuple[int, ...]:
    """STATISTICS of one text in UTF-8."""
    words = text.split()  # bytes split at exactly 0x20 and 0x09-0x0D
    n = len(words)
    known: dict[bytes, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    chars = np.frombuffer(text, np.uint8)
    points = int(((chars & 0xC0) != 0x80).sum()) - sum(text.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    upper, symbols = (sum(text.translate(t)) if len(text) < 64 else int(np.frombuffer(text.translate(t), np.uint8).sum(dtype=np.int64)) for t in (_UPPER, _SYMBOL))
    return n, points, symbols, len(lines) - len(set(lines)), repeated_words(codes) if len(known) < n else 0, upper, len(known)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([statistics(t) for t in byte_texts(batch.column(1))], np.int64).reshape(-1, len(STATISTICS))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, i]) for i in range(rows.shape[1]))], ["doc_id", *STATISTICS])


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and STATISTICS of each row's whole text; a null text counts as empty."""
    schema = ", ".join(["doc_id long", *(f"{s} long" for s in STATISTICS)])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_measure, schema)


def _features(stats: dict[str, np.ndarray]) -> np.ndarray:
    s = {k: v.astype(np.float64) for k, v in stats.items()}
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    # length and repetition have base rules, and digits mark harmless rarities; long texts repeat words by nature
    return np.stack([s["word_chars"] / words, s["n_symbols"] / chars, s["n_upper"] / chars, s["n_distinct"] / words**0.85], 1)


class IsolationForest:
    """Trees of random splits over samples of ``size`` rows; arrays of (feature, threshold, left, right, path)."""

    def __init__(self, rows: np.ndarray, trees: int, size: int, seed: int) -> None:
        draw = np.random.default_rng(seed)
        self.trees = [self._grow(rows[draw.choice(len(rows), min(size, len(rows)), replace=False)], draw) for _ in range(trees)] if len(rows) else []
        self.norm = self._mean_path(min(size, len(rows))) or 1.0

    @staticmethod
    def _mean_path(n: int) -> float:
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n if n > 2 else 1.0

    def _grow(self, rows: np.ndarray, draw: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, threshold, left, right, path = [], [], [], [], []
        deepest = int(np.ceil(np.log2(max(len(rows), 2))))

        def node(part: np.ndarray, depth: int) -> int:
            at = len(feature)
            for column, value in ((feature, -1), (threshold, 0.0), (left, at), (right, at), (path, depth + self._mean_path(len(part)))):
                column.append(value)
            low, high = part.min(0), part.max(0)
            can = np.flatnonzero(high > low)
            if depth < deepest and len(part) > 1 and len(can):
                f = int(draw.choice(can))
                t = float(draw.uniform(low[f], high[f]))
                feature[at], threshold[at] = f, t
                left[at], right[at] = node(part[part[:, f] <= t], depth + 1), node(part[part[:, f] > t], depth + 1)
            return at

        node(rows, 0)
        return np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(path)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 anomalous, about 0.5 ordinary."""
        if not self.trees:
            return np.zeros(len(rows))
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, threshold, left, right, path in self.trees:
            at = np.zeros(len(rows), np.int64)
            while (inner := feature[at] >= 0).any():
                goes_left = rows[every, np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / self.norm)


def _score(forest: IsolationForest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = {s: batch.column(s).to_numpy(zero_copy_only=False) for s in STATISTICS}
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.score(_features(stats)), pa.float64())], [*batch.schema.names, "anomaly"])

    return run


def calibrated_threshold(scored: DataFrame, labels: DataFrame, label_col: str, id_col: str, keep_good: float, bins: int = 2000) -> float:
    """The least anomaly score at which at most 1 - ``keep_good`` of the good labelled rows lie; all labelled rows count.

    A histogram of ``bins`` scores goes to the driver. Above 1 (nothing is anomalous) where no good row is labelled.
    """
    labelled = labels.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(label_col).alias("_tp_good"))
    held = scored.filter(F.col("n_words") >= 20).join(labelled, "doc_id").groupBy(F.floor(F.col("anomaly") * bins).alias("bin"))
    rows = {r["bin"]: (r["good"] or 0, r["bad"] or 0) for r in held.agg(F.sum((F.col("_tp_good") == 1).cast("long")).alias("good"), F.sum((F.col("_tp_good") == 0).cast("long")).alias("bad")).collect()}
    all_good, all_bad = (sum(r[i] for r in rows.values()) for i in (0, 1))
    best, best_at, good, bad = 0.0, 1.01, 0, 0
    for b in sorted(rows, reverse=True):
        good, bad = good + rows[b][0], bad + rows[b][1]
        gain = bad / max(all_bad, 1) - good / max(all_good, 1)
        if good <= (1 - keep_good) * all_good and gain > best:
            best, best_at = gain, b / bins
    return best_at


def least_rows(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """The ``n`` rows (all, if fewer) whose id's seeded hash is least; the edge is found by histograms, so no task sends more than it holds of them."""
    drawn = rows.withColumn("_tp_u", id_uniform(seed, F.coalesce(F.col("doc_id"), F.lit(-1))))
    edge = kth_greatest(drawn.select((-F.col("_tp_u")).alias("u"), "doc_id"), "u", "doc_id", n)
    if edge is None:
        return drawn
    at = -edge[0]  # rows of one id share their hash: of those at the edge, as many as are wanting
    below = drawn.filter(F.col("_tp_u") < at)
    return below.unionByName(drawn.filter(F.col("_tp_u") == at).orderBy(*STATISTICS).limit(max(n - below.count(), 0)))


def judge_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", trees: int = 100, tree_rows: int = 256, fit_rows: int = 20_000, keep_good: float = 0.99, seed: int = 7) -> DataFrame:
    """doc_id, STATISTICS, anomaly score, base_failed and kept for each row.

    base_failed: under 20 words, or more than 30 % of the words in repeated 8-word windows. The forest is fitted on the
    ``fit_rows`` rows (at most) whose seeded hash is least, among documents that pass the base rules; statistics, scores
    and the threshold cover all rows. Null texts are empty and fail; repeated ids are judged row by row; without labels
    the forest drops nothing; an empty table gives an empty result.
    """
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    stats = saved(rule_statistics(docs, id_col, text_col), "rules")
    sample = least_rows(stats.filter(~base_failed), fit_rows, seed).toPandas().sort_values(["_tp_u", *STATISTICS])
    forest = IsolationForest(_features({s: sample[s].to_numpy() for s in STATISTICS}), trees, tree_rows, seed)
    schema = ", ".join(["doc_id long", *(f"{s} long" for s in STATISTICS), "anomaly double"])
    scored = saved(stats.mapInArrow(_score(forest), schema), "anomaly")
    threshold = calibrated_threshold(scored, labels, label_col, id_col, keep_good)
    return scored.withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < threshold))
