"""Alignment of two tokenizers' ids over the same bytes.

The cumulative ends of either token list become a dictionary from end to index; the ends that both have cut the lists into
groups, and every pair of tokens in a group whose bytes overlap is a link. A text is aligned in segments that begin with a
space after a character that is no white space: neither tokenizer merges across such a place, so each segment's ids and
links are found once and kept.

How many documents link a pair is counted over the whole corpus. Tasks write chunks of a bounded number of links: a row
each, with the chunk's distinct pairs and, for each document, which of these it links how often. Pairs are counted by
aggregation, and each chunk gets the counts of its own pairs back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_worker, saved

#: Segments that a worker keeps before it begins anew, and the characters of texts that are looked up at a time.
KEPT, AT_ONCE = 400_000, 1 << 20
SPACE = "▁"
CHUNK = "chunk long, ids array<long>, facts array<struct<n_a: long, n_b: long, n_groups: long, n_links: long, groups_sha256: string>>, cuts array<int>, places binary, times binary, pairs array<long>, docs array<int>"


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[list[int], list[int], list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Groups and links of two rising lists of cumulative ends of the same bytes.

    Of each group its end, and how many tokens of a and of b end with it or before; of each link its end and its places in a
    and b. Between two neighbouring ends of either list lie bytes of one token of a and one of b: a link each.
    """
    index_a = dict(zip(ends_a.tolist(), range(1, len(ends_a) + 1), strict=True))
    index_b = dict(zip(ends_b.tolist(), range(1, len(ends_b) + 1), strict=True))
    common = sorted(index_a.keys() & index_b.keys())
    ends = np.union1d(ends_a, ends_b)
    return common, [index_a[e] for e in common], [index_b[e] for e in common], ends, np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


class Aligner:
    """Segments of texts, each kept under a number: its groups as text, its numbers of tokens, groups and links, and its linked pairs."""

    before_space, segments = re.compile(r"\s ").search, re.compile(r" (?:[^ ]|(?<!\S) )*").findall

    def __init__(self, tokenizer_path: str, ranks_path: str | None, pieces_path: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(tokenizer_path)
        whole.encode_special_tokens = True
        self.encode_a = lambda s: whole.encode(s, add_special_tokens=False).ids
        if ranks_path:  # the same vocabulary for a faster encoder
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.encode_a = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        of, vocabulary = byte_of_char(), whole.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(of[c] for c in token) if all(c in of for c in token) else b""
        self.pieces = p = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        names = [p.id_to_piece(i) for i in range(p.get_piece_size())]
        self.bytes_b = [bytes([int(n[3:5], 16)]) if p.is_byte(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(names)]
        self.lengths = [np.array([len(x) for x in known], np.int64) for known in (self.bytes_a, self.bytes_b)]
        #: whether a segment can stand by itself: no piece goes on with a space after another character
        self.cut = not any(SPACE in n.lstrip(SPACE) for n in names)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.told: list[str] = []
        #: of each segment: tokens of a and b, groups, links; whether the bytes don't come back; where its links begin
        self.facts, self.lost, self.starts, self.pairs = np.zeros((0, 4), np.int64), np.zeros(0, bool), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def split(self, text: str) -> list[str]:
        """The segments of a space and ``text``, without the space that each begins with."""
        if not self.cut:
            return [text]
        if not self.before_space(f" {text}"):
            return text.split(" ")
        return [s[1:] for s in self.segments(f" {text}")]

    def learn(self, new: list[str]) -> None:
        """Numbers for segments that have none yet: all are aligned as one list."""
        ids_a = [self.encode_a(f" {s}") for s in new]
        # the pieces' encoder sets the space, but none before nothing
        ids_b = [b if s else [self.pieces.piece_to_id(SPACE)] for s, b in zip(new, self.pieces.encode(new, num_threads=1), strict=True)]
        raw = [f" {s}".encode() for s in new]
        lost = np.zeros(len(new), bool)
        for ids, known in ((ids_a, self.bytes_a), (ids_b, self.bytes_b)):
            if b"".join(known[i] for x in ids for i in x) != b"".join(raw):
                lost |= np.array([b"".join(known[i] for i in x) != r for x, r in zip(ids, raw, strict=True)])
        for i in np.flatnonzero(lost):
            ids_a[i] = ids_b[i] = raw[i] = ()
        n_a, n_b, n_bytes = (np.array([len(x) for x in xs], np.int64) for xs in (ids_a, ids_b, raw))
        a, b = (np.fromiter((i for x in xs for i in x), np.int64, n.sum()) for xs, n in ((ids_a, n_a), (ids_b, n_b)))
        common, to_a, to_b, ends, at_a, at_b = align(np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b]))
        names_a, names_b = [str(i) for i in a.tolist()], [str(i) for i in b.tolist()]
        told = [f"{names_a[i] if k == i + 1 else ','.join(names_a[i:k])}|{names_b[j] if m == j + 1 else ','.join(names_b[j:m])}" for i, k, j, m in zip([0, *to_a], to_a, [0, *to_b], to_b, strict=False)]
        stops = np.cumsum(n_bytes)  # segments end where both lists do
        groups, links = np.searchsorted(common, stops, "right"), np.searchsorted(ends, stops, "right")
        cuts = [0, *groups.tolist()]
        self.told += [";".join(told[i:k]) for i, k in zip(cuts, cuts[1:], strict=False)]
        self.facts = np.concatenate([self.facts, np.stack([n_a, n_b, np.diff(groups, prepend=0), np.diff(links, prepend=0)], 1)])
        self.lost = np.concatenate([self.lost, lost])
        self.starts = np.concatenate([self.starts, self.starts[-1] + links])
        self.pairs = np.concatenate([self.pairs, a[at_a] << 32 | b[at_b]])
        self.number |= zip(new, range(len(self.number), len(self.number) + len(new)), strict=True)

    def known(self, texts: list[str]) -> Iterator[np.ndarray | None]:
        """The numbers of each text's segments; None if it is empty or its bytes don't come back."""
        if len(self.number) > KEPT:
            self.clear()
        parts = [self.split(t) if t else [] for t in texts]
        if new := [s for s in dict.fromkeys(s for p in parts for s in p) if s not in self.number]:
            self.learn(new)
        for p in parts:
            numbers = np.fromiter(map(self.number.__getitem__, p), np.int64, len(p))
            yield None if not p or self.lost[numbers].any() else numbers


class Chunk:
    """Documents of one chunk, until it holds ``most`` pairs of documents."""

    def __init__(self) -> None:
        self.ids, self.facts, self.pairs, self.times, self.size = [], [], [], [], 0

    def add(self, doc_id: int | None, numbers: np.ndarray | None, of: Aligner) -> None:
        told, pairs, times = [0, 0, 0, 0, ""], np.zeros(0, np.int64), np.zeros(0, np.int64)
        if numbers is not None:
            told = [*of.facts[numbers].sum(0).tolist(), hashlib.sha256(";".join(map(of.told.__getitem__, numbers.tolist())).encode()).hexdigest()]
            segments, n = np.unique(numbers, return_counts=True)
            sizes = of.starts[segments + 1] - of.starts[segments]
            at = np.arange(sizes.sum()) + np.repeat(of.starts[segments] - np.cumsum(sizes) + sizes, sizes)
            linked = of.pairs[at]
            order = np.argsort(linked, kind="stable")
            linked, n = linked[order], np.repeat(n, sizes)[order]
            first = np.flatnonzero(np.diff(linked, prepend=-1))
            pairs, times = linked[first], np.add.reduceat(n, first)
        self.ids.append(doc_id)
        self.facts.append(dict(zip(("n_a", "n_b", "n_groups", "n_links", "groups_sha256"), told, strict=True)))
        self.pairs.append(pairs)
        self.times.append(times)
        self.size += len(pairs) + 1

    def row(self, chunk: int) -> pa.RecordBatch:
        pairs, places, docs = np.unique(np.concatenate(self.pairs), return_inverse=True, return_counts=True)
        values = [chunk, self.ids, self.facts, np.cumsum([len(p) for p in self.pairs], dtype=np.int32), places.astype("<i4").tobytes(), np.concatenate(self.times).astype("<i4").tobytes(), pairs, docs.astype(np.int32)]
        fact = pa.struct([(k, pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links")] + [("groups_sha256", pa.string())])
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(fact), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["chunk", "ids", "facts", "cuts", "places", "times", "pairs", "docs"])


def _chunks(paths: tuple[str, str | None, str], most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = per_worker(("aligner", *paths), lambda: Aligner(*paths))
        number, chunk = TaskContext.get().partitionId() << 32, Chunk()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            stops = np.searchsorted(np.cumsum([len(t) for t in texts]), np.arange(AT_ONCE, sum(map(len, texts)) + AT_ONCE, AT_ONCE)) + 1
            for i, k in zip([0, *stops], [*stops, len(texts)], strict=True):
                for doc_id, numbers in zip(ids[i:k], aligner.known(texts[i:k]), strict=True):
                    chunk.add(doc_id, numbers, aligner)
                    if chunk.size >= most:
                        yield chunk.row(number)
                        number, chunk = number + 1, Chunk()
        if chunk.ids:
            yield chunk.row(number)

    return run


def _told(key: tuple, chunk: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of one chunk, with what the corpus tells about their pairs."""
    row = {c: chunk[c][0] for c in chunk.column_names}
    n = len(row["pairs"].values) if row["pairs"].values is not None else 0
    count, best = np.zeros(n, np.int64), np.zeros(n, bool)
    at = counts["place"].to_numpy()
    count[at], best[at] = counts["n"].to_numpy(), counts["best"].to_numpy()
    places, times = np.frombuffer(row["places"].as_py(), "<i4"), np.frombuffer(row["times"].as_py(), "<i4").astype(np.int64)
    cuts = np.concatenate([[0], row["cuts"].values.to_numpy()])
    sums = [np.concatenate([[0], np.cumsum(times * x[places])])[cuts] for x in (best, count)]
    facts = row["facts"].values
    columns = [row["ids"].values, *[facts.field(k) for k in ("n_a", "n_b", "n_groups", "n_links")], *[pa.array(np.diff(s)) for s in sums], facts.field("groups_sha256")]
    return pa.Table.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def align_tokens(docs: DataFrame, tokenizer_path: str, pieces_path: str, ranks_path: str | None = None, most: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of ``docs``.

    Tokens are those of a space and the whole text: a by the byte-level ``tokenizer_path`` (``ranks_path``: the same
    vocabulary for a faster encoder), b by the pieces of ``pieces_path``, which sets the space itself; strings of special
    tokens are plain text. Null and empty texts, and texts whose bytes a tokenizer doesn't give back, have no tokens:
    zeros and an empty hash. A pair's count is the number of rows that link it. Repeated and null ids are rows of
    their own; other columns are ignored; an empty table gives an empty result. A chunk holds about ``most`` pairs, or one document.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # tasks come again with the same rows, and what later steps read is written once
    chunks = saved(texts.mapInArrow(_chunks((tokenizer_path, ranks_path, pieces_path), most), CHUNK), "aligned")
    held = chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "docs")).alias("place", "p")).select("chunk", "place", F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs"))
    counts = saved(held.groupBy("pair").agg(F.sum("docs").alias("n")), "pair-counts")
    first = F.shiftright("pair", 32)
    highest = counts.groupBy(first.alias("a")).agg(F.max("n").alias("most"))
    judged = counts.withColumn("a", first).join(highest, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    back = held.select("chunk", "place", "pair").join(judged, "pair").select(F.col("chunk").alias("of"), "place", "n", "best")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    told = chunks.drop("docs").groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(_told, schema)
    return told.withColumnRenamed("doc_id", id_col)


def linked_pairs(docs: DataFrame, tokenizer_path: str, pieces_path: str, ranks_path: str | None = None, most: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, n, best): every pair of ids that some row of ``docs`` links, the number of rows that do, and whether no pair of ``a`` has more."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chunks = texts.mapInArrow(_chunks((tokenizer_path, ranks_path, pieces_path), most), CHUNK)
    counts = saved(chunks.select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.docs").alias("n")), "pair-counts")
    pairs = counts.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND((1 << 32) - 1).alias("b"), "n")
    return pairs.join(pairs.groupBy("a").agg(F.max("n").alias("most")), "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))
