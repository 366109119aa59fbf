"""Vector bin packing of token sequences by the dot-product heuristic, under limits on tokens, segments and loss tokens.

Each task packs the documents of its partition: documents longer than a sequence give whole sequences, and what is left
waits in a pool. A sequence takes from the pool, again and again, the piece whose demand has the greatest dot product
with what the sequence still has of each resource. A piece that doesn't fit is cut to fit. A sequence that closes early
is cut back to a power of two, which needs no padding.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, per_worker

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, loss_tokens long, sequence_id long, offset long"


class Tokens:
    """Token ids of texts as little-endian 32-bit bytes.

    A byte-level BPE never merges across the start of white space that follows other characters, so each such segment is
    encoded once and kept. Texts that hold a special token's string go to the tokenizer whole. ``ranks_path``, the same
    vocabulary for a faster encoder, is optional.
    """

    KEPT, LONGEST = 400_000, 48

    def __init__(self, tokenizer_path: str, ranks_path: str | None) -> None:
        import re

        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer_path)
        with open(tokenizer_path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f).get("added_tokens", [])]
        self.encode = lambda s: self.whole.encode(s, add_special_tokens=False).ids
        if ranks_path:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        space = r"\t-\r \x85\xa0  -     　"
        self.segments = re.compile(f"[{space}]*[^{space}]+|[{space}]+").findall
        self.kept: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        kept, out = self.kept, []
        for s in self.segments(text):
            ids = kept.get(s)
            if ids is None:
                ids = np.asarray(self.encode(s), "<u4").tobytes()
                if len(kept) < self.KEPT and len(s) <= self.LONGEST:
                    kept[s] = ids
            out.append(ids)
        return b"".join(out)


class Packer:
    """Packs the pieces that it is given; ``rows`` holds what is placed."""

    def __init__(self, first_id: int, tokens: int, segments: int, loss: int, pool: int) -> None:
        self.limits = np.array([tokens, segments, loss], np.float64)
        self.tokens, self.segments, self.loss = tokens, segments, loss
        self.next_id, self.rows = first_id, []
        #: of each waiting piece: demand, and (doc, start, end, first loss-bearing token)
        self.demand, self.pieces, self.pool = np.zeros((pool, 3)), [], pool

    @staticmethod
    def loss_of(start: int, end: int, loss_from: int) -> int:
        return max(0, end - max(start, loss_from))

    def wait(self, doc, start: int, end: int, loss_from: int) -> None:
        if len(self.pieces) == len(self.demand):
            self.demand = np.concatenate([self.demand, np.zeros_like(self.demand)])
        self.demand[len(self.pieces)] = end - start, 1, self.loss_of(start, end, loss_from)
        self.pieces.append((doc, start, end, loss_from))

    def take(self, i: int):
        piece, last = self.pieces[i], self.pieces.pop()
        if i < len(self.pieces):
            self.pieces[i] = last
            self.demand[i] = self.demand[len(self.pieces)]
        return piece

    def add(self, doc, n: int, loss_from: int) -> None:
        start = 0
        while n - start >= self.tokens and self.loss_of(start, start + self.tokens, loss_from) <= self.loss:
            self.emit([(doc, start, start + self.tokens, loss_from)])
            start += self.tokens
        if start < n:
            while len(self.pieces) >= self.pool:  # each sequence places at least one token
                self.fill()
            self.wait(doc, start, n, loss_from)

    def emit(self, pieces: list) -> None:
        at = 0
        for doc, start, end, loss_from in pieces:
            self.rows.append((doc, start, end, self.loss_of(start, end, loss_from), self.next_id, at))
            at += end - start
        self.next_id += 1

    def fill(self) -> None:
        """One sequence from the pool."""
        chosen, length = [], 0
        left = self.limits.copy()
        while self.pieces and left.min() > 0:
            demand = self.demand[: len(self.pieces)]
            score = (demand / self.limits) @ (left / self.limits)
            fits = (demand <= left).all(1)
            i = int(np.argmax(np.where(fits, score, -1.0) if fits.any() else score))
            doc, start, end, loss_from = self.take(i)
            if not fits[i]:
                cut = min(end, start + int(left[0]), max(start, loss_from) + int(left[2]))
                self.wait(doc, cut, end, loss_from)
                end = cut
            chosen.append((doc, start, end, loss_from))
            length += end - start
            left -= end - start, 1, self.loss_of(start, end, loss_from)
        whole = length if length == self.tokens else 1 << (length.bit_length() - 1)
        while length > whole:  # closed early: what is over the power of two waits again
            doc, start, end, loss_from = chosen.pop()
            over = min(length - whole, end - start)
            if end - over > start:
                chosen.append((doc, start, end - over, loss_from))
            self.wait(doc, end - over, end, loss_from)
            length -= over
        self.emit(chosen)


def _pack(tokenizer_path: str, ranks_path: str | None, end_id: int, tokens: int, segments: int, loss: int, pool: int):
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = per_worker(("tokens", tokenizer_path, ranks_path), lambda: Tokens(tokenizer_path, ranks_path))
        packer = Packer(TaskContext.get().partitionId() << 32, tokens, segments, loss, pool)
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "loss_tokens", "sequence_id", "offset"]

        def out() -> pa.RecordBatch:
            rows, packer.rows = packer.rows, []
            columns = [[d[0] for d, *_ in rows], [r[1] for r in rows], [r[2] - r[1] for r in rows], [d[1][4 * s : 4 * e] for d, s, e, *_ in rows], [len(d[1]) // 4 for d, *_ in rows], [r[3] for r in rows], [r[4] for r in rows], [r[5] for r in rows]]
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            prompts = byte_texts(batch.column(2)) if batch.num_columns > 2 else None
            for i, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), strict=True)):
                prompt = encode(prompts[i].decode("utf-8", "replace")) if prompts else b""
                ids = prompt + encode(text.decode("utf-8", "replace")) + end
                packer.add((doc_id, ids), len(ids) // 4, len(prompt) // 4)
                if len(packer.rows) >= 2000:
                    yield out()
        while packer.pieces:
            packer.fill()
        if packer.rows:
            yield out()

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, end_id: int = 1, max_tokens: int = 2048, max_segments: int = 64, max_loss: int = 2048, pool: int = 256, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None) -> DataFrame:
    """The pieces of all documents, each with its place in a sequence (``sequence_id``, ``offset``) and its ``ids``.

    A document is the ids of its prompt, if any, of its text (null: empty) and ``end_id``; the prompt's ids bear no
    loss. A sequence has at most ``max_tokens`` tokens, ``max_segments`` pieces and ``max_loss`` loss-bearing tokens.
    Each partition is packed by itself in the order that it is read, so nothing is shuffled and a task that runs again
    after a lost executor replaces its own sequences only. A repeated or null id is packed like any other; an empty
    table gives an empty result; columns not named are ignored.
    """
    cols = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")] + ([F.col(prompt_col).alias("prompt")] if prompt_col else [])
    return docs.select(*cols).mapInArrow(_pack(tokenizer_path, ranks_path, end_id, max_tokens, max_segments, max_loss, pool), SCHEMA)
