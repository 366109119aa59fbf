"""Hard negatives, license scans and token alignment against brute force and SQL."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tapestone.llm import hard_negatives as hn
from tapestone.llm import license_scan as lic
from tapestone.llm import queries
from tapestone.llm import token_alignment as ta

SF = "/root/testdata/sf0.01"
TOKENS = tuple(public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"))
VECTORS = "vec_id long, embedding array<float>, label int, key int, block string, score double"


# Hard negatives


def _hard(rows, is_anchor, positives=5, negatives=10):
    """Brute force over (id, vector, label) rows, with numbers of any size."""
    used = [(i, [math.floor(256 * float(x)) for x in v], y) for i, v, y in rows if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (a, q, label) in enumerate(used):
        if not is_anchor(a):
            continue
        scored = sorted((-sum(x * z for x, z in zip(q, v)), i, y) for m, (i, v, y) in enumerate(used) if m != n)  # noqa: B905
        for s, i, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out += [(a, i, k + 1, j, -s, -t) for k, (t, j, _) in enumerate(fits)]
    return sorted(out)


def _found(df):
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect())


def test_hilbert_keys_are_one_walk():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = hn.hilbert_keys(cells, bits)
        walk = cells[np.argsort(keys)]
        assert sorted(keys) == list(range(len(cells))) and (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_bounds_hold():
    draw = np.random.default_rng(1)
    a, v = draw.integers(-300, 300, (20, 7)), draw.integers(-300, 300, (50, 7))
    least, greatest = hn.intervals(a, v.min(0)[None], v.max(0)[None])
    scores = hn.products(a, v)
    assert (scores == np.array([[sum(int(x) * int(y) for x, y in zip(p, q)) for q in v] for p in a])).all()  # noqa: B905
    assert (least[:, 0] <= scores.min(1)).all() and (scores.max(1) <= greatest[:, 0]).all()
    big = np.array([[1 << 62, 1 << 62]])
    assert hn.products(big, big)[0, 0] == hn.LONG.max and hn.products(big, -big)[0, 0] == hn.LONG.min and hn.products(big, big * 0 + 1)[0, 0] == hn.LONG.max


def _clusters(n=1500, dim=12, seed=5):
    """Rows of tight clusters, a label each: zone maps rule most blocks out."""
    draw = np.random.default_rng(seed)
    centres = draw.normal(0, 1, (6, dim))
    at = draw.integers(0, 6, n)
    return [(i, (centres[c] + draw.normal(0, 0.05, dim)).astype(np.float32).tolist(), int(draw.random() < 0.3) * 3 + int(c) // 2) for i, c in enumerate(at)]


def test_blocks_that_cannot_matter_are_not_read(spark, monkeypatch):
    rows = _clusters()
    df = spark.createDataFrame([(*r, 0, "b", 0.5) for r in rows], VECTORS)
    seen = []
    needed = hn.needed_blocks

    def counted(batches, blocks, same):
        out = needed(batches, blocks, same)
        seen.append((out.count(), batches.count() * blocks.count()))
        return out

    monkeypatch.setattr(hn, "needed_blocks", counted)
    monkeypatch.setattr(hn, "NEAR", 2)
    assert _found(hn.mine_hard_negatives(df, F.col("vec_id") % 50 == 0, block_rows=16)) == _hard(rows, lambda i: i % 50 == 0)
    assert all(0 < read < 0.7 * every for read, every in seen)


def test_hard_negatives_odd(spark):
    nan, inf = float("nan"), float("inf")
    draw = random.Random(3)
    rows = [(i, [draw.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(3)], i % 3) for i in range(120)]  # ties everywhere
    rows += [(100, [1.0, 0.0, 0.25], 1), (200, None, 1), (201, [1.0, None, 0.0], 1), (202, [nan, 1.0, 1.0], 0), (203, [inf, 1.0, 1.0], 0), (204, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 0), (205, [1.0], 2), (300, [], 1), (301, [1.0, 1.0, 1.0], -4)]
    df = spark.createDataFrame([(*r, 0, "b", 0.5) for r in rows], VECTORS)
    own = [(i, v + [0.0] * (3 - len(v)) if v is not None else None, y) for i, v, y in rows]
    want = _hard(own, lambda i: i % 100 == 0)
    got = _found(hn.mine_hard_negatives(df, F.col("vec_id") % 100 == 0, block_rows=7))
    assert got == want and any(r[0] == 100 for r in got)
    # all rows alike, of one label, and no rows at all
    alike = spark.createDataFrame([(i, [0.5, 0.5], 1, 0, "b", 0.5) for i in range(250)], VECTORS)
    assert _found(hn.mine_hard_negatives(alike, F.col("vec_id") % 100 == 0, block_rows=16)) == []
    assert hn.mine_hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    huge = [(i, [(1.0 if i % 3 else 0.7) * 1e30, 1.0], i % 2) for i in range(8)]  # scores stop at the limits
    assert hn.mine_hard_negatives(spark.createDataFrame([(*r, 0, "b", 0.5) for r in huge], VECTORS), F.col("vec_id") == 0).count() >= 0


# License scans


def _words(text):
    return re.findall(lic.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _blocks(text, threshold, notices=lic.NOTICES):
    words, out = _words(text), []
    for t in lic.templates_of(notices, threshold):
        n, size = t["width"], len(t["words"])
        for start in range(0, max(1, len(words)), n):
            both = len(set(t["words"]) & set(words[start : start + 2 * n]))
            if both >= math.ceil(round(threshold * size, 9)):
                out.append((t["label"], t["id"], start, min(2 * n, len(words) - start), both / size))
    return sorted(out)


def test_license_labels(spark):
    rows = queries.op12_license_scan(spark, SF).collect()
    assert {x for r in rows for x in r["labels"].split(",")} >= {"mit", "apache", "gpl", "reserved", "cc-by", "cc-by-nc"}
    for r in rows[::7]:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.9, 1.0])
def test_blocks_are_all_found(spark, threshold):
    draw = random.Random(9)
    texts = []
    for i in range(120):
        words = [draw.choice(["wind", "the", "river", "of", "license", "and", "this"]) for _ in range(draw.randrange(200))]
        for _ in range(draw.randrange(3)):
            notice = draw.choice(lic.NOTICES)[1].split()
            notice = [w for w in notice if draw.random() > 0.1]
            draw.random() < 0.3 and draw.shuffle(notice)
            at = draw.randrange(len(words) + 1)
            words[at:at] = notice
        texts.append((i, " ".join(w.upper() if draw.random() < 0.1 else w for w in words)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: sorted((b["label"], b["template"], b["start"], b["length"], b["containment"]) for b in r["blocks"]) for r in lic.scan_licenses(df, threshold=threshold).collect()}
    assert got == {i: _blocks(t, threshold) for i, t in texts} and sum(map(len, got.values())) > 20


def test_whole_notices_are_found_wherever_they_stand(spark):
    rows = [(i * 100 + pad, "x " * pad + text.capitalize() + "." + " y" * pad) for i, (_, text) in enumerate(lic.NOTICES) for pad in (0, 1, 7, 33)]
    found = {r["doc_id"]: {b["label"] for b in r["blocks"]} for r in lic.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(lic.NOTICES[i // 100][0] in found[i] for i, _ in rows)


def test_license_odd(spark):
    long = "word " * 100_000 + "CC-BY all rights reserved"
    rows = [(1, None), (2, ""), (3, " .\n"), (4, "cc by cc by"), (4, "CC BY"), (None, "General Public License"), (5, long), (6, "All rightſ reserved, cc bİy, general public licenſe; BK"), (7, "released under the MIT license")]
    df = spark.createDataFrame([(i, t, 1, 2, "m") for i, t in rows], "doc_id long, text string, n_words int, places int, blocks string")
    got = sorted((r["doc_id"] or 0, r["n_words"], [(p["label"], p["at"]) for p in r["places"]], sorted({b["label"] for b in r["blocks"]})) for r in lic.scan_licenses(df).collect())
    assert got == [
        (0, 3, [("gpl", 0)], []), (1, 0, [], []), (2, 0, [], []), (3, 0, [], []), (4, 1, [], []), (4, 4, [("cc-by", 0), ("cc-by", 2)], []),
        (5, 100_005, [("cc-by", 100_000), ("reserved", 100_002)], ["reserved"]), (6, 9, [], []), (7, 5, [], ["mit"]),
    ]
    assert lic.scan_licenses(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        lic.scan_licenses(df, notices=(("none", " . "),))


# Token alignment


def _aligned(texts):
    """All documents at once, with whole texts through either tokenizer."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(TOKENS[0]), sentencepiece.SentencePieceProcessor(model_file=TOKENS[1])
    a.encode_special_tokens = True
    of = ta.byte_of_char()
    told, holds = [], Counter()
    for text in texts:
        raw = f" {text}".encode()
        ids_a, ids_b = (a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        parts_a = [bytes(of[c] for c in a.id_to_token(i)) for i in ids_a]
        parts_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(parts_a) != raw or b"".join(parts_b) != raw:
            told.append(None)
            continue
        ends_a, ends_b = (list(itertools.accumulate(map(len, p))) for p in (parts_a, parts_b))
        groups, x, y = [], [], []
        links = [(ids_a[i], ids_b[j]) for i in range(len(ids_a)) for j in range(len(ids_b)) if ends_a[i] - len(parts_a[i]) < ends_b[j] and ends_b[j] - len(parts_b[j]) < ends_a[i]] if len(ids_a) < 400 else None
        if links is None:  # long texts: the overlapping ones in order
            links, j = [], 0
            for i, e in enumerate(ends_a):
                while True:
                    links.append((ids_a[i], ids_b[j]))
                    if ends_b[j] >= e:
                        j += ends_b[j] == e
                        break
                    j += 1
        both = set(ends_a) & set(ends_b)
        ia = ib = 0
        for end in sorted(both):
            x, y = [], []
            while ia < len(ends_a) and ends_a[ia] <= end:
                x.append(ids_a[ia])
                ia += 1
            while ib < len(ends_b) and ends_b[ib] <= end:
                y.append(ids_b[ib])
                ib += 1
            groups.append(f"{','.join(map(str, x))}|{','.join(map(str, y))}")
        holds.update(set(links))
        told.append((len(ids_a), len(ids_b), groups, links))
    best: dict = defaultdict(int)
    for (p, _), n in holds.items():
        best[p] = max(best[p], n)
    return [
        (0, 0, 0, 0, 0, 0, "") if t is None else (t[0], t[1], len(t[2]), len(t[3]), sum(holds[x] == best[x[0]] for x in t[3]), sum(holds[x] for x in t[3]), hashlib.sha256(";".join(t[2]).encode()).hexdigest())
        for t in told
    ]


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in queries.op13_token_alignment(spark, SF).collect()}
    want = dict(zip([i for i, _ in docs], _aligned([t for _, t in docs]), strict=True))
    assert got == want and any(w[2] < w[0] for w in want.values())


def test_alignment_odd(spark):
    draw = random.Random(2)
    pieces = [" ", "  ", "\n", "\t", " ", "a", "the", "é", "é", "漢字", "😀", "<|endoftext|>", "<s>", "<0x41>", "don't", "1234", "　", " ", "x" * 30, "▁", "\x00", "\x1c", "ﬁ", " ?", "\r\n"]
    texts = [None, "", " ", "▁", "a▁b", "word " * 3000, "y" * 5000] + ["".join(draw.choice(pieces) for _ in range(draw.randrange(1, 30))) for _ in range(300)]
    rows = [(i if i % 9 else None, t, 1, 2, 3) for i, t in enumerate(texts)] + [(5, "word " * 3000, 1, 2, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, chunk int, pairs int, n int")
    want = Counter(zip([r[0] for r in rows], _aligned([r[1] for r in rows]), strict=True))
    for most in (1 << 20, 50):  # one chunk a task, and many
        got = Counter((r["doc_id"], tuple(r[c] for c in NAMES)) for r in ta.align_tokens(df, *TOKENS, most=most).collect())
        assert got == want
    assert sum(w[1][0] > 0 for w in want.elements()) > 100
    assert ta.align_tokens(df.limit(0), *TOKENS).count() == 0


def test_linked_pairs(spark):
    df = spark.createDataFrame([(1, "the wind"), (2, "the river"), (3, None)], "doc_id long, text string")
    pairs = {(r["a"], r["b"]): (r["n"], r["best"]) for r in ta.linked_pairs(df, *TOKENS).collect()}
    assert max(n for n, _ in pairs.values()) == 2 and all(best for _, best in pairs.values())
