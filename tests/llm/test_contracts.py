"""Each query against a brute-force version on whole tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from tapestone.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_sharding(spark, docs):
    rows = queries.op1_sharding(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        text = (docs[r["doc_id"]] or "").encode()
        assert r["size"] == len(text) + 1 and r["text_crc32"] == zlib.crc32(text)
    shards = defaultdict(list)
    for r in rows:
        shards[r["shard"]].append(r["slot"])
    assert sorted(shards) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    sizes = [len(s) for s in shards.values()]
    assert max(sizes) - min(sizes) <= 1


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    import numpy as np

    rows = queries.op2_packing(spark, SF).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(docs)
    for doc_id, pieces in by_doc.items():
        ids = np.array([*tokenizer.encode(docs[doc_id] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048 and len(pieces) <= 64
        assert at & (at - 1) == 0  # full, or a power of two: nothing is padded


def test_rules(spark, docs):
    for r in queries.op4_quality_rules(spark, SF).collect():
        text = docs[r["doc_id"]] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        inside = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(words) < 20 or 100 * len(inside) > 30 * len(words))
        assert not (r["base_failed"] and r["kept"])


def test_rules_follow_labels(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in queries.op4_quality_rules(spark, SF).collect() if r["doc_id"] in labels]
    good = [r["kept"] for r in rows if labels[r["doc_id"]] == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in rows if labels[r["doc_id"]] == 0]
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) < 0.2


def _shingles(text: str, k: int) -> set:
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words)} if 0 < len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def test_near_duplicates(spark, docs):
    sets = {i: _shingles(t, 2) for i, t in docs.items()}
    ids, at = sorted(docs), defaultdict(list)
    for i in ids:
        for s in sets[i]:
            at[s].append(i)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        shared = Counter(j for s in sets[i] for j in at[s] if j < i)
        for j, n in shared.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    rows = queries.op6_minhash(spark, SF).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows} == {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_toxicity(spark):
    at = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    rows = queries.op7_toxicity(spark, at).collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    told = [(labels[r["doc_id"]], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    pairs = [(p > n) + 0.5 * (p == n) for a, p in told if a for b, n in told if not b]
    assert sum(pairs) / len(pairs) > 0.95


def _base(text: str) -> list[tuple[str, int, int]]:
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]
    return out


def test_personal_data(spark, docs):
    kinds = ("email", "ip", "card", "phone")
    seen = Counter()
    for r in queries.op8_pii(spark, SF).collect():
        base = _base(docs[r["doc_id"]] or "")
        assert [r[f"n_{k}"] for k in kinds] == [sum(s[0] == k for s in base) for k in kinds]
        told = [":".join(map(str, s)) for s in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert set(told) <= set(r["spans"].split(","))
        seen.update(s[0] for s in base)
    assert all(seen[k] for k in kinds)


def test_resampling(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op5_quality_classifier(spark, SF).collect()
    keys = sorted((-r["gumbel_key"], r["doc_id"]) for r in rows)
    assert {r["doc_id"] for r in rows if r["selected"]} == {i for _, i in keys[: round(len(rows) / 2)]}
    mean = lambda q: (lambda x: sum(x) / len(x))([r["log_weight"] for r in rows if labels.get(r["doc_id"]) == q])
    assert mean(1) > mean(0)
