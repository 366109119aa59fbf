"""Near-duplicate pairs beyond the bands: the prefix join against brute force, and texts of one template in work that grows with their number."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tapestone.llm import minhash, prefix_pairs

SCHEMA = "rep long, component long, text string"


def alike(a: set, b: set, percent: int) -> bool:
    return 100 * len(a & b) >= percent * len(a | b)


def drawn_texts(seed: int) -> list[tuple[int, int, str]]:
    """Families of edited word lists of many lengths, one-word texts and repeated texts, in random components."""
    draw, rows = random.Random(seed), []
    for _ in range(40):
        words = [f"w{draw.randrange(300)}" for _ in range(draw.choice([1, 2, 3, 8, 30, 120]))]
        for _ in range(6):
            text = [f"x{draw.randrange(9**6)}" if draw.random() < draw.choice([0, 0.02, 0.06]) else w for w in words]
            rows.append(" ".join(text[: max(1, len(text) - draw.randrange(1 + len(text) // 6))]))
    return [(i, draw.choice([i, i, 1000 + i % 7]), t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("k,percent,split", [(1, 80, 2000), (2, 80, 2), (2, 60, 2000), (5, 80, 3)])
def test_no_pair_is_left_out(spark, monkeypatch, k, percent, split):
    monkeypatch.setattr(prefix_pairs, "SPLIT", split)
    rows = drawn_texts(k)
    sets = {r: set(minhash.shingle_set(minhash.words_of(t.encode()), k, {}).tolist()) for r, _, t in rows}
    want = {(a, b) for a, ca, _ in rows for b, cb, _ in rows if a < b and ca != cb and alike(sets[a], sets[b], percent)}
    found = [tuple(r) for r in prefix_pairs.prefix_pairs(spark.createDataFrame(rows, SCHEMA).repartition(5), minhash._sets(k), percent).collect()]
    component = {r: c for r, c, _ in rows}
    assert want and want <= set(found) and len(found) == len(set(found))
    assert all(a < b and component[a] != component[b] for a, b in found)


def test_prefix_lengths_are_the_least_that_serve():
    for percent in (50, 80, 100):
        for n in range(1, 300):
            few, many = prefix_pairs.prefix_lengths(n, percent)
            assert many == n - -(-percent * n // 100) + 1 and few == n - -(-2 * percent * n // (100 + percent)) + 1
            assert 1 <= few <= many <= n


def templates(n: int, own: int, seed: int = 4) -> list[tuple[int, int, str]]:
    """Texts of 200 words, of which ``own`` stand in no other, where those are drawn afresh; every tenth is followed by a near copy."""
    draw, rows = random.Random(seed), []
    shared = [f"t{i}" for i in range(200 - own)]
    for i in range(n):
        words = shared + [f"o{draw.randrange(10**12)}" for _ in range(own)]
        rows.append((2 * i, 2 * i, " ".join(words)))
        if i % 10 == 0:
            rows.append((2 * i + 1, 2 * i + 1, " ".join([*words[:-2], "a", "b"])))
    return rows


@pytest.mark.parametrize("own", [50, 30])
def test_templates_meet_near_copies_only(spark, own):
    """Of 3,000 texts of one template (5.4 million pairs of a bucket), the pairs to look at are the near copies."""
    rows = templates(3000, own)
    found = prefix_pairs.prefix_pairs(spark.createDataFrame(rows, SCHEMA).repartition(8), minhash._sets(1), 80)
    assert sorted(tuple(r) for r in found.collect()) == [(2 * i, 2 * i + 1) for i in range(0, 3000, 10)]


def test_template_documents_keep_their_links(spark):
    rows = templates(10_000, 50)
    docs = spark.createDataFrame([(r, t) for r, _, t in rows], "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r["component_id"] for r in minhash.find_near_duplicates(docs, k=2).collect()}
    assert got == {r: r - r % 2 for r, _, _ in rows}


def test_odd_tables(spark):
    empty = prefix_pairs.prefix_pairs(spark.createDataFrame([], SCHEMA), minhash._sets(2), 80)
    assert empty.count() == 0
    same = prefix_pairs.prefix_pairs(spark.createDataFrame([(1, 1, "a"), (2, 2, "a"), (3, 1, "a"), (4, 4, "")], SCHEMA), minhash._sets(2), 80)
    assert sorted(map(tuple, same.collect())) == [(1, 2), (2, 3)]
    assert np.array_equal(prefix_pairs._slots(np.zeros(1, np.uint64)), [0])
