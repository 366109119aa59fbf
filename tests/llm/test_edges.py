"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import random
import re

import public_tokenizers
import pytest

import corpus_pipeline
from tapestone.llm import exact_dedup, line_dedup, minhash, mixing, packing, pii, quality_classifier, quality_rules, sharding, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, n_removed string, toxicity string, topic int, tokens int, kept string"
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
LONG = "word thing other " * 20_000 + "x" * 50_000 + "1" * 50_000 + "@" * 1000


@pytest.fixture(scope="module")
def odd(spark):
    def row(i, text, lang="en", source="s0"):
        return (i, text, lang, source, None, 1, "x", "y", 2, 3, "z")

    rows = [row(1, None), row(2, ""), row(3, " \t\n"), row(4, LONG), row(5, "a b c"), row(5, "a b c"), row(6, "a b c", None, None), row(None, "a b c"), row(7, "A  b\nc"), row(8, "<|endoftext|> end"), row(9, "é" * 30)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 0), (5, 0, 1), (5, 0, 1), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "sharding": lambda d, _: sharding.shuffle_into_shards(d, 3),
    "mixing": lambda d, _: mixing.mix(d),
    "rules": lambda d, x: quality_rules.judge_quality(d, x),
    "classifier": lambda d, x: quality_classifier.resample_by_importance(d, x),
    "minhash": lambda d, _: minhash.find_near_duplicates(d),
    "toxicity": lambda d, x: toxicity.score_documents(d, toxicity.train(d, x)),
    "pii": lambda d, _: pii.find_personal_data(d),
    "redact": lambda d, _: pii.redact(d),
    "lines": lambda d, _: line_dedup.remove_boilerplate(d),
    "exact": lambda d, _: exact_dedup.find_exact_duplicates(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(odd, labels, name):
    assert OPERATORS[name](odd, labels).count() == odd.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(odd, labels, name):
    assert OPERATORS[name](odd.limit(0), labels.limit(0)).count() == 0


def test_packing_odd(odd):
    rows = packing.pack_documents(odd, *PATHS).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == 1
    assert sum(r["length"] for r in rows if r["doc_id"] == 8) == 3  # the special token is one id
    assert packing.pack_documents(odd.limit(0), *PATHS).count() == 0


def test_packing_limits(spark):
    docs = spark.createDataFrame([(i, "please answer " * (i % 40), "yes it is so " * (1 + i % 60)) for i in range(400)], "doc_id long, prompt string, text string")
    rows = packing.pack_documents(docs.coalesce(1), *PATHS, max_tokens=512, max_segments=4, max_loss=256, prompt_col="prompt").collect()
    used: dict = {}
    for r in rows:
        u = used.setdefault(r["sequence_id"], [0, 0, 0])
        u[0], u[1], u[2] = u[0] + r["length"], u[1] + 1, u[2] + r["loss_tokens"]
    assert all(a <= 512 and b <= 4 and c <= 256 for a, b, c in used.values())
    assert max(u[2] for u in used.values()) > 200


def test_exact_odd(odd):
    rows = [r.asDict() for r in exact_dedup.find_exact_duplicates(odd).collect()]
    assert {r["group_size"] for r in rows if r["doc_id"] in (1, 2, 3)} == {3}
    assert all(r["keep_id"] == 3 for r in rows if r["doc_id"] in (1, 2, 3))  # the most code points
    assert {r["keep_id"] for r in rows if r["doc_id"] in (5, 6, None)} == {5}


def test_directory_splits(spark):
    keys = spark.range(5000).selectExpr("xxhash64(id) as key")
    cells, depth = exact_dedup.directory(keys, 100)
    found = keys.selectExpr(f"shiftrightunsigned(key, {64 - depth}) as cell").join(cells, "cell").groupBy("bucket").count().collect()
    assert len(found) >= 50 and max(r["count"] for r in found) <= 100 and cells.count() == 1 << depth


def test_minhash_odd(odd):
    rows = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.find_near_duplicates(odd, k=2).collect()}
    assert {(1, 1, True), (2, 2, True), (3, 3, True), (5, 5, True), (6, 5, False), (7, 5, False), (None, None, True)} <= rows


def test_minhash_chain(spark):
    """A chain of texts, each near only to its neighbours, beside a large group: no link is lost."""
    words = [f"w{i}" for i in range(400)]
    chain = [(i, " ".join(words[4 * i : 4 * i + 100])) for i in range(70)]
    group = [(1000 + i, " ".join(["g" + str(j if j != i % 90 else 1000 + i) for j in range(100)])) for i in range(200)]
    docs = spark.createDataFrame(chain + group, "doc_id long, text string")
    rows = minhash.find_near_duplicates(docs, k=1).collect()
    assert {r["component_id"] for r in rows if r["doc_id"] < 70} == {0}
    assert {r["component_id"] for r in rows if r["doc_id"] >= 1000} == {1000}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(101, 100), (102, 100)], "a long, b long")
    rows = {r["node"]: r["component"] for r in minhash.components(edges).collect()}
    assert all(rows[i] == 0 for i in range(41)) and all(rows[i] == 100 for i in (100, 101, 102))


def test_components_of_long_chains(spark):
    """Chains of descending and of shuffled ids, whose smallest id is hundreds of links away."""
    order = list(range(1000, 1600))
    random.Random(5).shuffle(order)
    fall = [0, *range(599, 0, -1)]
    edges = [*zip(fall, fall[1:]), *zip(order, order[1:])]
    rows = {r["node"]: r["component"] for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert rows == {i: i // 1000 * 1000 for i in fall + order}


def test_components_limit_raises(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        minhash.components(edges, rounds=1)


def test_kth_greatest(spark):
    keys = spark.range(3000).selectExpr("cast(id % 7 as double) as k", "id")
    rows = sorted(((-(i % 7), i) for i in range(3000)))
    for k in (1, 500, 1500, 3000):
        assert quality_classifier.kth_greatest(keys, "k", "id", k, 16, 50) == (-rows[k - 1][0], rows[k - 1][1])
    assert quality_classifier.kth_greatest(keys, "k", "id", 3001) is None


def test_personal_data_kinds():
    text = "IBAN DE89 3704 0044 0532 0130 00 AND my ssn 123-45-6789, amex card 3782 822463 10005, not 111-11-1112"
    assert [s[0] for s in pii.find(text)] == ["iban", "shortcard", "ssn"]
    assert re.sub("[0-9]", "", text[slice(*pii.find(text)[0][1:3])]).strip() == "DE"


def test_lines(spark):
    shared = "this line is on many sites"
    docs = spark.createDataFrame([(i, f"own text of document {i}\n{shared}\nshort", f"s{i}") for i in range(4)], "doc_id long, text string, source string")
    rows = {r["doc_id"]: r for r in line_dedup.remove_boilerplate(docs).collect()}
    assert shared in rows[0]["text"] and all(shared not in rows[i]["text"] and rows[i]["n_removed"] == 1 and "short" in rows[i]["text"] for i in (1, 2, 3))


def test_rake(spark):
    cells = spark.createDataFrame([("a", "en", "t", 100), ("a", "fr", "t", 50), ("b", "en", "t", 10), ("b", "fr", "t", 20)], "source string, lang string, topic string, tokens long")
    rows = mixing.rake(cells, {"source": 0.0, "lang": 1.0}, 60).collect()
    total = sum(r["weight"] for r in rows)
    assert abs(sum(r["weight"] for r in rows if r["source"] == "a") / total - 0.5) < 1e-6


def test_rare_source_keeps_the_rest(spark):
    """One short document of a source of its own doesn't make the others vanish, and the stated share is kept."""
    docs = [(i, "word " * 20, "en" if i % 4 else "fr", f"s{i % 20 if i % 3 else 0}", 100) for i in range(3000)] + [(9999, "lone word", "en", "rare", 9)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.mix_sources(spark, docs, "").count()
    assert abs(kept / 3001 - 0.8) < 0.03
    rows = mixing.mix(docs, {"source": 0.7, "lang": 0.8}, keep=0.5).collect()
    share = lambda rs: sum(r["tokens"] * r["probability"] for r in rs)
    total = sum(r["tokens"] for r in rows)
    assert abs(share(rows) / total - 0.5) < 1e-6 and all(0 < r["probability"] <= 1 for r in rows)
    assert [r["probability"] for r in rows if r["source"] == "rare"] == [1.0]
    hot, small = (share(r for r in rows if r["source"] == s) for s in ("s0", "s1"))
    tokens = lambda s: sum(r["tokens"] for r in rows if r["source"] == s)
    assert abs(hot / small / (tokens("s0") / tokens("s1")) ** 0.7 - 1) < 0.01
    assert {r["probability"] for r in mixing.mix(docs, keep=1.0).collect()} == {1.0}


def test_pipeline(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, "/root/testdata/sf0.001")
        assert after.columns == docs.columns and after.dtypes == docs.dtypes, name
        assert 0 < after.count() <= docs.count()
    pieces = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert pieces.count() > 0
