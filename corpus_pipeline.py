"""The corpus pipeline: documents to packed training sequences, each stage one operator of ``tapestone.llm``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapestone.llm import line_dedup, minhash, mixing, packing, toxicity
from tapestone.llm.common import saved, sheltered


def _restored(result: DataFrame, names: dict[str, str]) -> DataFrame:
    """The input's columns, in its order and under its names."""
    return result.select(*[F.col(held).alias(name) for held, name in names.items()])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7, by a model of the labelled rows among ``docs``.

    Null and empty texts score the model's bias; repeated rows and rows of a null id are scored one by one, and the null
    id has no label. Without labels of both kinds all score one half and stay. Other columns, whatever their names, pass
    unchanged; an empty table stays empty.
    """
    held, names = sheltered(docs, "doc_id", "text")
    model = toxicity.train(held.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _restored(toxicity.score_documents(held, model).filter("toxicity < 0.7"), names)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without boilerplate lines; documents of which nothing else is left go.

    ``n_chars``, where there is one, is counted again for texts that changed. Texts that were null or empty before stay as
    they are; rows of one id are cleaned alike, rows of a null id not at all; a null source counts as no site. Other
    columns, whatever their names, pass unchanged; an empty table stays empty.
    """
    held, names = sheltered(docs, "doc_id", "text", "source")
    cleaned = line_dedup.remove_boilerplate(held)
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    kept = cleaned.filter(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in docs.columns:
        chars = next(h for h, c in names.items() if c == "n_chars")
        kept = kept.withColumn(chars, F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col(chars)).cast(docs.schema["n_chars"].dataType))
    return _restored(kept, names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id: shingles of 5 words, similarity 0.8.

    Null and empty texts, and rows of a null id, are in no group and stay; rows of one id stay or go together. Other
    columns, whatever their names, pass unchanged; an empty table stays empty.
    """
    held, names = sheltered(docs, "doc_id", "text")
    found = minhash.find_near_duplicates(held.select("doc_id", "text"), k=5)
    gone = found.filter("not kept").select("doc_id").distinct()
    return _restored(held.join(gone, "doc_id", "left_anti"), names)


#: The share of all tokens that mixing keeps, whatever the skew of the sources.
KEPT_TOKENS = 0.8


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of ``KEPT_TOKENS`` of the tokens whose source and language shares are tempered.

    Null sources and languages are values of their own; null and empty texts have no tokens and share the fate of their
    cell; rows of one id stay or go together, and so do all rows of a null id. Other columns, whatever their names, pass
    unchanged; an empty table stays empty.
    """
    held, names = sheltered(docs, "doc_id", "text", "source", "lang")
    return _restored(mixing.mix(held, {"source": 0.7, "lang": 0.8}, keep=KEPT_TOKENS).filter("selected"), names)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, with their ids.

    Null and empty texts are one end token; repeated rows and rows of a null id are packed like any other. Other columns
    are left behind; an empty table gives no pieces.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_boilerplate), ("near dedup", drop_near_duplicates), ("mixing", mix_sources), ("packing", pack_sequences)]

#: Training, sketches and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, name.replace(" ", "-"))
    return docs
