"""A pipeline from raw documents to token ids: each stage reads what the one before has kept and written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import lang_id, minmax_dedup, mixing, quality, word_bpe
from tidemark.llm.common import free, table, written

#: Documents whose language is predicted with a smaller cosine, or not at all, are rejected.
MIN_LANGUAGE_SCORE = 0.2


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep."""
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in a language that is recognised."""
    lang, score = free(docs, "lang_pred", "score")
    found = lang_id.predict(docs, lang_id.fit(docs), lang, score)
    return found.where((found[lang] != lang_id.UNKNOWN) & (found[score] >= MIN_LANGUAGE_SCORE)).drop(lang, score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minmax_dedup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, repeated as it takes them, in training order."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, with digests of them and of the text decoded from them."""
    return word_bpe.encode(docs.select("doc_id", "lang", "source", "text"), outputs=True).drop("text", "decoded")


STAGES = [("quality rules", quality_rules), ("language ID", language_id), ("near-duplicates", near_dedup), ("mix", mix_sources), ("BPE", encode)]
#: Models and a tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
