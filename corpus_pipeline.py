"""A corpus from documents: language ID, near-duplicates, decontamination, mixing, token shards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratalog.llm import decontam, langid, mixing, simhash, tokenbin
from stratalog.llm.common import cut
from stratalog.runtime import attach

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence; a NULL, empty or blank text has none. Trained on these documents.

    Repeated rows go or stay together; texts of any length are read whole; an empty table stays empty; other columns, whatever their names, stay.
    """
    attach(spark)
    return langid.keep_identified(docs, langid.train(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group, and all others. Rows that repeat an id stay or go together.

    Rows without an id, and those with a NULL, empty or wordless text, stay. Texts of any length are compared whole; an empty table stays empty; other columns stay.
    """
    attach(spark)
    return simhash.drop_near(docs, simhash.near_groups(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a leaked test item; rows that repeat a leaking document's id go with it.

    Rows without an id or text stay, as none is found in them. Texts of any length are read whole; an empty table, here or of items, removes nothing; other columns stay.
    """
    attach(spark)
    return decontam.drop_leaks(docs, decontam.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight and the budget (all tokens that came in) have it read, in the order of the permuted blocks.

    Rows without an id, and rows that repeat one, are read as any other; NULL is a source; a NULL or empty text counts no tokens; texts of any length stay whole;
    an empty table stays empty; other columns stay.
    """
    attach(spark)
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards, a row each. Rows without an id or text are left out; an empty text is an empty frame, repeated rows a frame each; a text of any length is one frame; an empty table gives no shards; other columns don't matter."""
    attach(spark)
    return tokenbin.token_shards(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage{k}")
    return docs
