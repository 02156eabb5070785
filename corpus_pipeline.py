"""The corpus pipeline: five stages from raw documents to a token store.

Languages that are not known go, one document of each near-duplicate group
stays, documents with benchmark passages go, sources are mixed to their target
weights, and what is left is written as a token store and read back.

Every stage takes rows with nulls in any column and texts of any length, and
gives an empty table for an empty one. All stages but the last return the
columns of their input, whatever those are called, and keep rows that repeat
another one unless the stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiweave.llm import decontamination, language_id, mixing, near_dedup, token_store
from lexiweave.runtime import Scratch


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose text is null or has no letter; the rest has a language.

    Texts with a letter stay whatever their language scores, and also when no
    row names a language to learn from.
    """
    return language_id.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each near-duplicate group.

    Of rows that repeat this id all stay. Rows with a null id count as larger
    than all ids: one stays of a group that has nothing else. Texts without a
    word are in no group.
    """
    return near_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item; null items and items without words have none."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take words of each source up to its target; repeats come as further rows.

    A null source is a source, the last one. Documents of which nothing is
    taken, such as those without words, do not appear.
    """
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token store and return one row per document read back from it, ordered by id, null ids first, and by text."""
    import public_tokenizers

    path = f"{Scratch(spark, 'pipeline').root}/store"
    token_store.write_store(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.read_store(spark, path)


STAGES = [
    ("language_id", known_language),
    ("near_dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("source_mix", mix_sources),
    ("token_store", write_tokens),
]

#: Sketches, draws and tokenizers are not for SQL: tests/llm/test_pipeline.py holds each stage against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    scratch = Scratch(spark, "stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return scratch.keep(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
