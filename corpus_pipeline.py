"""The training-data pipeline: language ID, exact dedup, near dedup, source mixing, packing.

Each stage takes all that its predecessor kept and is written as Parquet before the next reads it.

Defined cases, for every stage: any column may be null, texts may be empty or very long, columns of other
names pass through all stages but the last, and an empty table gives an empty result. What each stage
does with nulls, ties and repeated rows is said at the stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propgraph.llm import langid, mixing
from propgraph.llm.exact_dedup import DigestIndex
from propgraph.llm.minhash import near_duplicates
from propgraph.llm.packing import digests, pack
from propgraph.plans.staging import new_path, staged

#: A document in which no language makes up this share is rejected, like one without letters.
LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language was recognised.

    Null texts and texts without letters go. Rows that repeat share their fate; rows with a null id or null
    language are judged like others, but nothing is learned from them. Without any labelled text all go.
    """
    found = langid.identify(docs, langid.fit(docs))
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= LEAST_SHARE)).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space.

    The row with the most characters stays, then that of the least id, a null id last; of rows that are equal in
    id and length one, and of rows equal in all columns one. Null counts as the empty text.
    """
    return DigestIndex(spark, new_path(spark, "digest-index")).unique(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the least id.

    Rows with a null id and texts without words are linked with nothing and stay; rows of one id share their fate.
    """
    rows = near_duplicates(docs)
    gone = rows.groupBy(F.col("id").alias("doc_id")).agg(F.bool_or("kept").alias("kept")).filter("not kept")
    return docs.join(gone.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as bring the sources to their weights.

    A null source is a source of its own, the last. Texts without words get the whole copies of their source.
    Rows that repeat are taken together. Ties in the seeded order go by id.
    """
    rows = mixing.mix(docs, F.array(F.col("source").cast("string")), mixing.one_two_three).documents
    copies = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))
    return rows.filter("copies > 0").select("row", copies.alias("copy")).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of 2048 tokens.

    Null and empty texts are a document of the end id alone; rows that repeat are packed each for itself; a
    null id stays null.
    """
    return digests(pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("packing", packing),
]

#: SQL cannot express the language models, the seeded choice or the tokenizer; tests/llm/test_pipeline.py has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
