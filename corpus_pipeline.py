"""A corpus pipeline of five stages over `documents`, each calling one operator of leafmill.llm.

Each stage works on all that the one before kept; all but the last return the columns of
documents. Between stages the rows are written as Parquet and read again, and what a stage left
in the shared folder besides is removed.

Inputs with defined results, for every stage: an empty table gives an empty table; null texts are
texts without words; further columns, whatever their names, travel along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import language_id, line_dedup, mixing, packing, similar_texts
from leafmill.llm.common import scratch_scope, shared_dir, shuffles_removed


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told with a score of at least 0.5.

    Texts that are null or without a letter go; rows without a label aren't needed for fitting;
    without any label every document goes, as no language can be told. Repeated rows stay repeated.
    """
    return language_id.keep_known(docs, language_id.fit(docs), least=0.5)


def remove_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that stand on five sites or more out of all documents but the first.

    No document goes: one all of whose lines are boilerplate becomes empty, a null text stays
    null, repeated rows are treated alike. n_chars follows the text where it changed.
    """
    found = line_dedup.remove_spread_lines(docs)
    changed = F.when(F.col("lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", changed).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies (five words, similarity 0.8 or more) the document with the smallest id.

    Rows with a null id name no group and all stay; texts that are null or without words are
    copies of one another; of repeated rows with the kept id all stay.
    """
    return similar_texts.without_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's target in words; texts become the words taken, repeats after one another.

    Documents of which no word is taken go, those without words among them; a null source is a
    source of its own; repeated rows are mixed each. n_chars follows the text.
    """
    found = mixing.mix_documents(docs)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its place in a sequence; a text without words is a piece of its end id alone, repeated rows are packed each."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_boilerplate),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the naive Bayes, SimHash and permutation stages; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; an empty table gives an empty result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/leafmill/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        with scratch_scope(), shuffles_removed(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
