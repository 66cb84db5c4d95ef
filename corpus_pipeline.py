"""A corpus pipeline of five operators: each stage reads what the one before it kept.

Language ID drops documents without an accepted language, line dedup takes repeated lines out of texts, the n-gram Jaccard
join keeps one document of each group of near copies, mixing repeats or leaves out documents by source, and byte-level BPE
encodes what is left. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorloom.llm import bpe, jaccard, language, lines, mixing
from tremorloom.llm.common import checkpoint_folder, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted."""
    return language.accepted_documents(docs)


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others, or their own earlier lines, already have; n_chars follows the text.

    A document all of whose lines go, such as an exact copy, goes too; one that was blank from the start stays.
    """
    kept = lines.without_repeated_lines(docs).where("NOT (coalesce(lines_removed, 0) > 0 AND btrim(text, ' \\t\\r\\n') = '')")
    return kept.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(docs.columns)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the Jaccard join."""
    return jaccard.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, as often as it takes them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix."""
    return bpe.token_digest(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


STAGES = [
    ("language", identify_language),
    ("lines", deduplicate_lines),
    ("near copies", join_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The fuzzy stages and the tokenizer have no SQL counterpart; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again.

    What a stage has written is deleted once the next one has written its rows; only the last stage's input stays.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        if i:
            _delete(spark, f"{folder}/{i - 1}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
