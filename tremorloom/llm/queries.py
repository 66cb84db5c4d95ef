"""The numbered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tremorloom.llm import bpe, chat, exact, fingerprints, jaccard, language, lines, media, mixing, phrases, quality, substrings, trie
from tremorloom.llm.common import table


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.component_report(table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_report(table(spark, sf_dir, "documents"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_report(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.recovered(table(spark, sf_dir, "conversations"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collocations of every language of documents; nulls, empty and long texts, ties and empty tables as phrases states."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations; nulls, ties, repeated rows and empty tables as trie states."""
    return trie.trie_report(table(spark, sf_dir, "conversations"))


def op13_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every text of documents; nulls, repeated rows and empty texts as exact.copy_report states."""
    return exact.copy_report(table(spark, sf_dir, "documents")).drop("identity")


QUERIES = {"op1_lines": op1_lines, "op2_bpe": op2_bpe, "op3_mixing": op3_mixing, "op4_quality": op4_quality, "op5_jaccard": op5_jaccard, "op6_fingerprints": op6_fingerprints, "op7_substrings": op7_substrings, "op8_language": op8_language, "op9_media": op9_media, "op10_chat": op10_chat, "op11_phrases": op11_phrases, "op12_trie": op12_trie, "op13_exact": op13_exact}
ORACLES: dict[str, str] = {"op3_mixing": mixing.ORACLE, "op11_phrases": phrases.ORACLE, "op12_trie": trie.ORACLE, "op13_exact": exact.ORACLE}
