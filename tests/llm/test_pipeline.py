"""The pipeline's stages against brute force, and its run over a small folder."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import SCHEMA, corpus
from tremorloom.llm import bpe


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_stages_chain(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, folder).persist()
        assert docs.columns == columns, name
        sizes.append(docs.count())
        if name == "lines":
            assert {1, 2, 20, 21, 22} <= {r["doc_id"] for r in docs.collect()} and not {3, 7} & {r["doc_id"] for r in docs.collect()}
            seen = {}
            for r in docs.where("text IS NOT NULL AND doc_id IS NOT NULL").collect():
                for line in r["text"].split("\n"):
                    if line.strip():
                        assert seen.setdefault(line.strip(" \t\r\x0b\x0c"), r["doc_id"]) == r["doc_id"]
            assert docs.where("text IS NOT NULL AND n_chars <> length(text)").count() == 0
        if name == "near copies":
            assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
    assert sizes[0] == len(corpus())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert last.count() == sizes[-1]


def test_lines_are_not_sorted_in_the_filter(spark, folder):
    """The filter of the lines stage reads the lines that stay; it does not find them again for each of its conditions."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plan = corpus_pipeline.deduplicate_lines(spark, docs, folder)._jdf.queryExecution().optimizedPlan().toString()
    filters = [x.split("+-")[0] for x in plan.split("Filter ")[1:] if "array_join" in x.split("+-")[0]]
    assert filters and not any("sort_array" in x for x in filters)


def test_run_equals_the_stages(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    c = bpe.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), bpe.PATTERN)
    want = sorted((r["doc_id"] or -1, len(next(c.documents([r["text"] or ""]))[0].split())) for r in docs.collect())
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in got.select("doc_id", F.col("n_tokens")).collect()) == want
