"""Long computations in chunks that can be stopped and gone on with: finished chunks are kept, half-written ones are never seen."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from tremorloom.sources.published import exists, moved, names, removed


def signed(spark: SparkSession, folder: str, signature: str) -> None:
    """Bind a folder to the signature of its inputs; a folder that another one holds is refused."""
    place = f"{folder}/signature"
    if not exists(spark, place):
        staging = f"{folder}/staging-{uuid.uuid4().hex}"
        spark.createDataFrame([(signature,)], "signature string").coalesce(1).write.parquet(staging)
        try:
            moved(spark, staging, place)
        except FileExistsError:
            removed(spark, staging)  # another attempt was first
    if (found := spark.read.parquet(place).first()["signature"]) != signature:
        raise ValueError(f"{folder} belongs to inputs {found}, not {signature}")


def finished(spark: SparkSession, folder: str) -> set[str]:
    """Chunks that are complete."""
    return {n.removeprefix("chunk=") for n in names(spark, f"{folder}/done") if n.startswith("chunk=")}


def resumed(spark: SparkSession, folder: str, signature: str, chunks: Sequence[str], compute: Callable[[str], DataFrame]) -> DataFrame:
    """The rows of all chunks, with column chunk; only those that are not finished are computed.

    A chunk is written beside its place and renamed once it is whole. If two attempts compute the same chunk, the first stays.
    """
    if len(set(chunks)) != len(chunks) or any("/" in c or not c for c in chunks):
        raise ValueError("chunks need different plain names")
    signed(spark, folder, signature)
    done = finished(spark, folder)
    for chunk in chunks:
        if chunk in done:
            continue
        staging = f"{folder}/staging-{uuid.uuid4().hex}"
        compute(chunk).write.parquet(staging)
        try:
            moved(spark, staging, f"{folder}/done/chunk={chunk}")
        except FileExistsError:
            removed(spark, staging)
    rows = spark.read.option("basePath", f"{folder}/done").parquet(*[f"{folder}/done/chunk={c}" for c in chunks])
    return rows.withColumn("chunk", rows["chunk"].cast("string"))
