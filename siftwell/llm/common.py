"""Helpers shared by the corpus operators: table access, sizing, checkpoints and Arrow glue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.sources.scratch import discard, materialise, remove, scratch, shared_dir

__all__ = ["bounded_batches", "carried", "discard", "materialise", "remove", "restored", "scratch", "shared_dir", "shuffled", "shuffle_partitions", "table"]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of joins that are never broadcast.

    Spark estimates a table by its compressed file and an exploded one by what it was before, so tables that grow with the
    input would pass for small ones and fill the driver.
    """
    return df.hint("merge")


def bounded_batches(spark: SparkSession, size: str = "16m") -> None:
    """Arrow batches of at most this size, unless the session has its own bound: long texts then can't fill a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).lower() in ("67108864b", "67108864", "64m", "64mb"):
        spark.conf.set(key, size)


def carried(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and all others in one column ``row``, so that no name of theirs meets a name of the operator's."""
    rest = [c for c in docs.columns if c not in needed]
    packed = [F.struct(*(F.col("`" + c.replace("`", "``") + "`").alias(f"c{i}") for i, c in enumerate(rest))).alias("row")] if rest else []
    return docs.select(*needed, *packed)


def restored(rows: DataFrame, docs: DataFrame, *needed: str, **changed: Column) -> DataFrame:
    """The columns of docs again, in their order; changed ones are computed from the columns of rows."""
    place = {c: f"c{i}" for i, c in enumerate(c for c in docs.columns if c not in needed)}
    return rows.select(*(changed.get(c, F.col("row")[place[c]] if c in place else F.col(c)).alias(c) for c in docs.columns))
