"""Writing datasets, predictions, metrics and trackers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.sources.files import write_ply


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any Hadoop file system holds something."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and len(fs.listStatus(p)) > 0


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table under a path, built and written first if there is none."""
    if not exists(spark, path):
        build().write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def save_predictions(rows: DataFrame, predictions: DataFrame, key: str, path: str) -> None:
    """prompt, predict, label by row key; rows without a prediction are left out."""
    rows.join(predictions, key).select("prompt", "predict", "label").write.mode("overwrite").json(path)


def save_pair_scores(scores: DataFrame, path: str) -> None:
    """chosen and rejected, two decimals, halves to the even digit."""
    scores.select(F.bround("chosen", 2).alias("chosen"), F.bround("rejected", 2).alias("rejected")).write.mode("overwrite").json(path)


def append_log(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("append").json(path)


def write_matrix(spark: SparkSession, matrix: list[list[float]], path: str) -> None:
    """One line a row, eight decimals."""
    rows = [(i, *map(float, r)) for i, r in enumerate(matrix)]
    cols = [f"c{i}" for i in range(len(matrix[0]))]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{c} double" for c in cols))
    df.coalesce(1).sortWithinPartitions("i").select(F.format_string(" ".join(["%.8f"] * len(cols)), *cols)).write.mode("overwrite").text(path)


def write_points(points: DataFrame, path: str) -> None:
    """ASCII PLY files, one a partition."""
    write_ply(points, path)


def record_step(spark: SparkSession, path: str, step: int, score: float) -> None:
    """Appends a step to a tracker table."""
    spark.createDataFrame([(step, score)], "step long, score double").coalesce(1).write.mode("append").parquet(path)


def latest_step(spark: SparkSession, path: str) -> int | None:
    return spark.read.parquet(path).agg(F.max("step")).first()[0] if exists(spark, path) else None


def best_step(spark: SparkSession, path: str) -> int | None:
    return spark.read.parquet(path).agg(F.max_by("step", F.struct("score", "step"))).first()[0] if exists(spark, path) else None
