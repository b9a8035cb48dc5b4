"""Streams of training records: intake, dead letters, event-time windows, sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", files_per_trigger: int = 16) -> DataFrame:
    """New files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(path)


def with_dead_letters(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, text_of_row: str) -> DataFrame:
    """fn over whole batches; one that fails is halved until its bad rows stand alone.  A bad row keeps _error and _row, its other columns are null.

    A batch of n rows, k of them bad, takes at most 2k log2(n) + 1 calls, and never more than 2n.  Use good_rows and bad_rows to
    part the result, on batches and on streams alike.
    """
    names = [f.split()[0].strip("`") for f in schema.split(",")]

    def run(pdf: pd.DataFrame, made: list[pd.DataFrame], bad: list[tuple[str, str]]) -> None:
        try:
            made.append(fn(pdf))
        except Exception as e:  # noqa: BLE001 - whatever a user's function raises goes to the dead letters
            if len(pdf) < 2:
                bad += [(f"{type(e).__name__}: {e}", str(x)) for x in pdf[text_of_row]]
                return
            half = len(pdf) // 2
            run(pdf.iloc[:half], made, bad)
            run(pdf.iloc[half:], made, bad)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made: list[pd.DataFrame] = []
            bad: list[tuple[str, str]] = []
            run(pdf, made, bad)
            # pieces whose columns differ in type stay apart: put together, a null would turn large integers into floats
            for _, alike in groupby(made, lambda piece: (tuple(piece.columns), tuple(piece.dtypes))):
                yield pd.concat(alike, ignore_index=True).assign(_error=None, _row=None).reindex(columns=[*names, "_error", "_row"])
            if bad:
                yield pd.DataFrame(bad, columns=["_error", "_row"]).reindex(columns=[*names, "_error", "_row"])

    return df.mapInPandas(whole, f"{schema}, _error string, _row string")


def good_rows(df: DataFrame) -> DataFrame:
    return df.where("_error IS NULL").drop("_error", "_row")


def bad_rows(df: DataFrame) -> DataFrame:
    return df.where("_error IS NOT NULL").select("_error", "_row")


def windowed_means(stream: DataFrame, ts: str, value: str, window: str = "1 hour", late: str = "10 minutes", by: str | None = None) -> DataFrame:
    """Means per event-time window; later rows than the watermark are dropped."""
    keys = [F.window(ts, window).alias("w"), *([F.col(by)] if by else [])]
    out = stream.withWatermark(ts, late).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return out.select(F.col("w.start").alias("start"), *([by] if by else []), "n", "mean")


def append_json(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Rows appended as JSON lines, exactly once by the sink's log."""
    w = stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()


def for_each_batch(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """fn(batch, number) for everything that is there now; a number seen again means a retry."""
    return stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
