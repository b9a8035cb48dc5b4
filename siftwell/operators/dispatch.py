"""Scatter and gather: running a function on equal chunks of a frame, as lazily as the frame itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.operators.batch import chunk, concat

Scatter = Callable[[DataFrame, str, int], list[DataFrame]]
Gather = Callable[[list[DataFrame]], DataFrame]


def to_all(df: DataFrame, order: str, workers: int) -> list[DataFrame]:
    """Every worker sees everything."""
    return [df] * workers


def in_chunks(df: DataFrame, order: str, workers: int) -> list[DataFrame]:
    """Equal contiguous chunks; the row count must be divisible."""
    cut = chunk(df, order, workers)
    return [cut.where(F.col("chunk") == i).drop("chunk") for i in range(workers)]


def first_of(parts: list[DataFrame]) -> DataFrame:
    return parts[0]


MODES: dict[str, tuple[Scatter, Gather]] = {"one_to_all": (to_all, first_of), "chunks": (in_chunks, concat), "all_to_all": (lambda df, order, workers: [df], first_of)}


def register_mode(name: str, scatter: Scatter, gather: Gather) -> None:
    if name in MODES:
        raise ValueError(f"mode {name} is registered already")
    MODES[name] = (scatter, gather)


def dispatch(df: DataFrame, order: str, workers: int, fn: Callable[[DataFrame], DataFrame], mode: str = "chunks") -> DataFrame:
    """fn on every worker's part; nothing runs before the result is asked for."""
    scatter, gather = MODES[mode]
    return gather([fn(p) for p in scatter(df, order, workers)])


def ship(df: DataFrame, order: str, workers: int, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A pandas function on each of equal chunks, all in one job: the chunk is the group."""
    cut = chunk(df, order, workers)
    return cut.groupBy("chunk").applyInPandas(lambda pdf: fn(pdf.drop(columns="chunk")), schema)


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Batches of rows in, batches out; the number of rows may change."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield fn(pdf)

    return df.mapInPandas(run, schema)


def once_per_key(df: DataFrame, key: str, inputs: list[str], fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Costly work done once per key and joined back to all of the key's rows."""
    made = fn(df.select(key, *inputs).dropDuplicates([key]))
    return df.join(made.drop(*inputs), key)
