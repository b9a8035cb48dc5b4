"""Streams with state of their own: groups that fill up or expire, batches of groups, and a bounded shuffle.

State lives in the session's RocksDB store (``with_state_store`` sets it), so a restarted query goes on where its log
ends and gives the same rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _table(rows: Iterator[pd.DataFrame], columns: list[str]) -> pd.DataFrame:
    """All rows of a call; names are set again, as odd ones don't come through."""
    return pd.concat([pdf.set_axis(columns, axis=1) for pdf in rows], ignore_index=True)


def with_state_store(spark: SparkSession) -> None:
    """The state store that these operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class _Groups(StatefulProcessor):
    """One group: its first ``size`` rows by number, told apart by row id; a mark once it is given out."""

    def __init__(self, group: str, row: str, score: str, size: int, low: float, high: float, patience: int):
        self.names, self.size, self.low, self.high, self.patience = (group, row, score), size, low, high, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "row long", "score double")
        self.state = handle.getValueState("state", "n int, done boolean, expires long")

    def _row(self, key: tuple, status: str, scores: list[float]) -> pd.DataFrame:
        return pd.DataFrame({self.names[0]: [key[0]], "status": [status], "n": [len(scores)], "mean": [float(np.mean(scores)) if scores else None]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        group, row, score = self.names
        got = _table(rows, [group, row, score, "ts", "ms"]).sort_values(row, kind="stable")
        now = max(timerValues.getCurrentWatermarkInMs(), 0)
        n, done, expires = self.state.get() if self.state.exists() else (0, False, 0)
        if expires == 0:  # a group waits from its first row on
            expires = max(now, int(got["ms"].min())) + self.patience
            self.handle.registerTimer(expires)
        if not done:
            for r, s in zip(got[row].tolist(), got[score].tolist(), strict=True):
                if n < self.size and not self.seen.containsKey((r,)):
                    self.seen.updateValue((r,), (float(s),))
                    n += 1
        if not done and n >= self.size:
            scores = [v[0] for _, v in sorted(self.seen.iterator())]
            # one addition after the other, by row id: as a plain average does, also where it meets a bound
            mean = float(np.cumsum(scores)[-1]) / n
            self.seen.clear()
            done = True
            yield self._row(key, "kept" if self.low < mean < self.high else "dropped", scores)
        self.state.update((n, done, expires))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, done, _ = self.state.get() if self.state.exists() else (0, True, 0)
        if not done:
            yield self._row(key, "expired", [v[0] for v in self.seen.values()])
        self.seen.clear()
        self.state.clear()

    def close(self) -> None:
        pass


def complete_groups(stream: DataFrame, group: str, row: str, score: str, ts: str, size: int, low: float, high: float, patience: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """group, status, n, mean: each group once, as soon as ``size`` of its rows are there.

    kept if low < mean < high, else dropped; expired if ``patience`` (event time) after its first row some are still
    missing.  Rows beyond size, repeated row ids and rows of a group that was given out are ignored; the state of a
    group, also of one that never fills, is gone when its patience ends.
    """
    kind = dict(stream.dtypes)[group]
    wait = int(pd.Timedelta(patience).total_seconds() * 1000)
    rows = stream.withWatermark(ts, late).select(group, F.col(row).cast("long").alias(row), F.col(score).cast("double").alias(score), F.col(ts).alias(ts), F.unix_millis(F.col(ts).cast("timestamp")).alias("ms"))
    made = _Groups(group, row, score, size, low, high, wait)
    return rows.groupBy(group).transformWithStateInPandas(made, f"`{group}` {kind}, status string, n int, mean double", "Append", "EventTime")


class _Batches(StatefulProcessor):
    """One shard: the groups that wait for the next batch, and how many fetches they have waited for."""

    def __init__(self, group: str, size: int, tries: int):
        self.group, self.size, self.tries = group, size, tries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "id string")
        self.state = handle.getValueState("state", "batch long, tries int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = sorted(set(_table(rows, ["shard", self.group])[self.group].astype(str)))
        batch, tries = self.state.get() if self.state.exists() else (0, 0)
        held = [x[0] for x in self.waiting.get()] if self.waiting.exists() else []
        held += [x for x in new if x not in set(held)]
        tries += 1
        full = len(held) // self.size
        for i in range(full):
            some = held[i * self.size : (i + 1) * self.size]
            yield pd.DataFrame({"shard": [key[0]] * self.size, "batch": [batch + i] * self.size, "place": range(self.size), self.group: some, "tries": [tries] * self.size})
        rest = held[full * self.size :]
        tries = 0 if full else tries
        if self.tries > 0 and not full and tries >= self.tries:
            raise RuntimeError(f"shard {key[0]}: {len(rest)} of {self.size} groups after {tries} fetches; is too much filtered out?")
        if rest:
            self.waiting.put([(x,) for x in rest])
        else:
            self.waiting.clear()
        self.state.update((batch + full, tries))

    def close(self) -> None:
        pass


def filled_batches(groups: DataFrame, group: str, size: int, shards: int = 1, max_tries: int = 0) -> DataFrame:
    """shard, batch, place, group, tries: groups gathered over several fetches until ``size`` are there.

    Groups are dealt to shards by hash, each filling batches of its own, so that no task sees all of them; what is over
    waits for the next batch.  A fetch is a micro-batch that brings a shard groups; if ``max_tries`` of them don't fill
    a batch, the query fails (0: no limit).
    """
    rows = groups.select(F.pmod(F.xxhash64(group), F.lit(shards)).cast("int").alias("shard"), F.col(group).cast("string").alias(group))
    return rows.groupBy("shard").transformWithStateInPandas(_Batches(group, size, max_tries), f"shard int, batch long, place int, `{group}` string, tries int", "Append", "None")


class _Shuffle(StatefulProcessor):
    """One shard: its buffer of rows and the number of rows that went through."""

    def __init__(self, columns: list[str], order: str, ends: str, buffer: int, seed: int):
        self.columns, self.order, self.ends, self.buffer, self.seed = columns, order, ends, buffer, seed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "rows binary, put long, given long")

    def _draws(self, shard: int, first: int, n: int, below: np.ndarray) -> np.ndarray:
        """Places for rows number first, first + 1, ...: a function of seed, shard and number alone."""
        start = zlib.crc32(f"{self.seed}:{shard}".encode())
        x = (np.arange(first, first + n, dtype=np.uint64) + np.uint64(start)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x >> np.uint64(11)) % below.astype(np.uint64)).astype(np.int64)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        shard = int(key[0])
        new = _table(rows, ["", *self.columns, self.ends]).sort_values(self.order, kind="stable").reset_index(drop=True)
        over = bool(new[self.ends].any())
        new = new[~new[self.ends].astype(bool)][self.columns]
        held, put, given = None, 0, 0
        if self.state.exists():
            data, put, given = self.state.get()
            held = pa.ipc.open_stream(data).read_pandas()
        pool = pd.concat([held, new], ignore_index=True) if held is not None and len(held) else new.reset_index(drop=True)
        n = len(pool) - len(new)
        slots, out = list(range(min(n, self.buffer))), []
        draws = self._draws(shard, put, len(new), np.full(len(new), self.buffer)).tolist()
        for i, slot in zip(range(n, len(pool)), draws, strict=True):
            if len(slots) < self.buffer:
                slots.append(i)
            else:
                out.append(slots[slot])
                slots[slot] = i
        put += len(new)
        if over:
            left = self._draws(shard, put, len(slots), np.arange(len(slots), 0, -1)).tolist()
            for slot in left:
                out.append(slots[slot])
                slots[slot] = slots[-1]
                slots.pop()
            put += len(left)
        if out:
            yield pool.iloc[out].assign(_shard=shard, _at=range(given, given + len(out)))
        table = pa.Table.from_pandas(pool.iloc[slots], preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table)
        self.state.update((sink.getvalue().to_pybytes(), put, given + len(out)))

    def close(self) -> None:
        pass


def shuffled_stream(stream: DataFrame, shard: str, order: str, ends: str, buffer: int = 16384, seed: int = 42) -> DataFrame:
    """The rows of a stream, each once, in the order of a bounded shuffle, with _shard and their place _at in it.

    A shard (an integer column, a source file's number) keeps ``buffer`` rows across micro-batches: a new row takes the
    place of a drawn one, which leaves.  Rows of one micro-batch enter by ``order``.  A row with ``ends`` set is no row
    of its own but says that its shard is over: the rest leaves.  Draws depend on seed, shard and count only, so a
    restart from the log gives the same order.
    """
    columns = [c for c in stream.columns if c not in (shard, ends)]
    kinds = dict(stream.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "_shard int, _at long"])
    rows = stream.select(F.col(shard).cast("int").alias("_key"), *columns, ends)
    return rows.groupBy("_key").transformWithStateInPandas(_Shuffle(columns, order, ends, buffer, seed), schema, "Append", "None")
