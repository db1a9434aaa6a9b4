"""Structured Streaming: rate windows, sessions, keyed state, sliding history, a learning gate, and vectors of arriving texts.

All jobs write through ``run_once``: each micro-batch is one folder, so a batch that is run again after a failure replaces itself. Where a batch may change what an earlier one wrote (update mode), the last
row of each key counts; windows are dropped from state once the watermark has passed them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..shared import Workspace

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Processors with timers and lists keep their state in RocksDB."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def read_files(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A stream over Parquet files as they arrive, ``files`` of them a batch."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{path}*")


def read_events(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """Events as they arrive; times are in UTC."""
    return read_files(spark, path, files).withColumn("ts", F.col("ts").cast("timestamp"))


def run_once(stream: DataFrame, ws: Workspace, name: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Processes what is there, with checkpoints in the shared folder, and reads the result: all rows (append), or the last row of each of ``keys`` (update)."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{ws.path(name)}/batch={number}")

    with rocks(spark):
        started = stream.writeStream.outputMode(mode).option("checkpointLocation", ws.path(f"{name}-checkpoint")).trigger(availableNow=True).foreachBatch(write).start()
        started.awaitTermination()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    found = spark.read.schema(f"{schema}, batch long").option("basePath", ws.path(name)).parquet(f"{ws.path(name)}/batch=*")
    if not keys:
        return found.drop("batch")
    rest = [c for c in stream.columns if c not in keys]
    last = found.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in stream.columns])


def minute_counts(events: DataFrame) -> DataFrame:
    w = events.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "60 seconds"), "user_id").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "user_id", "n")


def rate_windows(events: DataFrame, limit: int = 20) -> DataFrame:
    """Writes of each source in sliding minutes, late by ten minutes at most."""
    w = F.window("ts", "60 seconds", "10 seconds")
    return events.withWatermark("ts", "10 minutes").groupBy(w, "user_id").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "user_id", "n", (F.col("n") > limit).alias("spike"))


class Sessions(StatefulProcessor):
    """A source's stretches of writes that a later write may still prolong or join."""

    def __init__(self, gap_s: int):
        self.gap = gap_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first long, last long, n long")

    def _held(self) -> list[tuple[int, int, int]]:
        return [tuple(r) for r in self.open.get()] if self.open.exists() else []

    def handleInputRows(self, key, rows, timerValues):
        before = self._held()
        at = np.sort(np.concatenate([_micros(frame["ts"]) for frame in rows]))
        merged: list[list[int]] = []
        for first, last, n in sorted([*before, *((x, x, 1) for x in at.tolist())]):
            if merged and first - merged[-1][1] < self.gap:
                merged[-1] = [merged[-1][0], max(last, merged[-1][1]), merged[-1][2] + n]
            else:
                merged.append([first, last, n])
        now = {tuple(m) for m in merged}
        gone = {first for first, _, _ in before} - {first for first, _, _ in now}
        out = sorted([*(now - set(before)), *((first, first, 0) for first in gone)])
        self._keep(sorted(now), timerValues)
        first, last, n = np.array(out, dtype=np.int64).reshape(-1, 3).T
        yield pd.DataFrame({"start": pd.to_datetime(first, unit="us"), "end": pd.to_datetime(last + self.gap, unit="us"), "user_id": key[0], "n": n})

    def _keep(self, held: list[tuple[int, int, int]], timers) -> None:
        late = timers.getCurrentWatermarkInMs() * 1000
        kept = [x for x in held if x[1] + self.gap > late]
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old if isinstance(old, int) else old[0])
        if kept:
            self.open.put(kept)
            self.handle.registerTimer(int((min(x[1] for x in kept) + self.gap) // 1000) + 1)
        else:
            self.open.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self._keep(self._held(), timerValues)
        yield pd.DataFrame({"start": pd.Series([], dtype="datetime64[us]"), "end": pd.Series([], dtype="datetime64[us]"), "user_id": pd.Series([], dtype="int64"), "n": pd.Series([], dtype="int64")})

    def close(self) -> None:
        pass


def sessions(events: DataFrame, gap_s: int = 1800) -> DataFrame:
    """``start, end, user_id, n``: stretches of a source's writes with less than ``gap_s`` seconds between them, written whenever they change; the last row of a start counts. A session that a late write joins to an earlier one is written once more, with no
    writes. Those that the watermark has passed leave the state."""
    stream = events.withWatermark("ts", "10 minutes").select("ts", "user_id")
    return stream.groupBy("user_id").transformWithStateInPandas(statefulProcessor=Sessions(gap_s), outputStructType="start timestamp, end timestamp, user_id long, n long", outputMode="Update", timeMode="EventTime")


def tumbling_hyperedges(events: DataFrame, size: str = "300 seconds") -> DataFrame:
    """Members of each source's windows; those with two or more are hyperedges."""
    g = events.withWatermark("ts", "10 minutes").groupBy(F.window("ts", size), "user_id").agg(F.sort_array(F.collect_set("event_id")).alias("members"))
    return g.select(F.col("window.start").alias("start"), "user_id", F.size("members").alias("n"))


def _trust(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    trust, writes = state.get if state.exists else (1.0, 0)
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    for bad in rows["event_type"].eq("error"):
        trust = min(1.0, max(0.0, trust + (-0.2 if bad else 0.05)))
    writes += len(rows)
    state.update((trust, writes))
    yield pd.DataFrame({"user_id": [key[0]], "trust": [round(trust, 6)], "writes": [writes]})


def trust_state(events: DataFrame) -> DataFrame:
    """Trust of each source, carried as keyed state from batch to batch."""
    return events.groupBy("user_id").applyInPandasWithState(_trust, "user_id long, trust double, writes long", "trust double, writes long", "update", GroupStateTimeout.NoTimeout)


def _micros(times: pd.Series) -> np.ndarray:
    return pd.to_datetime(times, utc=True).dt.tz_localize(None).to_numpy().astype("datetime64[us]").astype(np.int64)


class History(StatefulProcessor):
    """Times of a source's writes, as long as a later write may still count them."""

    def __init__(self, span_s: int):
        self.span = span_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "at long")

    def _held(self) -> np.ndarray:
        return np.sort(np.array([r[0] for r in self.times.get()] if self.times.exists() else [], dtype=np.int64))

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat(list(rows))
        at = _micros(frame["ts"])
        every = np.sort(np.r_[self._held(), at])
        n = np.searchsorted(every, at, "right") - np.searchsorted(every, at - self.span, "left")
        self._keep(every, timerValues)
        yield pd.DataFrame({"event_id": frame["event_id"].to_numpy(), "user_id": key[0], "n": n})

    def _keep(self, every: np.ndarray, timers) -> None:
        oldest = timers.getCurrentWatermarkInMs() * 1000 - self.span
        kept = every[every >= oldest]
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old if isinstance(old, int) else old[0])
        if len(kept):
            self.times.put([(int(x),) for x in kept])
            self.handle.registerTimer(int((kept[0] + self.span) // 1000) + 1)
        else:
            self.times.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self._keep(self._held(), timerValues)
        yield pd.DataFrame({"event_id": pd.Series([], dtype="int64"), "user_id": pd.Series([], dtype="int64"), "n": pd.Series([], dtype="int64")})

    def close(self) -> None:
        pass


def sliding_history(events: DataFrame, span_s: int = 300, late: str = "10 minutes") -> DataFrame:
    """``event_id, user_id, n``: how many writes of its source lie in the ``span_s`` seconds up to each write, itself included.

    Each write is counted once, when it arrives: among those of its own batch and all before that are still held, whatever their order. A write that comes after younger ones counts what lies before it and is counted by what comes after; one behind
    the watermark is dropped. A timer drops times that no write may ask for any more, so a source's state is bounded by its writes in the span and the allowed lateness.
    """
    stream = events.withWatermark("ts", late).select("ts", "event_id", "user_id")
    return stream.groupBy("user_id").transformWithStateInPandas(statefulProcessor=History(span_s), outputStructType="event_id long, user_id long, n long", outputMode="Append", timeMode="EventTime")


class Gate(StatefulProcessor):
    """A leaky state and a weight that learns from outcomes, one of each a source."""

    def __init__(self, warmup: int, rate: float):
        self.warmup, self.rate = warmup, rate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("gate", "h double, weight double, alpha double, reward double, n long, kept long")

    def handleInputRows(self, key, rows, timerValues):
        now = tuple(self.state.get()) if self.state.exists() else (0.0, 0.0, 0.9, 0.0, 0, 0)
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        for x, good in zip((frame["value"] / 100).tolist(), frame["event_type"].ne("error").tolist(), strict=True):
            now = gate_step(now, x, good, self.warmup, self.rate)
        self.state.update(now)
        yield pd.DataFrame({"user_id": [key[0]], "weight": [round(now[1], 6)], "alpha": [round(now[2], 6)], "kept": [now[5]], "n": [now[4]]})

    def close(self) -> None:
        pass


def gate_step(now: tuple, x: float, good: bool, warmup: int, rate: float) -> tuple:
    """One write and its outcome. The gate mixes a squashed leaky state with a weighted input; it keeps a write during warm-up, while nothing was learned, and from one half on. Then the weight follows the outcome, and the learned part gains
    influence where it was right."""
    h, weight, alpha, reward, n, kept = now
    h, n = 0.9 * h + 0.1 * float(np.tanh(x)), n + 1
    learned = 1 / (1 + float(np.exp(-weight * h)))
    gate = alpha / (1 + float(np.exp(-h))) + (1 - alpha) * learned
    keep = n <= warmup or abs(reward) <= 1e-9 or gate > 0.5
    right = 1.0 if (learned > 0.5) == good else -1.0
    weight += rate * (float(good) - learned) * h
    alpha = min(1 - 1e-9, max(0.3, alpha - (0.01 if right > 0 else 0.0)))
    return h, weight, alpha, 0.9 * reward + right, n, kept + keep


def learning_gate(events: DataFrame, warmup: int = 10, rate: float = 0.5) -> DataFrame:
    """``user_id, weight, alpha, kept, n`` of each source after its writes; an error is a write that should not have been kept."""
    stream = events.select("user_id", "ts", "event_id", "event_type", "value")
    return stream.groupBy("user_id").transformWithStateInPandas(statefulProcessor=Gate(warmup, rate), outputStructType="user_id long, weight double, alpha double, kept long, n long", outputMode="Update", timeMode="None")


def embed_batches(texts: DataFrame, quarantined: Callable[[], DataFrame], vector: Column, ws: Workspace, name: str = "vectors") -> DataFrame:
    """``id, vector`` of all texts (id, text) of a stream, the last one of an id: each batch encodes what isn't quarantined when it runs and writes its own folder.

    The folder's name is the batch's number, which a checkpoint gives again to a batch that is replayed: it replaces itself, so vectors are written once whatever fails. ``vector`` is the encoder, a column over ``text``; null vectors (empty texts) write nothing."""
    spark = texts.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        fresh = batch.where("id IS NOT NULL").join(quarantined(), "id", "left_anti").select("id", vector.alias("vector")).where("vector IS NOT NULL")
        fresh.groupBy("id").agg(F.max("vector").alias("vector")).write.mode("overwrite").parquet(f"{ws.path(name)}/batch={number}")

    started = texts.writeStream.option("checkpointLocation", ws.path(f"{name}-checkpoint")).trigger(availableNow=True).foreachBatch(write).start()
    started.awaitTermination()
    return stored_vectors(spark, ws, name)


def stored_vectors(spark: SparkSession, ws: Workspace, name: str = "vectors") -> DataFrame:
    found = spark.read.schema("id long, vector array<double>, batch long").option("basePath", ws.path(name)).parquet(f"{ws.path(name)}/batch=*")
    return found.groupBy("id").agg(F.max_by("vector", "batch").alias("vector"))


def hashed_words(dimensions: int = 64):
    """A plug-in encoder for tests and fallback: counts of words by a hash of each, at unit length; Arrow batches, null where a text has no word."""

    @F.pandas_udf("array<double>")
    def encode(texts: pd.Series) -> pd.Series:
        import hashlib
        import re

        place: dict[str, int] = {}
        out = []
        for t in texts:
            v = np.zeros(dimensions)
            for w in re.split(r"[^a-z0-9à-ÿ]+", (t or "").lower()):
                if len(w) > 1:
                    if w not in place:
                        place[w] = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dimensions
                    v[place[w]] += 1
            norm = np.linalg.norm(v)
            out.append((v / norm).tolist() if norm else None)
        return pd.Series(out)

    return encode
