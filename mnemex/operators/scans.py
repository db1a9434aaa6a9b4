"""Recurrences over each key's rows in order, in two levels.

Rows are dealt out by ranges of (key, order), so a key with many rows lies in several ranges, each sorted by itself. A task folds its stretch of a key to something that can be
composed with the stretches before it; composing needs a row a stretch, and at most as many a key as there are ranges. No key's rows ever meet in one row or task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..shared import Workspace


def _sorted(rows: DataFrame, key: str, order: list[str], value: Column, carry: Column | None = None) -> DataFrame:
    carried = [] if carry is None else [carry.alias("carry")]
    own = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], value.alias("value"), *carried)
    by = ["key", *(f"o{i}" for i in range(len(order)))]
    return own.repartitionByRange(*by).sortWithinPartitions(*by).select("key", "value", *(["carry"] if carried else []))


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[object, np.ndarray]]:
    keys, values = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
    if len(keys):
        plain = keys.to_numpy(zero_copy_only=False)
        cut = [0, *(np.flatnonzero(plain[1:] != plain[:-1]) + 1).tolist(), len(plain)]
        for a, b in zip(cut, cut[1:], strict=False):
            yield keys[a].as_py(), values[a:b]


def clamped_sum(rows: DataFrame, key: str, order: list[str], change: Column, start: float, low: float, high: float) -> DataFrame:
    """``key, value, n``: a number that each row changes, held between two bounds all along.

    Changes compose: after a stretch the number is min(top, max(bottom, number + sum)), where bottom and top are where the bounds themselves end up.
    """
    kind, arrow = rows.schema[key].dataType.simpleString(), to_arrow_type(rows.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        done: list[tuple] = []
        now = None
        for batch in batches:
            for k, changes in _stretches(batch):
                if now is None or now[0] != k:
                    if now is not None:
                        done.append(now)
                    now = (k, part, 0.0, low, high, 0)
                _, _, total, bottom, top, n = now
                for x in changes.tolist():
                    total += x
                    bottom = min(high, max(low, bottom + x))
                    top = min(high, max(low, top + x))
                now = (k, part, total, bottom, top, n + len(changes))
            if len(done) > 10_000:
                yield out(done)
                done = []
        if now is not None:
            done.append(now)
        yield out(done)

    def out(done: list[tuple]) -> pa.RecordBatch:
        keys, *rest = zip(*done, strict=True) if done else [()] * 6
        types = [pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
        return pa.record_batch([pa.array(keys, arrow), *(pa.array(c, t) for c, t in zip(rest, types, strict=True))], names=["key", "part", "total", "bottom", "top", "n"])

    sums = _sorted(rows, key, order, change.cast("double")).mapInArrow(run, f"key {kind}, part int, total double, bottom double, top double, n long")
    stretches = F.array_sort(F.collect_list(F.struct("part", "total", "bottom", "top")))
    value = F.aggregate(stretches, F.lit(float(start)), lambda x, s: F.least(s["top"], F.greatest(s["bottom"], x + s["total"])))
    return sums.groupBy("key").agg(value.alias("value"), F.sum("n").alias("n")).withColumnRenamed("key", key)


def leaky_states(rows: DataFrame, key: str, order: list[str], push: Column, keep: float, carry: Column) -> DataFrame:
    """``key, place, state, carry`` of each row: state = keep x the state before + push, from 0 on; ``place`` counts from 1, and the number ``carry`` comes along.

    The state is linear in what a stretch starts from, so each stretch is folded from 0 and keep to the power of the place times its start is added.
    """
    ws = Workspace(rows.sparkSession, "leaky-states")
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, state, place = TaskContext.get().partitionId(), None, 0.0, 0
        for batch in batches:
            states, places = [], []
            for k, pushes in _stretches(batch):
                if now != k:
                    now, state, place = k, 0.0, 0
                for x in pushes.tolist():
                    state = keep * state + x
                    place += 1
                    states.append(state), places.append(place)
            yield pa.record_batch({"key": batch.column(0), "carry": batch.column(2), "part": pa.array(np.full(batch.num_rows, part, dtype=np.int32)), "place": pa.array(places, pa.int64()), "state": pa.array(states, pa.float64())})

    local = ws.save(_sorted(rows, key, order, push.cast("double"), carry.cast("double")).mapInArrow(run, f"key {kind}, carry double, part int, place long, state double"), "local")
    ends = local.groupBy("key", "part").agg(F.max(F.struct("place", "state")).alias("end"))
    stretches = F.array_sort(F.collect_list(F.struct("part", F.col("end.place").alias("n"), F.col("end.state").alias("state"))))
    nothing = F.array().cast("array<struct<part:int,start:double,before:bigint>>")
    zero = F.struct(F.lit(0.0).alias("state"), F.lit(0).cast("long").alias("n"), nothing.alias("out"))

    def step(a: Column, s: Column) -> Column:
        start = F.struct(s["part"].alias("part"), a["state"].alias("start"), a["n"].alias("before"))
        return F.struct((s["state"] + F.pow(F.lit(keep), s["n"]) * a["state"]).alias("state"), (a["n"] + s["n"]).alias("n"), F.concat(a["out"], F.array(start)).alias("out"))

    starts = ends.groupBy("key").agg(F.aggregate(stretches, zero, step)["out"].alias("s")).select("key", F.explode("s").alias("s")).select("key", "s.*")
    both = local.join(starts, ["key", "part"])
    return both.select(F.col("key").alias(key), (F.col("before") + F.col("place")).alias("place"), (F.col("state") + F.pow(F.lit(keep), F.col("place")) * F.col("start")).alias("state"), "carry")
