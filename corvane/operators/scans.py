"""State machines over the ordered events of a key as segmented scans, so that one key's events may lie in many tasks.

Events are sorted by (key, t, id) and cut into blocks by ranges; a key with many events spans several. Only such keys need more than a walk:

1. each of their blocks becomes a function from the state before it to the state after it, told as runs: the state before decides only at which event the block is
   entered, and many entries lead to the same end (a success, say, forgets what was before), so neighbouring entries of the same end are one run;
2. the functions of a key are applied one after another in the order of its blocks (their runs stream through a task; nothing but a state is held), which gives the state before each block;
3. all blocks are walked from the state before them, side by side.

No array of a key's events is ever built; a block is about ``block`` events. Events of equal key, t and id are the same to the machines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.config import SETTINGS, Settings
from corvane.sources.shared import written

#: Events of a block; a key that has more is cut.
BLOCK = 1 << 16
#: (class of the state before, last time of the run's entries, whether the count starts anew, count, value after)
Run = tuple[int, float, bool, int, float]
_RUNS = "array<struct<c:int,upto:double,anew:boolean,count:bigint,value:double>>"


def _runs(c: int, t: np.ndarray, ends: list[tuple[bool, int, float]]) -> list[Run]:
    last = [i for i in range(len(ends)) if i + 1 == len(ends) or ends[i] != ends[i + 1]]
    return [(c, float(t[i]), *ends[i]) for i in last]


class Breaker:
    """State: failures in a row, and the time until which the breaker is open. An event before that time is rejected and changes nothing; a failure counts, and
    from ``least`` on it opens; a success resets both. An open time that ends resets nothing."""

    start, outputs = (0, 0.0), ("outcome string", "failures int")

    def __init__(self, least: int, seconds: float):
        self.least, self.seconds = max(1, least), seconds

    def function(self, t: np.ndarray, failed: np.ndarray) -> list[Run]:
        n, top = len(t), self.least - 1
        ends = [[(False, 0, 0.0)] * (n + 1) for _ in range(self.least)]  # by class of failures, and by the first event that is let in
        for i in range(n - 1, -1, -1):
            for c in range(self.least):
                if not failed[i]:
                    _, count, until = ends[0][i + 1]
                    ends[c][i] = (True, count, until)
                    continue
                until = float(t[i] + self.seconds)
                at = max(i + 1, int(np.searchsorted(t, until, "left"))) if c == top else i + 1
                anew, count, after = ends[min(c + 1, top)][at]
                ends[c][i] = (anew, count if anew else count + 1, until if c == top and at == n else after)
        return [r for c in range(self.least) for r in _runs(c, t, ends[c][:n])]

    def after(self, state: tuple[int, float], runs: list[Run]) -> tuple[int, float]:
        failures, until = state
        for c, upto, anew, count, value in runs:
            if c == min(failures, self.least - 1) and until <= upto:
                return (count if anew else failures + count, value)
        return state  # open all the time

    def walk(self, state: tuple[int, float], t: float, failed: bool) -> tuple[tuple[int, float], tuple]:
        failures, until = state
        if until > t:
            return state, ("rejected", failures)
        if not failed:
            return (0, 0.0), ("ok", 0)
        failures += 1
        return (failures, t + self.seconds if failures >= self.least else until), ("failed", failures)


class Cache:
    """State: the time of the last write. An event within ``seconds`` of it is a hit and renews nothing; another writes."""

    start, outputs = (0, -np.inf), ("hit boolean",)

    def __init__(self, seconds: float):
        self.seconds = seconds

    def function(self, t: np.ndarray, _: np.ndarray) -> list[Run]:
        n = len(t)
        ends: list[tuple[bool, int, float]] = [(False, 0, 0.0)] * n
        for i in range(n - 1, -1, -1):
            at = int(np.searchsorted(t, t[i] + self.seconds, "right"))
            while at > i + 1 and t[at - 1] - t[i] > self.seconds:  # sums and differences are rounded apart
                at -= 1
            while at < n and t[at] - t[i] <= self.seconds:
                at += 1
            ends[i] = ends[at] if i < at < n else (False, 0, float(t[i]))
        return _runs(0, t, ends)

    def after(self, state: tuple[int, float], runs: list[Run]) -> tuple[int, float]:
        for _, upto, _, _, value in runs:
            if upto - state[1] > self.seconds:
                return (0, value)
        return state

    def walk(self, state: tuple[int, float], t: float, _: bool) -> tuple[tuple[int, float], tuple]:
        hit = t - state[1] <= self.seconds
        return (state if hit else (0, t)), (hit,)


def _functions(machine) -> object:
    def f(group: pa.Table) -> pa.Table:
        order = np.lexsort((group["id"].to_numpy(), group["t"].to_numpy()))
        runs = machine.function(group["t"].to_numpy()[order], group["failed"].to_numpy(zero_copy_only=False)[order])
        names = ("c", "upto", "anew", "count", "value")
        kind = pa.list_(pa.struct([("c", pa.int32()), ("upto", pa.float64()), ("anew", pa.bool_()), ("count", pa.int64()), ("value", pa.float64())]))
        return pa.table({"key": group["key"].slice(0, 1), "block": group["block"].slice(0, 1), "runs": pa.array([[dict(zip(names, r, strict=True)) for r in runs]], kind)})

    return f


def _chained(machine) -> object:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, machine.start
        for b in batches:
            out = []
            for key, block, runs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != now:
                    now, state = key, machine.start
                out.append((key, block, *state))
                state = machine.after(state, [tuple(r.values()) for r in runs])
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.int64(), pa.float64()))], ["key", "block", "s_count", "s_value"])

    return f


def _walked(machine) -> object:
    kinds = [pa.string() if o.endswith("string") else pa.int32() if o.endswith("int") else pa.bool_() for o in machine.outputs]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, machine.start
        for b in batches:
            out = []
            for key, block, t, failed, count, value in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("key", "block", "t", "failed", "s_count", "s_value")), strict=True):
                if (key, block) != now:
                    now, state = (key, block), (machine.start if count is None else (count, value))
                state, said = machine.walk(state, t, failed)
                out.append(said)
            more = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in ("key", "id", "t")), *more], ["key", "id", "t", *[o.split()[0] for o in machine.outputs]])

    return f


def scan(events: DataFrame, machine, block: int = BLOCK) -> DataFrame:
    """(key, id, t and the machine's outputs) of events (key: string, id: long, t: seconds, failed)."""
    rows = events.select("key", "id", F.col("t").cast("double").alias("t"), "failed")
    parts = max(1, -(-rows.count() // block))
    rows = written(rows.repartitionByRange(parts, "key", "t", "id").withColumn("block", F.spark_partition_id()))
    spans = rows.groupBy("key").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).where("lo < hi").select(F.col("key").alias("k_"))
    cut = rows.join(spans, F.col("key").eqNullSafe(F.col("k_")), "left_semi")  # at most one key for each border of two blocks
    functions = cut.groupBy("key", "block").applyInArrow(_functions(machine), f"key string, block int, runs {_RUNS}")
    ordered = functions.repartition("key").sortWithinPartitions("key", "block")
    before = ordered.mapInArrow(_chained(machine), "key string, block int, s_count long, s_value double").select(F.col("key").alias("k_"), F.col("block").alias("b_"), "s_count", "s_value")
    rows = rows.join(before, F.col("key").eqNullSafe(F.col("k_")) & (F.col("block") == F.col("b_")), "left").drop("k_", "b_")
    rows = rows.repartition("key", "block").sortWithinPartitions("key", "block", "t", "id")
    return rows.mapInArrow(_walked(machine), "key string, id long, t double, " + ", ".join(machine.outputs))


def circuit_breaker(events: DataFrame, s: Settings = SETTINGS, block: int = BLOCK) -> DataFrame:
    """(key, id, outcome, failures) of events (key, id, t: seconds, failed)."""
    return scan(events, Breaker(s.breaker_failures, s.breaker_seconds), block).drop("t")


def breaker_snapshot(events: DataFrame, s: Settings = SETTINGS, block: int = BLOCK) -> DataFrame:
    """(key, failures, outcome) after the last event of each key."""
    rows = scan(events, Breaker(s.breaker_failures, s.breaker_seconds), block)
    return rows.groupBy("key").agg(F.max_by(F.struct("failures", "outcome"), F.struct("t", "id")).alias("s")).select("key", "s.*")


def prompt_cache(events: DataFrame, s: Settings = SETTINGS, block: int = BLOCK) -> DataFrame:
    """(key, id, hit) of events (key, id, t: seconds)."""
    return scan(events.withColumn("failed", F.lit(False)), Cache(s.cache_seconds), block).drop("t")
