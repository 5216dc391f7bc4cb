"""The keyed state operators over streams, with timers: one key's state at a time, kept in the checkpoint, so that a restart goes on where it ended.

Events may come in any order within ``delay`` of the latest one seen (the watermark): the breaker keeps them until the watermark has passed them and takes them in order
of time then; memory lets an older value that comes late change nothing. What comes later than that is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corvane.config import SETTINGS, Settings
from corvane.operators.scans import Breaker
from corvane.operators.state import LASTS

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _millis(t: float) -> int:
    """Whole milliseconds, upward: the watermark passes an event only after its time."""
    return int(-(-t * 1000 // 1)) + 1


class _Ordered(StatefulProcessor):
    """Keeps events until the watermark has passed them, then walks a machine over them in order of time."""

    def __init__(self, machine):
        self.machine = machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "count long, value double")
        self.waiting = handle.getListState("waiting", "t double, id long, failed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        least = None
        for frame in rows:
            new = [(float(t), int(i), bool(f)) for t, i, f in zip(frame["t"], frame["id"], frame["failed"], strict=True) if _millis(t) > passed]
            if new:
                self.waiting.appendList(new)
                least = min([x[0] for x in new] + ([] if least is None else [least]))
        if least is not None:
            self.handle.registerTimer(_millis(least))
        yield pd.DataFrame([], columns=["key", "id", "outcome", "failures"], dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = sorted(tuple(x) for x in self.waiting.get())
        due, later = [x for x in held if _millis(x[0]) <= passed], [x for x in held if _millis(x[0]) > passed]
        state, out = tuple(self.state.get()) if self.state.exists() else self.machine.start, []
        for t, i, failed in due:
            state, said = self.machine.walk(state, t, failed)
            out.append((key[0], i, *said))
        if due:
            self.state.update((int(state[0]), float(state[1])))
            self.waiting.clear()
            if later:
                self.waiting.put(later)
                self.handle.registerTimer(_millis(later[0][0]))
        yield pd.DataFrame(out, columns=["key", "id", "outcome", "failures"], dtype=object)

    def close(self) -> None:
        pass


def breaker_stream(events: DataFrame, s: Settings = SETTINGS, delay: str = "1 hour") -> DataFrame:
    """(key, id, outcome, failures) for a stream of events (key, id, t: seconds, failed), each once the watermark has passed it."""
    rows = events.select("key", "id", F.col("t").cast("double").alias("t"), "failed", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("at")).withWatermark("at", delay)
    return rows.groupBy("key").transformWithStateInPandas(_Ordered(Breaker(s.breaker_failures, s.breaker_seconds)), "key string, id long, outcome string, failures int", "Append", "EventTime")


class _Memory(StatefulProcessor):
    """The newest value of each (kind, key) of a session, until it expires. All that a session holds is one value, read and written once a micro-batch, with one timer for what expires
    first: each call to the state costs far more than a row."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "timer long, kinds array<string>, keys array<string>, ts array<bigint>, ords array<bigint>, expires array<bigint>")

    def _load(self) -> tuple[int, dict]:
        timer, *lists = self.held.get() or (-1, [], [], [], [], [])
        return timer, {(kind, key): x for kind, key, *x in zip(*lists, strict=True)}

    def _store(self, timer: int, held: dict) -> None:
        """``timer``: the one that is registered, or -1."""
        first = min((-(-x[2] // 1000) for x in held.values() if x[2] >= 0), default=-1)
        if first >= 0 and (timer < 0 or first < timer):
            if timer >= 0:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
            timer = first
        lists = list(zip(*[(*k, *x) for k, x in held.items()], strict=True)) or [()] * 5
        self.held.update((timer, *map(list, lists)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = {}
        for frame in rows:
            ts = frame["ts"].astype("datetime64[us]").astype("int64").tolist()
            for kind, name, t, place, value in zip(frame["kind"].tolist(), frame["key"].tolist(), ts, frame["ord"].tolist(), frame["value"].tolist(), strict=True):
                if (kind, name) not in best or (t, place) > best[kind, name][:2]:
                    best[kind, name] = (t, place, value)
        passed, out = timerValues.getCurrentWatermarkInMs() * 1000, []
        timer, held = self._load()
        for (kind, name), (t, place, value) in best.items():
            lasts = LASTS.get(kind)
            expires, old = -1 if lasts is None else t + lasts * 1_000_000, held.get((kind, name))
            if not 0 <= expires <= passed and (old is None or (t, place) > (old[0], old[1])):
                held[kind, name] = [t, int(place), expires]
                out.append((key[0], kind, name, int(place), value, pd.Timestamp(t, unit="us"), None if expires < 0 else pd.Timestamp(expires, unit="us"), "set"))
        if out:
            self._store(timer, held)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, fired, out = timerValues.getCurrentWatermarkInMs() * 1000, expiredTimerInfo.getExpiryTimeInMs(), []
        timer, held = self._load()
        if timer == fired:
            for (kind, name), (t, place, expires) in list(held.items()):
                if 0 <= expires <= max(passed, fired * 1000):
                    del held[kind, name]
                    out.append((key[0], kind, name, int(place), None, pd.Timestamp(t, unit="us"), pd.Timestamp(expires, unit="us"), "expired"))
            if held:
                self._store(-1, held)
            else:
                self.held.clear()
        yield self._frame(out)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["session", "kind", "key", "ord", "value", "ts", "expires_at", "event"])
        return out.astype({"ts": "datetime64[us]", "expires_at": "datetime64[us]"})

    def close(self) -> None:
        pass


def memory_stream(log: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(session, kind, key, ord, value, ts, expires_at, event) for a stream of log rows (session, kind, key, value, ts, ord): ``set`` whenever a key gets a newer value,
    ``expired`` once the watermark has passed its time to live."""
    rows = log.select("session", "kind", "key", "value", "ts", "ord").withWatermark("ts", delay)
    schema = "session long, kind string, key string, ord long, value string, ts timestamp, expires_at timestamp, event string"
    return rows.groupBy("session").transformWithStateInPandas(_Memory(), schema, "Append", "EventTime")


def remembered(changes: DataFrame, as_of) -> DataFrame:
    """(session, kind, key, ord) of what a memory stream's changes leave in force at ``as_of``."""
    last = changes.where("event = 'set'").groupBy("session", "kind", "key").agg(F.max_by(F.struct("ord", "expires_at"), F.struct("ts", "ord")).alias("s"))
    return last.where(F.col("s.expires_at").isNull() | (F.col("s.expires_at") > as_of)).select("session", "kind", "key", "s.ord")


def run_once(stream: DataFrame, path: str) -> DataFrame:
    """All that a stream has now, written under ``path`` (a folder that all executors share) and read back; run again with the same path, it goes on from its checkpoint."""
    spark = stream.sparkSession
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/out").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(_STORE, before)
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
