"""Event frames out of pieces of bytes that come in micro-batches: what is left of a frame waits in the state of its session.

Pieces (session, seq, piece) may be cut anywhere, in the middle of a character too, and may come out of order: pieces ahead wait until those before are there. A frame ends at
a blank line; lines end with LF or CRLF; several data lines of a frame are joined by line feeds; other fields are passed over.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def parse(rest: bytes, piece: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """(event, data) of the frames that end in ``piece``, and what is left; a last CR is left as it is, as its LF may be in the next piece."""
    *ended, rest = (rest + piece).replace(b"\r\n", b"\n").split(b"\n\n")
    frames = []
    for block in ended:
        event, data = "message", []
        for line in block.decode("utf-8", "replace").split("\n"):
            name, _, value = line.partition(":")
            value = value.removeprefix(" ")
            if name == "event":
                event = value
            elif name == "data":
                data.append(value)
        if data:
            frames.append((event, "\n".join(data)))
    return frames, rest


class _Frames(StatefulProcessor):
    """All that a key's sessions hold is one value, read and written once a micro-batch: each call to the state costs far more than a piece, and each key far more than a session."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "sessions binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Rows without a column ``session`` are of the session that the key names."""
        kept = self.place.get()
        held = pickle.loads(kept[0]) if kept else {}  # by session: next, frames, rest, pieces ahead
        met = {}
        for frame in rows:
            sessions = frame["session"] if "session" in frame.columns else [key[0]] * len(frame)
            for session, s, p in zip(sessions, frame["seq"], frame["piece"], strict=True):
                place = met.get(session)
                if place is None:
                    place = met[session] = held.setdefault(session, [0, 0, b"", {}])
                if s >= place[0]:
                    place[3][int(s)] = bytes(p)
        out = []
        for session, place in met.items():
            next_, count, rest, ahead = place
            ready = []
            while next_ in ahead:
                ready.append(ahead.pop(next_))
                next_ += 1
            frames, rest = parse(rest, b"".join(ready))
            name = session if session is None else int(session)
            out += [(name, count + i, event, data) for i, (event, data) in enumerate(frames)]
            place[:3] = next_, count + len(frames), rest
        self.place.update((pickle.dumps(held, pickle.HIGHEST_PROTOCOL),))
        yield pd.DataFrame(out, columns=["session", "n", "event", "data"], dtype=object)

    def close(self) -> None:
        pass


def frame_stream(pieces: DataFrame, keys: int = 1024) -> DataFrame:
    """(session, n, event, data) for a stream of pieces (session: long, seq from 0, piece: binary), each frame once it is whole; pieces that come twice count once.

    Sessions are dealt to ``keys`` keys of the state by a hash; a stream has to go on with as many as it began with."""
    rows = pieces.select(F.pmod(F.xxhash64("session"), F.lit(keys)).alias("of"), F.col("session").cast("string").alias("session"), "seq", "piece")
    return rows.groupBy("of").transformWithStateInPandas(_Frames(), "session long, n long, event string, data string", "Append", "None")


def assembled(frames: DataFrame) -> DataFrame:
    """(session, text, status) of frames: deltas joined in order, the last done frame's status."""
    delta = F.when(F.col("event") == "delta", F.struct("n", F.coalesce(F.get_json_object("data", "$.delta"), F.lit("")).alias("d")))
    done = F.col("event") == "done"
    by = frames.groupBy("session").agg(F.array_sort(F.collect_list(delta)).alias("ds"), F.max_by(F.when(done, F.get_json_object("data", "$.status")), F.when(done, F.col("n"))).alias("status"))
    return by.select("session", F.array_join(F.transform("ds", lambda x: x["d"]), "").alias("text"), "status")


def cut(streams: DataFrame, least: int = 5, most: int = 40) -> DataFrame:
    """(session, seq, piece) of streams (session, stream) cut into pieces of ``least`` to ``most`` bytes, by a rule."""
    step = (least + most) // 2
    raw = streams.select("session", F.encode("stream", "UTF-8").alias("b"))
    starts = F.transform(F.sequence(F.lit(0), F.floor(F.octet_length("b") / step)), lambda i: F.when(i == 0, F.lit(0)).otherwise(i * step - F.pmod(F.xxhash64("session", i), F.lit(step - least)).cast("int")))
    rows = raw.select("session", "b", F.posexplode(starts).alias("seq", "at"))
    end = F.lead("at").over(Window.partitionBy("session").orderBy("seq"))
    rows = rows.withColumn("end", F.coalesce(end, F.octet_length("b")))
    return rows.select("session", F.col("seq").cast("long").alias("seq"), F.substring("b", F.col("at") + 1, F.greatest(F.col("end") - F.col("at"), F.lit(0))).alias("piece"))
