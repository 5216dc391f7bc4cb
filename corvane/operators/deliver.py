"""Event streams of answers: pieces, frames, and putting them together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import windows


def frames(answers: DataFrame, size: int = 24) -> DataFrame:
    """(session, seq, event, data) of answers (session, text, status): a frame for each piece of ``size`` characters, then one that is done."""
    none = F.array().cast("array<struct<event:string,data:string>>")
    deltas = F.transform(windows(F.col("text"), size, 0), lambda x: F.struct(F.lit("delta").alias("event"), F.to_json(F.struct(x.alias("delta"))).alias("data")))
    done = F.array(F.struct(F.lit("done").alias("event"), F.to_json(F.struct("status")).alias("data")))
    return answers.select("session", F.posexplode(F.concat(F.coalesce(deltas, none), done)).alias("seq", "f")).select("session", "seq", "f.*")


def wire(event: Column, data: Column) -> Column:
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def stream_text(rows: DataFrame) -> DataFrame:
    """(session, stream): the frames of a session as text."""
    parts = F.array_sort(F.collect_list(F.struct("seq", wire(F.col("event"), F.col("data")).alias("w"))))
    return rows.groupBy("session").agg(F.array_join(F.transform(parts, lambda x: x["w"]), "").alias("stream"))


def parse_stream(streams: DataFrame) -> DataFrame:
    """(session, text, status) of streams: deltas joined in order; the last done frame's status."""
    clean = F.replace("stream", F.lit("\r\n"), F.lit("\n"))
    blocks = F.filter(F.split(clean, "\n\n"), lambda x: x != "")
    cut = F.transform(blocks, lambda b: F.struct(F.regexp_extract(b, r"(?m)^event: *(.*)$", 1).alias("event"), F.array_join(F.transform(F.filter(F.split(b, "\n"), lambda x: F.startswith(x, F.lit("data:"))), lambda x: F.regexp_replace(x, "^data: ?", "")), "\n").alias("data")))
    rows = streams.select("session", cut.alias("f"))
    text = F.array_join(F.transform(F.filter("f", lambda x: x["event"] == "delta"), lambda x: F.coalesce(F.get_json_object(x["data"], "$.delta"), F.lit(""))), "")
    done = F.element_at(F.filter("f", lambda x: x["event"] == "done"), -1)
    return rows.select("session", text.alias("text"), F.get_json_object(done["data"], "$.status").alias("status"))


def mock_answer(query: Column, blocks: Column, notes: Column) -> Column:
    """The offline answer: question, up to four blocks of 110 characters, notes."""
    lines = lambda a, n, none: F.when(F.size(a) > 0, F.array_join(F.transform(a, lambda x: F.concat(F.lit("- "), F.substring(x, 1, n))), "\n")).otherwise(none)
    return F.concat(F.lit("问题："), query, F.lit("\n\n基于当前检索到的材料，先给你结论再给依据：\n"), lines(F.slice(blocks, 1, 4), 110, "- 未命中可靠证据。"), F.lit("\n\n本轮能力执行情况：\n"), lines(notes, 1 << 30, "- 未启用额外增强功能。"))
