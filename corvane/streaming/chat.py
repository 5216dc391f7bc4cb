"""Requests as a stream: each micro-batch goes from audit to answer and leaves its effects in memory exactly once.

A batch's answers and memory rows are written to a folder named by the batch's number, over whatever lies there: a batch that is run again after a failure writes the same rows to the
same place. Hints for a batch come from the memory of batches with smaller numbers only, so that a repeated batch sees what it saw the first time. Turns of a session that come in
one batch don't see each other's effects.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane import config as c
from corvane.operators import deliver, gateway, safety, understand
from corvane.streaming.state import LASTS

MEMORY = "session long, ord long, kind string, key string, value string, verified timestamp, batch long"
BLOCKED = "请求未通过安全检查。"
INSTEAD = "内容已按安全规则替换。"
NOTICE = "以下回答缺少可核对的来源。\n\n"


def memory(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """What batches (those numbered below ``before``) have left."""
    try:
        rows = spark.read.schema(MEMORY.removesuffix(", batch long")).option("basePath", f"{path}/memory").parquet(f"{path}/memory")
        rows = rows.withColumn("batch", F.regexp_extract(F.input_file_name(), r"batch=(\d+)", 1).cast("long"))
    except AnalysisException:
        return spark.createDataFrame([], MEMORY)
    return rows if before is None else rows.where(F.col("batch") < before)


def latest(rows: DataFrame, as_of) -> DataFrame:
    """The last value of each (session, kind, key) that hasn't expired at ``as_of``."""
    last = rows.groupBy("session", "kind", "key").agg(F.max_by(F.struct("value", "verified"), F.struct("verified", "ord")).alias("m")).select("session", "kind", "key", "m.*")
    until = F.lit(None).cast("timestamp")
    for kind, seconds in LASTS.items():
        until = F.when(F.col("kind") == kind, F.col("verified") + F.make_dt_interval(secs=F.lit(seconds))).otherwise(until)
    return last.withColumn("until", until).where(F.col("until").isNull() | (F.col("until") > as_of)).drop("until")


def prepared(requests: DataFrame, smalltalk: tuple[str, ...] = c.GATEWAY_SMALLTALK) -> DataFrame:
    """Requests (session, ord, at, query, features) with the input audit, intent, edited and planned features, notes, audit trail and the model's route."""
    rows = requests.withColumn("query", F.coalesce("query", F.lit("")))
    intent, reason = understand.gateway_intent(F.col("query"), smalltalk)
    rows = rows.withColumns({"flag": safety.audit_input(F.col("query")), "intent": intent, "why": reason})
    rows = rows.withColumn("wanted", understand.routed_features(F.col("intent"), F.col("features")))
    notes, audit = gateway.route_notes(F.col("intent"), F.col("why"), F.col("features"), F.col("wanted"))
    rows = rows.withColumns({"notes": notes, "audit": audit})
    return rows.withColumns({"features": understand.planned(F.col("wanted")), "model": understand.model_route(F.col("query"), F.lit(0), F.lit(None).cast("string"))}).drop("wanted", "why")


def offline(rows: DataFrame) -> DataFrame:
    """The answerer that asks nobody: the template over a request's hints, without sources."""
    return rows.select("session", "ord", deliver.mock_answer(F.col("query"), F.col("hints"), F.col("notes")).alias("text"), F.array().cast("array<string>").alias("sources"), F.array().cast("array<string>").alias("degraded"))


def serve(requests: DataFrame, held: DataFrame, answerer: Callable[[DataFrame], DataFrame] = offline, smalltalk: tuple[str, ...] = c.GATEWAY_SMALLTALK) -> tuple[DataFrame, DataFrame]:
    """(answers, memory rows) of requests, given the memory before them: (session, ord, query, intent, features, status, text, audit) and (session, ord, kind, key, value, verified)."""
    rows = prepared(requests, smalltalk)
    entries = held.select(F.col("session").alias("s_"), "kind", "key", "value", "verified")
    hints = gateway.memory_context(entries.withColumnRenamed("s_", "session").where("kind = 'long'")).select(F.col("session").alias("h_"), F.col("blocks").alias("hints"))
    rows = rows.join(hints, F.col("session") == F.col("h_"), "left").drop("h_").withColumn("hints", F.coalesce("hints", F.array().cast("array<string>")))
    good = rows.where("flag = 'ok'")
    made = answerer(good).select(F.col("session").alias("a_"), F.col("ord").alias("o_"), "text", "sources", "degraded")
    none = F.array().cast("array<string>")
    rows = rows.join(made, (F.col("session") == F.col("a_")) & (F.col("ord") == F.col("o_")), "left").drop("a_", "o_")
    bad = F.col("flag") != "ok"
    rows = rows.withColumns({
        "text": F.when(bad, BLOCKED).otherwise(F.col("text")), "sources": F.coalesce("sources", none), "degraded": F.when(bad, F.array(F.lit("input_audit"))).otherwise(F.coalesce("degraded", none)),
        "audit": F.when(bad, F.concat("audit", F.array(F.concat(F.lit("safety_audit:input_blocked:"), "flag")))).otherwise(F.col("audit")), "route": F.col("model"), "cache_hit": F.lit(False),
    })
    rows = gateway.assembled(rows, NOTICE, INSTEAD)
    effects = gateway.memory_effects(rows.where(~bad).select("session", "ord", F.col("query").alias("question"), "text"))
    times = rows.select(F.col("session").alias("t_"), F.col("ord").alias("u_"), F.col("at").alias("verified"))
    effects = effects.join(times, (F.col("session") == F.col("t_")) & (F.col("ord") == F.col("u_"))).drop("t_", "u_")
    return rows.select("session", "ord", "query", "intent", F.array_join("features", ",").alias("features"), "status", "text", F.array_join("audit", "|").alias("audit")), effects


def run(requests: DataFrame, path: str, answerer: Callable[[DataFrame], DataFrame] = offline, smalltalk: tuple[str, ...] = c.GATEWAY_SMALLTALK) -> None:
    """Serves what a stream of requests (session: long, ord: long, at: timestamp, query, features) has now, under ``path``: answers and memory by batch, and the checkpoint from which the next run goes on."""

    def batch(rows: DataFrame, number: int) -> None:
        held = memory(rows.sparkSession, path, number)
        answers, effects = serve(rows, held, answerer, smalltalk)
        for name, out in (("answers", answers), ("memory", effects)):
            out.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    requests.writeStream.foreachBatch(batch).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
