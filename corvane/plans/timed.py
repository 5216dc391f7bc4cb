"""Queries of vectors under settings, validity by day, and state over streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane import config as c
from corvane.operators import ann, asof, deliver, inverted, scans
from corvane.plans import retrieval, service
from corvane.plans.ingest import _SQ
from corvane.sources.shared import shared_dir, written
from corvane.sources.tables import CORPUS_SQL, corpus, read
from corvane.streaming import chat, frames
from corvane.streaming import state as streams

FAMILY, K, SETTING = ann.Family(), 5, (4, 3)


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, d, "embeddings").select("vec_id", "embedding")
    return rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), rows


def ann_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Every setting against the exact truth: vectors whose id is divisible by 20 ask all others."""
    return ann.sweep(*_vectors(spark, d), K, FAMILY).select("tables", "level", "bucket", "cases", "avg_recall", "avg_share", "p95_share")


def pareto_frontier(spark: SparkSession, d: str) -> DataFrame:
    """The sweep's settings that no setting of a smaller share of candidates equals in recall."""
    rows = written(ann_sweep(spark, d).withColumn("setting", F.col("tables") * 100 + F.col("level")))
    return ann.frontier(rows, "avg_share", "avg_recall", "setting").select("tables", "level", "avg_recall", "avg_share")


def dot_product_topk(spark: SparkSession, d: str) -> DataFrame:
    return ann.dot_top(*_vectors(spark, d), K, FAMILY).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def ann_bucket_topk(spark: SparkSession, d: str) -> DataFrame:
    """The nearest among vectors that share a bucket of one setting."""
    return ann.search(*_vectors(spark, d), K, *SETTING, FAMILY).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def as_of_join(spark: SparkSession, d: str) -> DataFrame:
    """For each question a day, derived from its place, and by source the documents in force on it and the one that came into force last."""
    turns = read(spark, d, "conversations").where("role = 'user'")
    day = F.date_add(F.lit("2019-06-01").cast("date"), ((F.col("conv_id") * 97 + F.col("turn") * 31) % 2500).cast("int")).cast("string")
    asked = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), day.alias("as_of"))
    docs = corpus(read(spark, d, "documents")).withColumn("effective_date", F.when(F.col("doc_id") % 5 == 1, "").otherwise(F.col("effective_date"))).withColumn("expire_date", F.when(F.col("doc_id") % 7 == 1, "").otherwise(F.col("expire_date")))
    docs = docs.withColumn("effective_date", F.when(F.col("effective_date") != "", F.col("publish_date")).otherwise(""))
    return asof.latest_in_force(asked, docs, "topic", "query_id", "doc_id")


def breaker_states(spark: SparkSession, d: str) -> DataFrame:
    return scans.breaker_snapshot(service._events(spark, d), service.BREAKER)


#: Days of events that arrive together, days that an event may come late, and the watermark's delay.
TOGETHER, LATE, DELAY = 5, 2, "8 days"


def _arrivals(spark: SparkSession, d: str) -> str:
    """A folder of events as they arrive: up to LATE days after their time, TOGETHER days at a time, and a last one long after all others that lets the watermark pass them."""
    path = shared_dir(spark)
    e = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    due = F.unix_seconds("ts") + F.pmod(F.xxhash64("event_id"), F.lit(LATE * 86400))
    e = written(e.withColumn("arrival", F.floor(due / (TOGETHER * 86400)).cast("int")))
    for (at,) in sorted(tuple(r) for r in e.select("arrival").distinct().collect()):  # a write for each TOGETHER days
        e.where(F.col("arrival") == at).drop("arrival").coalesce(4).write.mode("append").parquet(path)
    last = e.agg(F.max("ts").alias("ts"), F.max("event_id").alias("event_id"))
    closing = last.select(*[(F.col("ts") + F.make_dt_interval(F.lit(365))).alias("ts") if n == "ts" else F.lit(-1).cast(t).alias(n) if n in ("event_id", "user_id") else F.lit(None).cast(t).alias(n) for n, t in e.drop("arrival").dtypes])
    closing.write.mode("append").parquet(path)
    return path


def _streamed(spark: SparkSession, path: str) -> DataFrame:
    """The folder's files some at a time, as they were written."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 8).parquet(path)


def breaker_stream(spark: SparkSession, d: str) -> DataFrame:
    """The breaker over events that come late and in another order, in several micro-batches."""
    source = _streamed(spark, _arrivals(spark, d))
    rows = source.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), F.unix_seconds("ts").cast("double").alias("t"), (F.col("event_type") == "error").alias("failed"))
    return streams.run_once(streams.breaker_stream(rows, service.BREAKER, DELAY), shared_dir(spark)).where("id >= 0")


def memory_stream(spark: SparkSession, d: str) -> DataFrame:
    """What memory holds at the end of January, from the changes of the stream."""
    kind = F.element_at(F.array(F.lit("short"), F.lit("long"), F.lit("special")), (F.pmod("event_id", F.lit(3)) + 1).cast("int"))
    source = _streamed(spark, _arrivals(spark, d))
    log = source.select(F.col("user_id").alias("session"), kind.alias("kind"), F.coalesce("event_type", F.lit("")).alias("key"), F.col("props").alias("value"), "ts", F.col("event_id").alias("ord"))
    changes = streams.run_once(streams.memory_stream(log, DELAY), shared_dir(spark)).where("ord >= 0")
    return streams.remembered(changes, F.lit("2024-01-30 00:00:00").cast("timestamp"))


#: Sessions of a key of the state, about.
SESSIONS = 128


def frames_stream(spark: SparkSession, d: str) -> DataFrame:
    """Answers put together from pieces of bytes that come in three micro-batches, each with pieces from everywhere; every other session has CRLF and frames of several data lines."""
    said = deliver.frames(service._said(spark, d))
    split = F.replace(deliver.wire(F.col("event"), F.replace("data", F.lit('":"'), F.lit('":\ndata: "'))), F.lit("\n"), F.lit("\r\n"))
    wire = F.when(F.col("session") % 2 == 0, deliver.wire(F.col("event"), F.col("data"))).otherwise(split)
    whole = said.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", wire.alias("w")))), lambda x: x["w"]), "").alias("stream"))
    pieces, path = written(frames.cut(whole)), shared_dir(spark)
    files, keys = max(4, pieces.rdd.getNumPartitions()), max(16, pieces.where("seq = 0").count() // SESSIONS)
    for at in range(3):
        pieces.where(F.pmod(F.xxhash64("session", "seq"), F.lit(3)) == at).coalesce(files).write.mode("append").parquet(path)
    source = spark.readStream.schema(pieces.schema).option("maxFilesPerTrigger", files).parquet(path)
    return frames.assembled(streams.run_once(frames.frame_stream(source, keys), shared_dir(spark)))


def chat_answers(spark: SparkSession, d: str) -> DataFrame:
    """Questions served as a stream, a few turns of all conversations at a time, each with the memory of those before."""
    rows = read(spark, d, "conversations").where("role = 'user'")
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    features = F.array(F.lit("rag"), F.lit("web_search"), F.lit("skill_exec"))
    asked = rows.select(F.col("conv_id").alias("session"), F.col("turn").alias("ord"), at.alias("at"), F.coalesce("text", F.lit("")).alias("query"), features.alias("features"))
    source, path = shared_dir(spark), shared_dir(spark)
    for few in ("ord < 2", "ord BETWEEN 2 AND 3", "ord > 3"):
        asked.where(few).coalesce(4).write.mode("append").parquet(source)
    chat.run(spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 4).parquet(source), path, smalltalk=service.SMALLTALK)
    return spark.read.parquet(f"{path}/answers").select(F.col("session").cast("long").alias("session"), F.col("ord").cast("long").alias("ord"), "intent", "features", "status")


def bm25_kept_topk(spark: SparkSession, d: str) -> DataFrame:
    """The best documents of each benchmark text, from an inverted index of two segments."""
    docs, path = corpus(read(spark, d, "documents")), shared_dir(spark)
    for part in (0, 1):
        inverted.append(docs.where(F.pmod("doc_id", F.lit(2)) == part), path)
    found, _ = inverted.bm25(retrieval._queries(spark, d), inverted.load(spark, path), retrieval.N)
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


QUERIES = {f.__name__: f for f in (ann_sweep, pareto_frontier, dot_product_topk, ann_bucket_topk, as_of_join, breaker_states, breaker_stream, memory_stream, frames_stream, chat_answers, bm25_kept_topk)}

_ANN = f"""v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
k AS (SELECT i, list_transform(range(0, 64), lambda d: (i * 131 + d + 1) * 2654435761 % 4294967296 // 268435456 * 2 - 15) AS a FROM range(16) AS t(i)),
h AS (SELECT vec_id, i, (list_sum(list_transform(range(1, 65), lambda d: floor(e[d] * 256)::BIGINT * a[d]))::BIGINT + 1099511627776) // {FAMILY.width} AS h FROM v, k),
g AS (SELECT a.vec_id AS query_id, b.vec_id, a.i // 2 AS t, max(CASE WHEN a.h = b.h THEN 0 ELSE length(bin(xor(a.h, b.h))) END) AS apart FROM h a JOIN h b ON a.i = b.i AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 GROUP BY ALL),
m AS (SELECT query_id, vec_id, t + 1 AS tables, min(apart) OVER (PARTITION BY query_id, vec_id ORDER BY t) AS met FROM g),
s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_inner_product(a.e, b.e), 9) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
tr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= {K})"""
_SWEEP = f"""{_ANN}, l AS (SELECT unnest(range(0, {FAMILY.levels})) AS level),
q AS (SELECT m.query_id, tables, level, count(*) FILTER (met <= level) AS candidates, count(*) AS others, count(*) FILTER (met <= level AND tr.vec_id IS NOT NULL) AS hits, count(tr.vec_id) AS truth FROM m JOIN l ON true LEFT JOIN tr ON tr.query_id = m.query_id AND tr.vec_id = m.vec_id GROUP BY ALL),
w AS (SELECT tables, level, count(*) AS cases, round(avg(round(hits / truth::DOUBLE, 4)), 4) AS avg_recall, round(avg(round(candidates / others::DOUBLE, 6)), 6) AS avg_share,
 list_sort(list(round(candidates / others::DOUBLE, 6)))[greatest(1, floor(count(*) * 0.95 + 0.9999)::INT)] AS p95_share FROM q GROUP BY ALL)"""

ORACLES = {
    "ann_sweep": f"WITH {_SWEEP} SELECT tables::INT AS tables, level::INT AS level, {FAMILY.width} << level AS bucket, cases, avg_recall, avg_share, p95_share FROM w",
    "pareto_frontier": f"""WITH {_SWEEP}, b AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY avg_share ORDER BY avg_recall DESC, tables * 100 + level) = 1)
SELECT tables::INT AS tables, level::INT AS level, avg_recall, avg_share FROM b QUALIFY avg_recall > coalesce(max(avg_recall) OVER (ORDER BY avg_share ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)""",
    "dot_product_topk": f"WITH {_ANN} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM tr",
    "ann_bucket_topk": f"""WITH {_ANN} SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
FROM s JOIN m USING (query_id, vec_id) WHERE tables = {SETTING[0]} AND met <= {SETTING[1]} QUALIFY rank <= {K}""",
    "as_of_join": f"""WITH {CORPUS_SQL}, r AS (SELECT conv_id * 1000 + turn AS query_id, strftime(DATE '2019-06-01' + ((conv_id * 97 + turn * 31) % 2500)::INT, '%Y-%m-%d') AS as_of FROM conversations WHERE role = 'user'),
x AS (SELECT doc_id, topic, CASE WHEN doc_id % 7 = 1 THEN '' ELSE expire_date END AS expire_date, CASE WHEN doc_id % 5 = 1 OR effective_date = '' THEN '' ELSE publish_date END AS effective_date FROM corpus)
SELECT query_id, topic, count(*) AS in_force, arg_max(doc_id, (effective_date, -doc_id)) AS latest FROM r JOIN x ON (effective_date <> '' OR expire_date <> '') AND (effective_date = '' OR effective_date <= as_of) AND (expire_date = '' OR expire_date >= as_of) GROUP BY ALL""",
    "breaker_states": service._BREAKER.replace("SELECT key, id, outcome, failures FROM r", "SELECT key, arg_max(failures, n) AS failures, arg_max(outcome, n) AS outcome FROM r GROUP BY key"),
    "breaker_stream": service._BREAKER,
    "memory_stream": """WITH l AS (SELECT user_id AS session, ['short', 'long', 'special'][(event_id % 3 + 1)::INT] AS kind, event_type AS key, ts, event_id AS ord FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 3, event_type ORDER BY ts DESC, event_id DESC) = 1)
SELECT session, kind, key, ord FROM l WHERE kind = 'long' OR ts + CASE kind WHEN 'short' THEN INTERVAL 4 HOUR ELSE INTERVAL 90 DAY END > TIMESTAMP '2024-01-30'""",
    "chat_answers": service.ORACLES["route_intent"].split("SELECT query_id, split_part(i, '/', 1)")[0] + f"""SELECT query_id // 1000 AS session, query_id % 1000 AS ord, split_part(i, '/', 1) AS intent,
 CASE split_part(i, '/', 1) WHEN 'smalltalk' THEN 'rag' WHEN 'follow_up' THEN 'rag,skill_exec' ELSE 'rag,web_search,skill_exec' END AS features,
 CASE WHEN regexp_matches({_SQ("query")}, '{c.INPUT_RULES[0][0]}') OR regexp_matches({_SQ("query")}, '{c.INPUT_RULES[1][0]}') OR regexp_matches(query, '{c.OUTPUT_RULES[0][0]}') OR regexp_matches(query, '{c.OUTPUT_RULES[1][0]}') THEN 'degraded' ELSE 'ok' END AS status
 FROM i JOIN u USING (query_id)""",
    "bm25_kept_topk": retrieval.ORACLES["bm25_topk"],
    "frames_stream": service.ORACLES["sse_reassemble"],
}
