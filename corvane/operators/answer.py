"""The whole way from requests to answers, as stages over a table of requests: route, rewrite, retrieve, rerank, resolve, judge, retry once, guard, pack.

A row per request comes out: status ``ok`` or ``degraded`` with the first reason, sources, context blocks. Requests: query_id, query, hints (what memory knows; may be
null), fail (names of stages that are made to fail, for tests of degrading; may be null).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.config import SETTINGS, TIME_WORDS_GATE, TIME_WORDS_RETRIEVAL, Settings
from corvane.functions.text import content_hash, strip
from corvane.operators import index as chunks
from corvane.operators import rank, retrieve, understand
from corvane.sources.shared import written

#: Reasons of the gate for which a request is retrieved for once more.
RETRIED = ("low_coverage", "empty_retrieval", "stale_evidence")


def routed(requests: DataFrame, index: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """query (trimmed), route, depth, forms (the query and up to five rewrites; of a follow-up without hints the query alone), focus (parents of the best summaries, for policy questions only)."""
    rows = requests.withColumn("query", strip(F.coalesce("query", F.lit(""))))
    label, _ = understand.retrieval_route(F.col("query"))
    rows = rows.withColumn("route", label).withColumn("depth", understand.route_depth(F.col("route"), s).cast("int"))
    hints = F.coalesce("hints", F.array().cast("array<string>"))
    more = F.concat(F.array("query"), understand.rewrites(F.col("query"), hints))
    forms = F.when((F.col("route") == "follow_up") & (F.size(hints) == 0), F.array("query")).otherwise(F.slice(F.array_distinct(F.filter(F.transform(more, strip), lambda x: x != "")), 1, 6))
    rows = rows.withColumn("forms", forms)
    summaries = index.where("chunk_level = 'summary'").select("chunk_id", "parent_id", "ord", F.concat_ws(" ", "section_hint", "topic", "chunk_text").alias("body"))
    found = retrieve.summary_parents(rows.where("route = 'policy'").select("query_id", "query"), summaries)
    focus = found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "parent_id"))), lambda x: x["parent_id"]).alias("focus"))
    return rows.join(focus, "query_id", "left").withColumn("focus", F.coalesce("focus", F.array().cast("array<string>")))


def answer(
    requests: DataFrame, index: DataFrame, top_k: int | None = None, words: tuple[str, ...] = TIME_WORDS_RETRIEVAL, gate_words: tuple[str, ...] = TIME_WORDS_GATE, s: Settings = SETTINGS,
    reranker: Callable | None = None, table: Callable[[DataFrame], DataFrame] = written,
) -> DataFrame:
    """query_id, route, status, reason, retried, sources, blocks. ``table`` writes a result that later stages read more than once.

    Conflicts are resolved before the gate: of a request that has one resolved, the gate judges the rows that are left, for coverage and age alone. The guard, the sources and the blocks go by
    the resolved rows, else by those of the second retrieval, else of the first. A block has its group, source and score before its text."""
    k = max(1, min(top_k or s.top_k, s.top_k))
    names = {"hints": "array<string>", "fail": "array<string>"}
    asked = requests.select("query_id", "query", *[(F.col(c) if c in requests.columns else F.lit(None)).cast(t).alias(c) for c, t in names.items()])
    asked = table(routed(asked, index, s))
    fails = lambda stage: F.coalesce(F.array_contains("fail", stage), F.lit(False))
    open_ = asked.where(~fails("retrieve"))
    found = table(chunks.chunks_of(chunks.merged(open_.select("query_id", "forms", "depth", "focus"), index, words=words, s=s), index).join(asked.select("query_id", "query"), "query_id"))
    ranked = table(chunks.rerank_with(found, s.top_k, reranker))
    queries = asked.select("query_id", "query")
    resolved = table(rank.resolve_conflicts(ranked, gate_words).where("resolved").drop("resolved"))
    settled = table(resolved.select("query_id").distinct())
    plain = rank.quality(ranked.join(settled, "query_id", "left_anti"), queries.join(settled, "query_id", "left_anti"), gate_words, s)
    after = rank.quality(resolved.withColumn("rank", F.col("place")), queries.join(settled, "query_id"), gate_words, s)
    first = table(plain.select("query_id", "reason").unionByName(rank.after_resolving(after, resolved, gate_words, s)))
    again = first.where(F.col("reason").isin(*RETRIED)).select("query_id").join(open_.select("query_id", "query", "depth", "focus", "route"), "query_id")
    forms = table(again.select("query_id", rank.retry_queries(F.col("query"), F.col("route") == "time_sensitive").alias("forms"), F.greatest(F.lit(s.retry_n), "depth").alias("depth"), "focus"))
    second = chunks.chunks_of(chunks.merged(forms, index, words=words, s=s), index).join(queries, "query_id")
    second = table(chunks.rerank_with(second, s.top_k, reranker))
    retried = forms.select("query_id")
    judged = rank.quality(second, queries.join(retried, "query_id"), gate_words, s).select("query_id", F.col("reason").alias("then"))
    own = lambda df: df.groupBy("query_id").agg(F.max("degraded").alias("fell_back"))
    slow = own(ranked).join(own(second).withColumnRenamed("fell_back", "fell_again"), "query_id", "full")
    # what later stages show: rows that a conflict was resolved to, else those of the second retrieval, else those of the first
    plain_rows = ranked.join(retried, "query_id", "left_anti").unionByName(second).join(settled, "query_id", "left_anti").withColumn("place", F.col("rank"))
    shown_rows = table(resolved.select(plain_rows.columns).unionByName(plain_rows))
    guard = rank.citation_guard(shown_rows.withColumn("rank", F.col("place")), queries, s).select("query_id", F.col("reason").alias("guard"))
    source = F.struct("chunk_id", "title", "source_url", "publish_date", F.round("score", 6).alias("score"))
    shown = shown_rows.where(F.col("place") <= k).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", source.alias("s")))), lambda x: x["s"]).alias("sources"))
    group = F.coalesce(F.nullif("topic", F.lit("")), F.nullif("title", F.lit("")), F.lit("default"))
    packed = shown_rows.withColumns({"rank": F.col("place"), "topic": group, "content_hash": F.coalesce("chunk_text_hash", content_hash(F.col("text")))})
    packed = rank.pack_context(packed, s.top_k)
    text = index.select(F.col("ord").alias("doc_id"), "title", chunks.small_to_big(index).alias("block_text"))
    line = F.concat(F.lit("[证据组:"), "topic", F.lit("][来源:"), F.coalesce("title", F.lit("")), F.lit("][score="), F.format_string("%.3f", F.col("score").cast("double")), F.lit("]\n"), "block_text")
    blocks = packed.join(text, "doc_id").select("query_id", "block", line.alias("line")).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "line"))), lambda x: x["line"]).alias("blocks"))
    out = asked.select("query_id", "route", "fail")
    for side in (first.withColumnRenamed("reason", "gate"), judged, guard, slow, shown, blocks, settled.withColumn("settled", F.lit(True)), forms.select("query_id", F.lit(True).alias("retried"))):
        out = out.join(side, "query_id", "left")
    said = lambda c: F.coalesce(c, F.lit(""))
    fell = lambda c: F.lit(reranker is not None) & F.coalesce(c, F.lit(False))
    once = F.when(fails("retrieve"), "retrieval_error").when(fell("fell_back"), "rerank_degraded").otherwise(said("gate"))
    twice = (
        F.when(F.col("retried").isNull(), once).when(fell("fell_again"), "rerank_degraded").when(said("then") != "", F.col("then"))
        .when(once.isin(*RETRIED), "").otherwise(once)
    )
    reason = F.when(twice == "", said("guard")).when((twice == "conflicting_evidence") & F.col("settled").isNotNull(), "").otherwise(twice)
    none = F.array().cast("array<string>")
    out = out.withColumn("reason", reason).withColumn("status", F.when(F.col("reason") == "", "ok").otherwise("degraded"))
    return out.select("query_id", "route", "status", "reason", F.coalesce("retried", F.lit(False)).alias("retried"), "sources", F.coalesce("blocks", none).alias("blocks"))


def latest_question(turns: DataFrame, default: str = "") -> DataFrame:
    """(session, query): the last message of the user of each session (session, turn, role, text), or the default."""
    last = F.max_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    return turns.groupBy("session").agg(F.coalesce(F.nullif(strip(last), F.lit("")), F.lit(default)).alias("query"))


def graph_evidence(answers: DataFrame, facts: DataFrame, limit: int = 2) -> DataFrame:
    """Facts (query_id, fact, score) appended to answers (query_id, sources, blocks) as blocks and as sources of score 0.12, the best ``limit`` of each query."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "fact")
    best = facts.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit)
    best = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", "fact"))).alias("f"))
    rows = answers.join(best, "query_id", "left")
    more = F.transform("f", lambda x: F.struct(F.concat(F.lit("graph-"), x["n"].cast("string")).alias("chunk_id"), x["fact"].alias("title"), F.lit("").alias("source_url"), F.lit("").alias("publish_date"), F.lit(0.12).alias("score")))
    blocks = F.concat("blocks", F.coalesce(F.transform("f", lambda x: F.concat(F.lit("[graph] "), x["fact"])), F.array().cast("array<string>")))
    return rows.withColumns({"sources": F.when(F.col("f").isNull(), F.col("sources")).otherwise(F.concat(F.coalesce("sources", F.filter(more, lambda x: F.lit(False))), more)), "blocks": blocks}).drop("f")
