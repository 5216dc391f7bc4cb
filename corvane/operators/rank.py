"""What happens to ranked evidence: reranking, conflicts, quality, citations, retry, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.config import SETTINGS, TIME_WORDS_GATE, Settings
from corvane.functions.text import YEAR, count_of, tokens
from corvane.operators.retrieve import time_sensitive, top


def rerank(ranked: DataFrame, n: int) -> DataFrame:
    """Of rows (query_id, query, doc_id, text, publish_date, score, rank): 0.6 of the score, 0.1 for each occurrence of a query token up to four, 0.05 by place, 0.03 if dated."""
    text = F.lower("text")
    counted = F.aggregate(tokens(F.col("query")), F.lit(0).cast("int"), lambda s, t: s + F.least(count_of(text, t), F.lit(4)))
    score = F.col("score") * 0.6 + counted * 0.1 + F.lit(0.05) / F.col("rank") + F.when(F.coalesce("publish_date", F.lit("")) != "", 0.03).otherwise(0.0)
    rows = ranked.withColumn("score", F.round(score, 9)).withColumnRenamed("rank", "place")
    return top(rows, n, F.desc("score"), F.col("place"))


def authority(url: Column, own_domains: tuple[str, ...] = ()) -> Column:
    """4 for government, 3 for the house's own domains, 2 for other schools, 1 for any address, 0 for none."""
    u = F.lower(F.coalesce(url, F.lit("")))
    own = F.lit(False)
    for s in own_domains:
        own = own | u.contains(s)
    return F.when(u.contains(".gov.cn"), 4).when(own, 3).when(u.contains(".edu.cn"), 2).when(u != "", 1).otherwise(0)


def document_year() -> Column:
    dated = F.coalesce(*[F.when(F.col(c).rlike("^[0-9]{4}"), F.substring(c, 1, 4)) for c in ("effective_date", "publish_date", "expire_date")])
    return F.coalesce(dated, F.regexp_extract(F.concat_ws(" ", "title", "topic", "text"), YEAR, 1))


def resolve_conflicts(ranked: DataFrame, words: tuple[str, ...] = TIME_WORDS_GATE) -> DataFrame:
    """Of each time-sensitive query whose first four differ in priority and whose best has no equal: only rows of the winner's year, best first. ``resolved`` and ``place`` are added; other queries stay as they are."""
    empty = F.lit("")
    rows = ranked.withColumn("year", document_year())
    publish = F.coalesce(F.nullif("publish_date", empty), "year")
    rows = rows.withColumn("priority", F.struct(authority(F.col("source_url")).alias("a"), F.coalesce(F.nullif("effective_date", empty), publish).alias("e"), publish.alias("p")))
    q = Window.partitionBy("query_id")
    rows = rows.withColumn("kinds", F.size(F.collect_set(F.when(F.col("rank") <= 4, F.col("priority"))).over(q)))
    rows = rows.withColumn("place", F.row_number().over(q.orderBy(F.desc("priority"), "rank")))
    rows = rows.withColumns({"best": F.max(F.when(F.col("place") == 1, F.col("priority"))).over(q), "second": F.max(F.when(F.col("place") == 2, F.col("priority"))).over(q), "winner": F.max(F.when(F.col("place") == 1, F.col("year"))).over(q)})
    resolved = time_sensitive(F.col("query"), words) & (F.col("kinds") > 1) & ~F.col("best").eqNullSafe(F.col("second"))
    rows = rows.withColumn("resolved", resolved).where(~F.col("resolved") | ((F.col("winner") != "") & (F.col("year") == F.col("winner"))) | ((F.col("winner") == "") & (F.col("place") == 1)))
    return rows.withColumn("place", F.row_number().over(q.orderBy(F.when(F.col("resolved"), F.col("place")).otherwise(F.col("rank"))))).drop("kinds", "best", "second", "winner", "priority")


def quality(ranked: DataFrame, queries: DataFrame, words: tuple[str, ...] = TIME_WORDS_GATE, s: Settings = SETTINGS) -> DataFrame:
    """A row per query: coverage of its tokens by the first four documents, sources, conflicts, stale documents, reason, passed."""
    source = F.coalesce(F.nullif("source_url", F.lit("")), F.nullif("title", F.lit("")), F.col("doc_id").cast("string"))
    first = F.col("rank") <= 4
    years = F.when(first & time_sensitive(F.col("query"), words), F.when(F.col("publish_date") != "", F.array(F.substring("publish_date", 1, 4))).otherwise(F.regexp_extract_all(F.concat_ws(" ", "title", "topic", "text"), F.lit(YEAR), F.lit(1))))
    by = ranked.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(first, F.struct("rank", F.lower("text").alias("t"))))), lambda x: x["t"]), " ").alias("body"),
        F.countDistinct(source).alias("unique_sources"), F.count("*").alias("n"), F.count_if((F.col("expire_date") != "") & (F.col("expire_date") < s.as_of)).alias("stale_count"),
        F.size(F.array_distinct(F.flatten(F.collect_list(years)))).alias("years"),
    )
    t = tokens(F.col("query"))
    rows = queries.join(by, "query_id", "left").withColumn("coverage", F.when(F.col("n").isNull(), 0.0).when(F.size(t) == 0, 1.0).otherwise(F.round(F.size(F.filter(t, lambda x: F.contains(F.col("body"), x))) / F.greatest(F.size(t), F.lit(1)), 4)))
    conflict = F.when(F.col("years") > 1, 1).otherwise(0)
    reason = (
        F.when(F.col("n").isNull(), "empty_retrieval").when(conflict > 0, "conflicting_evidence").when(F.col("coverage") < s.min_coverage, "low_coverage")
        .when(time_sensitive(F.col("query"), words) & (F.col("stale_count") >= F.col("n")), "stale_evidence")
    )
    return rows.select("query_id", "coverage", F.coalesce("unique_sources", F.lit(0)).alias("unique_sources"), F.coalesce(conflict, F.lit(0)).alias("conflict_count"), F.coalesce("stale_count", F.lit(0)).alias("stale_count"), F.coalesce(reason, F.lit("")).alias("reason"), reason.isNull().alias("passed"))


def after_resolving(report: DataFrame, resolved: DataFrame, words: tuple[str, ...] = TIME_WORDS_GATE, s: Settings = SETTINGS) -> DataFrame:
    """(query_id, reason) of a report on rows that a conflict was resolved to: coverage and age alone, as the conflict is settled."""
    timely = resolved.groupBy("query_id").agg(F.max(time_sensitive(F.col("query"), words)).alias("timely"), F.count("*").alias("n"))
    reason = F.when(F.col("coverage") < s.min_coverage, "low_coverage").when(F.col("timely") & (F.col("stale_count") >= F.col("n")), "stale_evidence").otherwise("")
    return report.join(timely, "query_id").select("query_id", reason.alias("reason"))


def citation_guard(ranked: DataFrame, queries: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """no_source, insufficient_sources or low_top_score, in this order."""
    source = F.coalesce(F.nullif("source_url", F.lit("")), F.nullif("title", F.lit("")), F.col("doc_id").cast("string"))
    by = ranked.groupBy("query_id").agg(F.countDistinct(source).alias("sources"), F.min_by("score", "rank").alias("top_score"))
    reason = F.when(F.coalesce("sources", F.lit(0)) == 0, "no_source").when(F.col("sources") < s.min_sources, "insufficient_sources").when(F.col("top_score") < s.min_top_score, "low_top_score")
    return queries.select("query_id").join(by, "query_id", "left").select("query_id", F.coalesce("sources", F.lit(0)).alias("sources"), F.coalesce("top_score", F.lit(0.0)).alias("top_score"), F.coalesce(reason, F.lit("")).alias("reason"), reason.isNull().alias("passed"))


def retry_queries(query: Column, time_route: Column) -> Column:
    """The query, its first ten tokens run together, and the query with a word for official sources; up to three."""
    compact = F.array_join(F.slice(tokens(query), 1, 10), "")
    tail = F.when(time_route, F.concat(query, F.lit(" 官方公告"))).otherwise(F.concat(query, F.lit(" 招生政策")))
    some = F.array(query, F.when((compact != "") & (compact != F.lower(query)), compact).otherwise(""), tail)
    return F.slice(F.array_distinct(F.filter(F.transform(some, lambda x: F.trim(x)), lambda x: x != "")), 1, 3)


def pack_context(ranked: DataFrame, k: int) -> DataFrame:
    """(query_id, block, doc_id, topic, score): in order of rank rows are passed over if their parent or content was seen (rows passed over mark nothing); the best row of each topic stays; topics by best score, k at most; then the first, the last, and those between.

    Rows: query_id, doc_id, parent_id, content_hash, topic, score, rank. The fold is over one query's ranked rows."""
    item = F.struct("rank", "doc_id", "parent_id", "content_hash", "topic", "score")
    seen = F.struct(F.array().cast("array<string>").alias("parents"), F.array().cast("array<string>").alias("hashes"), F.array().cast("array<int>").alias("kept"))

    def step(a: Column, x: Column) -> Column:
        known = F.array_contains(a["parents"], x["parent_id"]) | F.array_contains(a["hashes"], x["content_hash"])
        return F.when(known, a).otherwise(F.struct(F.array_append(a["parents"], x["parent_id"]).alias("parents"), F.array_append(a["hashes"], x["content_hash"]).alias("hashes"), F.array_append(a["kept"], x["rank"]).alias("kept")))

    held = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    held = held.select("query_id", F.explode(F.filter("items", lambda x: F.array_contains(F.aggregate("items", seen, step)["kept"], x["rank"]))).alias("x")).select("query_id", "x.*")
    best = held.withColumn("r_", F.row_number().over(Window.partitionBy("query_id", "topic").orderBy(F.desc("score"), "rank"))).withColumn("first", F.min("rank").over(Window.partitionBy("query_id", "topic"))).where("r_ = 1")
    ordered = best.withColumn("g", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "first"))).where(F.col("g") <= k)
    ordered = ordered.withColumn("n", F.count("*").over(Window.partitionBy("query_id")))
    block = F.when((F.col("n") <= 2) | (F.col("g") == 1), F.col("g")).when(F.col("g") == F.col("n"), 2).otherwise(F.col("g") + 1)
    return ordered.select("query_id", block.cast("int").alias("block"), "doc_id", "topic", "score")
