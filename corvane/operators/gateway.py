"""Steps around an answer, as column functions and small joins: requests, features and failures, tools, assembly of the text, memory afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane import config as c
from corvane.functions.text import has_any, squeeze, strip, url_quote
from corvane.operators import safety

NONE = "array<string>"


def rejected(requests: DataFrame) -> Column:
    """A request that wants a saved skill must name one."""
    return F.coalesce(F.array_contains("features", "use_saved_skill"), F.lit(False)) & (strip(F.coalesce("saved_skill_id", F.lit(""))) == "")


def fail_features(header: Column) -> Column:
    """Names in a comma-separated header, each once."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(header, F.lit("")), ","), strip), lambda x: x != ""))


def failed(fails: Column, *stages: str) -> Column:
    """Whether a failure is injected into any of the stages."""
    return F.coalesce(F.arrays_overlap(fails, F.array(*[F.lit(s) for s in stages])), F.lit(False))


def route_notes(label: Column, reason: Column, before: Column, after: Column) -> tuple[Column, Column]:
    """What a route changed in the features, as codes of notes, and its audit trail."""
    added, gone = F.array_except(after, before), F.array_except(before, after)
    on = F.transform(added, lambda x: F.concat(F.lit("auto_enable:"), x))
    off = F.when(F.size(gone) > 0, F.array(F.concat(F.lit("auto_disable:"), F.array_join(gone, "+")))).otherwise(F.array().cast(NONE))
    notes = F.concat(on, off)
    return notes, F.concat(F.array(F.concat_ws(":", F.lit("query_router:label"), label, reason)), F.transform(notes, lambda x: F.concat(F.lit("query_router:"), x)))


def any_source(sources: Column) -> Column:
    return F.coalesce(F.size(sources) > 0, F.lit(False))


def soft_pass(ok: Column, error: Column) -> Column:
    """A guard that broke down, rather than said no, lets an answer with sources pass."""
    return ~F.coalesce(ok, F.lit(False)) & (strip(F.coalesce(error, F.lit(""))) != "")


def audited(text: Column, instead: str) -> tuple[Column, Column]:
    """The reason of the output audit (ok if none) and the text, replaced where it is flagged."""
    reason = safety.audit_output(F.coalesce(text, F.lit("")))
    bad = F.coalesce(reason, F.lit("")).isin("", "ok")
    return F.when(bad, "ok").otherwise(reason), F.when(bad, F.coalesce(text, F.lit(""))).otherwise(instead)


def citation_notice(features: Column, sources: Column, degraded: Column, notice: str) -> tuple[Column, Column]:
    """The notice before an answer whose sources can't be shown, and the degraded features with the guard among them."""
    wanted, known = F.array_contains(features, "citation_guard"), F.array_distinct(degraded)
    short = wanted & ~(any_source(sources) & ~F.array_contains(known, "citation_guard"))
    return F.when(short, notice).otherwise(""), F.when(short, F.array_union(known, F.array(F.lit("citation_guard")))).otherwise(known)


def assembled(rows: DataFrame, notice: str, instead: str) -> DataFrame:
    """Rows (features, sources, degraded, text, route, model, cache_hit, audit) with the final text, status, degraded features and audit trail."""
    prefix, degraded = citation_notice(F.col("features"), F.col("sources"), F.col("degraded"), notice)
    rows = rows.withColumns({"degraded": degraded, "text": F.concat(prefix, F.coalesce("text", F.lit("")))})
    reason, text = audited(F.col("text"), instead)
    rows = rows.withColumn("flag_", reason)
    made = F.concat_ws(":", F.lit("generation"), "route", F.coalesce("model", F.lit("unknown")), F.when(F.col("cache_hit"), "cache_hit").otherwise("cache_miss"))
    caught = F.when(F.col("flag_") != "ok", F.array(F.concat(F.lit("safety_audit:output_sanitized:"), "flag_"))).otherwise(F.array().cast(NONE))
    rows = rows.withColumns({"audit": F.concat("audit", F.array(made), caught), "text": text})
    return rows.withColumn("status", F.when((F.col("flag_") != "ok") | (F.size("degraded") > 0), "degraded").otherwise("ok")).drop("flag_")


def skill_note(bridge: Column, saved: Column, general: Column) -> Column:
    """The first note that isn't blank: the bridge's, the saved skill's, the general one."""
    pick = lambda x: F.nullif(strip(x), F.lit(""))
    return F.coalesce(pick(bridge), pick(saved), general)


def evidence_blocks(blocks: Column) -> Column:
    """Outside text, cleaned and marked as evidence, numbered from 1."""
    return F.transform(blocks, lambda x, i: F.concat(F.lit("[外部证据"), (i + 1).cast("string"), F.lit("] "), safety.sanitize(x)))


def web_hits(queries: DataFrame, domains: tuple[str, ...]) -> DataFrame:
    """The stand-in for a web search: one hit (query_id, title, url, snippet) on the first of the allowed domains for each query."""
    url = F.concat(F.lit(f"https://{domains[0]}/search?keyword="), url_quote(F.col("query")))
    return queries.select("query_id", F.lit(1).alias("n"), F.concat(F.lit("官方结果："), "query").alias("title"), url.alias("url"), F.lit(" ".join(domains)).alias("snippet"))


def page_hits(queries: DataFrame, pages: DataFrame, n: int = 5) -> DataFrame:
    """Hits (query_id, n, title, url, snippet) among crawled pages (page_id, url, html) by the sparse channel over their plain text."""
    from corvane.operators import retrieve

    plain = pages.select(F.col("page_id").alias("doc_id"), "url", safety.plain_text(F.col("html")).alias("text"))
    found = retrieve.sparse_overlap(queries, plain, n).where("score > 0")
    return found.join(plain, "doc_id").select("query_id", F.col("rank").alias("n"), F.substring("text", 1, 40).alias("title"), "url", F.substring(squeeze(F.col("text")), 1, 200).alias("snippet"))


def web_blocks(queries: DataFrame, hits: DataFrame, most: int = 2) -> DataFrame:
    """(query_id, blocks): the first hits of each query as text blocks."""
    block = F.concat(F.lit("[official-page][query="), "query", F.lit("][title="), "title", F.lit("][url="), "url", F.lit("]\n"), "snippet")
    rows = hits.where(F.col("n") <= most).join(queries.select("query_id", "query"), "query_id").select("query_id", F.struct("n", block.alias("b")).alias("s"))
    return rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["b"]).alias("blocks"))


def special_memory(text: Column, words: tuple = c.STYLE_WORDS) -> Column:
    """The preference that the first word found in the text stands for, or null."""
    out = F.lit(None).cast("string")
    for word, value in reversed(words):
        out = F.when(text.contains(word), value).otherwise(out)
    return out


def long_memory_snippet(question: Column, answer: Column) -> Column:
    return F.concat(F.lit("用户关注："), F.substring(question, 1, 80), F.lit("；系统回应摘要："), F.substring(squeeze(answer), 1, 160))


def memory_effects(answers: DataFrame) -> DataFrame:
    """What an answer (session, ord, question, text) leaves in memory: (session, ord, kind, key, value): the question, a piece of the rolling summary, a preference if one was said."""
    row = lambda kind, key, value: F.struct(F.lit(kind).alias("kind"), F.lit(key).alias("key"), value.alias("value"))
    three = F.array(row("short", "last_user_query", F.col("question")), row("long", "summary", long_memory_snippet(F.col("question"), F.col("text"))), row("special", "response_style", special_memory(F.col("question"))))
    return answers.select("session", "ord", F.explode(F.filter(three, lambda x: x["value"].isNotNull())).alias("m")).select("session", "ord", "m.*")


def memory_context(entries: DataFrame, most: int = 2) -> DataFrame:
    """(session, kind, blocks): the latest entries (session, kind, key, value, verified) of each kind, at most ``most``."""
    order = Window.partitionBy("session", "kind").orderBy(F.desc("verified"), "key")
    rows = entries.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    return rows.groupBy("session", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]).alias("blocks"))


def delivered(deltas: DataFrame, failure: str) -> DataFrame:
    """(session, text, status): deltas (session, seq, delta, error) joined in order; a stream that broke keeps what came and ends with the failure's text."""
    rows = deltas.groupBy("session").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("delta").isNotNull(), F.struct("seq", "delta")))), lambda x: x["delta"]), "").alias("said"),
        F.max(F.col("error").isNotNull()).alias("broke"),
    )
    text = F.when(~F.col("broke"), F.col("said")).when(F.col("said") == "", F.lit(failure)).otherwise(F.concat("said", F.lit("\n"), F.lit(failure)))
    return rows.select("session", text.alias("text"), F.when(F.col("broke"), F.when(F.col("said") == "", "failed").otherwise("degraded")).otherwise("ok").alias("status"))


def stream_outcome(items: DataFrame) -> DataFrame:
    """(key, id, t, failed): each stream (key, id, t, seq, error) as one event of the breaker, failed if any of its items is, at its last item."""
    return items.groupBy("key", "id").agg(F.max("t").alias("t"), F.max(F.col("error").isNotNull()).alias("failed"))


def preview(text: Column, most: int = 80) -> Column:
    one = squeeze(text)
    return F.when(F.length(one) <= most, one).otherwise(F.concat(F.substring(one, 1, most), F.lit("...")))


def setting(raw: Column, kind: str, default) -> Column:
    """A setting's text as ``double``, ``int`` or ``array<int>`` (comma-separated, bad parts left out), or the default where it is missing or bad."""
    if kind.startswith("array"):
        parts = F.filter(F.transform(F.split(raw, ","), lambda x: strip(x).try_cast("int")), lambda x: x.isNotNull())
        return F.coalesce(F.when(F.size(parts) > 0, parts), F.array(*[F.lit(x) for x in default]))
    return F.coalesce(strip(raw).try_cast(kind), F.lit(default).cast(kind))


def case_passed(ok: Column, status: Column, should_fail: Column) -> Column:
    """A case that should fail passes if it failed or came out degraded, another if it came out ok or degraded; none without an answer."""
    return F.coalesce(ok & F.when(should_fail, status.isin("failed", "degraded")).otherwise(status.isin("ok", "degraded")), F.lit(False))


def evaluated(rows: DataFrame, cases: DataFrame) -> DataFrame:
    """Results (name, ok, status, latency_ms) against cases (name, category, should_fail): one row per category and one over all (category null)."""
    joined = rows.join(cases, "name").withColumn("passed", case_passed(F.col("ok"), F.col("status"), F.col("should_fail")))
    share = F.round(F.avg(F.col("passed").cast("double")), 4).alias("pass_rate")
    return joined.rollup("category").agg(F.count("*").alias("total"), share, F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms)").alias("p95_latency_ms"))


def variant_flag(variant: Column, name: str, default: bool = False) -> Column:
    return F.when(variant.contains(f"_{name}_on"), True).when(variant.contains(f"_{name}_off"), False).otherwise(default)


def variant_base(variant: Column) -> Column:
    return F.regexp_replace(variant, "_(rewrite|rerank|small2big)_(on|off)", "")


def feature_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, on, list(needs)) for i, on, needs in c.FEATURES], "id string, default_enabled boolean, needs array<string>")


def tool_catalog(spark: SparkSession, domains: tuple[str, ...] = ()) -> DataFrame:
    rows = [(*t, list(domains) if t[1] == "remote" else []) for t in c.TOOLS]
    return spark.createDataFrame(rows, "id string, kind string, timeout_seconds double, attempts int, longest_query int, time_sensitive_only boolean, audit_scope string, domains array<string>")


def cache_key(*parts: Column) -> Column:
    """A hash that tells apart any two different lists of values."""
    return F.sha2(F.to_json(F.struct(*[p.cast("string").alias(f"p{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256)
