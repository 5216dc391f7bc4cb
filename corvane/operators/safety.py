"""Text safety: cleaning, audits, guards, sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane import config as c
from corvane.functions.text import has_any, has_year, squeeze


def sanitize(text: Column) -> Column:
    """Injections and scripts replaced, in the stated order; white space squeezed."""
    out = F.coalesce(text, F.lit(""))
    for pattern, stand_in in c.INJECTIONS:
        out = F.regexp_replace(out, pattern, stand_in)
    return squeeze(out)


def audit_input(query: Column) -> Column:
    return _audit(squeeze(F.coalesce(query, F.lit(""))), c.INPUT_RULES)


def audit_output(text: Column) -> Column:
    return _audit(F.coalesce(text, F.lit("")), c.OUTPUT_RULES)


def _audit(text: Column, rules: tuple) -> Column:
    out = F.lit("ok")
    for pattern, reason in reversed(rules):
        out = F.when(text.rlike(pattern), reason).otherwise(out)
    return out


def web_guard(query: Column, words: tuple[str, ...] = c.TIME_WORDS_GATEWAY) -> tuple[Column, Column]:
    """Reason and cleaned query of a web search."""
    q = squeeze(query)
    reason = F.when(q == "", "empty_query").when(F.length(q) > 120, "query_too_long").when(~(has_any(q, words) | has_year(q)), "not_time_sensitive").otherwise("official_whitelist")
    clean = squeeze(F.regexp_replace(q, r"[^\p{L}\p{N}_\s\-:/.]", " "))
    return reason, F.when(reason == "official_whitelist", clean).when(reason == "query_too_long", F.substring(q, 1, 120)).otherwise(q)


def skill_guard(requests: DataFrame, skills: DataFrame) -> DataFrame:
    """(query_id, reason, allowed) of requests (query_id, query, saved_skill_id) against saved skills (id)."""
    q = squeeze(F.col("query"))
    known = skills.select(F.col("id").alias("k_")).distinct()
    rows = requests.join(known, F.col("saved_skill_id") == F.col("k_"), "left")
    asked = F.coalesce("saved_skill_id", F.lit("")) != ""
    reason = F.when(q == "", "empty_query").when(F.length(q) > 200, "query_too_long").when(asked & F.col("k_").isNull(), "saved_skill_not_allowed").when(asked, "saved_skill_whitelisted").otherwise("generic_skill_allowed")
    return rows.select("query_id", reason.alias("reason"), reason.isin("saved_skill_whitelisted", "generic_skill_allowed").alias("allowed"))


def distinct_sources(rows: DataFrame, limit: int = 5) -> DataFrame:
    """The first ``limit`` sources (session, ord, url, title) of each session, each once."""
    one = rows.groupBy("session", "url", "title").agg(F.min("ord").alias("ord"))
    return one.withColumn("place", F.row_number().over(Window.partitionBy("session").orderBy("ord"))).where(F.col("place") <= limit)


def plain_text(html: Column) -> Column:
    """A page's text: scripts, styles and tags removed."""
    return squeeze(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style).*?>.*?</(script|style)>", " "), r"(?s)<[^>]*>", " "))
