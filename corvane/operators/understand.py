"""Queries before retrieval: routes, rewriting, features, models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane import config as c
from corvane.functions.text import has_any, has_year, let, squeeze


def retrieval_route(query: Column) -> tuple[Column, Column]:
    """Label and reason."""
    q = F.trim(query)
    rules = (
        (q == "", "policy", "empty_query"), (has_any(q, c.TIME_WORDS_RETRIEVAL), "time_sensitive", "time_sensitive_keyword"),
        ((F.length(q) <= 10) & has_any(q, c.FOLLOW_UP_WORDS), "follow_up", "short_follow_up"), (has_any(q, c.FAQ_WORDS), "faq", "faq_keyword"),
    )
    return _first(rules, "policy", "default_policy")


def gateway_intent(query: Column, smalltalk: tuple[str, ...] = c.GATEWAY_SMALLTALK) -> tuple[Column, Column]:
    q = squeeze(query)
    rules = (
        (q == "", "policy", "empty_query"), (has_any(q, c.TIME_WORDS_GATEWAY) | has_year(q), "time_sensitive", "time_sensitive_keyword"),
        ((F.length(q) <= 14) & has_any(q, c.GATEWAY_FOLLOW_UP), "follow_up", "short_follow_up"), (has_any(q, smalltalk), "smalltalk", "smalltalk_keyword"),
        (has_any(q, c.GATEWAY_PROCESS), "process", "process_keyword"), (has_any(q, c.GATEWAY_FAQ), "faq", "faq_keyword"),
    )
    return _first(rules, "policy", "default_policy")


def _first(rules: tuple, label: str, reason: str) -> tuple[Column, Column]:
    a = b = None
    for test, x, y in rules:
        a, b = (F.when(test, x), F.when(test, y)) if a is None else (a.when(test, x), b.when(test, y))
    return a.otherwise(label), b.otherwise(reason)


def route_depth(label: Column, s: c.Settings = c.SETTINGS) -> Column:
    return F.when(label == "time_sensitive", min(s.top_n + 12, s.retry_n)).when(label == "follow_up", max(12, s.top_n // 2)).when(label == "faq", max(20, s.top_n - 8)).otherwise(s.top_n)


def routed_features(label: Column, features: Column) -> Column:
    """Features after the route's edits."""
    f = F.array_distinct(features)
    has = lambda x: F.array_contains(f, x)
    outside = F.array(*[F.lit(x) for x in ("web_search", "skill_exec", "use_saved_skill")])
    return (
        F.when((label == "time_sensitive") & has("rag") & ~has("web_search"), F.array_append(f, F.lit("web_search")))
        .when((label == "process") & ~has("use_saved_skill") & ~has("skill_exec"), F.array_append(f, F.lit("skill_exec")))
        .when(label == "follow_up", F.array_remove(f, "web_search")).when(label == "smalltalk", F.array_except(f, outside)).otherwise(f)
    )


def normal_features(features: Column, tools: Column, strict: Column) -> Column:
    """Features with those of older tool names, the default ones if there are none, the citation guard if strict, and all that they need."""
    mapped = F.filter(F.transform(tools, _mapped), lambda x: x.isNotNull())
    f = F.array_distinct(F.concat(features, mapped))
    f = let(f, lambda f: F.when(F.size(f) == 0, F.array(F.lit("rag"), F.lit("citation_guard"))).otherwise(f))
    f = let(f, lambda f: F.when(strict & ~F.array_contains(f, "citation_guard"), F.array_append(f, F.lit("citation_guard"))).otherwise(f))
    for _ in range(len(c.FEATURE_NEEDS)):  # no chain of needs is longer
        f = let(f, lambda f: F.array_distinct(F.concat(f, F.filter(F.transform(f, _needed), lambda x: x.isNotNull()))))
    return f


def _mapped(t: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, feature in c.TOOL_FEATURES.items():
        out = F.when(t == name, feature).otherwise(out)
    return out


def _needed(f: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, need in c.FEATURE_NEEDS.items():
        out = F.when(f == name, need).otherwise(out)
    return out


def planned(features: Column) -> Column:
    """Features once each, in order of priority; unknown ones last, as they came."""
    f, order = F.array_distinct(features), F.array(*[F.lit(x) for x in c.FEATURE_ORDER])
    place = lambda x: F.when(F.array_contains(order, x), F.array_position(order, x)).otherwise(99)
    return F.transform(F.array_sort(F.transform(f, lambda x, i: F.struct(place(x).alias("p"), i.alias("i"), x.alias("x")))), lambda s: s["x"])


def needs_rewrite(query: Column) -> Column:
    return (F.length(query) >= 18) | has_any(query, c.QUESTION_WORDS)


def constraints(query: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(query, F.lit(f"({c.CONSTRAINTS})"), F.lit(1)))


def split_intents(query: Column, words: tuple[str, ...] = c.INTENT_WORDS) -> Column:
    """A query for each of up to four subjects, if it names two or more."""
    hits = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(query, w))
    tail = F.when(has_any(query, ("多少", "收费", "费用")), "是多少").when(has_any(query, ("怎么", "如何", "办理", "申请")), "怎么办").when(query.contains("什么"), "是什么").otherwise("")
    limits = F.array_join(F.slice(constraints(query), 1, 2), " ")
    return F.when(F.size(hits) > 1, F.slice(F.transform(hits, lambda w: F.trim(F.concat(w, tail, F.lit(" "), limits))), 1, 4)).otherwise(F.array().cast("array<string>"))


def enriched(query: Column, hints: Column) -> Column:
    """A short or pointing query with up to two hints from memory, tags removed, 48 characters each."""
    q = F.trim(query)
    hint = F.trim(F.array_join(F.transform(F.slice(hints, 1, 2), lambda h: F.substring(squeeze(F.regexp_replace(h, r"\[[^\]]+\]", " ")), 1, 48)), " "))
    wants = (F.length(q) <= 18) | has_any(q, ("这个", "那个", "它", "还", "那", "呢", "吗"))
    return F.when((q != "") & wants & (hint != ""), F.concat(q, F.lit(" "), hint)).otherwise(q)


def rewrites(query: Column, hints: Column | None = None, words: tuple[str, ...] = c.INTENT_WORDS) -> Column:
    """Up to six forms of a query: itself with memory, itself, its subjects, and two with official words."""
    e = enriched(query, hints) if hints is not None else F.trim(query)
    tail = F.array_join(constraints(e), " ")
    more = F.when(needs_rewrite(e), F.array(F.concat(e, F.lit(" 招生章程")), F.concat(e, F.lit(" 官方政策")))).otherwise(F.array(F.concat(e, F.lit(" 官方")), F.when(tail != "", F.concat(e, F.lit(" "), tail)).otherwise(F.concat(e, F.lit(" 招生")))))
    return merged(F.concat(F.array(e, query), split_intents(e, words), more))


def merged(queries: Column, most: int = 6) -> Column:
    return F.slice(F.array_distinct(F.filter(F.transform(queries, squeeze), lambda x: x != "")), 1, most)


def model_route(query: Column, n_blocks: Column, requested: Column) -> Column:
    """requested, main or light."""
    q = F.trim(query)
    points = (F.length(q) >= 48).cast("int") + (n_blocks >= 3).cast("int") + has_any(q, c.COMPLEX_WORDS).cast("int")
    return F.when(F.coalesce(requested, F.lit("")) != "", "requested").when(points >= 2, "main").otherwise("light")
