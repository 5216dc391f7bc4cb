"""Queries of understanding, state, safety, evaluation and delivery, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane import config as c
from corvane.functions.text import let, url_quote
from corvane.operators import answer, deliver, evaluate, gateway, ingest, retrieve, safety, scans, state, understand
from corvane.plans import retrieval as plans
from corvane.plans.ingest import _SQ, _STRIP, RULES
from corvane.sources.shared import written
from corvane.sources.tables import corpus, read

#: Small talk of the test conversations, which have none of the default words.
SMALLTALK = ("the ", " de ")


def _users(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))


def route_intent(spark: SparkSession, d: str) -> DataFrame:
    a, b = understand.gateway_intent(F.col("query"), SMALLTALK)
    r, why = understand.retrieval_route(F.col("query"))
    rows = _users(spark, d).select("query_id", a.alias("intent"), b.alias("reason"), r.alias("route"), why.alias("route_reason"), understand.route_depth(r).cast("long").alias("depth"))
    return rows.withColumn("features", F.array_join(understand.routed_features(F.col("intent"), F.array(F.lit("rag"), F.lit("web_search"), F.lit("skill_exec"))), ","))


def rewrite_queries(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("query")
    hints = F.array(F.lit("[长期记忆] 偏好 简短"), F.lit("the  second"))
    return _users(spark, d).select("query_id", F.array_join(understand.rewrites(q, hints, ("the", "que", "der")), "|").alias("forms"), understand.needs_rewrite(q).alias("long"))


def model_route(spark: SparkSession, d: str) -> DataFrame:
    return _users(spark, d).select("query_id", understand.model_route(F.col("query"), F.pmod("query_id", F.lit(5)), F.when(F.pmod("query_id", F.lit(7)) == 0, "big")).alias("route"))


def feature_closure(spark: SparkSession, d: str) -> DataFrame:
    """Requests whose features and tools are derived from the number of each event."""
    e = read(spark, d, "events").select("event_id").repartition("event_id")  # for all cores, however few row groups the file has
    names = ("rag", "web_search", "skill_exec", "use_saved_skill", "citation_guard")
    pick = lambda k, x: F.when(F.shiftright("event_id", k) % 2 == 1, x)
    has = lambda a: F.filter(a, lambda x: x.isNotNull())
    features = has(F.array(*[pick(i, n) for i, n in enumerate(reversed(names))]))
    tools = has(F.array(pick(5, "search"), pick(6, "plan"), pick(7, "unknown")))
    normal = understand.normal_features(features, tools, F.col("event_id") % 3 == 0)
    both = let(normal, lambda x: F.struct(F.array_join(x, ",").alias("features"), F.array_join(understand.planned(x), ",").alias("planned")))
    return e.select("event_id", both.alias("b")).select("event_id", "b.features", "b.planned")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), (F.col("event_type") == "error").alias("failed"), "event_type")


#: Events are hours apart, so the open time is long here.
BREAKER = c.Settings(breaker_failures=2, breaker_seconds=200_000)
CACHE = c.Settings(cache_seconds=500_000)


def circuit_breaker(spark: SparkSession, d: str) -> DataFrame:
    return scans.circuit_breaker(_events(spark, d), BREAKER)


def prompt_cache(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    return scans.prompt_cache(e.withColumn("key", F.concat_ws("/", "key", "event_type")), CACHE)


def memory_latest(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    kind = F.element_at(F.array(F.lit("short"), F.lit("long"), F.lit("special")), (F.col("event_id") % 3 + 1).cast("int"))
    log = e.select(F.col("user_id").alias("session"), kind.alias("kind"), F.col("event_type").alias("key"), F.col("props").alias("value"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("ord"))
    rows = state.memory_latest(log, F.lit("2024-01-30 00:00:00").cast("timestamp"))
    return rows.select("session", "kind", "key", "ord", F.col("place").cast("long").alias("place"))


def rolling_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("ord"), F.coalesce("text", F.lit("")).alias("text"))
    return state.rolling_summary(rows)


def skill_versions(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select(F.col("source").alias("name"), F.coalesce("text", F.lit("")).alias("workflow"), F.col("doc_id").alias("ord"))
    return state.skill_versions(rows).withColumn("version", F.col("version").cast("long"))


def session_store(spark: SparkSession, d: str) -> DataFrame:
    return state.session_last(read(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("ord"), F.col("text").alias("value")))


def latest_question(spark: SparkSession, d: str) -> DataFrame:
    return answer.latest_question(read(spark, d, "conversations").withColumnRenamed("conv_id", "session"), "-")


#: Words of the test corpus that stand in for those of a user that say how answers should look.
STYLES = (("tion", "long"), ("en", "short"), ("de", "plain"))


def special_preferences(spark: SparkSession, d: str) -> DataFrame:
    users = _users(spark, d)
    return users.select("query_id", gateway.special_memory(F.col("query"), STYLES).alias("preference"), F.md5(gateway.long_memory_snippet(F.col("query"), F.col("query"))).alias("snippet"), gateway.preview(F.col("query"), 24).alias("preview"))


def sanitize_text(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.md5(safety.sanitize(F.col("html"))).alias("h"), F.length(safety.plain_text(F.col("html"))).cast("long").alias("n_plain"))


def audit_flags(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return read(spark, d, "documents").select("doc_id", safety.audit_input(text).alias("input"), safety.audit_output(text).alias("output"))


def tool_guards(spark: SparkSession, d: str) -> DataFrame:
    reason, query = safety.web_guard(F.col("query"), plans.WORDS)
    users = _users(spark, d)
    asked = users.withColumn("saved_skill_id", F.when(F.pmod("query_id", F.lit(3)) == 0, "src0_v1").when(F.pmod("query_id", F.lit(3)) == 1, "none_v1"))
    skills = skill_versions(spark, d).select("id")
    return users.select("query_id", reason.alias("web_reason"), F.length(query).cast("long").alias("n"), F.length(url_quote(query)).cast("long").alias("n_quoted")).join(safety.skill_guard(asked, skills), "query_id")


def source_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "pages").select(F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("session"), F.col("page_id").alias("ord"), "url", F.length("html").cast("string").alias("title"))
    return safety.distinct_sources(rows).select("session", "ord", "url", F.col("place").cast("long").alias("place"))


def _cases(spark: SparkSession, d: str) -> DataFrame:
    chunks = ingest.two_level_chunks(corpus(read(spark, d, "documents"))).select("chunk_id", "chunk_level", "parent_id", "title", "topic", "section_hint", "chunk_text", "doc_id", "i", "j")
    chunks = written(chunks)  # cases read them three times
    e = ingest.expansions(F.col("chunk_text"), F.col("title"), F.col("topic"), F.col("section_hint"), RULES)
    rows = chunks.select("chunk_id", "chunk_level", "parent_id", "topic", "chunk_text", F.when(F.col("chunk_level") == "small", e).otherwise(F.array().cast("array<string>")).alias("query_expansions"), F.struct("doc_id", "i", "j").alias("ord"))
    return evaluate.retrieval_cases(rows)


def eval_cases(spark: SparkSession, d: str) -> DataFrame:
    return _cases(spark, d).select("case_id", "chunk_id", F.md5("query").alias("h"), "category", F.size("relevant").cast("long").alias("n_relevant"), F.md5(F.array_join("relevant", ",")).alias("relevant"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose id is divisible by 20 ask all documents with their first 32 characters; relevant are documents of equal content. The answer is the sparse channel's."""
    docs = corpus(read(spark, d, "documents"))
    same = docs.select("doc_id", F.sha2("text", 256).alias("class"))
    sizes = same.groupBy("class").agg(F.count("*").alias("n_relevant"))
    asked = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("case_id"), F.col("topic").alias("category"), F.sha2("text", 256).alias("class"), F.substring("text", 1, 32).alias("query"))
    found = retrieve.sparse_overlap(asked.select(F.col("case_id").alias("query_id"), "query"), docs, 5)
    found = found.join(same, "doc_id").select(F.col("query_id").alias("case_id"), F.col("doc_id").alias("id"), "rank", "class")
    return evaluate.class_metrics(asked.join(sizes, "class"), found, 5)


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d)


def bucket_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.summarize(_judged(spark, d).withColumn("latency_ms", F.pmod("case_id", F.lit(97)).cast("double")), "category", digits=7)


def ablation_variants(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of each channel alone and of all fused, for the benchmark's texts; relevant are all documents that hold the item whole."""
    docs, queries = plans._docs(spark, d), plans._queries(spark, d)
    searched = {"bm25": retrieve.bm25, "exact": retrieve.exact, "sparse": retrieve.sparse_overlap, "dense": retrieve.hash_dense}
    channels = {name: written(f(queries, docs, 12)) for name, f in searched.items()}
    fused = retrieve.fuse({name: channels[name] for name in ("sparse", "dense", "exact")})
    channels["rrf"] = retrieve.top(fused, 12, F.desc("rrf"), F.col("first.channel"), F.col("first.r"))
    truth = written(retrieve.holders(queries, docs).distinct())
    sizes = truth.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    cases = written(sizes.select(F.col("query_id").alias("case_id"), F.lit("all").alias("category"), F.lit(True).alias("class"), "n_relevant"))
    out = None
    for name, rows in channels.items():
        found = rows.join(truth, ["query_id", "doc_id"]).select(F.col("query_id").alias("case_id"), F.col("doc_id").alias("id"), "rank", F.lit(True).alias("class"))
        one = evaluate.summarize(evaluate.class_metrics(cases, found, 5)).withColumn("variant", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def _answers(spark: SparkSession, d: str) -> DataFrame:
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    rows = read(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text", words("the", "de", "en").alias("keywords"), words("idiot", "stupid").alias("forbidden"), (F.col("turn") % 2 == 0).alias("require_citation"), (F.col("conv_id") % 3).alias("n_sources"), (F.col("turn") > 3).alias("hard_case"))
    return evaluate.answer_metrics(rows)


def answer_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.rates(_answers(spark, d), "hard_case")


def release_gate(spark: SparkSession, d: str) -> DataFrame:
    report = evaluate.rates(_answers(spark, d)).select("pass_rate", "citation_hit_rate", F.lit(900.0).alias("p95_latency_ms"), F.lit(1).alias("failed_rows"))
    rows = evaluate.release_gate(report, "canary", baseline=(0.9, 0.9, 100.0))
    return rows.select("pass_rate", "citation_hit_rate", "decision", "next_stage", F.array_join("reasons", ",").alias("reasons"))


def label_quality_join(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id")
    return rows.groupBy("lang", "source").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality"), F.sum(F.col("toxic").cast("long")).alias("toxic"))


def _said(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("session"), F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("turn") % 2 == 0, "ok").otherwise("degraded").alias("status"))


def sse_chunks(spark: SparkSession, d: str) -> DataFrame:
    return deliver.frames(_said(spark, d)).select("session", F.col("seq").cast("long").alias("seq"), "event", F.coalesce(F.get_json_object("data", "$.delta"), F.get_json_object("data", "$.status")).alias("said"))


def sse_reassemble(spark: SparkSession, d: str) -> DataFrame:
    return deliver.parse_stream(deliver.stream_text(deliver.frames(_said(spark, d))))


QUERIES = {
    f.__name__: f
    for f in (
        route_intent, rewrite_queries, model_route, feature_closure, circuit_breaker, prompt_cache, memory_latest, rolling_summary, skill_versions, session_store, latest_question, special_preferences,
        sanitize_text, audit_flags, tool_guards, source_dedup, eval_cases, retrieval_metrics, bucket_metrics, ablation_variants, answer_metrics, release_gate, label_quality_join, sse_chunks, sse_reassemble,
    )
}


def _any(col: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


_YEAR = f"regexp_matches(q, '{plans._YEAR}')"
_USERS = "u AS (SELECT conv_id * 1000 + turn AS query_id, coalesce(text, '') AS query FROM conversations WHERE role = 'user')"
_EVENTS = "e AS (SELECT user_id::VARCHAR AS key, event_id AS id, epoch(date_trunc('second', ts))::DOUBLE AS t, event_type = 'error' AS failed, event_type FROM events)"
_BREAKER = f"""WITH RECURSIVE {_EVENTS}, o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, id) AS n FROM e),
r AS (SELECT key, id, n, CASE WHEN failed THEN 'failed' ELSE 'ok' END AS outcome, CASE WHEN failed THEN 1 ELSE 0 END AS failures, 0.0::DOUBLE AS until FROM o WHERE n = 1
 UNION ALL SELECT o.key, o.id, o.n, CASE WHEN r.until > o.t THEN 'rejected' WHEN o.failed THEN 'failed' ELSE 'ok' END,
  CASE WHEN r.until > o.t THEN r.failures WHEN o.failed THEN r.failures + 1 ELSE 0 END,
  CASE WHEN r.until > o.t THEN r.until WHEN o.failed AND r.failures + 1 >= 2 THEN o.t + {BREAKER.breaker_seconds} WHEN o.failed THEN r.until ELSE 0.0 END FROM r JOIN o ON o.key = r.key AND o.n = r.n + 1)
SELECT key, id, outcome, failures FROM r"""
_ORDER = ("rag", "web_search", "skill_exec", "use_saved_skill", "citation_guard")
_BIT = lambda k, x: f"CASE WHEN (event_id >> {k}) % 2 = 1 THEN '{x}' END"
_HITS = "list_filter(['the', 'que', 'der'], lambda w: contains(e, w))"
_LIMITS = "array_to_string(list_distinct(regexp_extract_all(e, '(20[0-9]{2}|[0-9]+分|[0-9]+元|不(?:要|能|可以|允许)|河南|河北|艺术类|理工类)', 1))[:2], ' ')"
_TAIL = "CASE WHEN " + _any("e", ("多少", "收费", "费用")) + " THEN '是多少' WHEN " + _any("e", ("怎么", "如何", "办理", "申请")) + " THEN '怎么办' WHEN contains(e, '什么') THEN '是什么' ELSE '' END"
_OUT = list(c.INJECTIONS)
_SAN = "coalesce(html, '')"
for _p, _r in _OUT:
    _SAN = f"regexp_replace({_SAN}, '{_p}', '{_r}', 'g')"
_JUDGED = f"""WITH {plans.CORPUS_SQL}, q AS (SELECT doc_id AS query_id, substr(text, 1, 32) AS query FROM corpus WHERE doc_id % 20 = 0), tok AS (SELECT doc_id, regexp_extract_all(lower(text), '{plans.TOKEN}', 1) AS t FROM corpus),
post AS (SELECT doc_id, token, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS token FROM tok) GROUP BY ALL), {plans._sparse("sp", "q", 5)},
cs AS (SELECT c.doc_id AS case_id, c.topic AS category, count(*) AS n FROM corpus c JOIN corpus o ON c.text = o.text WHERE c.doc_id % 20 = 0 GROUP BY ALL),
hit AS (SELECT query_id AS case_id, rank FROM sp JOIN corpus c ON c.doc_id = query_id JOIN corpus o ON o.doc_id = sp.doc_id WHERE c.text = o.text),
by_case AS (SELECT case_id, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM hit GROUP BY ALL),
m AS (SELECT case_id, category, round(coalesce(hits / n::DOUBLE, 0), 4) AS recall, round(coalesce(1.0::DOUBLE / first, 0), 4) AS mrr, round(coalesce(dcg / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1))), 0), 4) AS ndcg FROM cs LEFT JOIN by_case USING (case_id))"""
_TEXT = "lower(coalesce(text, ''))"
_ANSWERS = f"""a AS (SELECT turn > 3 AS hard_case, round(len(list_filter(['the', 'de', 'en'], lambda w: contains({_TEXT}, w))) / 3.0::DOUBLE, 4) AS cov, turn % 2 <> 0 OR conv_id % 3 > 0 AS citation_hit,
 contains({_TEXT}, 'idiot') OR contains({_TEXT}, 'stupid') AS bad FROM conversations WHERE role = 'assistant'), j AS (SELECT *, cov >= 0.5 AND citation_hit AND NOT bad AS passed FROM a)"""
_RATES = "count(*) AS total, round(avg(passed::INT), 4) AS pass_rate, round(avg(citation_hit::INT), 4) AS citation_hit_rate, round(avg(bad::INT), 4) AS hallucination_rate"
_CUT = "range(0, CASE WHEN length(text) = 0 THEN 0 ELSE (length(text) + 23) // 24 END)"
_SAID = "s AS (SELECT conv_id * 1000 + turn AS session, coalesce(text, '') AS text, CASE WHEN turn % 2 = 0 THEN 'ok' ELSE 'degraded' END AS status FROM conversations)"

ORACLES = {
    "route_intent": f"""WITH {_USERS}, s AS (SELECT *, {_SQ("query")} AS q, trim(query) AS t FROM u),
i AS (SELECT query_id, CASE WHEN q = '' THEN 'policy/empty_query' WHEN {_any("q", c.TIME_WORDS_GATEWAY)} OR {_YEAR} THEN 'time_sensitive/time_sensitive_keyword' WHEN length(q) <= 14 AND {_any("q", c.GATEWAY_FOLLOW_UP)} THEN 'follow_up/short_follow_up'
 WHEN {_any("q", SMALLTALK)} THEN 'smalltalk/smalltalk_keyword' WHEN {_any("q", c.GATEWAY_PROCESS)} THEN 'process/process_keyword' WHEN {_any("q", c.GATEWAY_FAQ)} THEN 'faq/faq_keyword' ELSE 'policy/default_policy' END AS i,
 CASE WHEN t = '' THEN 'policy/empty_query' WHEN {_any("t", c.TIME_WORDS_RETRIEVAL)} THEN 'time_sensitive/time_sensitive_keyword' WHEN length(t) <= 10 AND {_any("t", c.FOLLOW_UP_WORDS)} THEN 'follow_up/short_follow_up' WHEN {_any("t", c.FAQ_WORDS)} THEN 'faq/faq_keyword' ELSE 'policy/default_policy' END AS r FROM s)
SELECT query_id, split_part(i, '/', 1) AS intent, split_part(i, '/', 2) AS reason, split_part(r, '/', 1) AS route, split_part(r, '/', 2) AS route_reason,
 CASE split_part(r, '/', 1) WHEN 'time_sensitive' THEN 52 WHEN 'follow_up' THEN 20 WHEN 'faq' THEN 32 ELSE 40 END AS depth, CASE split_part(i, '/', 1) WHEN 'smalltalk' THEN 'rag' WHEN 'follow_up' THEN 'rag,skill_exec' ELSE 'rag,web_search,skill_exec' END AS features FROM i""",
    "rewrite_queries": f"""WITH {_USERS}, e AS (SELECT *, CASE WHEN trim(query) <> '' AND (length(trim(query)) <= 18 OR {_any("trim(query)", ("这个", "那个", "它", "还", "那", "呢", "吗"))}) THEN trim(query) || ' 偏好 简短 the second' ELSE trim(query) END AS e FROM u),
x AS (SELECT *, {_HITS} AS hits, length(e) >= 18 OR {_any("e", c.QUESTION_WORDS)} AS more FROM e),
f AS (SELECT query_id, query, list_filter(list_transform([e, query] || CASE WHEN len(hits) > 1 THEN list_transform(hits, lambda w: trim(w || {_TAIL} || ' ' || {_LIMITS}))[:4] ELSE [] END || CASE WHEN more THEN [e || ' 招生章程', e || ' 官方政策'] ELSE [e || ' 官方', e || ' 招生'] END, lambda x: {_SQ("x")}), lambda x: x <> '') AS f FROM x)
SELECT query_id, array_to_string(list_filter(f, lambda x, i: list_position(f, x) = i)[:6], '|') AS forms, length(query) >= 18 OR {_any("query", c.QUESTION_WORDS)} AS long FROM f""",
    "model_route": f"WITH {_USERS} SELECT query_id, CASE WHEN query_id % 7 = 0 THEN 'requested' WHEN (length(trim(query)) >= 48)::INT + (query_id % 5 >= 3)::INT + {_any('trim(query)', c.COMPLEX_WORDS)}::INT >= 2 THEN 'main' ELSE 'light' END AS route FROM u",
    "feature_closure": f"""WITH b AS (SELECT event_id, list_filter([{", ".join(_BIT(i, n) for i, n in enumerate(reversed(_ORDER)))}, CASE WHEN (event_id >> 5) % 2 = 1 THEN 'web_search' END, CASE WHEN (event_id >> 6) % 2 = 1 THEN 'skill_exec' END], lambda x: x IS NOT NULL) AS f FROM events),
d AS (SELECT event_id, CASE WHEN len(f) = 0 THEN ['rag', 'citation_guard'] ELSE list_filter(f, lambda x, i: list_position(f, x) = i) END AS f FROM b),
s AS (SELECT event_id, CASE WHEN event_id % 3 = 0 AND NOT list_contains(f, 'citation_guard') THEN f || ['citation_guard'] ELSE f END AS f FROM d),
n AS (SELECT event_id, f || list_filter(list_transform(f, lambda x: CASE x WHEN 'use_saved_skill' THEN 'skill_exec' WHEN 'citation_guard' THEN 'rag' END), lambda x: x IS NOT NULL AND NOT list_contains(f, x)) AS f FROM s)
SELECT event_id, array_to_string(f, ',') AS features, array_to_string(list_filter({list(_ORDER)}, lambda x: list_contains(f, x)), ',') AS planned FROM n""",
    "circuit_breaker": _BREAKER,
    "prompt_cache": f"""WITH RECURSIVE {_EVENTS}, o AS (SELECT key || '/' || event_type AS key, id, t, row_number() OVER (PARTITION BY key, event_type ORDER BY t, id) AS n FROM e),
r AS (SELECT key, id, n, false AS hit, t AS written FROM o WHERE n = 1 UNION ALL SELECT o.key, o.id, o.n, o.t - r.written <= {CACHE.cache_seconds}, CASE WHEN o.t - r.written <= {CACHE.cache_seconds} THEN r.written ELSE o.t END FROM r JOIN o ON o.key = r.key AND o.n = r.n + 1)
SELECT key, id, hit FROM r""",
    "memory_latest": """WITH l AS (SELECT user_id AS session, ['short', 'long', 'special'][(event_id % 3 + 1)::INT] AS kind, event_type AS key, ts, event_id AS ord FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 3, event_type ORDER BY ts DESC, event_id DESC) = 1),
v AS (SELECT * FROM l WHERE kind = 'long' OR ts + CASE kind WHEN 'short' THEN INTERVAL 4 HOUR ELSE INTERVAL 90 DAY END > TIMESTAMP '2024-01-30')
SELECT session, kind, key, ord, row_number() OVER (PARTITION BY session, kind ORDER BY ts DESC, ord DESC, key) AS place FROM v""",
    "rolling_summary": f"""WITH RECURSIVE s AS (SELECT conv_id AS session, {_SQ("coalesce(text, '')")} AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(text, '')) AS n FROM conversations),
r AS (SELECT session, n, substr(x, 1, 600) AS a FROM s WHERE n = 1 UNION ALL SELECT s.session, s.n, CASE WHEN x = '' THEN a WHEN a = '' THEN substr(x, 1, 600) WHEN contains(a, x) THEN substr(a, 1, 600) ELSE substr(a || ' | ' || x, greatest(length(a || ' | ' || x) - 600, 0) + 1, 600) END FROM r JOIN s ON s.session = r.session AND s.n = r.n + 1)
SELECT session, arg_max(a, n) AS summary FROM r GROUP BY session""",
    "skill_versions": """WITH s AS (SELECT source AS name, coalesce(text, '') AS w, doc_id FROM documents), h AS (SELECT name, substr(sha256(w), 1, 16) AS workflow_hash, min(doc_id) AS ord,
 round(least(0.45::DOUBLE + CASE WHEN contains(any_value(w), '->') THEN 0.2 ELSE 0 END + CASE WHEN length(any_value(w)) > 20 THEN 0.2 ELSE 0 END + CASE WHEN contains(any_value(w), '来源') OR contains(any_value(w), '条款') THEN 0.1 ELSE 0 END, 0.99), 4)::DOUBLE AS score FROM s GROUP BY 1, 2),
v AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ord) AS version FROM h)
SELECT name || '_v' || version AS id, name, version, workflow_hash, score, row_number() OVER (PARTITION BY name ORDER BY score DESC, version DESC) = 1 AS active FROM v""",
    "latest_question": f"SELECT conv_id AS session, coalesce(nullif({_STRIP.format('x')}, ''), '-') AS query FROM (SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS x FROM conversations GROUP BY 1)",
    "special_preferences": f"""WITH {_USERS} SELECT query_id, CASE WHEN contains(query, 'tion') THEN 'long' WHEN contains(query, 'en') THEN 'short' WHEN contains(query, 'de') THEN 'plain' END AS preference,
 md5('用户关注：' || substr(query, 1, 80) || '；系统回应摘要：' || substr({_SQ("query")}, 1, 160)) AS snippet, CASE WHEN length({_SQ("query")}) <= 24 THEN {_SQ("query")} ELSE substr({_SQ("query")}, 1, 24) || '...' END AS preview FROM u""",
    "session_store": "SELECT conv_id AS session, arg_max(text, turn) AS value FROM conversations GROUP BY 1",
    "sanitize_text": f"SELECT page_id, md5({_SQ(_SAN)}) AS h, length({_SQ("regexp_replace(regexp_replace(html, '(?is)<(script|style).*?>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')")}) AS n_plain FROM pages",
    "audit_flags": f"""SELECT doc_id, CASE WHEN regexp_matches({_SQ("coalesce(text, '')")}, '{c.INPUT_RULES[0][0]}') THEN '{c.INPUT_RULES[0][1]}' WHEN regexp_matches({_SQ("coalesce(text, '')")}, '{c.INPUT_RULES[1][0]}') THEN '{c.INPUT_RULES[1][1]}' ELSE 'ok' END AS input,
 CASE WHEN regexp_matches(coalesce(text, ''), '{c.OUTPUT_RULES[0][0]}') THEN '{c.OUTPUT_RULES[0][1]}' WHEN regexp_matches(coalesce(text, ''), '{c.OUTPUT_RULES[1][0]}') THEN '{c.OUTPUT_RULES[1][1]}' ELSE 'ok' END AS output FROM documents""",
    "tool_guards": f"""WITH {_USERS}, s AS (SELECT *, {_SQ("query")} AS q FROM u), g AS (SELECT *, CASE WHEN q = '' THEN 'empty_query' WHEN length(q) > 120 THEN 'query_too_long' WHEN NOT ({_any("q", plans.WORDS)} OR {_YEAR}) THEN 'not_time_sensitive' ELSE 'official_whitelist' END AS web_reason FROM s),
w AS (SELECT *, CASE web_reason WHEN 'official_whitelist' THEN {_SQ("regexp_replace(q, '[^\\p{L}\\p{N}_\\s\\-:/.]', ' ', 'g')")} WHEN 'query_too_long' THEN substr(q, 1, 120) ELSE q END AS c FROM g),
k AS (SELECT *, CASE WHEN q = '' THEN 'empty_query' WHEN length(q) > 200 THEN 'query_too_long' WHEN query_id % 3 = 1 THEN 'saved_skill_not_allowed' WHEN query_id % 3 = 0 THEN 'saved_skill_whitelisted' ELSE 'generic_skill_allowed' END AS reason FROM w)
SELECT query_id, web_reason, length(c) AS n, length(replace(url_encode(c), '%2F', '/')) AS n_quoted, reason, reason IN ('saved_skill_whitelisted', 'generic_skill_allowed') AS allowed FROM k""",
    "source_dedup": """WITH p AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS session, min(page_id) AS ord, url FROM pages GROUP BY 1, url, length(html))
SELECT *, row_number() OVER (PARTITION BY session ORDER BY ord) AS place FROM p QUALIFY place <= 5""",
    "retrieval_metrics": _JUDGED + " SELECT * FROM m",
    "bucket_metrics": _JUDGED + " SELECT category, count(*) AS total, round(avg(recall), 7) AS avg_recall, round(avg(mrr), 7) AS avg_mrr, round(avg(ndcg), 7) AS avg_ndcg, round(avg(case_id % 97), 7) AS avg_latency_ms, quantile_disc((case_id % 97)::DOUBLE, 0.95) AS p95_latency_ms FROM m GROUP BY 1",
    "answer_metrics": f"WITH {_ANSWERS} SELECT hard_case, {_RATES} FROM j GROUP BY 1",
    "release_gate": f"""WITH {_ANSWERS}, r AS (SELECT {_RATES} FROM j), g AS (SELECT *, list_filter([CASE WHEN pass_rate < 0.8 THEN 'pass_rate' END, CASE WHEN citation_hit_rate < 0.85 THEN 'citation_hit_rate' END, CASE WHEN 0.9 - pass_rate > 0.03 THEN 'pass_rate_regression' END, CASE WHEN 0.9 - citation_hit_rate > 0.05 THEN 'citation_hit_regression' END, 'p95_regression'], lambda x: x IS NOT NULL) AS f FROM r)
SELECT pass_rate, citation_hit_rate, 'rollback' AS decision, 'canary' AS next_stage, array_to_string(f, ',') AS reasons FROM g""",
    "label_quality_join": "SELECT lang, source, count(*) AS n, round(avg(quality), 6) AS quality, sum(toxic)::BIGINT AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2",
    "sse_chunks": f"""WITH {_SAID}, c AS (SELECT session, len({_CUT}) AS n, unnest(list_transform({_CUT}, lambda i: substr(text, CAST(i * 24 + 1 AS INT), 24))) AS said, unnest({_CUT}) AS seq FROM s)
SELECT session, seq, 'delta' AS event, said FROM c UNION ALL SELECT session, len({_CUT}), 'done', status FROM s""",
    "sse_reassemble": f"WITH {_SAID} SELECT session, text, status FROM s",
}
