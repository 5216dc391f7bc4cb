"""Queries of retrieval and ranking, with their SQL. All documents are searched for all benchmark texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.config import SETTINGS
from corvane.functions.text import content_hash, tokens
from corvane.operators import ingest, rank, retrieve
from corvane.plans.ingest import _LINES, _STRIP, _SUMMARY, _windows, TOKEN
from corvane.sources.shared import written
from corvane.sources.tables import CORPUS_SQL, corpus, read

N, K = SETTINGS.top_n, SETTINGS.top_k
#: Words that make a query depend on time in the test corpus, where none of the default words occur.
WORDS = ("tion", "ción")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return corpus(read(spark, d, "documents"))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))


def sparse_overlap_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.sparse_overlap(_queries(spark, d), _docs(spark, d), N).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.bm25(_queries(spark, d), _docs(spark, d), N).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def exact_match_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.exact(_queries(spark, d), _docs(spark, d), N).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def hash_dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.hash_dense(_queries(spark, d), _docs(spark, d), N).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, d, "embeddings").select("vec_id", "embedding")
    return rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), rows


def dense_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.cosine_top(*_vectors(spark, d), K).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def dense_lsh_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.lsh_top(*_vectors(spark, d), K)


def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.hybrid(_queries(spark, d), _docs(spark, d), N, temporal=False).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def _ranked(spark: SparkSession, d: str, n: int = N) -> DataFrame:
    docs, queries = _docs(spark, d), _queries(spark, d)
    return retrieve.hybrid(queries, docs, N, WORDS).where(F.col("rank") <= n).join(docs, "doc_id").join(queries, "query_id")


def temporal_bonus_rank(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.hybrid(_queries(spark, d), _docs(spark, d), N, WORDS).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def multi_query_merge(spark: SparkSession, d: str) -> DataFrame:
    """Each query and its first ten tokens as two forms over the sparse channel."""
    q = _queries(spark, d)
    forms = q.select("query_id", F.posexplode(F.array(F.col("query"), F.array_join(F.slice(tokens(F.col("query")), 1, 10), " "))).alias("form", "query"))
    found = retrieve.sparse_overlap(forms.select((F.col("query_id") * 2 + F.col("form")).alias("query_id"), "query"), _docs(spark, d), N)
    ranked = found.select(F.floor(F.col("query_id") / 2).cast("long").alias("query_id"), F.pmod("query_id", F.lit(2)).alias("form"), "doc_id", "score", "rank")
    return retrieve.merge_queries(ranked, N).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def summary_parents(spark: SparkSession, d: str) -> DataFrame:
    p = ingest.parents(_docs(spark, d))
    rows = p.select(F.concat_ws("-", F.col("doc_id").cast("string"), F.lit("summary"), F.col("i").cast("string")).alias("chunk_id"), "parent_id", F.struct("doc_id", "i").alias("ord"), F.concat_ws(" ", "section_hint", "topic", ingest.summary(F.col("parent_text"))).alias("body"))
    return retrieve.summary_parents(_queries(spark, d), rows).select("query_id", "parent_id", F.round("score", 6).alias("score"), "rank")


def fallback_rerank(spark: SparkSession, d: str) -> DataFrame:
    return rank.rerank(_ranked(spark, d), K).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def conflict_resolution(spark: SparkSession, d: str) -> DataFrame:
    return rank.resolve_conflicts(_ranked(spark, d, K), WORDS).select("query_id", "doc_id", "year", "resolved", "place")


def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = rank.quality(_ranked(spark, d, K), _queries(spark, d), WORDS)
    return rows.withColumns({c: F.col(c).cast("long") for c in ("unique_sources", "conflict_count", "stale_count")})


def citation_guard(spark: SparkSession, d: str) -> DataFrame:
    rows = rank.citation_guard(_ranked(spark, d, K), _queries(spark, d))
    return rows.withColumn("sources", F.col("sources").cast("long")).withColumn("top_score", F.round("top_score", 6))


def retry_forms(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("query")
    return _queries(spark, d).select("query_id", F.array_join(rank.retry_queries(q, retrieve.time_sensitive(q, WORDS)), "|").alias("forms"))


def retry_union(spark: SparkSession, d: str) -> DataFrame:
    """Queries that the gate turned away are searched again by their retry forms (sparse channel, more documents); the others keep their results."""
    docs, queries, ranked = _docs(spark, d), _queries(spark, d), written(_ranked(spark, d, K))  # read four times and more
    failed = written(rank.quality(ranked, queries, WORDS).where(F.col("reason").isin("low_coverage", "empty_retrieval", "stale_evidence")).select("query_id"))
    q = F.col("query")
    forms = queries.join(failed, "query_id", "left_semi").select("query_id", F.posexplode(rank.retry_queries(q, retrieve.time_sensitive(q, WORDS))).alias("form", "query"))
    again = retrieve.sparse_overlap(forms.select((F.col("query_id") * 3 + F.col("form")).alias("query_id"), "query"), docs, SETTINGS.retry_n)
    again = retrieve.merge_queries(again.select(F.floor(F.col("query_id") / 3).cast("long").alias("query_id"), F.pmod("query_id", F.lit(3)).alias("form"), "doc_id", "score", "rank"), K)
    kept = ranked.select("query_id", "doc_id", "score", "rank").join(failed, "query_id", "left_anti").withColumn("retried", F.lit(False))
    again = again.withColumn("retried", F.lit(True)).repartition("query_id", "doc_id")  # a union of sides that are dealt alike fails where adaptive execution deals one anew
    return kept.unionByName(again).withColumn("score", F.round("score", 6))


def context_pack(spark: SparkSession, d: str) -> DataFrame:
    rows = _ranked(spark, d).withColumn("parent_id", F.floor(F.col("doc_id") / 3).cast("string")).withColumn("content_hash", content_hash(F.col("text")))
    return rank.pack_context(rows, K).withColumn("score", F.round("score", 6))


QUERIES = {
    f.__name__: f
    for f in (
        sparse_overlap_topk, bm25_topk, exact_match_topk, hash_dense_topk, dense_cosine_topk, dense_lsh_topk, rrf_hybrid, temporal_bonus_rank, multi_query_merge, summary_parents,
        fallback_rerank, conflict_resolution, quality_gate, citation_guard, retry_forms, retry_union, context_pack,
    )
}


def _sparse(name: str, queries: str, n: int) -> str:
    """CTEs that end in ``name`` (query_id, doc_id, score, rank)."""
    return f"""{name}_q AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '{TOKEN}', 1)) AS token FROM {queries}) GROUP BY ALL),
{name}_h AS (SELECT query_id, doc_id, sum(qtf * least(tf, 4)) / greatest(any_value(dl), 1)::DOUBLE AS score FROM {name}_q JOIN post USING (token) GROUP BY ALL
 UNION ALL SELECT query_id, doc_id, 0.0 FROM {queries}, (SELECT doc_id FROM corpus ORDER BY doc_id LIMIT {n})),
{name}_m AS (SELECT query_id, doc_id, round(max(score), 9) AS score FROM {name}_h GROUP BY ALL),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {name}_m QUALIFY rank <= {n})"""


_YEAR = r"(?:^|[^\p{L}\p{N}_])(20[0-9]{2})(?:[^\p{L}\p{N}_]|$)"
_TIME = "(" + " OR ".join(f"contains(query, '{w}')" for w in WORDS) + f" OR regexp_matches(query, '{_YEAR}'))"
_ACTIVE = f"(NOT (effective_date <> '' AND effective_date > '{SETTINGS.as_of}') AND NOT (expire_date <> '' AND expire_date < '{SETTINGS.as_of}') AND (effective_date <> '' OR expire_date <> ''))"
_BASE = f"""WITH RECURSIVE {CORPUS_SQL},
q AS (SELECT item_id AS query_id, coalesce(text, '') AS query FROM benchmark),
tok AS (SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN}', 1) AS t FROM corpus),
post AS (SELECT doc_id, token, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS token FROM tok) GROUP BY ALL),
{_sparse("sparse", "q", N)}"""
_EXACT = f"""body AS (SELECT doc_id, publish_date, lower(text || ' ' || title || ' ' || topic) AS body FROM corpus),
qt AS (SELECT query_id, lower({_STRIP.format("query")}) AS phrase, regexp_extract_all(lower(query), '{TOKEN}', 1) AS t FROM q),
ex AS (SELECT query_id, doc_id, publish_date, contains(body, phrase) AND phrase <> '' AS whole, len(list_filter(t, lambda x: contains(body, x))) AS hits, len(list_filter(t, lambda x: contains(body, x) AND regexp_matches(x, '^[0-9]'))) AS numbers, len(t) AS n FROM qt, body),
exact AS (SELECT query_id, doc_id, round(CASE WHEN whole THEN 1.5 ELSE 0.0 END + hits / greatest(n, 1)::DOUBLE + numbers * 0.25, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(CASE WHEN whole THEN 1.5 ELSE 0.0 END + hits / greatest(n, 1)::DOUBLE + numbers * 0.25, 9) DESC, publish_date DESC, doc_id) AS rank
 FROM ex WHERE (hits > 0 OR whole) AND n > 0 QUALIFY rank <= {N})"""
_SEED = "coalesce(list_sum(list_transform(string_split({0}, ''), lambda c: unicode(c))), 0)::BIGINT % 97"
_DENSE = f"""cls AS (SELECT s, list_transform(r, lambda x: x / sqrt(list_sum(list_transform(r, lambda y: y * y)))) AS v FROM (SELECT s, list_transform(range(0, 32), lambda i: ((s + 13 * i) % 97) / 97.0::DOUBLE) AS r FROM range(97) AS t(s))),
near AS (SELECT a.s AS a, b.s AS b, round(list_inner_product(a.v, b.v), 9) AS score FROM cls a, cls b),
dense AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, {_SEED.format("query")} AS a FROM q) JOIN near USING (a) JOIN (SELECT doc_id, {_SEED.format("text")} AS b FROM corpus) USING (b) QUALIFY rank <= {N})"""
_FUSE = f"""fused AS (SELECT query_id, doc_id, round(coalesce(max(p) FILTER (c = 2), 0) + coalesce(max(p) FILTER (c = 0), 0) + coalesce(max(p) FILTER (c = 1), 0), 9) AS rrf, min((c, rank)) AS f FROM (
 SELECT query_id, doc_id, 2 AS c, rank, 1.0::DOUBLE / (60 + rank) AS p FROM sparse UNION ALL SELECT query_id, doc_id, 0, rank, 1.0::DOUBLE / (60 + rank) FROM dense UNION ALL SELECT query_id, doc_id, 1, rank, 1.2::DOUBLE / (60 + rank) FROM exact) GROUP BY ALL)"""
_HYBRID = f"{_BASE}, {_EXACT}, {_DENSE}, {_FUSE}"
_TEMPORAL = f"""{_HYBRID}, timed AS (SELECT query_id, doc_id, f, publish_date, round(rrf
 + CASE WHEN len(list_filter(regexp_extract_all(query, '{_YEAR}', 1), lambda y: contains(publish_date || ' ' || effective_date || ' ' || expire_date || ' ' || title || ' ' || topic || ' ' || text, y))) > 0 THEN 1.2 ELSE 0.0 END
 + CASE WHEN {_TIME} AND {_ACTIVE} THEN 0.6 ELSE 0.0 END - CASE WHEN expire_date <> '' AND expire_date < '{SETTINGS.as_of}' THEN 0.8 ELSE 0.0 END, 9) AS score FROM fused JOIN corpus USING (doc_id) JOIN q USING (query_id)),
hybrid AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, publish_date DESC, f) AS rank FROM timed QUALIFY rank <= {N}),
ranked AS (SELECT hybrid.*, query, corpus.* EXCLUDE (doc_id) FROM hybrid JOIN corpus USING (doc_id) JOIN q USING (query_id))"""
_SOURCE = "coalesce(nullif(source_url, ''), nullif(title, ''), doc_id::VARCHAR)"
_QUALITY = f"""top8 AS (SELECT * FROM ranked WHERE rank <= {K}),
gate AS (SELECT query_id, string_agg(lower(text), ' ' ORDER BY rank) FILTER (rank <= 4) AS body, count(DISTINCT {_SOURCE}) AS unique_sources, count(*) AS n, count(*) FILTER (expire_date <> '' AND expire_date < '{SETTINGS.as_of}') AS stale_count,
 count(DISTINCT substr(publish_date, 1, 4)) FILTER (rank <= 4) AS years FROM top8 GROUP BY query_id),
quality AS (SELECT query_id, CASE WHEN n IS NULL THEN 0.0 WHEN len(t) = 0 THEN 1.0 ELSE round(len(list_filter(t, lambda x: contains(body, x))) / len(t)::DOUBLE, 4) END AS coverage, coalesce(unique_sources, 0) AS unique_sources,
 CASE WHEN {_TIME} AND years > 1 THEN 1 ELSE 0 END AS conflict_count, coalesce(stale_count, 0) AS stale_count, n, {_TIME} AS timely
 FROM (SELECT *, regexp_extract_all(lower(query), '{TOKEN}', 1) AS t FROM q LEFT JOIN gate USING (query_id))),
verdict AS (SELECT query_id, coverage, unique_sources, conflict_count::BIGINT AS conflict_count, stale_count, CASE WHEN n IS NULL THEN 'empty_retrieval' WHEN conflict_count > 0 THEN 'conflicting_evidence' WHEN coverage < 0.25 THEN 'low_coverage' WHEN timely AND stale_count >= n THEN 'stale_evidence' ELSE '' END AS reason FROM quality)"""
_FORMS = f"""list_filter(list_transform([query, CASE WHEN c <> '' AND c <> lower(query) THEN c ELSE '' END, query || CASE WHEN {_TIME} THEN ' 官方公告' ELSE ' 招生政策' END], lambda x: trim(x)), lambda x: x <> '')"""
_RETRY = f"""forms AS (SELECT query_id, list_filter(f, lambda x, i: list_position(f, x) = i)[:3] AS forms FROM (SELECT query_id, {_FORMS} AS f FROM (SELECT *, array_to_string(regexp_extract_all(lower(query), '{TOKEN}', 1)[:10], '') AS c FROM q)))"""


def _merged(name: str, source: str, forms: int, n: int) -> str:
    return f"{name} AS (SELECT query_id, doc_id, greatest(max(score), 0.0) AS score, min((form, rank)) AS f FROM (SELECT query_id // {forms} AS query_id, query_id % {forms} AS form, doc_id, score, rank FROM {source}) GROUP BY 1, 2), {name}_top AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f) AS rank FROM {name} QUALIFY rank <= {n})"


_AUTH = "CASE WHEN contains(source_url, '.gov.cn') THEN 4 WHEN contains(source_url, '.edu.cn') THEN 2 WHEN source_url <> '' THEN 1 ELSE 0 END"
ORACLES = {
    "sparse_overlap_topk": _BASE + " SELECT query_id, doc_id, round(score, 6) AS score, rank FROM sparse",
    "bm25_topk": f"""{_BASE}, st AS (SELECT count(*) AS n_docs, avg(len(t)) AS avgdl FROM tok), raw AS (SELECT token, ln(n_docs - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM post, st GROUP BY token, n_docs),
idf AS (SELECT token, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER () ELSE raw END AS idf FROM raw),
b AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score FROM sparse_q JOIN post USING (token) JOIN idf USING (token), st GROUP BY ALL)
SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM b QUALIFY rank <= {N}""",
    "exact_match_topk": f"{_BASE}, {_EXACT} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM exact",
    "hash_dense_topk": f"{_BASE}, {_DENSE} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM dense",
    "dense_cosine_topk": f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.e, b.e), 9) AS score FROM v a, v b WHERE a.vec_id % 20 = 0)
SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= {K}""",
    "rrf_hybrid": f"{_HYBRID} SELECT query_id, doc_id, round(rrf, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, f) AS rank FROM fused QUALIFY rank <= {N}",
    "temporal_bonus_rank": _TEMPORAL + " SELECT query_id, doc_id, round(score, 6) AS score, rank FROM hybrid",
    "multi_query_merge": f"""{_BASE}, two AS (SELECT query_id * 2 AS query_id, query FROM q UNION ALL SELECT query_id * 2 + 1, array_to_string(regexp_extract_all(lower(query), '{TOKEN}', 1)[:10], ' ') FROM q),
{_sparse("sp2", "two", N)}, {_merged("mm", "sp2", 2, N)} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM mm_top""",
    "summary_parents": f"""{_BASE}, p AS (SELECT doc_id, topic, unnest(w) AS parent_text, unnest(range(1, len(w) + 1)) AS i FROM (SELECT *, {_windows("text", *SETTINGS.parent)} AS w FROM corpus)),
b AS (SELECT doc_id, i, doc_id || '-parent-' || i AS parent_id, lower(substr(coalesce(l[1], ''), 1, 40) || ' ' || topic || ' ' || {_SUMMARY}) AS body FROM (SELECT *, {_LINES.format("parent_text")} AS l FROM p)),
s AS (SELECT query_id, parent_id, doc_id, i, len(list_filter(t, lambda x: contains(body, x))) AS hits, len(t) AS n, len(list_filter(t, lambda x: contains(body, x) AND regexp_matches(x, '^[0-9]'))) > 0 AS number FROM (SELECT query_id, regexp_extract_all(lower(query), '{TOKEN}', 1) AS t FROM q), b),
r AS (SELECT query_id, parent_id, doc_id, i, round(hits / n::DOUBLE + CASE WHEN number THEN 0.2 ELSE 0.0 END, 9) AS score FROM s WHERE hits > 0)
SELECT query_id, parent_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, i) AS rank FROM r QUALIFY rank <= 3""",
    "fallback_rerank": f"""{_TEMPORAL}, r AS (SELECT query_id, doc_id, rank AS place, round(score * 0.6::DOUBLE + list_sum(list_transform(regexp_extract_all(lower(query), '{TOKEN}', 1), lambda x: least((length(lower(text)) - length(replace(lower(text), x, ''))) // length(x), 4))) * 0.1::DOUBLE + 0.05::DOUBLE / rank + CASE WHEN publish_date <> '' THEN 0.03::DOUBLE ELSE 0 END, 9) AS score FROM ranked)
SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) AS rank FROM r QUALIFY rank <= {K}""",
    "conflict_resolution": f"""{_TEMPORAL}, p AS (SELECT *, CASE WHEN effective_date <> '' THEN substr(effective_date, 1, 4) ELSE substr(publish_date, 1, 4) END AS year, ({_AUTH}, coalesce(nullif(effective_date, ''), publish_date), publish_date) AS pr, {_TIME} AS timely FROM ranked WHERE rank <= {K}),
w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pr DESC, rank) AS pl FROM p), k AS (SELECT query_id, count(DISTINCT pr) FILTER (rank <= 4) AS kinds, max(pr) FILTER (pl = 1) AS best, max(pr) FILTER (pl = 2) AS second, max(year) FILTER (pl = 1) AS winner FROM w GROUP BY query_id),
r AS (SELECT w.*, winner, timely AND kinds > 1 AND best IS DISTINCT FROM second AS resolved FROM w JOIN k USING (query_id))
SELECT query_id, doc_id, year, resolved, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN resolved THEN pl ELSE rank END) AS place FROM r WHERE NOT resolved OR year = winner""",
    "quality_gate": f"{_TEMPORAL}, {_QUALITY} SELECT *, reason = '' AS passed FROM verdict",
    "citation_guard": f"""{_TEMPORAL}, c AS (SELECT query_id, count(DISTINCT {_SOURCE}) AS sources, arg_min(score, rank) AS top_score FROM ranked WHERE rank <= {K} GROUP BY query_id),
r AS (SELECT query_id, coalesce(sources, 0) AS sources, round(coalesce(top_score, 0.0), 6) AS top_score, CASE WHEN coalesce(sources, 0) = 0 THEN 'no_source' WHEN sources < 2 THEN 'insufficient_sources' WHEN top_score < 0.18 THEN 'low_top_score' ELSE '' END AS reason FROM q LEFT JOIN c USING (query_id))
SELECT *, reason = '' AS passed FROM r""",
    "retry_forms": f"{_BASE}, {_RETRY} SELECT query_id, array_to_string(forms, '|') AS forms FROM forms",
    "retry_union": f"""{_TEMPORAL}, {_QUALITY}, {_RETRY}, bad AS (SELECT query_id FROM verdict WHERE reason IN ('low_coverage', 'empty_retrieval', 'stale_evidence')),
again AS (SELECT query_id * 3 + i - 1 AS query_id, query FROM (SELECT query_id, unnest(forms) AS query, unnest(range(1, len(forms) + 1)) AS i FROM forms WHERE query_id IN (SELECT query_id FROM bad))),
{_sparse("sp3", "again", SETTINGS.retry_n)}, {_merged("m3", "sp3", 3, K)}
SELECT query_id, doc_id, round(score, 6) AS score, rank, false AS retried FROM top8 WHERE query_id NOT IN (SELECT query_id FROM bad) UNION ALL SELECT query_id, doc_id, round(score, 6), rank, true FROM m3_top""",
}
