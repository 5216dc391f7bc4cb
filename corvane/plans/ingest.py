"""Queries of ingest and indexing, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.config import SETTINGS
from corvane.functions.text import code_point_sum, content_hash, hash_embedding, squeeze, tokens
from corvane.operators import ingest, retrieve
from corvane.sources.tables import CORPUS_SQL, corpus, read

TOKEN = r"([\x{4e00}-\x{9fff}]|[a-z]+|[0-9]+)"
SQUEEZE = r"regexp_replace(regexp_replace({0}, '[\s\x0B\x85\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'), '^ | $', '', 'g')"
#: A lexicon that fires on the test corpus, whose prose holds none of the default words.
RULES = (("the", ("topic 1", "topic 2")), ("que", ("tema 3",)), ("der", ("thema 4",)))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return corpus(read(spark, d, "documents"))


def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    t = tokens(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


def normalized_hash_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select("doc_id", "topic", content_hash(F.col("text")).alias("content_hash"))
    return rows.groupBy("topic", "content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def summary_lines(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", ingest.summary(F.col("text")).alias("summary"), ingest.section_hint(F.col("text")).alias("section_hint"))


def chunk_fixed_windows(spark: SparkSession, d: str) -> DataFrame:
    return ingest.fixed_chunks(_docs(spark, d)).select("doc_id", F.col("j").cast("long").alias("j"), F.length("chunk").cast("long").alias("n"), F.sha1("chunk").alias("h"))


def chunk_two_level_dedup(spark: SparkSession, d: str) -> DataFrame:
    return ingest.two_level_chunks(_docs(spark, d)).select("chunk_id", "chunk_level", "parent_id", "chunk_text_hash")


def chunk_recursive(spark: SparkSession, d: str) -> DataFrame:
    return ingest.recursive_chunks(read(spark, d, "documents"))


def metadata_window(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).withColumn("title", F.concat_ws(" ", "title", F.substring("publish_date", 1, 4)))
    a, b = ingest.validity(F.col("title"), F.col("topic"), F.col("publish_date"), F.col("text"), ("src1",), ("src",))
    return rows.select("doc_id", a.alias("valid_from"), b.alias("valid_to"), retrieve.active(F.col("effective_date"), F.col("expire_date"), SETTINGS.as_of).alias("active"))


def query_expansions(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d)
    e = ingest.expansions(F.col("text"), F.col("title"), F.col("topic"), F.substring("title", 1, 12), RULES)
    return rows.select("doc_id", F.array_join(e, "|").alias("expansions"))


def contextual_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    text = ingest.contextual(c("title"), c("topic"), c("publish_date"), c("effective_date"), c("expire_date"), c("text"))
    return _docs(spark, d).select("doc_id", F.md5(text).alias("h"), F.length(text).cast("long").alias("n"))


def postings_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return retrieve.term_stats(retrieve.postings(docs), docs.count()).select("token", "df", F.round("idf", 6).alias("idf"))


def local_embedding(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select("doc_id", code_point_sum(F.col("text")).alias("seed")).withColumn("v", hash_embedding(F.col("seed")))
    return rows.select("doc_id", "seed", *[F.round(F.col("v")[i], 9).alias(f"v{i}") for i in (0, 1, 31)])


def index_stats(spark: SparkSession, d: str) -> DataFrame:
    return ingest.two_level_chunks(_docs(spark, d)).groupBy("chunk_level").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


QUERIES = {f.__name__: f for f in (tokenize_counts, normalized_hash_dedup, summary_lines, chunk_fixed_windows, chunk_two_level_dedup, chunk_recursive, metadata_window, query_expansions, contextual_chunks, postings_stats, local_embedding, index_stats)}

_SQ = SQUEEZE.format
_STRIP = r"regexp_replace({0}, '^[\s\x0B\x85\x{{a0}}\x{{3000}}]+|[\s\x0B\x85\x{{a0}}\x{{3000}}]+$', '', 'g')"
_LINES = r"list_filter(list_transform(regexp_split_to_array({0}, '\r\n|\r|\n'), lambda x: " + _STRIP.format("x").replace("{", "{{").replace("}", "}}") + "), lambda x: x <> '')"


def _windows(text: str, size: int, overlap: int) -> str:
    step = size - overlap
    return f"CASE WHEN length({text}) > 0 THEN list_transform(range(0, CASE WHEN length({text}) <= {size} THEN 1 ELSE 1 + CAST(ceil((length({text}) - {size}) / {step}.0) AS INT) END), lambda i: substr({text}, CAST(i * {step} + 1 AS INT), {size})) ELSE [] END"


_MARKED = " OR ".join(f"contains(x, '{w}')" for w in ("第", "学费", "资助", "录取", "招生", "电话", "地址", "奖学金", "贷款", "公告"))
_SUMMARY = "substr(array_to_string(list_transform(CASE WHEN len(list_filter(l, lambda x: " + _MARKED + ")) > 0 THEN list_filter(l, lambda x: " + _MARKED + ")[:4] ELSE l[:3] END, lambda x: substr(x, 1, 80)), '；'), 1, 320)"
_P = SETTINGS.parent
_TWO = f"""WITH {CORPUS_SQL},
p AS (SELECT doc_id, source_url, unnest(w) AS parent_text, unnest(range(1, len(w) + 1)) AS i FROM (SELECT *, {_windows("text", *_P)} AS w FROM corpus)),
s AS (SELECT doc_id, source_url, i, unnest(w) AS chunk, unnest(range(1, len(w) + 1)) AS j FROM (SELECT *, {_windows("parent_text", SETTINGS.chunk, SETTINGS.overlap)} AS w FROM p)),
k AS (SELECT *, {_SQ("chunk")} AS c FROM s), h AS (SELECT *, sha1(lower(c)) AS hash FROM k WHERE length(c) >= {SETTINGS.least_chunk}),
small AS (SELECT doc_id, doc_id || '-' || i || '-' || j AS chunk_id, 'small' AS chunk_level, doc_id || '-parent-' || i AS parent_id, hash AS chunk_text_hash FROM h QUALIFY row_number() OVER (PARTITION BY source_url, hash ORDER BY doc_id, i, j) = 1),
total AS (SELECT doc_id, doc_id || '-summary-' || i AS chunk_id, 'summary' AS chunk_level, doc_id || '-parent-' || i AS parent_id, sha1(lower({_SQ("m")})) AS chunk_text_hash FROM (SELECT *, {_SUMMARY} AS m FROM (SELECT *, {_LINES.format("parent_text")} AS l FROM p))),
chunks AS (SELECT * FROM small UNION ALL SELECT * FROM total)"""

_EXP = f"""WITH {CORPUS_SQL},
k AS (SELECT *, substr(title, 1, 12) AS section, ((CASE WHEN contains(text, 'the') THEN ['topic 1', 'topic 2'] ELSE [] END) || (CASE WHEN contains(text, 'que') THEN ['tema 3'] ELSE [] END) || (CASE WHEN contains(text, 'der') THEN ['thema 4'] ELSE [] END)) AS f,
 regexp_split_to_array(text, '[。；\\n]') AS sentences FROM corpus),
w AS (SELECT *, (CASE WHEN len(f) > 0 THEN f ELSE list_filter([substr(coalesce(list_filter(list_transform(sentences, lambda x: {_STRIP.format("x")}), lambda x: x <> '')[1], ''), 1, 18)], lambda x: x <> '') END)[:3] AS words,
 regexp_extract(title || ' ' || text, '(?:^|[^\\p{{L}}\\p{{N}}_])(20[0-9]{{2}})(?:[^\\p{{L}}\\p{{N}}_]|$)', 1) AS year,
 regexp_extract_all(text, '(20[0-9]{{2}}|[0-9]+元|[0-9]+分|本科|专科|理工类|艺术类|国家助学贷款)', 1) AS raw FROM k),
l AS (SELECT *, list_filter(raw, lambda x, i: list_position(raw, x) = i)[:3] AS limits FROM w),
c AS (SELECT *, array_to_string(list_filter([topic, coalesce(nullif({_STRIP.format("section")}, ''), nullif(topic, ''), title), CASE WHEN len(words) > 0 THEN words[1] ELSE '政策' END], lambda x: x <> ''), ' ') AS one,
 CASE WHEN len(words) > 0 THEN array_to_string(list_filter([coalesce(nullif(title, ''), topic), array_to_string(words[:2], ' ')], lambda x: x <> ''), ' ') ELSE '' END AS two,
 CASE WHEN len(limits) > 0 THEN array_to_string(list_filter([year, CASE WHEN len(words) > 0 THEN words[1] ELSE topic END, array_to_string(limits[:2], ' ')], lambda x: x <> ''), ' ') ELSE '' END AS three FROM l),
m AS (SELECT *, list_filter([one, two, three], lambda x: x <> '') AS few FROM c),
n AS (SELECT *, list_transform(CASE WHEN len(few) < 3 AND year <> '' THEN few || [array_to_string(list_filter([year, coalesce(nullif(topic, ''), title), '官方规定'], lambda x: x <> ''), ' ')] ELSE few END, lambda x: {_SQ("x")}) AS q FROM m),
o AS (SELECT *, list_filter(q, lambda x: length(x) BETWEEN 4 AND 40 AND lower(x) <> lower({_SQ("text")}) AND regexp_matches(x, '[\\x{{4e00}}-\\x{{9fff}}0-9]')) AS g FROM n)
SELECT doc_id, array_to_string(list_filter(g, lambda x, i: list_position(list_transform(g, lambda y: lower(y)), lower(x)) = i)[:3], '|') AS expansions FROM o"""

ORACLES = {
    "tokenize_counts": f"WITH {CORPUS_SQL} SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN}', 1) AS t FROM corpus)",
    "normalized_hash_dedup": f"WITH {CORPUS_SQL} SELECT topic, sha1(lower({_SQ('text')})) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM corpus GROUP BY 1, 2",
    "summary_lines": f"WITH {CORPUS_SQL} SELECT doc_id, {_SUMMARY} AS summary, substr(coalesce(l[1], ''), 1, 40) AS section_hint FROM (SELECT *, {_LINES.format('text')} AS l FROM corpus)",
    "chunk_fixed_windows": f"WITH {CORPUS_SQL}, w AS (SELECT doc_id, unnest(w) AS chunk, unnest(range(1, len(w) + 1)) AS j FROM (SELECT *, {_windows('text', SETTINGS.chunk, SETTINGS.overlap)} AS w FROM corpus)), k AS (SELECT *, {_SQ('chunk')} AS c FROM w) SELECT doc_id, j, length(c) AS n, sha1(c) AS h FROM k WHERE length(c) >= {SETTINGS.least_chunk}",
    "chunk_two_level_dedup": _TWO + " SELECT chunk_id, chunk_level, parent_id, chunk_text_hash FROM chunks",
    "metadata_window": f"""WITH {CORPUS_SQL}, t AS (SELECT *, title || ' ' || substr(publish_date, 1, 4) AS head FROM corpus)
SELECT doc_id, CASE WHEN contains(head || ' ' || topic, 'src1') THEN publish_date WHEN contains(head || ' ' || topic, 'src') THEN y || '-01-01' ELSE '' END AS valid_from,
 CASE WHEN contains(head || ' ' || topic, 'src1') THEN '' WHEN contains(head || ' ' || topic, 'src') THEN y || '-12-31' ELSE '' END AS valid_to,
 NOT (effective_date <> '' AND effective_date > '{SETTINGS.as_of}') AND NOT (expire_date <> '' AND expire_date < '{SETTINGS.as_of}') AND (effective_date <> '' OR expire_date <> '') AS active
FROM (SELECT *, regexp_extract(head || ' ' || topic, '(?:^|[^\\p{{L}}\\p{{N}}_])(20[0-9]{{2}})(?:[^\\p{{L}}\\p{{N}}_]|$)', 1) AS y FROM t)""",
    "query_expansions": _EXP,
    "contextual_chunks": f"WITH {CORPUS_SQL}, t AS (SELECT doc_id, '标题：' || title || chr(10) || '主题：' || topic || chr(10) || '发布时间：' || publish_date || CASE WHEN effective_date <> '' THEN chr(10) || '生效时间：' || effective_date || chr(10) || '失效时间：' || expire_date ELSE '' END || chr(10) || '正文：' || {_STRIP.format('text')} AS c FROM corpus) SELECT doc_id, md5(c) AS h, length(c) AS n FROM t",
    "postings_stats": f"""WITH {CORPUS_SQL}, p AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '{TOKEN}', 1)) AS token FROM corpus),
t AS (SELECT token, count(*) AS df, ln((SELECT count(*) FROM corpus) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM p GROUP BY token)
SELECT token, df, round(CASE WHEN raw < 0 THEN avg(raw) OVER () * 0.25 ELSE raw END, 6) AS idf FROM t""",
    "local_embedding": f"""WITH {CORPUS_SQL}, s AS (SELECT doc_id, coalesce(list_sum(list_transform(string_split(text, ''), lambda c: unicode(c))), 0)::BIGINT AS seed FROM corpus),
v AS (SELECT *, list_transform(range(0, 32), lambda i: ((seed + 13 * i) % 97) / 97.0::DOUBLE) AS r FROM s), n AS (SELECT *, sqrt(list_sum(list_transform(r, lambda x: x * x))) AS m FROM v)
SELECT doc_id, seed, round(r[1] / m, 9) AS v0, round(r[2] / m, 9) AS v1, round(r[32] / m, 9) AS v31 FROM n""",
    "index_stats": _TWO + " SELECT chunk_level, count(*) AS n, count(DISTINCT doc_id) AS docs FROM chunks GROUP BY chunk_level",
}
