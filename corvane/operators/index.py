"""The index of chunks as a table that is built, kept and read again, and retrieval over it.

A row per chunk (small and summary): ord (place in load order), chunk_id, level, parent, parent text, text, page content (the text under its context),
auxiliary queries, metadata, embedding. Retrieval functions know a chunk by ``ord``; ``chunks_of`` joins the rows back.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.config import EXPANSION_RULES, SETTINGS, TIME_WORDS_RETRIEVAL, Settings
from corvane.functions.text import YEAR, code_point_sum, hash_embedding, tokens
from corvane.operators import ingest, retrieve
from corvane.sources.shared import written

#: Texts that an embedding provider gets at a time.
EMBED_BATCH = 16
PLACEHOLDER = "empty corpus"


def chunk_rows(corpus: DataFrame, s: Settings = SETTINGS, rules: tuple = EXPANSION_RULES) -> DataFrame:
    """Chunks of a corpus (doc_id, text, title, topic, dates, source_url) with everything that channels read. Rows without a chunk_id are left out."""
    c = ingest.two_level_chunks(corpus, s)
    small, empty = F.col("chunk_level") == "small", F.array().cast("array<string>")
    auxiliary = F.when(small, ingest.expansions(F.col("chunk_text"), F.col("title"), F.col("topic"), F.col("section_hint"), rules)).otherwise(empty)
    content = ingest.contextual(F.col("title"), F.col("topic"), F.col("publish_date"), F.col("effective_date"), F.col("expire_date"), F.col("chunk_text"), F.when(small, F.col("section_hint")))
    ord_ = F.col("doc_id") * 100_000_000 + F.col("i") * 10_000 + F.col("j")
    rows = c.where("coalesce(chunk_id, '') <> ''").withColumns({"ord": ord_.cast("long"), "queries": auxiliary, "page_content": content})
    return rows.withColumn("sparse_view", ingest.sparse_view(F.col("page_content"), F.col("queries")))


def local_embedding(text: Column) -> Column:
    return hash_embedding(F.pmod(code_point_sum(F.coalesce(text, F.lit(""))), F.lit(97)))


def embedded(rows: DataFrame, text: str, provider: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """``rows`` with a unit ``embedding`` of ``text`` and ``embedding_source``. A provider gets ``EMBED_BATCH`` texts at a time and must give as many vectors;
    where it fails for any text, all texts take the offline embedding. Without rows nothing is asked."""
    if provider is not None:

        @F.pandas_udf("array<double>")
        def remote(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                out: list[list[float]] = []
                for at in range(0, len(part), EMBED_BATCH):
                    some = part.iloc[at : at + EMBED_BATCH].fillna("").tolist()
                    got = provider(some)
                    if len(got) != len(some):
                        raise ValueError(f"{len(got)} vectors for {len(some)} texts")
                    for v in got:
                        v = np.asarray(v, float)
                        out.append((v / (np.linalg.norm(v) or 1.0)).tolist())
                yield pd.Series(out, index=part.index, dtype=object)

        try:  # one pass asks for all texts and decides for all of them
            return written(rows.withColumn("embedding", remote(text)).withColumn("embedding_source", F.lit("provider")))
        except Exception as e:  # noqa: BLE001  whatever a provider raises; faults of Spark's own go up
            if "PythonException" not in f"{type(e).__name__} {e}" and "Traceback" not in str(e):
                raise
    return rows.withColumn("embedding", local_embedding(F.col(text))).withColumn("embedding_source", F.lit("local"))


def _versions(spark: SparkSession, path: str) -> list:
    try:
        return sorted(spark.read.schema("version long, folder string, chunks long").parquet(f"{path}/manifest").collect())
    except AnalysisException:
        return []


def build(corpus: DataFrame, path: str, provider: Callable | None = None, s: Settings = SETTINGS, rules: tuple = EXPANSION_RULES) -> dict:
    """Writes a new version of the index of a corpus and names it in the manifest, in one step, once it is whole: status, chunks, chunks whose text was embedded anew, seconds.

    Vectors of texts (by hash of the page content) that the version before has from the same kind of source are taken over; a provider is asked for the others only. Readers
    keep the version that they have loaded."""
    began, spark = time.time(), corpus.sparkSession
    rows = chunk_rows(corpus, s, rules).withColumn("content_key", F.sha2(F.coalesce("page_content", F.lit("")), 256))
    held, kind = load(spark, path), "local" if provider is None else "provider"
    if held is not None and "content_key" in held.columns:
        known = held.where(F.col("embedding_source") == kind).groupBy(F.col("content_key").alias("key_")).agg(F.first("embedding").alias("embedding"))
        rows = written(rows.join(known, F.col("content_key") == F.col("key_"), "left").drop("key_"))
        new = rows.where("embedding IS NULL").select("content_key", "page_content").dropDuplicates(["content_key"])
    else:
        rows = written(rows.withColumn("embedding", F.lit(None).cast("array<double>")))
        new = rows.select("content_key", "page_content").dropDuplicates(["content_key"])
    made = written(embedded(new, "page_content", provider))
    got, asked = made.select("embedding_source").distinct().collect(), made.count()
    if provider is not None and got and got[0][0] == "local":  # the provider failed: all vectors are of one kind
        rows, kind = rows.withColumn("embedding", local_embedding(F.col("page_content"))), "local"
    else:
        vectors = made.select(F.col("content_key").alias("key_"), F.col("embedding").alias("made_"))
        rows = rows.join(vectors, F.col("content_key") == F.col("key_"), "left").withColumn("embedding", F.coalesce("embedding", "made_")).drop("key_", "made_")
    folder = f"{path}/versions/{uuid.uuid4().hex}"
    rows.withColumn("embedding_source", F.lit(kind)).write.parquet(folder)
    count, before = spark.read.parquet(folder).count(), _versions(spark, path)
    version = before[-1]["version"] + 1 if before else 1
    spark.createDataFrame([(version, folder, count)], "version long, folder string, chunks long").coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return {"status": "ok", "version": version, "chunk_count": count, "embedded": asked, "seconds": round(time.time() - began, 3)}


reindex = build


def opened(spark: SparkSession, path: str) -> tuple[DataFrame | None, str]:
    """The newest version of the index at ``path``, or nothing and why: ``missing``, or what reading it raised (a damaged file too: one column is read through)."""
    versions = _versions(spark, path)
    if not versions:
        return None, "missing"
    try:
        rows = spark.read.parquet(versions[-1]["folder"])
        found = rows.select("ord", "chunk_id", "embedding", "sparse_view").agg(F.count("chunk_id"), F.count_if(F.size("embedding") > 0)).first()[0]
        return (rows, "") if found == versions[-1]["chunks"] else (None, f"{found} of {versions[-1]['chunks']} chunks")
    except Exception as e:  # noqa: BLE001  an index that can't be read is none; the reason goes to the caller
        return None, type(e).__name__


def load(spark: SparkSession, path: str) -> DataFrame | None:
    return opened(spark, path)[0]


def load_or_build(corpus: DataFrame, path: str, **kw) -> DataFrame:
    held = load(corpus.sparkSession, path)
    if held is None:
        build(corpus, path, **kw)
        held = load(corpus.sparkSession, path)
    return held


def views(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the sparse channel and the exact channel search; an empty index has one placeholder chunk in the sparse view, with ord -1."""
    sparse = index.select(F.col("ord").alias("doc_id"), F.col("sparse_view").alias("text"))
    if not index.head(1):
        sparse = index.sparkSession.createDataFrame([(-1, PLACEHOLDER)], "doc_id long, text string")
    exact = index.select(F.col("ord").alias("doc_id"), F.col("chunk_text").alias("text"), "title", "topic", "publish_date", F.array_join("queries", " ").alias("auxiliary"), "page_content")
    return sparse, exact


def whitespace(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")


def dense(queries: DataFrame, index: DataFrame, n: int, provider: Callable | None = None) -> DataFrame:
    """Cosine of the queries' embeddings with those of the index."""
    asked = embedded(queries, "query", provider).select("query_id", "embedding")
    found = retrieve.cosine_top(asked, index.select(F.col("ord").alias("vec_id"), "embedding"), n)
    return found.select("query_id", F.col("vec_id").alias("doc_id"), "score", "rank")


def hybrid(queries: DataFrame, index: DataFrame, words: tuple[str, ...] = TIME_WORDS_RETRIEVAL, s: Settings = SETTINGS, cut: Callable[[Column], Column] = tokens, provider: Callable | None = None, channels: tuple[str, ...] = ("sparse", "dense", "exact")) -> DataFrame:
    """(query_id, ord, score, rank) of queries (query_id, query; optional depth and focus, parents that the query is about).

    BM25 over the sparse view, dense and exact channels of the query's depth, fused; sorted by fusion and temporal bonus, then the later date. Among equals chunks of a year that
    the query names go before others, else, for queries that depend on time, those that hold on the day; then the channels' order. Cut to the depth. The score adds the
    bonus for chunks of a parent in focus, and takes a little from summaries outside."""
    extra = {"depth": F.lit(s.top_n), "focus": F.array().cast("array<string>")}
    asked = queries.select("query_id", "query", *[F.col(c) if c in queries.columns else v.alias(c) for c, v in extra.items()])
    most = asked.agg(F.max("depth")).first()[0] or s.top_n
    return fused(asked.withColumn("of", F.col("query_id")), index, channel_rows(asked, index, most, cut, provider, channels), words, s)


def channel_rows(queries: DataFrame, index: DataFrame, n: int, cut: Callable[[Column], Column] = tokens, provider: Callable | None = None, channels: tuple[str, ...] = ("sparse", "dense", "exact")) -> dict[str, DataFrame]:
    """(query_id, doc_id: the chunk's ord, score, rank) of the n best chunks of each query by channel."""
    sparse, exact = views(index)
    made = {
        "sparse": lambda: retrieve.bm25(queries, sparse, n, cut=cut).where("doc_id >= 0"),
        "dense": lambda: dense(queries, index, n, provider),
        "exact": lambda: retrieve.exact(queries, exact, n),
    }
    return {c: made[c]().select("query_id", "doc_id", "score", "rank") for c in channels}


def fused(asked: DataFrame, index: DataFrame, made: dict[str, DataFrame], words: tuple[str, ...] = TIME_WORDS_RETRIEVAL, s: Settings = SETTINGS) -> DataFrame:
    """(query_id, ord, score, rank) of requests (query_id, of, query, depth, focus) from the channels' rows of the query that each is ``of``: several requests may take one query's rows to different depths."""
    deep = asked.select("query_id", "of", "depth")
    own = lambda rows: rows.withColumnRenamed("query_id", "of").join(deep, "of").where(F.col("rank") <= F.col("depth")).drop("of", "depth")
    found = retrieve.fuse({c: own(rows) for c, rows in made.items()}, s)
    docs = index.select(F.col("ord").alias("doc_id"), "title", "topic", "publish_date", "effective_date", "expire_date", F.col("page_content").alias("text"), "parent_id", "chunk_level")
    rows = found.join(docs, "doc_id").join(asked.drop("of"), "query_id")
    q = F.col("query")
    rows = rows.withColumn("base", F.round(F.col("rrf") + retrieve.temporal_bonus(q, words, s.as_of), 9))
    years = F.regexp_extract_all(q, F.lit(YEAR), F.lit(1))
    hay = F.concat_ws(" ", "publish_date", "effective_date", "expire_date", "title", "topic", "text")
    every = Window.partitionBy("query_id")
    rows = rows.withColumn("dated", F.exists(years, lambda y: F.contains(hay, y)))
    holds = retrieve.time_sensitive(q, words) & retrieve.active(F.col("effective_date"), F.col("expire_date"), s.as_of)
    rows = rows.withColumn("first_part", F.when(F.max("dated").over(every), F.col("dated")).otherwise(holds))
    order = [F.desc("base"), F.desc("publish_date"), F.desc("first_part"), F.col("first.channel"), F.col("first.r")]
    rows = rows.withColumn("rank", F.row_number().over(every.orderBy(*order))).where(F.col("rank") <= F.col("depth"))
    score = F.round(F.col("base") + retrieve.focus_bonus(F.col("parent_id"), F.col("chunk_level"), F.col("focus")), 9)
    return rows.select("query_id", F.col("doc_id").alias("ord"), score.alias("score"), "rank")


def merged(queries: DataFrame, index: DataFrame, **kw) -> DataFrame:
    """(query_id, ord, score, rank) of queries with several forms (query_id, forms; depth, focus): the best score of each chunk over the forms, 0 at least."""
    forms = queries.select("*", F.posexplode("forms").alias("form", "query")).drop("forms").withColumn("of_", F.col("query_id"))
    forms = forms.withColumn("query_id", F.col("of_") * 8 + F.col("form"))
    found = hybrid(forms.drop("form", "of_"), index, **kw)
    best = found.select(F.floor(F.col("query_id") / 8).cast("long").alias("query_id"), F.pmod("query_id", F.lit(8)).alias("form"), F.col("ord").alias("doc_id"), "score", "rank")
    return retrieve.merge_queries(best, kw.get("s", SETTINGS).top_n).withColumnRenamed("doc_id", "ord")


def chunks_of(ranked: DataFrame, index: DataFrame) -> DataFrame:
    """``ranked`` (query_id, ord, score, rank) with the chunks' columns, as rank functions want them: doc_id is the chunk's ord, text its text, else its page content."""
    text = F.coalesce(F.nullif(F.trim("chunk_text"), F.lit("")), F.col("page_content"))
    own = index.select("ord", "chunk_id", "chunk_level", "parent_id", "parent_text", "page_content", "chunk_text_hash", text.alias("text"), "title", "topic", "source_url", "publish_date", "effective_date", "expire_date")
    return ranked.join(own, "ord").withColumn("doc_id", F.col("ord"))


def small_to_big(rows: DataFrame) -> Column:
    """The parent's text of a chunk, or its own content."""
    return F.coalesce(F.nullif(F.col("parent_text"), F.lit("")), F.col("page_content"))


def rerank_with(ranked: DataFrame, n: int, provider: Callable[[str, list[str], int], list[tuple[int, float]]] | None = None) -> DataFrame:
    """The n best rows of each query by a provider (query, texts, n -> (position, score) pairs; positions out of range and repeats are dropped), or by the offline rule where there is none or it fails or gives nothing; ``degraded`` says which."""
    from corvane.operators import rank

    plain = rank.rerank(ranked, n).withColumn("degraded", F.lit(True))
    if provider is None:
        return plain

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank").reset_index(drop=True)
        try:
            got = [(int(i), float(x)) for i, x in provider(rows["query"].iloc[0], rows["text"].fillna("").tolist(), n) if 0 <= int(i) < len(rows)]
        except Exception:  # noqa: BLE001  whatever a provider raises
            got = []
        first: dict[int, float] = {}
        for i, x in got:
            first.setdefault(i, x)
        got = list(first.items())[:n]
        return pd.DataFrame({"query_id": rows["query_id"].iloc[0], "doc_id": [rows["doc_id"].iloc[i] for i, _ in got], "score_": [x for _, x in got], "rank_": np.arange(1, len(got) + 1)})

    asked = ranked.select("query_id", "query", "doc_id", "text", "rank").groupBy("query_id").applyInPandas(one, "query_id long, doc_id long, score_ double, rank_ int")
    done = ranked.drop("score", "rank").join(asked, ["query_id", "doc_id"]).withColumnsRenamed({"score_": "score", "rank_": "rank"}).withColumn("degraded", F.lit(False))
    rest = plain.join(asked.select("query_id").distinct(), "query_id", "left_anti").select(done.columns)
    return done.unionByName(rest)
