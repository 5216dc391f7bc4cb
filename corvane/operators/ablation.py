"""Ablation of retrieval: all variants over one pass of each channel.

Each case's forms (its query; for variants that rewrite, up to three) go through the channels once, to the largest depth that any variant asks for. Variants are a mask over these rows: which
forms they take, how deep, fused or one channel alone, reranked or not, and what counts as relevant. Fused variants are requests of one fusion, told apart by their ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.config import SETTINGS, TIME_WORDS_RETRIEVAL, VARIANTS, Settings
from corvane.functions.text import strip
from corvane.operators import evaluate, gateway, index, rank, retrieve, understand
from corvane.sources.shared import written

CHANNELS = {"bm25_only": "sparse", "dense_only": "dense", "exact_only": "exact"}
FORMS = 3


def _forms(cases: DataFrame) -> DataFrame:
    """cases with ``forms``: the query and its rewrites, FORMS at most."""
    rows = cases.withColumn("more", understand.rewrites(F.col("query"), F.array().cast("array<string>")))
    forms = F.filter(F.transform(F.concat(F.array("query"), "more"), strip), lambda x: x != "")
    return rows.withColumn("forms", F.slice(F.array_distinct(forms), 1, FORMS)).drop("more")


def predictions(cases: DataFrame, chunks: DataFrame, k: int = 5, variants: tuple[str, ...] = VARIANTS, s: Settings = SETTINGS, words: tuple[str, ...] = TIME_WORDS_RETRIEVAL, provider: Callable | None = None) -> DataFrame:
    """(variant, case_id, ord, rank): the first k chunks of each variant for each case (case_id, query)."""
    deep = max(3 * k, 12)
    numbered = written(_forms(cases.select("case_id", "query")).withColumn("n", F.row_number().over(Window.orderBy("case_id")).cast("long")))  # the stated cases are few
    forms = numbered.select("n", F.array_distinct(F.concat(F.array("query"), "forms")).alias("f")).select("n", F.posexplode("f").alias("form", "query"))
    asked = written(forms.select((F.col("n") * 8 + F.col("form")).alias("query_id"), "n", "form", "query"))
    made = {c: written(rows) for c, rows in index.channel_rows(asked.select("query_id", "query"), chunks, deep, provider=provider).items()}
    on = lambda v, name: f"_{name}_on" in v
    every = F.array(*[F.struct(F.lit(i).cast("long").alias("v"), gateway.variant_base(F.lit(v)).alias("base"), F.lit(on(v, "rewrite")).alias("rewrite"), F.lit(on(v, "rerank")).alias("rerank")) for i, v in enumerate(variants)])
    held = numbered.select("n", F.explode(every).alias("x")).select("n", "x.*")
    depth = F.when(F.col("rerank"), deep).otherwise(k)
    mixed = held.where("base = 'rrf_hybrid'").join(numbered.select("n", "forms", "query"), "n")
    wanted = mixed.select("n", "v", depth.alias("depth"), F.explode(F.when(F.col("rewrite"), F.col("forms")).otherwise(F.array("query"))).alias("query"))
    place = F.row_number().over(Window.partitionBy("n", "v").orderBy("form")) - 1
    wanted = wanted.join(asked.select("n", "query", F.col("query_id").alias("of"), "form"), ["n", "query"]).withColumn("at", place)
    requests = wanted.select(((F.col("n") * len(variants) + F.col("v")) * 8 + F.col("at")).alias("query_id"), "of", "query", "depth", F.array().cast("array<string>").alias("focus"))
    found = index.fused(requests, chunks, made, words, s)
    split = found.select(F.floor(F.col("query_id") / 8).cast("long").alias("query_id"), F.pmod("query_id", F.lit(8)).alias("form"), F.col("ord").alias("doc_id"), "score", "rank")
    best = retrieve.merge_queries(split, deep).select((F.floor(F.col("query_id") / len(variants))).cast("long").alias("n"), F.pmod("query_id", F.lit(len(variants))).alias("v"), "doc_id", "score", "rank")
    for name, channel in CHANNELS.items():
        mine = held.where(F.col("base") == name).select("n", "v")
        rows = made[channel].where(F.pmod("query_id", F.lit(8)) == 0).select(F.floor(F.col("query_id") / 8).cast("long").alias("n"), "doc_id", "score", "rank")
        best = best.unionByName(mine.join(rows, "n").select("n", "v", "doc_id", "score", "rank"))
    best = written(best.join(held.select("n", "v", "rerank", depth.alias("depth")), ["n", "v"]).where(F.col("rank") <= F.col("depth")))
    texts = chunks.select(F.col("ord").alias("doc_id"), F.coalesce(F.nullif(F.trim("chunk_text"), F.lit("")), F.col("page_content")).alias("text"), "publish_date")
    again = best.where("rerank").join(texts, "doc_id").join(numbered.select("n", "query"), "n").withColumn("query_id", F.col("n") * len(variants) + F.col("v"))
    again = rank.rerank(again.select("query_id", "query", "doc_id", "text", "publish_date", "score", "rank"), k)
    again = again.select(F.floor(F.col("query_id") / len(variants)).cast("long").alias("n"), F.pmod("query_id", F.lit(len(variants))).alias("v"), "doc_id", "rank")
    out = best.where("NOT rerank").select("n", "v", "doc_id", "rank").unionByName(again).where(F.col("rank") <= k)
    out = out.join(numbered.select("n", "case_id"), "n")
    name = F.element_at(F.array(*[F.lit(v) for v in variants]), (F.col("v") + 1).cast("int"))
    return out.select(name.alias("variant"), "case_id", F.col("doc_id").alias("ord"), "rank")


def ablation(cases: DataFrame, chunks: DataFrame, k: int = 5, variants: tuple[str, ...] = VARIANTS, **kw) -> DataFrame:
    """A row per variant: cases, avg_recall, avg_mrr, avg_ndcg at k, of cases (case_id, query, chunk_id, category, relevant). Where small-to-big is off, only the case's own chunk is relevant."""
    found = predictions(cases, chunks, k, variants, **kw).join(chunks.select("ord", F.col("chunk_id").alias("id")), "ord")
    tags = F.array(*[F.lit(v) for v in variants])
    each = cases.withColumn("variant", F.explode(tags)).withColumn("relevant", F.when(gateway.variant_flag(F.col("variant"), "small2big", True), F.col("relevant")).otherwise(F.slice("relevant", 1, 1)))
    key = F.concat_ws("|", "variant", "case_id")
    rows = evaluate.ranking_metrics(each.select(key.alias("case_id"), F.col("variant").alias("category"), "relevant"), found.select(key.alias("case_id"), "id", "rank"), k)
    return evaluate.summarize(rows, "category").withColumnRenamed("category", "variant")
