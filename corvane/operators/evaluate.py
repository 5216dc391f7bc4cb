"""Evaluation: cases, ranking metrics, summaries, Pareto curves, answers, release gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retrieval_cases(chunks: DataFrame, most: int | None = None) -> DataFrame:
    """(case_id, chunk_id, query, category, relevant): for each small chunk its auxiliary queries and the first 32 characters of its text, 4 characters at least, each once; relevant are the chunk, its siblings and their summary.

    ``chunks``: chunk_id, chunk_level, parent_id, topic, chunk_text, query_expansions, ord."""
    small = chunks.where("chunk_level = 'small'")
    group = chunks.where("parent_id <> ''").groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct((F.col("chunk_level") == "summary").alias("s"), "ord", "chunk_id"))).alias("all"))
    rows = small.join(group, "parent_id", "left")
    asked = F.array_distinct(F.filter(F.transform(F.concat(F.coalesce("query_expansions", F.array().cast("array<string>")), F.array(F.substring("chunk_text", 1, 32))), lambda x: F.trim(x)), lambda x: F.length(x) >= 4))
    relevant = F.array_distinct(F.concat(F.array("chunk_id"), F.coalesce(F.transform("all", lambda x: x["chunk_id"]), F.array().cast("array<string>"))))
    rows = rows.select("chunk_id", F.col("topic").alias("category"), "ord", relevant.alias("relevant"), F.posexplode(asked).alias("k", "query"))
    rows = rows.withColumn("case_id", F.concat_ws("/", "chunk_id", F.col("k").cast("string")))
    if most is not None:
        rows = rows.orderBy("ord", "k").limit(most)
    return rows.select("case_id", "chunk_id", "query", "category", "relevant")


def ranking_metrics(cases: DataFrame, predicted: DataFrame, k: int) -> DataFrame:
    """(case_id, category, recall, mrr, ndcg) of cases (case_id, category, relevant) and predictions (case_id, id, rank)."""
    hits = predicted.where(F.col("rank") <= k).join(cases.select("case_id", "relevant"), "case_id").where(F.array_contains("relevant", F.col("id")))
    return _metrics(cases.withColumn("n_relevant", F.size("relevant")), hits, k)


def class_metrics(cases: DataFrame, predicted: DataFrame, k: int) -> DataFrame:
    """The same where relevant is what shares the case's class: cases (case_id, category, class, n_relevant), predictions (case_id, id, rank, class). No list of relevant ids is built."""
    own = cases.select("case_id", F.col("class").alias("own_"))
    hits = predicted.where(F.col("rank") <= k).join(own, "case_id").where(F.col("class") == F.col("own_"))
    return _metrics(cases, hits, k)


def _metrics(cases: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    by = hits.groupBy("case_id").agg(F.countDistinct("id").alias("hits"), F.min("rank").alias("first"), F.sum(F.lit(1.0) / F.log2(F.col("rank") + 1)).alias("dcg"))
    n = F.col("n_relevant")
    count = F.greatest(F.least(n, F.lit(k)), F.lit(1)).cast("int")
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), count), lambda i: F.lit(1.0) / F.log2(i + 1)), F.lit(0.0), lambda s, x: s + x)
    zero = lambda c: F.round(F.coalesce(F.when(n > 0, c), F.lit(0.0)), 4)
    return cases.join(by, "case_id", "left").select("case_id", "category", zero(F.col("hits") / n).alias("recall"), zero(F.lit(1.0) / F.col("first")).alias("mrr"), zero(F.col("dcg") / ideal).alias("ndcg"))


def summarize(rows: DataFrame, *by: str, digits: int = 4) -> DataFrame:
    """Means of recall, mrr, ndcg and, if there, latency_ms with its nearest-rank 95th percentile, by the given columns or over all."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), digits).alias(f"avg_{c}")
    out = [F.count("*").alias("total"), mean("recall"), mean("mrr"), mean("ndcg")]
    if "latency_ms" in rows.columns:
        out += [mean("latency_ms"), F.coalesce(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms)"), F.lit(0.0)).alias("p95_latency_ms")]
    return rows.groupBy(*by).agg(*out)


def answer_metrics(answers: DataFrame) -> DataFrame:
    """``answers`` (text, keywords, forbidden, require_citation, n_sources) with keyword_coverage, citation_hit, hallucination, passed."""
    text = F.lower(F.coalesce("text", F.lit("")))
    found = F.size(F.filter("keywords", lambda w: F.contains(text, F.lower(w))))
    coverage = F.round(F.when(F.size("keywords") > 0, found / F.greatest(F.size("keywords"), F.lit(1))).otherwise(1.0), 4)
    bad = F.exists("forbidden", lambda w: F.contains(text, F.lower(w)))
    cited = ~F.col("require_citation") | (F.col("n_sources") > 0)
    return answers.withColumns({"keyword_coverage": coverage, "citation_hit": cited, "hallucination": bad, "passed": (coverage >= 0.5) & cited & ~bad})


def rates(rows: DataFrame, *by: str) -> DataFrame:
    rate = lambda c: F.round(F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)), 4)
    return rows.groupBy(*by).agg(F.count("*").alias("total"), rate("passed").alias("pass_rate"), rate("citation_hit").alias("citation_hit_rate"), rate("hallucination").alias("hallucination_rate"))


STAGES = ("shadow", "canary", "full")


def release_gate(report: DataFrame, stage: str = "shadow", min_pass: float = 0.8, min_citation: float = 0.85, max_p95: float = 1500.0, max_failed: int = 2, baseline: tuple[float | None, float | None, float | None] = (None, None, None), drops: tuple[float, float, float] = (0.03, 0.05, 200.0)) -> DataFrame:
    """(decision, next_stage, reasons) of a report row (pass_rate, citation_hit_rate, p95_latency_ms, failed_rows)."""
    if stage not in STAGES:
        raise ValueError(f"unknown stage: {stage}")
    p, c, t = F.col("pass_rate"), F.col("citation_hit_rate"), F.col("p95_latency_ms")
    tests = [(p < min_pass, "pass_rate"), (c < min_citation, "citation_hit_rate"), (t > max_p95, "p95_latency"), (F.col("failed_rows") > max_failed, "failed_rows")]
    bp, bc, bt = baseline
    tests += [(F.lit(b) - v > d, name) for b, v, d, name in ((bp, p, drops[0], "pass_rate_regression"), (bc, c, drops[1], "citation_hit_regression")) if b is not None]
    tests += [(t - bt > drops[2], "p95_regression")] if bt is not None else []
    reasons = F.filter(F.array(*[F.when(x, name) for x, name in tests]), lambda x: x.isNotNull())
    following = STAGES[min(STAGES.index(stage) + 1, len(STAGES) - 1)]
    return report.select("*", reasons.alias("reasons")).withColumn("decision", F.when(F.size("reasons") > 0, "rollback").otherwise("promote")).withColumn("next_stage", F.when(F.size("reasons") > 0, stage).otherwise(following))
