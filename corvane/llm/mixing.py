"""Mixing sources to target weights by systematic sampling.

Every document gets an expected number of copies (its source's target over its source's size). Within a source the
expected copies are summed in one fixed order (by size, so that every stretch of sizes gives its share), one random
offset is added, and a copy is emitted for each whole number that the running sum passes.

The running sum is made in two levels: counts of cells (source, size, doc_id modulo ``cells``) are summed first, then
rows are numbered inside their cell; no task ever holds a source. Null text counts as size 0, a null source is a source
of its own (the last), a null doc_id sits in cell 0 and comes last there, rows of one size that share a doc_id (or have none) go by a hash of
all their columns, so that reruns agree whatever the order rows come in, repeated rows are documents of their own, and
an empty table gives an empty result. A very long text is one row of one task. Other columns pass unseen; their names must not be
copies, source_size or target (callers set clashing ones aside).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.common import columns, read

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, CAP, CELLS, SEED = 1.5, 2, 64, "corvane"


def with_size(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORDS)).cast("long"), F.lit(0).cast("long")))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """From a row per source (source, source_size): its target. Sources by code point, null last, take the weights in turn; targets stop at ``cap`` times the source's size, and the excess goes to the others by weight."""
    order = Window.orderBy(F.col("source").isNull(), "source")  # one row per source
    w = F.lit(None)
    for i, x in enumerate(weights):
        w = F.when((F.row_number().over(order) - 1) % len(weights) == i, float(x)).otherwise(w)
    s = sizes.withColumn("weight", w)
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(share)
    s = s.withColumn("ratio", F.col("source_size") * F.lit(float(cap)) / F.col("weight"))
    s = s.withColumn("level", (total - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(float(cap))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("water", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(everything)["level"])
    return s.select("source", "source_size", F.when(F.col("water").isNull(), F.col("source_size") * F.lit(float(cap))).otherwise(F.least(F.col("weight") * F.col("water"), F.col("source_size") * F.lit(float(cap)))).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, cells: int = CELLS, seed: str = SEED) -> DataFrame:
    """``docs`` (doc_id, source, size and any others) with source_size, target and copies."""
    cell = F.coalesce(F.pmod("doc_id", F.lit(cells)), F.lit(0))
    counts = docs.groupBy("source", "size", cell.alias("cell")).agg(F.count("*").alias("n"))
    goal = targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, cap)
    before = Window.partitionBy("source").orderBy("size", "cell").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .select(F.col("source").alias("c_source"), F.col("size").alias("c_size"), "cell", "before", "source_size", "target")
    )
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    row = F.xxhash64(*[F.col(f"`{n}`") for n, t in docs.dtypes if "map<" not in t and t != "variant"])
    rank = F.row_number().over(Window.partitionBy("source", "size", "c_").orderBy(F.col("doc_id").asc_nulls_last(), "h_")) + F.col("before")
    return (
        docs.withColumns({"c_": cell, "h_": row})
        .join(plan, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size")) & (F.col("c_") == F.col("cell")))
        .withColumn("r_", rank)
        .withColumn("copies", (F.floor(rate * F.col("r_") + offset) - F.floor(rate * (F.col("r_") - 1) + offset)).cast("long"))
        .drop("c_", "h_", "c_source", "c_size", "cell", "before", "r_")
    )


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_size(columns(read(spark, sf_dir, "documents"), "doc_id", "source", "text")).drop("text")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


OP10_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORDS}')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight FROM s),
r AS (SELECT *, source_size * 2.0::DOUBLE / weight AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size) OVER p, 0) * 2.0::DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS level
  FROM r WINDOW p AS (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(weight * (SELECT arg_min(level, ratio) FROM l WHERE ratio >= level), source_size * 2.0::DOUBLE) AS target,
  ('0x' || substr(md5('{SEED}' || coalesce(source, '')), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM l),
k AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size, coalesce(doc_id % {CELLS}, 0), doc_id NULLS LAST) AS r FROM d)
SELECT doc_id, size, source_size, target, (size * (floor(c * r + u) - floor(c * (r - 1) + u)))::BIGINT AS taken, (floor(c * r + u) - floor(c * (r - 1) + u))::BIGINT AS copies
FROM (SELECT k.*, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS c FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
"""
