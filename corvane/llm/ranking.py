"""Ranked lexical search: postings in term buckets, joined with the terms of items, scores in whole numbers.

Terms are maximal runs of bytes outside \\x00-\\x2F, \\x3A-\\x40, \\x5B-\\x60, \\x7B-\\x7F, only A-Z in lower case. Each row of the documents is a
document. The postings (bucket, term, doc_id, text_key, tf, n) are a written table: every task that reads texts writes those of its rows, sorted by
bucket (a hash of the term), so that no shuffle gathers the postings of a frequent term; a search reads only the buckets of its terms. One more row
with bucket -1 tells a document's size.

A search counts the documents of each term, joins the postings with the items' terms, sums the scores by item and document, and numbers
the best of each item. Postings are dealt out by document before that join, so that sums need no second shuffle, and each task sends its own ``k`` best only.
Items' terms are sent to all tasks after they were counted, ``SENT_TERMS`` at most; more are joined by a shuffle, with the same rows.

Null and empty texts have no terms, are no documents of the corpus' counts and are never found. A null doc_id comes after all others of its score. Rows
that repeat a doc_id are documents of their own; rows that repeat doc_id and text are counted each and found each. Rows that repeat an item_id
(a null one too) are one item of all their terms; items without terms find nothing. Equal scores go by doc_id, then by the hash of the text. A very long text is one row of
one task. Columns other than doc_id and text (item_id and text) are not read, whatever their names. Empty tables give an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.common import chunks, columns, read, table
from corvane.llm.decontaminate import words

BUCKETS, TOP = 256, 10
#: Terms of items (rows of item and term) that are sent to all tasks; more are joined by a shuffle.
SENT_TERMS = 1 << 19


def _bucket(term) -> F.Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each item."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            rows = [(k, t) for k, text in enumerate(b.column(1).to_pylist()) for t in sorted(set(words(text)))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([k for k, _ in rows], pa.int64())), pa.array([t for _, t in rows], pa.binary()).cast(pa.string())], ["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    return columns(items, "item_id", "text").mapInArrow(f, f"item_id {kind}, term string").distinct()


def postings(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """The postings of all terms, or of those in ``terms`` (term) only, where they are few enough to be sent to all tasks."""
    spark, sent = docs.sparkSession, None
    if terms is not None:
        few = [r[0].encode() for r in terms.select("term").distinct().limit(SENT_TERMS + 1).collect()]
        sent = spark.sparkContext.broadcast(frozenset(few)) if len(few) <= SENT_TERMS else None

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            at, term, tf, n = [], [], [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                all_ = words(text)
                if not all_:
                    continue
                count = Counter(all_)
                if sent is not None:
                    count = {t: count[t] for t in count.keys() & sent.value}
                term += [None, *count]
                tf += [0, *count.values()]
                at += [k] * (len(count) + 1)
                n += [len(all_)] * (len(count) + 1)
            ids = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.binary()).cast(pa.string()), b.column(0).take(ids), b.column(2).take(ids), pa.array(tf, pa.int64()), pa.array(n, pa.int64())], ["term", "doc_id", "text_key", "tf", "n"])

    rows = columns(docs, "doc_id", "text").select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(f, "term string, doc_id long, text_key long, tf long, n long")
    bucket = F.when(F.col("term").isNull(), F.lit(-1)).otherwise(_bucket("term"))
    return table(rows.select(bucket.alias("bucket"), "*").sortWithinPartitions("bucket"))


def search(terms: DataFrame, post: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item, from (item_id, term) and postings that hold all of these terms."""
    sizes = post.where("bucket < 0")
    held, total = sizes.agg(F.count("*"), F.sum("n")).first()
    if not held:
        return terms.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    terms = table(terms)
    few = terms.count() <= SENT_TERMS
    sent = F.broadcast if few else (lambda df: df)
    if few:
        wanted = [r[0] for r in terms.select(_bucket("term")).distinct().collect()]  # at most BUCKETS
        mine = post.where(F.col("bucket").isin(wanted))
    else:
        mine = post.where("bucket >= 0")
    df = mine.join(sent(terms.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * held + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weighed = table(terms.join(df, "term").select("item_id", "term", weight.alias("w")).where("w > 0"))
    m = F.expr(f"10 + (90 * n * {held}L) div {total}L")
    part = mine.withColumn("m", m).select("term", "doc_id", "text_key", F.expr("(1000000000 * tf) div (1000 * tf + 8 * m)").alias("f"))
    if few:
        part = part.join(sent(weighed.select("term").distinct()), "term", "left_semi").repartition("doc_id", "text_key")
    sums = part.join(sent(weighed), "term").groupBy("item_id", "doc_id", "text_key").agg(F.sum(F.col("w") * F.col("f")).alias("score"))
    again = table(sizes.groupBy(F.col("doc_id").alias("d_"), F.col("text_key").alias("t_")).agg(F.count("*").alias("copies")).where("copies > 1"))
    if again.head(1):  # rows that repeat doc_id and text were summed together
        sums = sums.join(again, F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("text_key") == F.col("t_")), "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
        sums = sums.select("item_id", "doc_id", "text_key", F.expr("score div copies").alias("score"), F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)))))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "text_key")
    best = sums.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("item_id", "rank", "doc_id", "score")


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = item_terms(read(spark, sf_dir, "benchmark"))
    return search(terms, postings(read(spark, sf_dir, "documents"), terms))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hash(text) AS h, {_TERMS} AS t FROM documents WHERE text IS NOT NULL),
s AS (SELECT r, doc_id, h, len(t) AS size FROM d WHERE len(t) > 0),
g AS (SELECT count(*)::BIGINT AS held, sum(size)::BIGINT AS total FROM s),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
w AS (SELECT item_id, term, floor(1000 * ln((2 * held + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM i JOIN f USING (term), g),
x AS (SELECT item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * size * held) // total))))::BIGINT AS score
  FROM w JOIN p USING (term) JOIN s USING (r), g GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x WHERE score > 0) WHERE rank <= 10
"""
