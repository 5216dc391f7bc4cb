"""Readers: the driver's tables, a folder of Markdown files, and the derived metadata of the test corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_ord, path, name, text) of the Markdown files of a folder in path order, read-me files left out. A missing folder gives no rows."""
    try:
        files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md").select("value", "_metadata.file_path", "_metadata.file_name")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "doc_ord long, path string, name string, text string")
    from pyspark.sql import Window

    files = files.where(F.lower("file_name") != "readme.md").withColumnRenamed("file_path", "path")
    places = files.select("path").withColumn("doc_ord", (F.row_number().over(Window.orderBy("path")) - 1).cast("long"))  # paths alone in one task
    return places.join(files, "path").select("doc_ord", "path", F.col("file_name").alias("name"), F.col("value").alias("text"))


def markdown_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of Markdown files as a corpus: doc_id, text, title, topic, publish, effective and expire dates, source_url."""
    from corvane.operators import ingest

    rows = ingest.header_metadata(markdown(spark, folder))
    effective, expire = ingest.validity(F.col("source_title"), F.col("topic"), F.col("publish_date"), F.col("text"))
    return rows.select(F.col("doc_ord").alias("doc_id"), "text", F.lit("").alias("lang"), "topic", F.col("source_title").alias("title"), "publish_date", effective.alias("effective_date"), expire.alias("expire_date"), "source_url")


def corpus(docs: DataFrame) -> DataFrame:
    """Documents with metadata derived from their ids: a test device (dates, address and title stand in for a corpus that has them)."""
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") * 37 % 2000).cast("int"))
    year, dated, kind = F.year(day).cast("string"), F.col("doc_id") % 3 != 0, F.col("doc_id") % 4
    return docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", F.col("source").alias("topic"), F.substring(F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)), 1, 40).alias("title"),
        day.cast("string").alias("publish_date"), F.when(dated, F.concat(year, F.lit("-01-01"))).otherwise("").alias("effective_date"), F.when(dated, F.concat(year, F.lit("-12-31"))).otherwise("").alias("expire_date"),
        F.when(kind == 0, F.concat(F.lit("https://"), "source", F.lit(".gov.cn"))).when(kind == 1, F.concat(F.lit("https://"), "source", F.lit(".edu.cn"))).when(kind == 2, F.concat(F.lit("https://"), "source", F.lit(".example"))).otherwise("").alias("source_url"),
    )


#: The same in DuckDB.
CORPUS_SQL = """corpus AS (SELECT doc_id, coalesce(text, '') AS text, lang, source AS topic, substr(split_part(coalesce(text, ''), chr(10), 1), 1, 40) AS title,
 strftime(day, '%Y-%m-%d') AS publish_date, CASE WHEN doc_id % 3 <> 0 THEN strftime(day, '%Y') || '-01-01' ELSE '' END AS effective_date,
 CASE WHEN doc_id % 3 <> 0 THEN strftime(day, '%Y') || '-12-31' ELSE '' END AS expire_date,
 CASE doc_id % 4 WHEN 0 THEN 'https://' || source || '.gov.cn' WHEN 1 THEN 'https://' || source || '.edu.cn' WHEN 2 THEN 'https://' || source || '.example' ELSE '' END AS source_url
 FROM (SELECT *, DATE '2020-01-01' + CAST(doc_id * 37 % 2000 AS INT) AS day FROM documents))"""
