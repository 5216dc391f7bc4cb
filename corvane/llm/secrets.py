"""Secret scans over a ledger of content-addressed blobs, with DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its text. The ledger holds, for each blob and rule version
already scanned, the secrets found (often none). A scan takes the blobs that the ledger lacks for the rule version, one text for each,
adds their rows to the ledger, and joins findings back to all versions.

Offsets come from the pieces between matches: a match starts after all pieces and matches before it. They are code
points of the text, the end not included. Null text counts as empty; null doc_ids, repeated rows and ties keep a row
each; a very long text is one row of one task; columns other than path and text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.common import columns, read, shared_dir, table

#: kind, pattern, group that must be long enough, its least length. Order breaks ties of start.
RULES = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),  # the runs of 16 and more: runs never touch
)
RULE_VERSION = "2024-1"
LEDGER = "blob string, rule_version string, spans array<struct<start:bigint,kind:int,end:bigint>>"


def _matches(k: int) -> Column:
    """For each match in turn: kind, length of the piece before it, its own length, whether it is long enough. One more entry holds the last piece."""
    _, pattern, group, least = RULES[k]
    p = F.lit(pattern)
    whole, pieces = F.regexp_extract_all("text", p, F.lit(0)), F.split("text", pattern, -1)
    lengths = F.transform(whole, lambda m: F.struct(F.length(m).alias("m"), (F.length(m) >= least).alias("ok")))
    if group:
        lengths = F.zip_with(whole, F.regexp_extract_all("text", p, F.lit(group)), lambda m, g: F.struct(F.length(m).alias("m"), (F.length(g) >= least).alias("ok")))
    return F.when(F.col("text").rlike(pattern), F.zip_with(pieces, lengths, lambda g, m: F.struct(F.lit(k).alias("kind"), F.length(g).alias("gap"), m["m"].alias("m"), m["ok"].alias("ok"))))


def scan_blobs(blobs: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
    """Ledger rows of (blob, text), a row for each blob."""
    none = F.array().cast("array<struct<kind:int,gap:int,m:int,ok:boolean>>")
    found = blobs.select("blob", F.posexplode_outer(F.concat(*[F.coalesce(_matches(k), none) for k in range(len(RULES))])).alias("i", "f")).select("blob", "i", "f.*")
    w = Window.partitionBy("blob", "kind").orderBy("i")
    start = F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    span = F.when(F.col("ok"), F.struct(F.col("start"), F.col("kind"), (F.col("start") + F.col("m")).alias("end")))
    return found.withColumn("start", start).groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("spans")).select("blob", F.lit(rule_version).alias("rule_version"), F.col("spans").cast("array<struct<start:bigint,kind:int,end:bigint>>"))


def scan_history(versions: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """``versions``: path and text of every version. Returns the new rows of the ledger, written, and the findings (path, blob, spans) of all versions."""
    rows = columns(versions, "path", "text").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("blob", F.sha2("text", 256))
    texts = rows.groupBy("blob").agg(F.first("text").alias("text"))  # rows that repeat path and text are one blob too
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == rule_version).dropDuplicates(["blob"])
        unseen = rows.select("blob").distinct().join(seen.select(F.col("blob").alias("b_")), F.col("blob") == F.col("b_"), "left_anti").select(F.col("blob").alias("u_"))
        texts = rows.join(unseen.hint("shuffle_hash"), F.col("blob") == F.col("u_"), "left_semi").groupBy("blob").agg(F.first("text").alias("text"))
    new = table(scan_blobs(texts, rule_version))
    known = new if ledger is None else new.unionByName(seen)
    known = known.where(F.size("spans") > 0).select(F.col("blob").alias("b_"), "spans")
    found = rows.select("path", "blob").join(known, F.col("blob") == F.col("b_"), "left")
    return new, found.select("path", "blob", F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")).alias("spans"))


def scan_with_ledger(versions: DataFrame, path: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """Findings (path, blob, spans) of all versions by the ledger kept at ``path``: only blobs that it lacks for the rule version are scanned, and their rows are appended. The folder may be missing at first; one writer at a time."""
    spark = versions.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    held = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    new, found = scan_history(versions, spark.read.schema(LEDGER).parquet(path) if held else None, rule_version)
    new.write.mode("append").parquet(path)
    return found


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the ledger that ``spark.corvane.secrets.ledger`` names; without one, against a new ledger."""
    docs = columns(read(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("doc_id", "path")
    found = scan_with_ledger(docs, spark.conf.get("spark.corvane.secrets.ledger", None) or shared_dir(spark))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    names = F.array(*[F.lit(r[0]) for r in RULES])
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(F.col("path").alias("doc_id"), *[count(k).alias(f"n_{r[0]}") for k, r in enumerate(RULES)], F.sha2(text, 256).alias("base_sha256"), text.alias("spans"))


def _sql(k: int) -> str:
    kind, pattern, group, least = RULES[k]
    p = pattern.replace("'", "''")
    return f"""
 SELECT id, {k} AS kind, '{kind}' AS name, start, start + length(m) AS stop FROM (
  SELECT id, m, g, (sum(length(gap)) OVER (PARTITION BY id ORDER BY i) + coalesce(sum(length(m)) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start
  FROM (SELECT id, unnest(regexp_extract_all(text, '{p}', 0)) AS m, unnest(regexp_extract_all(text, '{p}', {group})) AS g,
   unnest(regexp_split_to_array(text, '{p}')[:-2]) AS gap, unnest(generate_series(1, len(regexp_extract_all(text, '{p}', 0)))) AS i FROM d WHERE regexp_matches(text, '{p}')))
 WHERE length(g) >= {least}"""


OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(_sql(k) for k in range(len(RULES)))}),
a AS (SELECT id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
 string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans FROM f GROUP BY id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (id)
"""
