"""State by key, in batch: memory, rolling summary, skills. (Breaker and cache are in ``scans``.)"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.config import SETTINGS, Settings
from corvane.functions.text import squeeze


#: Seconds that a kind of memory lasts; a kind that isn't here lasts for good.
LASTS = {"short": 4 * 3600, "special": 90 * 86400}


def memory_latest(log: DataFrame, as_of: Column) -> DataFrame:
    """The last value of each (session, kind, key) of a log (session, kind, key, value, ts, ord) that holds at ``as_of``, newest first by ``place``."""
    last = Window.partitionBy("session", "kind", "key").orderBy(F.desc("ts"), F.desc("ord"))
    rows = log.withColumn("r_", F.row_number().over(last)).where("r_ = 1").drop("r_")
    until = F.lit(None).cast("timestamp")
    for kind, seconds in LASTS.items():
        until = F.when(F.col("kind") == kind, F.col("ts") + F.make_dt_interval(secs=F.lit(seconds))).otherwise(until)
    rows = rows.withColumn("expires_at", until).where(F.col("expires_at").isNull() | (F.col("expires_at") > as_of))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("session", "kind").orderBy(F.desc("ts"), F.desc("ord"), "key")))


def rolling_summary(snippets: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """(session, summary) of snippets (session, ord, text): appended with a bar unless already inside; the last 600 characters stay."""
    most = F.lit(s.summary_chars)

    def step(a: Column, e: Column) -> Column:
        new = squeeze(e["text"])
        joined = F.concat(a, F.lit(" | "), new)
        return F.when(new == "", a).when(a == "", F.substring(new, F.lit(1), most)).when(F.contains(a, new), F.substring(a, F.lit(1), most)).otherwise(F.substring(joined, F.greatest(F.length(joined) - most, F.lit(0)) + 1, most))

    rows = snippets.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("items"))
    return rows.select("session", F.aggregate("items", F.lit(""), step).alias("summary"))


def skill_score(workflow: Column) -> Column:
    return F.least(F.lit(0.45) + F.when(workflow.contains("->"), 0.2).otherwise(0.0) + F.when(F.length(workflow) > 20, 0.2).otherwise(0.0) + F.when(workflow.contains("来源") | workflow.contains("条款"), 0.1).otherwise(0.0), F.lit(0.99))


def skill_versions(saves: DataFrame) -> DataFrame:
    """(id, name, version, workflow_hash, score, active) of saves (name, workflow, ord): a workflow that a name has already makes no version; the best score, the newest of equals, is active."""
    rows = saves.withColumn("workflow_hash", F.substring(F.sha2("workflow", 256), 1, 16)).withColumn("score", F.round(skill_score(F.col("workflow")), 4))
    rows = rows.groupBy("name", "workflow_hash").agg(F.min("ord").alias("ord"), F.first("score").alias("score"))
    rows = rows.withColumn("version", F.row_number().over(Window.partitionBy("name").orderBy("ord")))
    best = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), F.desc("version"))) == 1
    return rows.select(F.concat(F.col("name"), F.lit("_v"), F.col("version").cast("string")).alias("id"), "name", "version", "workflow_hash", "score", best.alias("active"))


def session_last(results: DataFrame) -> DataFrame:
    """The last result of each session (session, ord, value)."""
    return results.groupBy("session").agg(F.max_by("value", "ord").alias("value"))
