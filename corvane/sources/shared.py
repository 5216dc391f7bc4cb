"""Tables written to the folder that all executors share (spark.checkpoint.dir): they cut the lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the session's checkpoint folder; one of its own only under a local master, where none need be set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/corvane/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    path, schema = shared_dir(df.sparkSession), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
