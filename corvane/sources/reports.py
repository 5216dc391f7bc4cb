"""JSON reports, and lines of JSON that are added to."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def write_report(rows: DataFrame, path: str) -> None:
    """The rows as JSON in place of what the folder holds."""
    rows.write.mode("overwrite").json(path, ignoreNullFields=False)


def read_report(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A report: a file or folder of JSON, over one line or several; nothing where there is none."""
    reader = spark.read.schema(schema) if schema else spark.read
    try:
        return reader.json(path, multiLine=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def append_lines(rows: DataFrame, path: str) -> None:
    """Adds the rows to a folder of JSON lines."""
    rows.write.mode("append").json(path, ignoreNullFields=False)
