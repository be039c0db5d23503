"""Prediction rows of tools as JSON lines: read together, resume, append; reports as JSON.

Row: tool, tool_version, corpus_role, corpus_fingerprint, model_sha256, track_id, expected_bpm, expected_key,
detected_bpm, detected_key, elapsed_ms, error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "tool string, tool_version string, corpus_role string, corpus_fingerprint string, model_sha256 string, track_id string, expected_bpm double, expected_key string, detected_bpm double, detected_key string, elapsed_ms double, error string"


def read_predictions(spark: SparkSession, *paths: str) -> DataFrame:
    """All rows of all files; blank lines are skipped, a line that is no JSON gives a row with ``error``."""
    raw = spark.read.text(list(paths)).where(F.trim("value") != "")
    row = raw.select(F.from_json("value", f"{SCHEMA}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return row.select("r.*").withColumn("error", F.coalesce("error", F.when(F.col("_corrupt").isNotNull(), F.lit("not a JSON object")))).drop("_corrupt")


def append_predictions(rows: DataFrame, path: str) -> None:
    """Adds the rows whose (tool, track_id) ``path`` doesn't hold yet, as further files: a run that was cut short goes on where it ended."""
    spark = rows.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        rows = rows.join(read_predictions(spark, path).select("tool", "track_id").distinct(), ["tool", "track_id"], "left_anti")
    rows.write.mode("append").json(path)


def write_report(rows: DataFrame, path: str) -> None:
    """Results as JSON lines, nulls left out."""
    rows.write.mode("overwrite").option("ignoreNullFields", "true").json(path)
