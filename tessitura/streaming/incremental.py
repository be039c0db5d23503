"""New audio files analysed as they arrive: a file stream whose batches run the batch pipeline."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.analysis import analyze
from ..sources.audio import SCHEMA, _decode


def analyze_arrivals(spark: SparkSession, folder: str, out: str, checkpoint: str, columns: int = 1500):
    """Starts a query that appends (track_id, analysis, error, times) as JSON; each file is analysed once, one that can't be decoded is an error row."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    pcm = files.select("path", "content").mapInPandas(_decode, SCHEMA)

    def batch(df, _):
        analyze(df.withColumnRenamed("path", "track_id").withColumnRenamed("error", "decode_error"), columns, timed=True).write.mode("append").json(out)

    return pcm.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
