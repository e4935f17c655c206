"""Extension: the metric engine over a stream of trace lines. Metrics look at one row at a time, so the batch plan runs
unchanged in append mode, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics
from ..sources.jsonl import parsed


def score_stream(spark: SparkSession, directory: str, config: dict | None = None) -> DataFrame:
    """Metric results of all JSON lines that arrive as files in a directory. line is a hash of the line's text."""
    rows = spark.readStream.text(directory).where(F.trim("value") != "").withColumn("line", F.xxhash64("value"))
    return metrics.score(parsed(rows), config)


def without_repeats(results: DataFrame, time_col: str, lateness: str = "1 hour") -> DataFrame:
    """The first result of each trace and metric within a watermark."""
    return results.withWatermark(time_col, lateness).dropDuplicatesWithinWatermark(["trace_id", "metric_name"])
