"""Summaries kept up to date as batches arrive.

Sums, extremes and histogram counts of separate batches add up, so each micro-batch is reduced on its own and appended;
what is read back is the sum. A batch that a restarted query delivers again replaces its own part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terrane.operators import stats


def summarise(stream: DataFrame, by: Sequence[str], value: str, low: float, high: float, out: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that takes what there is and ends; parts are written under out/batch=N."""

    def part(df: DataFrame, batch: int) -> None:
        stats.moments(df, by, value, low, high).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return stream.writeStream.foreachBatch(part).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def summary(spark: SparkSession, out: str, by: Sequence[str]) -> DataFrame:
    return stats.merged_moments(spark.read.parquet(out).drop("batch"), by)


def latest(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """The stream without deliveries of a key that came before, as far back as `late` (an interval such as '30 days')."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def counts(stream: DataFrame, time: str, width: str, late: str, by: Sequence[str]) -> DataFrame:
    """(window, by, n) of events by windows of time, closed once the watermark has passed them."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))
