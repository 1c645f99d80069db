"""Scores of arriving answers as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pageloom.functions import metrics
from pageloom.functions import text as tx


def answers_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files of answers as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def without_repeats(stream: DataFrame, keys: list[str], event_time: str | None = None, late: str = "30 days") -> DataFrame:
    """The stream without repeated rows.

    Without event time every key stays in the state and no row is lost, however
    late. With it, state is kept for `late`, and older rows are dropped: it should
    be the arrival time, which later batches do not fall behind.
    """
    if event_time is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys)


def native_scores(stream: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """The stream with error rates and lengths; native expressions but for texts of a million words, no state."""
    r, h = F.col(reference), F.col(hypothesis)
    return stream.withColumns({"cer": metrics.cer(r, h), "wer": metrics.wer(r, h), "length_ocr": F.length(tx.strip(h))})


def windowed_counts(stream: DataFrame, event_time: str, by: list[str], window: str = "1 day", late: str = "7 days") -> DataFrame:
    """(start, by, n): arrivals per window; windows close when the watermark has passed them."""
    return stream.withWatermark(event_time, late).groupBy(F.window(event_time, window), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Work off what has arrived, write it as Parquet, and end."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
