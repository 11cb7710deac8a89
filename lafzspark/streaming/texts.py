"""Streams of texts: column functions have no state and run as they are; counts keep one row for each word or window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lafzspark.functions import text as T


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder, with the columns that its present ones have."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def normalized(stream: DataFrame, text_col: str = "text") -> DataFrame:
    return stream.withColumn(text_col, T.normalize(F.col(text_col)))


def word_counts(stream: DataFrame, text_col: str = "text") -> DataFrame:
    """word, n; for output mode update or complete. The state is the vocabulary."""
    return stream.select(F.explode(T.words(F.col(text_col))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def event_counts(stream: DataFrame, time_col: str, by: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, end, by, n of event-time windows; the watermark closes a window, and drops its state, when `late` has passed."""
    timed = stream.withColumn(time_col, F.col(time_col).cast("timestamp"))  # watermarks want a time zone
    counted = timed.withWatermark(time_col, late).groupBy(F.window(time_col, window).alias("w"), by).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")
