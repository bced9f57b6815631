"""The time analyses over streams: bounded state behind a watermark (which takes instants, so times without a zone are cast)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clock import interval_start
from ..functions.text import hashtag_list


def hashtag_counts(stream: DataFrame, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """window start, tag, count; a window closes when the watermark passes it."""
    timed = stream.withColumn("time", F.col("time").cast("timestamp")).withWatermark("time", late)
    tags = timed.select("time", F.explode(hashtag_list(F.col("hashtags"))).alias("tag"))
    counted = tags.groupBy(F.window("time", every), "tag").agg(F.count(F.lit(1)).alias("count"))
    return counted.select(F.col("window.start").alias("time"), "tag", "count")


def active_users(stream: DataFrame, period: str = "15 minutes", every: str = "5 minutes", late: str = "15 minutes") -> DataFrame:
    """window start, user_id, posts: what pairs are made from once a window is closed."""
    timed = stream.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    seen = timed.where("user_id is not null").withWatermark("timestamp", late)
    counted = seen.groupBy(F.window("timestamp", period, every), "user_id").agg(F.count(F.lit(1)).alias("posts"))
    return counted.select(F.col("window.start").alias("window_start"), "user_id", "posts")


def interval_counts(stream: DataFrame, seconds: int = 3600) -> DataFrame:
    """Seconds of the day, count; the state is one row an interval of the day."""
    return stream.groupBy(interval_start(F.col("timestamp"), seconds).alias("start")).agg(F.count("timestamp").alias("count"))
