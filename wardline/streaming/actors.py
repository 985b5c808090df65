"""Streaming extension: parsed log lines and windowed actor metrics. Batch semantics are not claimed for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.url import add_features
from wardline.sources.logs import PATTERNS, parse_json, parse_line


def stream_events(spark: SparkSession, folder: str, fmt: str = "nginx", late: str = "10 minutes") -> DataFrame:
    """Events of new files in a folder of logs, with features and a watermark."""
    lines = spark.readStream.text(folder)
    parsed = lines.select((parse_line(F.col("value"), fmt) if fmt in PATTERNS else parse_json(F.col("value"))).alias("e")).filter("e is not null")
    return add_features(parsed.select("e.*")).withWatermark("timestamp", late)


def windowed_metrics(events: DataFrame, width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Requests, approximate distinct URLs, entropy and suspicious requests of each actor and window."""
    return events.groupBy(F.window("timestamp", width, slide or width), "source_ip").agg(
        F.count("*").alias("requests"), F.approx_count_distinct("url").alias("urls"), F.avg("entropy").alias("avg_entropy"), F.count_if("is_suspicious").alias("suspicious"),
    )


def sessions(events: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """Sessions of each actor: requests that follow within ``gap``."""
    return events.groupBy(F.session_window("timestamp", gap), "source_ip").agg(F.count("*").alias("requests"))
