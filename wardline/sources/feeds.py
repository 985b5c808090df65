"""Indicator feeds: small tables of patterns, refreshed on the driver when they are older than their time to live."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEED_TYPES = ("user_agent", "url_path", "ip_address", "url_pattern")
SCHEMA = "feed_ord int, feed string, feed_type string, enabled boolean, pattern string"


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """Distinct patterns of a text file: one a line, blank lines and comments are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("pattern")).filter("pattern <> '' and not startswith(pattern, '#')").distinct()


class FeedRegistry:
    """Feeds in the order of their configuration. A feed is disabled after ``max_errors`` failed reads in a row."""

    def __init__(self, spark: SparkSession, feeds: list[dict], update_interval: float = 3600, max_errors: int = 3):
        self.spark, self.update_interval, self.max_errors = spark, update_interval, max_errors
        self.feeds = [{"enabled": True, "errors": 0, "rows": None} | f for f in feeds]
        self.updated: float | None = None

    def update(self, force: bool = False) -> bool:
        """Reads enabled feeds again unless that was less than update_interval ago; tells whether any was read."""
        if not force and self.updated is not None and time.time() - self.updated < self.update_interval:
            return False
        read = 0
        for f in self.feeds:
            if not f["enabled"]:
                continue
            try:
                f["rows"] = [r["pattern"] for r in read_patterns(self.spark, f["path"]).orderBy("pattern").collect()] if "path" in f else sorted(set(f["patterns"]))
                f["errors"], read = 0, read + 1
            except Exception:  # noqa: BLE001  a feed that can't be read counts as an error of the feed
                f["errors"] += 1
                f["enabled"] = f["errors"] < self.max_errors
        if read:
            self.updated = time.time()
        return read > 0

    def table(self) -> DataFrame:
        rows = [(k, f["name"], f["feed_type"], f["enabled"], p) for k, f in enumerate(self.feeds) for p in f["rows"] or [None]]
        return self.spark.createDataFrame(rows, SCHEMA)
