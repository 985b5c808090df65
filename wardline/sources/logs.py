"""Access logs as event tables.

One canonical schema: event_ord, timestamp, source_ip, url, url_normalized, method, status_code, user_agent, referer. Lines
that can't be parsed are counted apart and never stop a scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.url import normalize_url

_TAIL = r' \[([^\]]+)\] "(\S+) (\S+) \S+" (\d+) \d+ "([^"]*)" "([^"]*)"'
PATTERNS = {"nginx": r"^(\S+) - \S+" + _TAIL, "apache": r"^(\S+) \S+ \S+" + _TAIL}
REQUIRED = ("source_ip", "timestamp", "http_method", "url_raw", "status_code", "user_agent")
_BYTE = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"
COLUMNS = ("event_ord", "timestamp", "source_ip", "url", "url_normalized", "method", "status_code", "user_agent", "referer")


def is_ipv4(ip: Column) -> Column:
    return F.coalesce(ip.rlike(IPV4), F.lit(False))


def parse_line(line: Column, fmt: str) -> Column:
    """A struct of one nginx or Apache line, null where the line or its time doesn't fit."""
    text, pattern = F.trim(line), PATTERNS[fmt]
    part = lambda k: F.regexp_extract(text, pattern, k)
    at = F.try_to_timestamp(part(2), F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
    fits = text.rlike(pattern) & is_ipv4(part(1)) & at.isNotNull()
    return F.when(fits, F.struct(
        at.alias("timestamp"), part(1).alias("source_ip"), part(4).alias("url"), normalize_url(part(4)).alias("url_normalized"),
        part(3).alias("method"), part(5).try_cast("int").alias("status_code"), part(7).alias("user_agent"), part(6).alias("referer"),
    ))


def parse_json(line: Column) -> Column:
    """A struct of one JSON line: all required keys present, an IPv4 source, time as ISO text (UTC if it has no zone) or epoch seconds."""
    text = F.trim(line)
    keys = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    get = lambda k: F.get_json_object(text, f"$.{k}")
    at = F.coalesce(F.timestamp_micros((get("timestamp").try_cast("double") * 1000000).cast("long")), get("timestamp").try_cast("timestamp"))
    fits = F.coalesce(F.size(F.array_except(F.array(*(F.lit(k) for k in REQUIRED)), keys)) == 0, F.lit(False)) & is_ipv4(get("source_ip")) & at.isNotNull() & get("status_code").try_cast("int").isNotNull()
    return F.when(fits, F.struct(
        at.alias("timestamp"), get("source_ip").alias("source_ip"), get("url_raw").alias("url"), normalize_url(get("url_raw")).alias("url_normalized"),
        get("http_method").alias("method"), get("status_code").try_cast("int").alias("status_code"), get("user_agent").alias("user_agent"), F.lit(None).cast("string").alias("referer"),
    ))


def parse_logs(lines: DataFrame, fmt: str = "nginx") -> tuple[DataFrame, DataFrame]:
    """Events and rejected lines of a table (event_ord, value)."""
    if fmt not in (*PATTERNS, "json"):
        raise ValueError(f"unknown log format: {fmt}")
    parsed = lines.withColumn("e", parse_json(F.col("value")) if fmt == "json" else parse_line(F.col("value"), fmt))
    events = parsed.filter("e is not null").select("event_ord", "e.*").select(*COLUMNS)
    return events, parsed.filter("e is null").select("event_ord", "value")


def read_logs(spark: SparkSession, path: str, fmt: str = "nginx", max_events: int | None = None) -> DataFrame:
    """Events of a log file or folder; a missing path raises. event_ord is the order of lines within a file."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("event_ord"), "value")
    events = parse_logs(lines, fmt)[0]
    return events if max_events is None else events.orderBy("event_ord").limit(max_events)


def read_configured(spark: SparkSession, config: dict) -> DataFrame:
    """Reads what a configuration names; both spellings of its keys are known."""
    own = config.get("ingestion", config)
    return read_logs(spark, own.get("log_path") or own.get("input_file"), own.get("format") or own.get("log_format") or "nginx", own.get("max_events"))


def load_config(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}
