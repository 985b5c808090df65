"""A web log made from the driver's ``events`` table, in the canonical event schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def weblog(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type")
    user, kind, k = F.col("user_id"), F.col("user_id") % 10, F.col("event_id") % 8
    # Only scanners' rows show their number, so the others are neither shuffled nor sorted.
    scans = kind.eqNullSafe(F.lit(0))
    numbered = e.filter(scans).withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    rows = numbered.unionByName(e.filter(~scans).withColumn("rn", F.lit(None).cast("int")))
    text = lambda c: c.cast("string")
    url = (
        F.when(kind == 0, F.concat(F.lit("/scan/"), text(user % 3), F.lit("/"), text(F.col("rn")), F.lit(".php")))
        .when((kind == 1) & (k < 3), F.concat(F.lit("/index.php?page=../../../etc/passwd&n="), text(k)))
        .when((kind == 2) & (k < 2), F.lit("/login.php?id=1' OR '1'='1"))
        .when((kind == 2) & k.isin(2, 3), F.lit("/search?q=<script>alert(1)</script>"))
        .when((kind == 3) & (k <= 4), F.element_at(F.array(*(F.lit(x) for x in ("/admin", "/login", "/.env", "/wp-admin", "/.git/config"))), (F.least(k, F.lit(4)) + 1).cast("int")))
        .when((kind == 4) & (k == 0), F.lit("/exec?cmd=cat /etc/shadow"))
        .otherwise(F.concat(F.lit("/g"), text(user % 25), F.lit("/"), F.col("event_type"), F.lit("?k="), text(k)))
    )
    agent = F.when(kind == 0, "python-requests/2.31").when(kind == 1, "sqlmap/1.7").when(kind == 2, "Mozilla/5.0 (X11)").when(kind == 9, F.lit(None).cast("string")).otherwise(F.concat(F.lit("Mozilla/5.0 (u"), text(user % 25), F.lit(")")))
    steady = F.timestamp_micros(F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("rn").cast("long") * 60_000_000)
    return rows.select(
        F.col("event_id").alias("event_ord"), F.when(kind == 0, steady).otherwise(F.col("ts").cast("timestamp")).alias("timestamp"),
        F.concat(F.lit("10.0."), text(F.floor(user / 256)), F.lit("."), text(user % 256)).alias("source_ip"), url.alias("url"),
        F.when(F.col("event_type") == "purchase", "POST").otherwise("GET").alias("method"), F.when(F.col("event_type") == "error", 500).when(k == 7, 404).otherwise(200).alias("status_code"), agent.alias("user_agent"),
    )


def as_address(source: Column) -> Column:
    """The IPv4 address of a source of the web log: the third number of a name grows with the user, beyond 255 it carries into the second and the first."""
    third, text = F.split_part(source, F.lit("."), F.lit(3)).cast("long"), lambda c: c.cast("string")
    return F.concat(text(10 + F.floor(third / 65536)), F.lit("."), text(F.floor(third / 256) % 256), F.lit("."), text(third % 256), F.lit("."), F.split_part(source, F.lit("."), F.lit(4)))


def as_source(address: Column) -> Column:
    """The web log's name of an address that ``as_address`` made."""
    first, second, third = (F.split_part(address, F.lit("."), F.lit(k)).cast("long") for k in (1, 2, 3))
    return F.concat(F.lit("10.0."), (((first - 10) * 256 + second) * 256 + third).cast("string"), F.lit("."), F.split_part(address, F.lit("."), F.lit(4)))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The web log as nginx lines (event_ord, value) with valid addresses, every 50th spoilt; URLs are cut at their first blank."""
    w = weblog(spark, sf_dir)
    when = F.date_format("timestamp", "dd/MMM/yyyy:HH:mm:ss")
    line = F.concat(as_address(F.col("source_ip")), F.lit(" - - ["), when, F.lit(' +0000] "'), F.col("method"), F.lit(" "), F.split_part("url", F.lit(" "), F.lit(1)), F.lit(' HTTP/1.1" '), F.col("status_code"), F.lit(' 123 "-" "'), F.coalesce("user_agent", F.lit("")), F.lit('"'))
    return w.select("event_ord", F.when(F.col("event_ord") % 50 == 49, F.concat(F.lit("x"), line)).otherwise(line).alias("value"))
