"""Actors: one row per source address."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.trail import NO_EVIDENCE, NO_TAGS

DIMENSIONS = 50


def actor_metrics(events: DataFrame, min_events: int = 1) -> DataFrame:
    """Counts, exact URL diversity, entropy and time span of each source_ip, in one aggregation.

    actor_ord is the order of first appearance.
    """
    out = events.groupBy("source_ip").agg(
        F.min("event_ord").alias("actor_ord"), F.count("*").alias("total_requests"), F.count_distinct("url").alias("unique_urls"),
        F.coalesce(F.avg("entropy"), F.lit(0.0)).alias("avg_entropy"), F.coalesce(F.max("entropy"), F.lit(0.0)).alias("max_entropy"),
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
    )
    ratio = F.coalesce(F.try_divide("unique_urls", "total_requests"), F.lit(0.0))
    return out.withColumn("url_diversity_ratio", ratio).filter(F.col("total_requests") >= min_events)


def as_actors(metrics: DataFrame) -> DataFrame:
    """Metrics with the columns that detectors write."""
    return metrics.withColumns({"anomaly_ratio": F.lit(0.0), "centrality": F.lit(0.0), "threat_score": F.lit(0.0), "tags": F.expr(NO_TAGS), "evidence_trail": F.expr(NO_EVIDENCE)})


def url_frequencies(events: DataFrame) -> DataFrame:
    """(source_ip, url, n, frequency) of each actor's URLs."""
    counts = events.groupBy("source_ip", "url").agg(F.count("*").alias("n"))
    totals = counts.groupBy("source_ip").agg(F.sum("n").alias("total"))
    return counts.join(totals, "source_ip").select("source_ip", "url", "n", (F.col("n") / F.col("total")).alias("frequency"))


def url_frequency_map(events: DataFrame) -> DataFrame:
    return url_frequencies(events).groupBy("source_ip").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("url", "frequency")))).alias("url_frequency_vector"))


def behavior_vectors(events: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(source_ip, vector): the largest URL frequencies, descending, padded with zeros, of sum 1.

    Counts are reduced to (count, how many URLs have it) first, so an actor with very many URLs ships few rows.
    """
    counts = events.groupBy("source_ip", "url").agg(F.count("*").alias("n"))
    ranks = counts.groupBy("source_ip", "n").agg(F.count("*").alias("times"))
    tops = ranks.groupBy("source_ip").agg(F.sort_array(F.collect_list(F.struct("n", "times")), False).alias("r"))
    spread = F.slice(F.flatten(F.transform("r", lambda x: F.array_repeat(x["n"].cast("double"), F.least(x["times"], F.lit(dimensions)).cast("int")))), 1, dimensions)
    padded = F.concat(spread, F.array_repeat(F.lit(0.0), F.lit(dimensions) - F.size(spread)))
    total = F.aggregate(spread, F.lit(0.0), lambda a, x: a + x)
    return tops.select("source_ip", F.transform(padded, lambda x: F.when(total > 0, x / total).otherwise(x)).alias("vector"))


def distribution(events: DataFrame, column: str) -> DataFrame:
    """(source_ip, column, n)."""
    return events.groupBy("source_ip", column).agg(F.count("*").alias("n"))


def actor_signatures(events: DataFrame) -> DataFrame:
    """Rate, span and diversity of each actor; a missing user agent is a value of its own."""
    out = events.groupBy("source_ip").agg(
        F.count("*").alias("total_urls_count"), F.count_distinct("url_normalized").alias("unique_urls_count"),
        ((F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))) / 1e6).alias("time_span_seconds"),
        (F.count_distinct("user_agent") + F.max(F.col("user_agent").isNull().cast("int"))).alias("unique_user_agents"),
    )
    return out.withColumns({
        "avg_events_per_second": F.col("total_urls_count") / F.greatest("time_span_seconds", F.lit(1.0)),
        "url_diversity_ratio": F.col("unique_urls_count") / F.col("total_urls_count"),
        "user_agent_diversity": F.col("unique_user_agents") / F.col("total_urls_count"),
    })


def signature_maps(events: DataFrame) -> DataFrame:
    """Signatures with method and status distributions as maps."""
    out = actor_signatures(events)
    for column, name in (("method", "method_distribution"), ("status_code", "status_distribution")):
        maps = distribution(events.filter(F.col(column).isNotNull()), column).groupBy("source_ip").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(name))
        out = out.join(maps, "source_ip", "left")
    return out


def heuristic_tags(actors: DataFrame, events: DataFrame) -> DataFrame:
    """Gives actors the attack flags of their events as tags, each with one evidence entry."""
    from wardline.functions.url import ATTACK_FLAGS

    flags = events.select("source_ip", F.explode(F.array_intersect("heuristic_flags", F.array(*(F.lit(f) for f in ATTACK_FLAGS)))).alias("flag"))
    seen = flags.groupBy("source_ip").agg(F.array_sort(F.collect_set("flag")).alias("own"))
    entries = F.transform("own", lambda f: F.struct(F.lit("HeuristicEnricher").alias("source"), F.lit("tag_added").alias("type"), F.concat(F.lit("Added tag: "), f).alias("details"), F.lit(1.0).alias("confidence")))
    out = actors.join(seen, "source_ip", "left")
    return out.withColumns({
        "tags": F.when(F.col("own").isNotNull(), F.array_sort(F.array_union("tags", "own"))).otherwise(F.col("tags")),
        "evidence_trail": F.when(F.col("own").isNotNull(), F.concat("evidence_trail", entries)).otherwise(F.col("evidence_trail")),
    }).drop("own")
