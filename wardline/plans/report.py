"""Reports as text, JSON and HTML. Only counters and the rows that a report shows reach the driver; whole tables are written by Spark."""

from __future__ import annotations

import html
import json
import logging
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.plans.pipeline import Analysis

log = logging.getLogger(__name__)
HIGH, TOP, LAST = 7.0, 10, 3


def summary(actors: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Actors, campaigns, actors with a score above 7 and actors with tags, in one row."""
    own = actors.agg(F.count("*").alias("total_actors"), F.count_if(F.col("threat_score") > HIGH).alias("high_threat_actors"), F.count_if(F.size("tags") > 0).alias("tagged_actors"))
    return own.crossJoin(campaigns.agg(F.count("*").alias("total_campaigns"))).select("total_actors", "total_campaigns", "high_threat_actors", "tagged_actors")  # one row each


def top_actors(actors: DataFrame, n: int = TOP) -> DataFrame:
    """The highest scores; ties in order of appearance."""
    return actors.orderBy(F.desc("threat_score"), "actor_ord").limit(n)


def last_evidence(trail, n: int):
    return F.slice(trail, F.greatest(F.size(trail) - n + 1, F.lit(1)), F.lit(n))


def actor_documents(actors: DataFrame) -> DataFrame:
    """One JSON document per actor, for writing at any size."""
    metrics = F.struct("total_requests", "unique_urls", "avg_entropy", "anomaly_ratio", "centrality")
    return actors.select(F.to_json(F.struct(F.col("source_ip").alias("ip_address"), "threat_score", "tags", metrics.alias("metrics"), "evidence_trail")).alias("value"))


def campaign_documents(campaigns: DataFrame) -> DataFrame:
    return campaigns.select(F.to_json(F.struct("campaign_id", "threat_score", "campaign_type", "primary_tags", F.col("actors").alias("actor_count"), "evidence_trail")).alias("value"))


def context_entries(context: DataFrame) -> DataFrame:
    """(key, value) of the context row."""
    return context.select(F.explode(F.create_map(*(x for c in context.columns for x in (F.lit(c), F.col(c).cast("string")))))).toDF("key", "value")


def write_reports(a: Analysis, folder: str) -> None:
    """All actors, campaigns and context entries as JSON lines, written by the executors."""
    for name, rows in (("actors", actor_documents(a.actors)), ("campaigns", campaign_documents(a.campaigns)), ("context", context_entries(a.context).select(F.to_json(F.struct("key", "value")).alias("value")))):
        rows.write.mode("overwrite").text(f"{folder}/{name}")


def _shown(a: Analysis) -> dict:
    """What text and HTML show: the top actors with their last evidence, and all campaigns."""
    cut = top_actors(a.actors).select("source_ip", "threat_score", "tags", "total_requests", "unique_urls", "avg_entropy", "anomaly_ratio", last_evidence(F.col("evidence_trail"), LAST).alias("trail"))
    order = F.regexp_extract("campaign_id", r"(\d+)$", 1).try_cast("long")
    return {"summary": summary(a.actors, a.campaigns).first().asDict(), "actors": [r.asDict(True) for r in cut.collect()], "campaigns": [r.asDict(True) for r in a.campaigns.orderBy(order).collect()], "context": {r["key"]: r["value"] for r in context_entries(a.context).collect()}}


def text_report(shown: dict) -> str:
    s, out = shown["summary"], ["THREAT ANALYSIS REPORT", f"Generated: {datetime.now(UTC):%Y-%m-%d %H:%M:%S}", ""]
    out += [f"Total Threat Actors: {s['total_actors']}", f"Total Campaigns: {s['total_campaigns']}", f"High Threat Actors (>7.0): {s['high_threat_actors']}", f"Tagged Actors: {s['tagged_actors']}", ""]
    for i, x in enumerate(shown["actors"], 1):
        out += [f"Actor {i}: {x['source_ip']}", f"Threat Score: {x['threat_score']:.2f}", f"Tags: {', '.join(x['tags']) or 'None'}", f"Requests: {x['total_requests']} | Unique URLs: {x['unique_urls']}", f"Avg Entropy: {x['avg_entropy']:.2f} | Anomaly Ratio: {x['anomaly_ratio']:.2f}"]
        out += [*(f"  - {e['source']}: {e['details']}" for e in x["trail"]), ""]
    if s["total_actors"] > TOP:
        out += [f"... and {s['total_actors'] - TOP} more actors", ""]
    for i, x in enumerate(shown["campaigns"], 1):
        out += [f"Campaign {i}: {x['campaign_id']}", f"Threat Score: {x['threat_score']:.2f}", f"Type: {x['campaign_type']}", f"Primary Tags: {', '.join(x['primary_tags']) or 'None'}", f"Actors: {x['actors']}", *(f"  - {e['source']}: {e['details']}" for e in x["evidence_trail"][-2:]), ""]
    return "\n".join([*out, *(f"{k}: {v}" for k, v in shown["context"].items())])


def json_report(shown: dict) -> str:
    return json.dumps({"metadata": {"generated_at": datetime.now(UTC).isoformat()}, **shown}, indent=2, default=str)


def console_summary(a: Analysis, actors: int = 5) -> str:
    """The evidence of the first actors, by appearance, last three entries each, and of all campaigns, last two."""
    said = lambda trail: [f"    [{e['source']}] {e['details']}" for e in trail]
    first = a.actors.orderBy("actor_ord").limit(actors).select("source_ip", "threat_score", last_evidence(F.col("evidence_trail"), LAST).alias("trail")).collect()
    out = ["EVIDENCE SUMMARY"]
    for r in first:
        out += [f"  Actor {r.source_ip}: score {r.threat_score:.2f}", *said(r.trail)]
    for r in a.campaigns.orderBy("campaign_id").select("campaign_id", "threat_score", last_evidence(F.col("evidence_trail"), 2).alias("trail")).toLocalIterator():
        out += [f"  Campaign {r.campaign_id}: score {r.threat_score:.2f}", *said(r.trail)]
    return "\n".join(out)


def html_report(shown: dict) -> str:
    e = lambda x: html.escape(str(x))
    cards = "".join(f"<div class='card'><b>{e(v)}</b> {e(k.replace('_', ' '))}</div>" for k, v in shown["summary"].items())
    rows = lambda xs, key: "".join(f"<section><h3>{e(x[key])}</h3><p>Score {x['threat_score']:.2f}</p><p>{e(', '.join(x.get('tags') or x.get('primary_tags') or []))}</p><ul>{''.join(f"<li>{e(y['source'])}: {e(y['details'])}</li>" for y in x.get('trail', x.get('evidence_trail', []))[-LAST:])}</ul></section>" for x in xs)
    n = shown["summary"]["total_actors"] - len(shown["actors"])
    more = f"<p>... and {n} more actors</p>" if n else ""
    context = "".join(f"<tr><td>{e(k)}</td><td>{e(v)}</td></tr>" for k, v in shown["context"].items())
    return f"<!DOCTYPE html><html><body><h1>Threat analysis</h1>{cards}<h2>Threat Actors</h2>{rows(shown['actors'], 'source_ip')}{more}<h2>Campaigns</h2>{rows(shown['campaigns'], 'campaign_id')}<h2>Context</h2><table>{context}</table></body></html>"


RENDERERS = {"html": html_report, "json": json_report, "text": text_report}


def whole_json(a: Analysis, shown: dict) -> str:
    """The JSON report: all actors and campaigns with all their evidence, gathered on the driver; ``write_reports`` is the one for large logs."""
    every = lambda rows: [json.loads(r.value) for r in rows.toLocalIterator()]
    order = F.regexp_extract("campaign_id", r"(\d+)$", 1).try_cast("long")
    return json_report({**shown, "actors": every(actor_documents(a.actors.orderBy(F.desc("threat_score"), "actor_ord"))), "campaigns": every(campaign_documents(a.campaigns.orderBy(order)))})


def generate_reports(a: Analysis, formats=("html", "json", "text")) -> dict[str, str]:
    """Reports by format. A format that fails is logged and left out."""
    shown, out = _shown(a), {}
    for f in formats:
        try:
            out[f] = whole_json(a, shown) if f == "json" else RENDERERS[f](shown)
        except Exception:  # noqa: BLE001
            log.exception("report %s failed", f)
    return out
