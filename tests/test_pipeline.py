import json

from wardline.plans import report
from wardline.plans.pipeline import STAGES, analyse
from wardline.plans.weblog import log_lines, weblog
from wardline.streaming.actors import sessions, stream_events, windowed_metrics

SF = "/root/testdata/sf0.001"


def test_whole_analysis_and_reports(spark, tmp_path):
    a = analyse(weblog(spark, SF))
    actors = a.actors.collect()
    assert len(actors) == 15 and all(r.tags == sorted(set(r.tags)) for r in actors) and any("COMMAND_INJECTION" in r.tags for r in actors)
    shown = report.generate_reports(a)
    assert set(shown) == {"html", "json", "text"} and json.loads(shown["json"])["summary"]["total_actors"] == 15 and "and 5 more actors" in shown["text"]
    assert report.generate_reports(a, formats=("pdf", "text")).keys() == {"text"}
    report.write_reports(a, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/actors").count() == 15 and spark.read.json(f"{tmp_path}/context").count() > 5


def test_strict_switches_and_own_stages(spark):
    strict = analyse(weblog(spark, SF), {"heuristic_tags": False, "aliases": False, "extended_context": False}, until="score")
    assert not any("XSS" in r.tags for r in strict.actors.select("tags").collect()) and "prevalence" not in strict.summaries["fft"].columns
    seen = []
    analyse(weblog(spark, SF), stages={"one": lambda a, o: (seen.append(1), a)[1], **{"enrich": STAGES["enrich"]}}, until="one")
    assert seen == [1]


def test_stream(spark, tmp_path):
    log_lines(spark, SF).select("value").coalesce(1).write.text(f"{tmp_path}/logs")
    events = stream_events(spark, f"{tmp_path}/logs")
    for name, rows in (("windows", windowed_metrics(events)), ("sessions", sessions(events))):
        q = rows.writeStream.format("memory").queryName(name).outputMode("complete" if name == "windows" else "append").option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
    assert spark.sql("SELECT sum(requests) FROM windows").first()[0] == 980


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["source_ip", "actor_ord", "threat_score", "tags"]
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= 40


def test_log_lines_of_users_beyond_two_bytes(spark, tmp_path):
    """The third number of a source's name passes 255 at 65,536 users; its line has a valid address nonetheless and is not rejected."""
    from wardline.plans import queries

    users = (0, 65_535, 65_536, 89_999, 16_777_216, 20_000_000)
    rows = ",".join(f"({k}L, timestamp'2024-01-01 00:00:{k:02d}', {u}L, 'view')" for k, u in enumerate(users))
    spark.sql(f"SELECT * FROM VALUES {rows} AS t(event_id, ts, user_id, event_type)").write.parquet(f"{tmp_path}/events.parquet")
    assert queries.rejected_lines(spark, str(tmp_path)).count() == 0
    assert {r.source_ip for r in queries.parsed_log(spark, str(tmp_path)).collect()} == {f"10.0.{u // 256}.{u % 256}" for u in users}


def test_vectors_are_made_once(spark):
    """Leaders and density clusters read the vectors several times; the log itself isn't read again at the end."""
    from wardline.plans import queries

    assert "parquet" not in queries.leader_clusters(spark, SF)._jdf.queryExecution().executedPlan().toString().lower()
