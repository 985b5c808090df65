import json

from wardline.plans.report import RENDERERS


def test_reports_show_all_campaigns():
    actor = {"source_ip": "192.0.2.1", "threat_score": 9.0, "tags": ["x"], "total_requests": 1, "unique_urls": 1, "avg_entropy": 0.0, "anomaly_ratio": 0.0, "trail": [{"source": "Rule", "details": "a<b"}]}
    campaigns = [{"campaign_id": f"C_{k}", "threat_score": 8.0, "campaign_type": "x", "primary_tags": [], "actors": 3, "evidence_trail": []} for k in range(60)]
    shown = {"summary": {"total_actors": 14, "total_campaigns": 60, "high_threat_actors": 14, "tagged_actors": 14}, "actors": [actor] * 10, "campaigns": campaigns, "context": {}}
    said = {k: f(shown) for k, f in RENDERERS.items()}
    for f in ("text", "html"):
        assert "and 4 more actors" in said[f] and all(f"C_{k}" in said[f] for k in range(60))
    assert "a&lt;b" in said["html"]
    assert len(json.loads(said["json"])["campaigns"]) == 60


def test_json_and_console_have_everything(spark):
    from wardline.plans.queries import _analysis
    from wardline.plans.report import console_summary, generate_reports

    a = _analysis(spark, "/root/testdata/sf0.001", "campaigns")
    n, m = a.actors.count(), a.campaigns.count()
    report = json.loads(generate_reports(a, ("json",))["json"])
    assert len(report["actors"]) == n > 10 and len(report["campaigns"]) == m
    assert all("evidence_trail" in x for x in report["actors"])
    assert sum(x.startswith("  Actor ") for x in console_summary(a).split("\n")) == min(n, 5)
