import itertools
import math
import random
from collections import defaultdict, deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wardline.functions.trail import checkpoint
from wardline.functions.url import add_features
from wardline.operators import anomaly, cadence, clusters, graph, intelligence, meta, profile, recommend, rules

START = datetime(2024, 1, 1)


def events(spark, rows):
    """rows: (ip, seconds, url, agent)."""
    made = [(i, START + timedelta(seconds=s), ip, url, "GET", 200, agent) for i, (ip, s, url, agent) in enumerate(rows)]
    return add_features(spark.createDataFrame(made, "event_ord long, timestamp timestamp, source_ip string, url string, method string, status_code int, user_agent string"))


def actors_of(e):
    return profile.as_actors(profile.actor_metrics(e))


def test_metrics_vector_and_signatures(spark):
    e = events(spark, [("a", k, u, "x" if k else None) for k, u in enumerate(["/admin", "/admin", "/admin", "/login", "/test"])] + [("b", 9, "/z", None)])
    m = {r.source_ip: r for r in profile.actor_metrics(e).collect()}
    assert (m["a"].total_requests, m["a"].unique_urls, m["a"].url_diversity_ratio, m["a"].actor_ord, m["b"].actor_ord) == (5, 3, 0.6, 0, 5)
    v = {r.source_ip: r.vector for r in profile.behavior_vectors(e).collect()}
    assert len(v["a"]) == 50 and v["a"][:3] == [0.6, 0.2, 0.2] and sum(v["a"]) == pytest.approx(1) and v["b"] == [1.0] + [0.0] * 49
    s = {r.source_ip: r for r in profile.signature_maps(e.withColumn("url_normalized", F.col("url"))).collect()}
    assert s["a"].method_distribution == {"GET": 5} and s["a"].status_distribution == {200: 5} and s["a"].unique_user_agents == 2 and s["a"].avg_events_per_second == 5 / 4 and s["b"].avg_events_per_second == 1
    assert {r.source_ip: r.url_frequency_vector for r in profile.url_frequency_map(e).collect()}["a"] == {"/admin": 0.6, "/login": 0.2, "/test": 0.2}


def test_cadence(spark):
    e = events(spark, [("rhythm", 60 * k, f"/p{k}", None) for k in range(15)] + [("hand", 15 * k, u, None) for k, u in enumerate(["/admin", "/login", "/wp-admin", "/phpmyadmin", "/config"])]
               + [("few", k, f"/test{k}", None) for k in range(5)] + [("both", 60 * k, "/admin", None) for k in range(12)] + [("uneven", k * k * 30, f"/x{k}", None) for k in range(12)])
    tagged, summary = cadence.detect(actors_of(e), e, extended=True)
    tags = {r.source_ip: r.tags for r in tagged.collect()}
    assert tags == {"rhythm": ["AUTOMATED_SCAN"], "hand": ["MANUAL_SCAN"], "few": [], "both": ["AUTOMATED_SCAN"], "uneven": []}
    assert summary.first().asDict() == {"total_actors": 5, "total_rhythmic_actors": 2, "total_manual_actors": 1, "prevalence": 0.4, "is_rhythmic": True}
    trail = tagged.filter("source_ip = 'rhythm'").first().evidence_trail
    assert [(x.type, x.confidence) for x in trail] == [("tag_added", 1.0), ("rhythmic_pattern", 0.9)] and trail[1].details == "Near-constant request interval (cv=0.000)"


def brandes(nodes, links):
    """Betweenness of an undirected graph, normalised over ordered pairs."""
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        order, before, sigma, dist, queue = [], defaultdict(list), defaultdict(float, {s: 1.0}), {s: 0}, deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
                    before[w].append(v)
        delta = defaultdict(float)
        for w in reversed(order):
            for v in before[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                score[w] += delta[w]
    n = len(nodes)
    return {v: x / ((n - 1) * (n - 2)) if n > 2 else 0.0 for v, x in score.items()}


def test_graph_metrics_against_plain_algorithms(spark, monkeypatch):
    monkeypatch.setattr(graph, "SOURCES_PER_TASK", 5)
    rnd = random.Random(1)
    names = [f"n{k:02d}" for k in range(26)]
    links = sorted({tuple(sorted(rnd.sample(names[:12], 2))) for _ in range(22)} | {tuple(sorted(rnd.sample(names[12:22], 2))) for _ in range(12)})
    nodes, edges = spark.createDataFrame([(x,) for x in names], "source_ip string"), spark.createDataFrame(links, "src string, dst string")
    got, want = {r.source_ip: r for r in graph.graph_metrics(nodes, edges).collect()}, brandes(names, links)
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    for x in names:
        pairs = list(itertools.combinations(sorted(near[x]), 2))
        assert got[x].centrality == pytest.approx(want[x], abs=1e-12) and got[x].clustering == pytest.approx(sum(b in near[a] for a, b in pairs) / len(pairs) if pairs else 0.0)


def test_similarity_by_all_pairs(spark):
    rnd = random.Random(2)
    rows = [(f"10.0.0.{k}", s, f"/u{rnd.randrange(6)}", rnd.choice([None, "", "x", "y"])) for k in range(9) for s in range(rnd.randrange(1, 6))]
    e = events(spark, rows)
    urls, agents = defaultdict(set), defaultdict(set)
    for ip, _, u, a in rows:
        urls[ip].add(u)
        agents[ip] |= {a} if a else set()
    for threshold in (0.3, 0.1):
        want = {}
        for a, b in itertools.combinations(sorted(urls), 2):
            x = 0.7 * len(urls[a] & urls[b]) / len(urls[a] | urls[b]) + (0.3 * len(agents[a] & agents[b]) / len(agents[a] | agents[b]) if agents[a] and agents[b] else 0.0)
            if x > threshold:
                want[a, b] = x
        got = {(r.src, r.dst): r.weight for r in graph.similarity_edges(e, threshold).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)


def test_graph_detector_and_single_actor(spark):
    trio = events(spark, [(ip, k, f"/admin/test{k}", "agent") for ip in "abc" for k in range(5)])
    tagged, summary = graph.detect(actors_of(trio), trio)
    assert summary.first().total_actors == 3 and {tuple(r.tags) for r in tagged.collect()} == {("CLUSTER_MEMBER",)}
    one = events(spark, [("a", 0, "/x", None)])
    assert graph.detect(actors_of(one), one)[1] is None and anomaly.detect(actors_of(one))[1] is None and clusters.detect(actors_of(one), profile.behavior_vectors(one))[1] is None


def actor_rows(spark, rows, **more):
    """rows: dicts with ip and any of the actor's columns."""
    base = {"avg_entropy": 3.0, "url_diversity_ratio": 0.5, "centrality": 0.3, "anomaly_ratio": 0.4, "total_requests": 10, "threat_score": 0.0, "tags": [], "evidence_trail": []}
    made = [tuple({**base, "source_ip": f"ip{k}", "actor_ord": k, **r}[c] for c in ("source_ip", "actor_ord", "avg_entropy", "url_diversity_ratio", "centrality", "anomaly_ratio", "total_requests", "threat_score", "tags", "evidence_trail")) for k, r in enumerate(rows)]
    return spark.createDataFrame(made, "source_ip string, actor_ord long, avg_entropy double, url_diversity_ratio double, centrality double, anomaly_ratio double, total_requests long, threat_score double, tags array<string>, evidence_trail array<struct<source:string,type:string,details:string,confidence:double>>")


def test_anomalies(spark):
    crowd = [{"avg_entropy": 3 + 0.1 * i, "url_diversity_ratio": 0.5 + 0.05 * i, "total_requests": 10 + i, "centrality": 0.3 + 0.05 * i, "anomaly_ratio": 0.0} for i in range(5)]
    rows, summary = anomaly.detect(actor_rows(spark, [*crowd, {"avg_entropy": 6.0, "url_diversity_ratio": 0.9, "total_requests": 100, "centrality": 0.8, "anomaly_ratio": 0.8}, {"avg_entropy": 4.0, "url_diversity_ratio": 0.7, "total_requests": 50, "centrality": 0.5, "anomaly_ratio": 0.6}]))
    got = {r.source_ip: r for r in rows.collect()}
    assert got["ip5"].tags == ["ANOMALOUS"] and got["ip6"].tags == ["SUSPICIOUS"] and got["ip5"].anomaly_ratio >= 0.8 and summary.first().anomalies == 1
    same, _ = anomaly.detect(actor_rows(spark, [{"anomaly_ratio": 0.0}] * 3))
    assert {r.anomaly_ratio for r in same.collect()} == {0.0}


def vectors(spark, points):
    return spark.createDataFrame([(f"ip{k}", [float(x) for x in p]) for k, p in enumerate(points)], "source_ip string, vector array<double>")


def test_leaders_and_density_by_plain_algorithms(spark):
    rnd = random.Random(3)
    for trial in range(3):
        points = []
        for _ in range(25):
            p = sorted((rnd.random() ** 3 for _ in range(4)), reverse=True)
            points.append([0.0] * 4 if rnd.random() < 0.08 else [round(x / sum(p), 2) for x in p] if rnd.random() < 0.8 or not points else points[-1])
        v = vectors(spark, points)
        order = actor_rows(spark, [{} for _ in points])
        usable = [k for k, p in enumerate(points) if sum(p) > 0]
        dot = lambda a, b: sum(x * y for x, y in zip(points[a], points[b], strict=True))
        led = {}
        for i in usable:
            if i not in led:
                for j in usable:
                    if j >= i and j not in led and (i == j or dot(i, j) / math.sqrt(dot(i, i) * dot(j, j)) >= 0.9):
                        led[j] = i
        assert {r.source_ip: r.leader for r in clusters.leader_clusters(v, order, 0.9).collect()} == {f"ip{j}": i for j, i in led.items()}
        n, columns = len(usable), list(zip(*(points[k] for k in usable), strict=True))
        mean = [sum(c) / n for c in columns]
        std = [math.sqrt(sum((x - m) ** 2 for x in c) / n) or 1 for c, m in zip(columns, mean, strict=True)]
        z = {k: [(x - m) / s for x, m, s in zip(points[k], mean, std, strict=True)] for k in usable}
        near = {a: [b for b in usable if math.dist(z[a], z[b]) <= 0.5] for a in usable}
        label, number = {}, 0
        for k in usable:
            if k in label or len(near[k]) < 2:
                continue
            queue = [k]
            while queue:
                x = queue.pop()
                if x not in label:
                    label[x] = number
                    queue += near[x] if len(near[x]) >= 2 else []
            number += 1
        assert {r.source_ip: r.cluster for r in clusters.density_clusters(v, order).collect()} == {f"ip{k}": label.get(k, -1) for k in usable}, trial


def test_campaigns(spark):
    points = [[0.5, 0.5], [0.5, 0.5], [0.5, 0.5], [0.9, 0.1], [0.9, 0.1], [1.0, 0.0]]
    actors = actor_rows(spark, [{"tags": ["A", "B"], "threat_score": 3.0}, {"tags": ["B"], "threat_score": 6.0}, {}, {}, {}, {}])
    tagged, members = clusters.campaigns(actors, vectors(spark, points), eps=0.1)
    tags = {r.source_ip: r.tags for r in tagged.collect()}
    assert tags["ip0"] == ["A", "B", "COORDINATED_ATTACK"] and tags["ip3"] == ["PAIRED_ATTACK"] and tags["ip5"] == ["ISOLATED_ATTACKER"]
    out = {r.campaign_id: r for r in clusters.campaign_rollup(tagged, members).collect()}
    assert out["campaign_0"].actors == 3 and out["campaign_0"].threat_score == 3.0 and out["campaign_0"].campaign_type == "COORDINATED_ATTACK" and out["campaign_1"].campaign_type == "PAIRED_ATTACK"
    assert clusters.campaigns(actors.limit(1), vectors(spark, points[:1]))[1].count() == 0


OWN = {"LFI_RFI": (8.0, (("high_entropy", None, 1.3, "e"), ("coordinated_attack", None, 1.5, "e"))), "AUTOMATED_SCAN": (4.0, (("fft_is_rhythmic", None, 1.5, "e"),)), "COORDINATOR": (5.0, (("high_centrality", 0.5, 1.4, "e"),)), "ANOMALOUS": (5.5, (("anomalous_behavior", None, 1.3, "e"),))}
COMBOS = {("LFI_RFI", "COORDINATED_ATTACK"): (1.8, "c"), ("AUTOMATED_SCAN", "COORDINATOR"): (1.4, "c")}


@pytest.mark.parametrize(("actor", "summaries", "want", "kinds"), [
    ({"tags": ["LFI_RFI"]}, {}, 8.0, []), ({"tags": ["LFI_RFI"], "avg_entropy": 5.0}, {}, 10.4, ["modifier_applied"]), ({"tags": ["COORDINATED_ATTACK", "LFI_RFI"]}, {}, 14.4, ["combination_detected"]),
    ({"tags": ["LFI_RFI", "SQL_INJECTION"]}, {}, 12.0, []), ({"tags": ["COORDINATOR", "LFI_RFI"]}, {}, 23.4, []), ({"tags": ["AUTOMATED_SCAN"]}, {"fft": "0.6D AS prevalence"}, 4.8, ["contextual_modifier"]),
    ({"tags": ["LFI_RFI"]}, {"fft": "150 AS total_actors", "graph": "8 AS coordinators"}, 12.48, ["global_modifier", "global_modifier"]), ({}, {}, 0.0, []),
    ({"tags": ["COORDINATOR"], "centrality": 0.8}, {}, 7.0, ["modifier_applied"]), ({"tags": ["ANOMALOUS"], "anomaly_ratio": 0.8}, {}, 7.15, ["modifier_applied"]),
])
def test_scores(spark, actor, summaries, want, kinds):
    rows = actor_rows(spark, [actor])
    made = {k: spark.range(1).selectExpr(v) for k, v in summaries.items()}
    context = rules.context_row(rows, coordinated_attack=False, **made)
    r = rules.score(rows, context, OWN, COMBOS).first()
    assert r.threat_score == pytest.approx(want) and [e.type for e in r.evidence_trail] == [*kinds, "threat_score_calculated"]


def test_rules_from_configuration():
    config = {"scoring_engine": {"scoring_profiles": {"X": {"base_score": 2, "modifiers": [{"if": "high_entropy", "value": 1.5}]}}, "tag_combinations": {"X+Y": {"multiplier": 3}}}}
    assert rules.rules_of(config) == ({"X": (2.0, (("high_entropy", None, 1.5, "Applied X modifier: 1.5"),))}, {("X", "Y"): (3.0, "Detected tag combination: X+Y")})


def test_cross_validation(spark):
    say = lambda *xs: [(s, "t", d, c) for s, d, c in xs]
    rows = actor_rows(spark, [
        {"evidence_trail": say(("FFTDetector", "x", 0.9), ("AnomalyDetector", "Normal day", 0.5))}, {"evidence_trail": say(("GraphDetector", "low centrality", 0.3), ("AnomalyDetector", "x", 0.9))},
        {"tags": ["SQL_INJECTION", "XSS"], "evidence_trail": say(("HeuristicEnricher", "x", 1.0), ("HeuristicEnricher", "x", 0.1))}, {"tags": ["XSS"], "evidence_trail": say(("HeuristicEnricher", "x", 1.0))},
        {"tags": ["AUTOMATED_SCAN"], "evidence_trail": say(("FFTDetector", "No rhythmic pattern", 0.1))}, {"tags": ["XSS"]},
    ])
    out = {r.source_ip: (set(r.tags), [round(e.confidence, 6) for e in r.evidence_trail]) for r in meta.detect(rows, aliases=True).collect()}
    assert out["ip0"] == ({"CONFIRMED_BOTNET", "FALSE_POSITIVE"}, [1.0, 0.1, 0.9, 0.8])
    assert out["ip1"] == ({"CONFIRMED_COORDINATED", "FALSE_POSITIVE"}, [0.1, 0.6, 0.9, 0.8])
    assert out["ip2"] == ({"SQL_INJECTION", "XSS", "CONFIRMED_SOPHISTICATED"}, [1.0, 0.3, 0.9]) and out["ip3"] == ({"XSS", "ISOLATED_INDICATOR"}, [0.7, 0.8])
    assert out["ip4"] == ({"AUTOMATED_SCAN", "INCONSISTENT_TIMING"}, [0.0, 0.8]) and out["ip5"] == ({"XSS"}, [])


def test_techniques_indicators_and_advice(spark):
    rows = actor_rows(spark, [{"tags": ["AUTOMATED_SCAN", "CONFIRMED_BOTNET", "SQL_INJECTION"], "threat_score": 9.0}, {"tags": ["NONE"]}, {"tags": ["ISOLATED_INDICATOR"]}])
    found = intelligence.techniques_for(rows, "source_ip", aliases=True)
    assert {(r.source_ip, r.technique_id) for r in found.collect()} == {("ip0", t) for t in ("T1595", "T1071.001", "T1071.002", "T1190")} | {("ip2", "T1595")}
    assert spark.range(1).select(intelligence.reference(F.lit("T1105")), intelligence.reference(F.lit("T1"))).first()[:] == ("T1105 - Ingress Tool Transfer (Lateral Movement)", "T1")
    feeds = spark.createDataFrame([(0, "one", "ip_address", True, "1.2.3.4"), (1, "two", "ip_address", True, "1.2"), (2, "off", "ip_address", False, "9")], "feed_ord int, feed string, feed_type string, enabled boolean, pattern string")
    hits = {r.value: (r.feed, r.pattern, r.confidence) for r in intelligence.ioc_matches(spark.createDataFrame([("11.2.3.40",), ("1.2.9.9",), (None,), ("9.9.9.9",)], "value string"), feeds, "ip_address").collect()}
    assert hits == {"11.2.3.40": ("one", "1.2.3.4", 0.95), "1.2.9.9": ("two", "1.2", 0.95)}
    none = spark.createDataFrame([("campaign_1", 2, ["COORDINATED_ATTACK", "LFI_ATTACK"])], "campaign_id string, actors long, primary_tags array<string>")
    advice = recommend.recommendations(rows, none, aliases=True)
    assert [(r.subject, r.priority) for r in recommend.in_order(advice).collect()] == [("ip0", "HIGH"), ("campaign_1", "HIGH"), ("ip2", "LOW")]
    assert recommend.recommendation_summary(advice).first().asDict() == {"total_recommendations": 3, "high_priority": 2, "medium_priority": 0, "low_priority": 1, "immediate_actions": 2, "investigations": 0, "monitoring": 1}


def test_twins_are_one_node(spark, monkeypatch):
    """Actors with equal sets are worked on as one: few edges between classes, and the same edges and metrics as by plain algorithms."""
    monkeypatch.setattr(graph, "NUMBERS", 8)
    rnd = random.Random(5)
    kinds = [([f"/u{x}" for x in rnd.sample(range(9), rnd.randrange(1, 5))], rnd.choice([[], ["x"], ["x", "y"]])) for _ in range(12)] + [(["/alone"], []), ([None, "/u1"], ["x"])]
    sets = {f"10.0.{c}.{k}": kind for k, kind in enumerate(kinds) for c in range(rnd.randrange(1, 7))}
    rows = [(ip, s, u, a) for ip, (us, agents) in sets.items() for s, u in enumerate(us) for a in agents or [None]]
    e = events(spark, rows)

    def weight(x, y):
        known = {u for u in x[0] if u} & {u for u in y[0] if u}
        return 0.7 * len(known) / (len(x[0]) + len(y[0]) - len(known)) + (0.3 * len({*x[1]} & {*y[1]}) / len({*x[1], *y[1]}) if x[1] and y[1] else 0.0)

    for threshold in (0.3, 0.1, 0.8):
        want = {(a, b): weight(sets[a], sets[b]) for a, b in itertools.combinations(sorted(sets), 2)}
        want = {k: w for k, w in want.items() if w > threshold}
        got = {(r.src, r.dst): r.weight for r in graph.similarity_edges(e, threshold).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got), threshold
        members, classes, edges = graph.twin_graph(e, threshold)
        assert classes.agg(F.sum("twins")).first()[0] == len(sets)
        if threshold == 0.3:
            singles = sum(None in us for us, _ in sets.values())
            assert classes.count() <= 13 + singles and edges.count() < len(want) / 3
        found = {r.source_ip: r for r in graph.for_all(members, graph.graph_metrics(classes, edges)).collect()}
        triangles = {r.source_ip: r.triangles for r in graph.for_all(members, graph.clustering_coefficients(classes, edges)).collect()}
        central, near = brandes(sets, want), defaultdict(set)
        for a, b in want:
            near[a].add(b)
            near[b].add(a)
        for x in sets:
            linked = sum(b in near[a] for a, b in itertools.combinations(near[x], 2))
            n = len(near[x])
            assert (found[x].degree, triangles[x]) == (n, linked) and found[x].clustering == pytest.approx(2 * linked / (n * (n - 1)) if n > 1 else 0.0) and found[x].centrality == pytest.approx(central[x], abs=1e-12), (threshold, x)


def test_graph_reads_events_once(spark):
    """The classes of twins and their edges are made from one pass over the events."""
    seen, rows = spark.sparkContext.accumulator(0), [(f"10.0.0.{k % 6}", f"/{k % 4}", "a" if k % 2 else None) for k in range(24)]

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    schema = "source_ip string, url string, user_agent string"
    members, _, edges = graph.twin_graph(spark.createDataFrame(rows, schema).mapInArrow(counted, schema))
    assert members.count() == 6 and edges.count() >= 0 and seen.value == 24


def test_only_scanners_are_numbered(spark):
    """Rows of other users aren't dealt out by user to be numbered; all have the values that SQL gives them."""
    import duckdb

    from wardline.plans import oracle, queries, weblog

    sf = "/root/testdata/sf0.001"
    below = weblog.weblog(spark, sf)._jdf.queryExecution().optimizedPlan().toString().split("Window", 1)[1]
    assert "<=> 0" in below.split("Relation", 1)[0]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    want = sorted(con.execute(oracle.ORACLE["url_frequencies"]).fetchall())
    assert sorted(map(tuple, queries.url_frequencies(spark, sf).collect())) == want


@pytest.mark.parametrize("sign", [0, 1])
def test_head_of_vectors_decides_as_the_whole(spark, sign):
    """What the first coordinates decide is what all decide, also where coordinates are negative."""
    rng = random.Random(5)
    points = [[rng.random() ** 3 - 0.3 * sign for _ in range(24)] for _ in range(60)]
    df = spark.createDataFrame([(k, p) for k, p in enumerate(points)], "ord long, point array<double>")
    cos = lambda p, q: sum(x * y for x, y in zip(p, q)) / math.sqrt(sum(x * x for x in p) * sum(y * y for y in q))
    want = {(i, j) for i, j in itertools.combinations(range(60), 2) if cos(points[i], points[j]) >= 0.6}
    assert {tuple(r) for r in clusters.similar_points(df).collect()} == want and 0 < len(want) < 1770
    assert "size(u" in clusters.similar_points(df)._jdf.queryExecution().optimizedPlan().toString() or sign


@pytest.mark.parametrize("entries", [0, 1 << 24])
def test_nodes_with_the_same_neighbours_are_one(spark, monkeypatch, entries):
    """Linked nodes with the same other neighbours are searched as one, and metrics are those of plain algorithms, by lists of edges as by matrices."""
    monkeypatch.setattr(graph, "ENTRIES", entries)
    monkeypatch.setattr(graph, "SOURCES_PER_TASK", 5)
    rnd = random.Random(3)
    groups = [[f"n{g}-{k:02}" for k in range(14)] for g in range(3)]
    links = {pair for g in groups for pair in itertools.combinations(g, 2)} | {(groups[0][k], groups[1][k % 2]) for k in range(5)} | {("n2-00", "p0"), ("p0", "p1"), ("p1", "p2"), ("q0", "q1")}
    names = sorted({x for pair in links for x in pair} | {"alone"})
    twins = {x: rnd.randrange(1, 4) for x in names}
    nodes, edges = spark.createDataFrame(list(twins.items()), "source_ip string, twins long"), spark.createDataFrame([(*x, 0.5) for x in sorted(links)], "src string, dst string, weight double")
    members, merged, between = graph.alike(nodes, edges)
    assert members.count() == len(names) and merged.count() == 13 and merged.agg(F.sum("twins")).first()[0] == sum(twins.values()) and between.count() == 12
    each = [(x, k) for x in names for k in range(twins[x])]
    whole = {(a, b) for a, b in itertools.combinations(each, 2) if a[0] == b[0] or (a[0], b[0]) in links or (b[0], a[0]) in links}
    central, near = brandes(each, whole), defaultdict(set)
    for a, b in whole:
        near[a].add(b)
        near[b].add(a)
    found = {r.source_ip: r for r in graph.graph_metrics(nodes, edges).collect()}
    triangles = {r.source_ip: r.triangles for r in graph.clustering_coefficients(nodes, edges).collect()}
    alone = {r.source_ip: r.centrality for r in graph.betweenness(nodes, edges).collect()}
    assert found.keys() == triangles.keys() == alone.keys() == set(names)
    for x in names:
        n, linked = len(near[x, 0]), sum(b in near[a] for a, b in itertools.combinations(near[x, 0], 2))
        assert (found[x].degree, triangles[x]) == (n, linked) and found[x].clustering == pytest.approx(2 * linked / (n * (n - 1)) if n > 1 else 0.0)
        assert found[x].centrality == pytest.approx(central[x, 0], abs=1e-12) and alone[x] == pytest.approx(central[x, 0], abs=1e-12)


def test_followers_are_only_compared_with_leaders(spark, monkeypatch):
    """Many alike points make few pairs, and each follows the first leader that is similar, over several rounds."""
    made, near = [], clusters._near

    def counted(*rows):
        made.append(near(*rows).count())
        return near(*rows)

    monkeypatch.setattr(clusters, "_near", counted)
    monkeypatch.setattr(clusters, "FIRST", 4, raising=False)
    rng = random.Random(2)
    points = [[float(k % 5 == d) + rng.random() * 0.4 for d in range(5)] for k in range(5)] + [[float(rng.randrange(6) == d) + rng.random() * 0.4 for d in range(5)] for _ in range(155)]
    rows = spark.createDataFrame([(f"ip{k}", k, p) for k, p in enumerate(points)], "source_ip string, actor_ord long, vector array<double>")
    led = {}
    for i in range(len(points)):
        for j in range(i, len(points)) if i not in led else ():
            x, y = points[i], points[j]
            if j not in led and (i == j or sum(a * b for a, b in zip(x, y)) / math.sqrt(sum(a * a for a in x) * sum(b * b for b in y)) >= 0.8):
                led[j] = i
    assert {r.source_ip: r.leader for r in clusters.leader_clusters(rows.drop("actor_ord"), rows, 0.8).collect()} == {f"ip{k}": f for k, f in led.items()}
    assert len(set(led.values())) > 4 and sum(made) < 600, (len(set(led.values())), made)


def test_cut_tables_carry_no_constraints(spark):
    """What the optimizer knows of rows isn't carried on over a cut, and the session keeps its settings."""
    key = "spark.sql.constraintPropagation.enabled"
    before, out = spark.conf.get(key), checkpoint(spark.range(9).filter("id > 3").withColumn("twice", F.col("id") * 2))
    assert out._jdf.queryExecution().optimizedPlan().constraints().isEmpty() and sorted(out.collect()) == [(k, 2 * k) for k in range(4, 9)]
    assert spark.conf.get(key) == before


@pytest.fixture
def in_blocks(monkeypatch):
    """Small tables are worked on in blocks too, by several products and tasks."""
    monkeypatch.setattr(graph, "DENSE", -1)
    monkeypatch.setattr(graph.blocks, "STEP", 2)
    monkeypatch.setattr(graph.blocks, "ROWS", 3)
    monkeypatch.setattr(graph.blocks, "COLUMNS", 2)
    monkeypatch.setattr(graph.blocks, "SOURCES_PER_TASK", 4)
    monkeypatch.setattr(graph.blocks, "PARTS", 4)

    def no_pairs(*_):
        raise AssertionError("pairs of actors are joined")

    monkeypatch.setattr(graph, "_overlap", no_pairs)


def test_blocks_are_exact(spark, in_blocks):
    """Edges and metrics without a join of pairs are those of plain algorithms, over several blocks."""
    rnd = random.Random(11)
    sets = {f"10.{k % 3}.0.{k}": ([f"/u{x}" for x in rnd.sample(range(12), rnd.randrange(1, 6))], rnd.choice([[], ["x"], ["x", "y"], ["z"]])) for k in range(60)}
    sets |= {"10.9.0.1": (["/alone"], []), "10.9.0.2": ([None, "/u1"], ["x"]), "10.9.0.3": (["/p", "/q"], ["w"]), "10.9.0.4": (["/p", "/q"], ["w"]), "10.9.0.5": ([None], ["x"])}
    e = events(spark, [(ip, s, u, a) for ip, (us, agents) in sets.items() for s, u in enumerate(us) for a in agents or [None]])

    def weight(x, y):
        known = {u for u in x[0] if u} & {u for u in y[0] if u}
        return 0.7 * len(known) / (len(x[0]) + len(y[0]) - len(known)) + (0.3 * len({*x[1]} & {*y[1]}) / len({*x[1], *y[1]}) if x[1] and y[1] else 0.0)

    for threshold in (0.3, 0.1, 0.6):
        want = {(a, b): weight(sets[a], sets[b]) for a, b in itertools.combinations(sorted(sets), 2)}
        want = {k: w for k, w in want.items() if w > threshold}
        rows = graph.similarity_edges(e, threshold).collect()
        got = {(r.src, r.dst): r.weight for r in rows}
        assert len(rows) == len(got) and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got), threshold
        central, near = brandes(sets, want), defaultdict(set)
        for a, b in want:
            near[a].add(b)
            near[b].add(a)
        found = {r.source_ip: r for r in graph.metrics(e, threshold).collect()}
        flat = {r.source_ip: r.triangles for r in graph.metrics(e, threshold, wanted=graph.clustering_coefficients).collect()}
        assert found.keys() == flat.keys() == sets.keys()
        for x in sets:
            n, linked = len(near[x]), sum(b in near[a] for a, b in itertools.combinations(near[x], 2))
            assert (found[x].degree, found[x].triangles, flat[x]) == (n, linked, linked) and found[x].clustering == pytest.approx(2 * linked / (n * (n - 1)) if n > 1 else 0.0), (threshold, x)
            assert found[x].centrality == pytest.approx(central[x], abs=1e-12), (threshold, x)


def test_blocks_hold_far_nodes(spark, in_blocks):
    """Chains and rings of actors have long shortest paths, in one component over several tasks."""
    links = [(k, k + 1) for k in range(9)] + [(20 + k, 20 + (k + 1) % 7) for k in range(7)]
    nodes = sorted({x for link in links for x in link})
    e = events(spark, [(f"10.0.0.{x}", s, f"/{min(a, b)}-{max(a, b)}", None) for x in nodes for s, (a, b) in enumerate([link for link in links if x in link])])
    want = {tuple(sorted((f"10.0.0.{a}", f"10.0.0.{b}"))): 1 for a, b in links}
    central = brandes([f"10.0.0.{x}" for x in nodes], want)
    assert {(r.src, r.dst) for r in graph.similarity_edges(e, 0.2).collect()} == want.keys()
    assert {r.source_ip: r.centrality for r in graph.metrics(e, 0.2, wanted=graph.betweenness).collect()} == pytest.approx(central)
