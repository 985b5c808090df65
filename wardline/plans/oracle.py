"""DuckDB SQL for the queries of the same names, built from common table expressions."""

from __future__ import annotations

from wardline.functions.url import AGENT_PATTERN, EXTENSIONS, FLAG_PATTERNS, PROBED_PATHS
from wardline.operators.intelligence import TAG_TECHNIQUES, TECHNIQUES
from wardline.operators.meta import ALIASES
from wardline.operators.recommend import ACTOR_RULES, CAMPAIGN_RULES, GLOBAL_RULES
from wardline.operators.rules import ATTACKS, COMBINATIONS, PROFILES


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


WEBLOG = """
numbered AS (
  SELECT event_id, ts, user_id, event_type, user_id % 10 AS cls, event_id % 8 AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events
), weblog AS (
  SELECT event_id AS event_ord, CASE WHEN cls = 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_seconds(60 * rn) ELSE ts END AS timestamp,
    '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS source_ip,
    CASE WHEN cls = 0 THEN '/scan/' || (user_id % 3) || '/' || rn || '.php'
         WHEN cls = 1 AND k < 3 THEN '/index.php?page=../../../etc/passwd&n=' || k
         WHEN cls = 2 AND k < 2 THEN '/login.php?id=1'' OR ''1''=''1'
         WHEN cls = 2 AND k IN (2, 3) THEN '/search?q=<script>alert(1)</script>'
         WHEN cls = 3 AND k <= 4 THEN ['/admin', '/login', '/.env', '/wp-admin', '/.git/config'][k + 1]
         WHEN cls = 4 AND k = 0 THEN '/exec?cmd=cat /etc/shadow'
         ELSE '/g' || (user_id % 25) || '/' || event_type || '?k=' || k END AS url,
    CASE WHEN event_type = 'purchase' THEN 'POST' ELSE 'GET' END AS method,
    CAST(CASE WHEN event_type = 'error' THEN 500 WHEN k = 7 THEN 404 ELSE 200 END AS INTEGER) AS status_code,
    CASE cls WHEN 0 THEN 'python-requests/2.31' WHEN 1 THEN 'sqlmap/1.7' WHEN 2 THEN 'Mozilla/5.0 (X11)' WHEN 9 THEN NULL ELSE 'Mozilla/5.0 (u' || (user_id % 25) || ')' END AS user_agent
  FROM numbered
)"""

_families = {f: "regexp_matches(url, " + _q("|".join(f"(?:{p})" for p in ps)) + ", 'i')" for f, ps in FLAG_PATTERNS.items()}
_FLAGS = _families | {
    "SUSPICIOUS_EXTENSION": f"regexp_matches(lower(url), '\\.({'|'.join(EXTENSIONS)})')", "HIGH_ENTROPY": "entropy > 4.5", "LONG_URL": "url_length > 2000", "MANY_PARAMS": "query_params_count > 10",
    "SUSPICIOUS_USER_AGENT": f"coalesce(regexp_matches(user_agent, {_q(AGENT_PATTERN)}, 'i'), false)",
}
FEATURES = WEBLOG + f""", letters AS (
  SELECT url, unnest(string_split(url, '')) AS c FROM (SELECT DISTINCT url FROM weblog)
), shares AS (
  SELECT url, count(*) / sum(count(*)) OVER (PARTITION BY url) AS p FROM letters GROUP BY url, c
), entropies AS (
  SELECT url, -sum(p * log2(p)) AS entropy FROM shares GROUP BY url
), measured AS (
  SELECT w.*, coalesce(e.entropy, 0.0) AS entropy, length(w.url) AS url_length,
    len(list_filter(string_split(string_split(w.url, '?')[1], '/'), lambda x: x <> '')) AS path_depth,
    CASE WHEN contains(w.url, '?') THEN len(string_split(string_split(w.url, '?')[2], '&')) ELSE 0 END AS query_params_count
  FROM weblog w LEFT JOIN entropies e ON w.url = e.url
), features AS (
  SELECT *, list_filter([{', '.join(f"CASE WHEN {c} THEN '{f}' END" for f, c in sorted(_FLAGS.items()))}], lambda x: x IS NOT NULL) AS flags FROM measured
)"""

METRICS = """, metrics AS (
  SELECT source_ip, min(event_ord) AS actor_ord, count(*) AS total_requests, count(DISTINCT url) AS unique_urls, avg(entropy) AS avg_entropy, max(entropy) AS max_entropy,
    count(DISTINCT url) / count(*) AS url_diversity_ratio, min(timestamp) AS first_seen, max(timestamp) AS last_seen
  FROM features GROUP BY source_ip
)"""

_probe = " OR ".join(f"contains(lower(url), {_q(p)})" for p in PROBED_PATHS)
CADENCE = f""", gaps AS (
  SELECT source_ip, ({_probe}) AS probe, (epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY source_ip ORDER BY timestamp)) / 1e6 AS gap FROM weblog
), intervals AS (
  SELECT source_ip, count(*) AS events, avg(gap) AS mean_interval, stddev_pop(gap) AS std_interval, count(*) FILTER (WHERE probe) AS hits FROM gaps GROUP BY source_ip
), cadence AS (
  SELECT *, CASE WHEN mean_interval > 0 THEN std_interval / mean_interval END AS cv,
    events >= 10 AND coalesce(CASE WHEN mean_interval > 0 THEN std_interval / mean_interval END < 0.15, false) AS rhythmic FROM intervals
), cadence_tags AS (
  SELECT source_ip, rhythmic, NOT rhythmic AND hits >= 3 AS manual FROM cadence
)"""

GRAPH = """, actor_urls AS (
  SELECT DISTINCT source_ip, url FROM weblog
), actor_agents AS (
  SELECT DISTINCT source_ip, user_agent FROM weblog WHERE user_agent <> ''
), nu AS (
  SELECT source_ip, count(*) AS n FROM actor_urls GROUP BY source_ip
), na AS (
  SELECT source_ip, count(*) AS n FROM actor_agents GROUP BY source_ip
), shared_urls AS (
  SELECT a.source_ip AS src, b.source_ip AS dst, count(*) AS n FROM actor_urls a JOIN actor_urls b ON a.url = b.url AND a.source_ip < b.source_ip GROUP BY 1, 2
), shared_agents AS (
  SELECT a.source_ip AS src, b.source_ip AS dst, count(*) AS n FROM actor_agents a JOIN actor_agents b ON a.user_agent = b.user_agent AND a.source_ip < b.source_ip GROUP BY 1, 2
), edges AS (
  SELECT u.src, u.dst, 0.7::DOUBLE * (u.n / (x.n + y.n - u.n)) + 0.3::DOUBLE * CASE WHEN coalesce(p.n, 0) > 0 AND coalesce(q.n, 0) > 0 THEN coalesce(g.n, 0) / (p.n + q.n - coalesce(g.n, 0)) ELSE 0 END AS weight
  FROM shared_urls u JOIN nu x ON x.source_ip = u.src JOIN nu y ON y.source_ip = u.dst LEFT JOIN na p ON p.source_ip = u.src LEFT JOIN na q ON q.source_ip = u.dst
  LEFT JOIN shared_agents g ON g.src = u.src AND g.dst = u.dst
  WHERE 0.7::DOUBLE * (u.n / (x.n + y.n - u.n)) + 0.3::DOUBLE * CASE WHEN coalesce(p.n, 0) > 0 AND coalesce(q.n, 0) > 0 THEN coalesce(g.n, 0) / (p.n + q.n - coalesce(g.n, 0)) ELSE 0 END > 0.3
), nodes AS (
  SELECT DISTINCT source_ip FROM weblog
), both_ways AS (
  SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges
), degrees AS (
  SELECT src AS source_ip, count(*) AS degree FROM both_ways GROUP BY 1
), triangles AS (
  SELECT a.src AS source_ip, count(*) // 2 AS triangles FROM both_ways a JOIN both_ways b ON a.src = b.src AND a.dst <> b.dst JOIN both_ways c ON c.src = a.dst AND c.dst = b.dst GROUP BY 1
), clustering AS (
  SELECT n.source_ip, coalesce(degree, 0) AS degree, coalesce(triangles, 0) AS triangles, CASE WHEN degree >= 2 THEN 2 * coalesce(triangles, 0) / (degree * (degree - 1)) ELSE 0.0::DOUBLE END AS clustering
  FROM nodes n LEFT JOIN degrees d USING (source_ip) LEFT JOIN triangles t USING (source_ip)
), walks(s, v, d, c) AS (
  SELECT source_ip, source_ip, 0, 1::DOUBLE FROM nodes
  UNION ALL SELECT s, e.dst, d + 1, sum(c) FROM walks w JOIN both_ways e ON e.src = w.v WHERE d < 8 GROUP BY s, e.dst, d + 1
), paths AS (
  SELECT s, v, min(d) AS d, min_by(c, d) AS c FROM walks GROUP BY s, v
), centrality AS (
  SELECT n.source_ip, coalesce(sum(sv.c * vt.c / st.c), 0.0) / ((SELECT count(*) FROM nodes) - 1) / ((SELECT count(*) FROM nodes) - 2) AS centrality
  FROM nodes n LEFT JOIN paths sv ON sv.v = n.source_ip AND sv.s <> n.source_ip LEFT JOIN paths vt ON vt.s = n.source_ip AND vt.v <> n.source_ip AND vt.v <> sv.s
  LEFT JOIN paths st ON st.s = sv.s AND st.v = vt.v AND st.d = sv.d + vt.d
  GROUP BY n.source_ip
), graph AS (
  SELECT source_ip, c.centrality, clustering, c.centrality > 0.3 AND clustering < 0.5 AS leads, NOT (c.centrality > 0.3 AND clustering < 0.5) AND clustering > 0.5 AS member
  FROM centrality c JOIN clustering k USING (source_ip)
)"""

_metric = ("avg_entropy", "url_diversity_ratio", "total_requests", "centrality")
ANOMALY = f""", four AS (
  SELECT m.*, g.centrality, g.leads, g.member FROM metrics m JOIN graph g USING (source_ip)
), base AS (
  SELECT {', '.join(f'avg({m}) AS {m}_mean, stddev_pop({m}) AS {m}_std' for m in _metric)} FROM four
), anomaly AS (
  SELECT four.*, coalesce(list_avg(list_filter([{', '.join(f"CASE WHEN {m}_std > 1e-12 * abs({m}_mean) THEN least(abs({m} - {m}_mean) / {m}_std / 3, 1.0) END" for m in _metric)}], lambda x: x IS NOT NULL)), 0.0) AS anomaly_ratio FROM four, base
)"""

VECTORS = """, url_counts AS (
  SELECT source_ip, url, count(*) AS n FROM weblog GROUP BY 1, 2
), ranked AS (
  SELECT source_ip, row_number() OVER (PARTITION BY source_ip ORDER BY n DESC) - 1 AS rank, n FROM url_counts
), vector_values AS (
  SELECT source_ip, rank, n / sum(n) OVER (PARTITION BY source_ip) AS value FROM ranked WHERE rank < 50
)"""

LEADERS = VECTORS + """, actor_order AS (
  SELECT source_ip, min(event_ord) AS actor_ord, row_number() OVER (ORDER BY min(event_ord)) AS i FROM weblog GROUP BY source_ip
), norms AS (
  SELECT source_ip, sqrt(sum(value * value)) AS norm FROM vector_values GROUP BY source_ip
), adjacent AS MATERIALIZED (
  SELECT oa.i AS a, ob.i AS b FROM vector_values x JOIN vector_values y ON x.rank = y.rank JOIN actor_order oa ON oa.source_ip = x.source_ip JOIN actor_order ob ON ob.source_ip = y.source_ip AND oa.i < ob.i
  JOIN norms nx ON nx.source_ip = x.source_ip JOIN norms ny ON ny.source_ip = y.source_ip GROUP BY oa.i, ob.i, nx.norm, ny.norm HAVING sum(x.value * y.value) / (nx.norm * ny.norm) >= 0.6
), earlier AS MATERIALIZED (
  SELECT b AS i, list(a) AS neighbours FROM adjacent GROUP BY b
), lead(i, leaders) AS (
  SELECT 0::BIGINT, []::BIGINT[]
  UNION ALL SELECT o.i, CASE WHEN list_has_any(leaders, coalesce(e.neighbours, [])) THEN leaders ELSE list_append(leaders, o.i) END FROM lead l JOIN actor_order o ON o.i = l.i + 1 LEFT JOIN earlier e ON e.i = o.i
), chosen AS (
  SELECT unnest(leaders) AS i FROM lead WHERE i = (SELECT max(i) FROM actor_order)
), led AS (
  SELECT o.source_ip, o.i, CASE WHEN o.i IN (SELECT i FROM chosen) THEN o.i ELSE (SELECT min(a) FROM adjacent x WHERE x.b = o.i AND x.a IN (SELECT i FROM chosen)) END AS l FROM actor_order o
), leader_clusters AS (
  SELECT led.source_ip, o.actor_ord AS leader, count(*) OVER (PARTITION BY l) AS size FROM led JOIN actor_order o ON o.i = led.l
)"""

_attacks = ", ".join(_q(a) for a in ATTACKS)
TAGS = f""", attack_flags AS (
  SELECT source_ip, list_sort(list(DISTINCT f)) AS own FROM (SELECT source_ip, unnest(flags) AS f FROM features) WHERE f IN ({_attacks}) GROUP BY 1
), detected AS (
  SELECT a.*, c.rhythmic, c.manual, coalesce(f.own, []) AS own, lc.size >= 2 AS clustered, a.anomaly_ratio >= 0.7 AS anomalous, a.anomaly_ratio >= 0.4 AND a.anomaly_ratio < 0.7 AS suspicious
  FROM anomaly a JOIN cadence_tags c USING (source_ip) JOIN leader_clusters lc USING (source_ip) LEFT JOIN attack_flags f USING (source_ip)
), voted AS (
  SELECT *, (rhythmic OR manual)::INT + clustered::INT + (anomalous OR suspicious)::INT AS votes, leads OR member AS graphed, anomalous OR suspicious AS odd,
    len(own) + (rhythmic OR manual)::INT + clustered::INT + (leads OR member)::INT + (anomalous OR suspicious)::INT AS sources,
    len(list_filter(own, lambda x: x IN ('LFI_RFI', 'SQL_INJECTION', 'XSS'))) AS named
  FROM detected
), tagged AS (
  SELECT *, list_sort(list_distinct(list_concat(own, list_filter([
    CASE WHEN rhythmic THEN 'AUTOMATED_SCAN' END, CASE WHEN manual THEN 'MANUAL_SCAN' END, CASE WHEN leads THEN 'COORDINATOR' END, CASE WHEN member OR clustered THEN 'CLUSTER_MEMBER' END,
    CASE WHEN anomalous THEN 'ANOMALOUS' END, CASE WHEN suspicious THEN 'SUSPICIOUS' END, CASE WHEN votes >= 2 THEN 'CONFIRMED_BOTNET' END, CASE WHEN graphed AND odd THEN 'CONFIRMED_COORDINATED' END,
    CASE WHEN named >= 2 AND (len(own) > 0 OR rhythmic OR manual) THEN 'CONFIRMED_SOPHISTICATED' END, CASE WHEN named > 0 AND sources = 1 THEN 'ISOLATED_INDICATOR' END], lambda x: x IS NOT NULL)))) AS tags
  FROM voted
)"""


def _conditions(name: str, threshold) -> str:
    return {
        "fft_is_rhythmic": "c.is_rhythmic", "coordinated_attack": "c.coordinators > 0", "multiple_attack_types": "attacks >= 2", "url_diversity_ratio": f"url_diversity_ratio > {threshold or 0.8}",
        "high_entropy": f"avg_entropy > {threshold or 4.5}", "high_centrality": f"centrality > {threshold or 0.5}", "anomalous_behavior": f"anomaly_ratio > {threshold or 0.7}",
    }.get(name, "false")


_has = lambda t: f"list_contains(tags, {_q(t)})"
_base = " + ".join(f"CASE WHEN {_has(t)} THEN {float(s)}::DOUBLE" + "".join(f" * CASE WHEN {_conditions(n, th)} THEN {f} ELSE 1.0 END::DOUBLE" for n, th, f, _ in ms) + " ELSE 0 END" for t, (s, ms) in sorted(PROFILES.items()))
_matches = [(" AND ".join(_has(t) for t in ts), f) for ts, (f, _) in COMBINATIONS.items()]
SCORES = f""", context AS (
  SELECT count(*) AS actors, count(*) FILTER (WHERE rhythmic) > 0 AS is_rhythmic, count(*) FILTER (WHERE rhythmic) / count(*) AS prevalence, count(*) FILTER (WHERE leads) AS coordinators, avg(centrality) AS avg_centrality,
    count(*) FILTER (WHERE anomalous) AS anomalies, count(*) FILTER (WHERE anomalous) / count(*) AS anomaly_rate, (SELECT max(size) FROM leader_clusters) AS largest FROM detected
), counted AS (
  SELECT *, len(list_filter(tags, lambda x: x IN ({_attacks}))) AS attacks FROM tagged
), parts AS (
  SELECT t.*, {_base} AS base_score,
    CASE WHEN {' OR '.join(f'({m})' for m, _ in _matches)} THEN {' * '.join(f'CASE WHEN {m} THEN {f} ELSE 1.0 END::DOUBLE' for m, f in _matches)}
      ELSE CASE WHEN attacks >= 3 THEN 2.0 WHEN attacks = 2 THEN 1.5 ELSE 1.0 END::DOUBLE * CASE WHEN ({_has('COORDINATOR')} OR {_has('COORDINATED_ATTACK')}) AND attacks > 0 THEN 1.8 ELSE 1.0 END::DOUBLE
        * CASE WHEN ({_has('AUTOMATED_SCAN')} OR {_has('MANUAL_SCAN')}) AND attacks > 0 THEN 1.3 ELSE 1.0 END::DOUBLE * CASE WHEN {_has('ANOMALOUS')} AND attacks > 0 THEN 1.4 ELSE 1.0 END::DOUBLE END AS combination_modifier,
    CASE WHEN c.prevalence > 0.5 THEN CASE WHEN {_has('AUTOMATED_SCAN')} THEN 1.2 ELSE 0.8 END ELSE 1.0 END::DOUBLE * CASE WHEN c.avg_centrality > 0 AND centrality > c.avg_centrality * 2 THEN 1.3 WHEN centrality < c.avg_centrality * 0.5 THEN 0.9 ELSE 1.0 END::DOUBLE
      * CASE WHEN c.anomaly_rate > 0.3 THEN CASE WHEN anomaly_ratio > 0.7 THEN 1.4 ELSE 0.7 END ELSE 1.0 END::DOUBLE * CASE WHEN c.largest >= 5 AND ({_has('COORDINATED_ATTACK')} OR {_has('COORDINATOR')}) THEN 1.5 ELSE 1.0 END::DOUBLE AS contextual_modifier,
    CASE WHEN c.actors > 100 THEN 1.2 WHEN c.actors > 50 THEN 1.1 ELSE 1.0 END::DOUBLE * CASE WHEN c.coordinators > 5 THEN 1.3 ELSE 1.0 END::DOUBLE * CASE WHEN c.anomalies > 10 THEN 1.2 ELSE 1.0 END::DOUBLE AS global_modifier
  FROM counted t, context c
), scored AS (
  SELECT *, base_score * combination_modifier * contextual_modifier * global_modifier AS threat_score FROM parts
)"""


def _all(*parts: str) -> str:
    return "WITH RECURSIVE " + "".join(parts).lstrip(", ")


_FULL = (FEATURES, METRICS, CADENCE, GRAPH, ANOMALY, LEADERS, TAGS, SCORES)

#: With two samples a cluster is a component of the graph of points at most eps apart; single points are noise.
DENSITY = """, grid AS (
  SELECT a.source_ip, a.actor_ord, r.rank, coalesce(v.value, 0.0) AS x FROM actor_order a CROSS JOIN range(50) r(rank) LEFT JOIN vector_values v ON v.source_ip = a.source_ip AND v.rank = r.rank
), spread AS (
  SELECT rank, avg(x) AS mean, CASE WHEN stddev_pop(x) > 1e-15 THEN stddev_pop(x) ELSE 1.0 END AS std FROM grid GROUP BY rank
), standard AS (
  SELECT source_ip, rank, (x - mean) / std AS x FROM grid JOIN spread USING (rank)
), close_by AS MATERIALIZED (
  SELECT a.source_ip AS a, b.source_ip AS b FROM standard a JOIN standard b ON a.rank = b.rank GROUP BY 1, 2 HAVING sqrt(sum((a.x - b.x) * (a.x - b.x))) <= 0.5
), reached(s, v) AS (
  SELECT source_ip, source_ip FROM actor_order
  UNION SELECT r.s, c.b FROM reached r JOIN close_by c ON c.a = r.v
), components AS (
  SELECT s AS source_ip, min(o.actor_ord) AS first, count(*) AS members FROM reached r JOIN actor_order o ON o.source_ip = r.v GROUP BY s
), density AS (
  SELECT source_ip, members, CASE WHEN members >= 2 THEN dense_rank() OVER (PARTITION BY members >= 2 ORDER BY first) - 1 ELSE -1 END AS cluster FROM components
)"""

CAMPAIGNS = DENSITY + """, finals AS (
  SELECT s.source_ip, s.threat_score, d.cluster, list_sort(list_distinct(list_append(s.tags, CASE WHEN d.members >= 3 THEN 'COORDINATED_ATTACK' WHEN d.members = 2 THEN 'PAIRED_ATTACK' ELSE 'ISOLATED_ATTACKER' END))) AS tags
  FROM scored s JOIN density d USING (source_ip)
), campaign_tags AS (
  SELECT cluster, tag, count(*) AS n FROM (SELECT cluster, unnest(tags) AS tag FROM finals WHERE cluster >= 0) GROUP BY 1, 2
), campaigns AS (
  SELECT 'campaign_' || f.cluster AS campaign_id, f.actors, f.threat_score, t.tags, t.campaign_type
  FROM (SELECT cluster, count(*) AS actors, avg(threat_score) AS threat_score FROM finals WHERE cluster >= 0 GROUP BY cluster) f
  JOIN (SELECT cluster, list(tag ORDER BY tag) AS tags, first(tag ORDER BY n DESC, tag) AS campaign_type FROM campaign_tags GROUP BY cluster) t USING (cluster)
)"""


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(_q(x) if isinstance(x, str) else f"{x}" for x in r) + ")" for r in rows)


_ALIASED = "list_concat(tags, list_filter([" + ", ".join(f"CASE WHEN {_has(t)} THEN {_q(a)} END" for t, a in ALIASES.items()) + "], lambda x: x IS NOT NULL))"
MITRE = f""", techniques(technique_id, name, tactic) AS (
  VALUES {_values(TECHNIQUES)}
), technique_of(tag, technique_id) AS (
  VALUES {_values((t, i) for t, ids in TAG_TECHNIQUES.items() for i in ids)}
), mitre AS (
  SELECT DISTINCT f.source_ip, t.* FROM (SELECT source_ip, unnest({_ALIASED}) AS tag FROM finals) f JOIN technique_of o USING (tag) JOIN techniques t USING (technique_id)
)"""


def _first_rule(rules) -> str:
    return "CASE " + " ".join(f"WHEN list_has_all({_ALIASED}, [{', '.join(_q(t) for t in r[0])}]) THEN {k}" for k, r in enumerate(rules)) + " END"


_texts = [(scope, k, r[1], r[2], r[3], ",".join(r[6]), r[7]) for scope, rules in (("actor", ACTOR_RULES), ("campaign", CAMPAIGN_RULES)) for k, r in enumerate(rules)]
_texts += [("global", k, "HIGH", "IMMEDIATE_ACTION", r[2], ",".join(r[5]), r[6]) for k, r in enumerate(GLOBAL_RULES)]
ADVICE = f""", texts(scope, rule, priority, category, title, mitre_techniques, confidence) AS (
  VALUES {_values(_texts)}
), ruled AS (
  SELECT 'actor' AS scope, source_ip AS subject, {_first_rule(ACTOR_RULES)} AS rule FROM finals
  UNION ALL SELECT 'campaign', campaign_id, {_first_rule(CAMPAIGN_RULES)} FROM campaigns
  UNION ALL SELECT 'global', 'all', CASE WHEN count(*) FILTER (WHERE threat_score > 8) > 5 THEN 0 END FROM finals
  UNION ALL SELECT 'global', 'all', CASE WHEN count(*) FILTER (WHERE {_has("CONFIRMED_BOTNET")}) > 3 THEN 1 END FROM finals
), advice AS (
  SELECT scope, subject, priority, category, replace(title, '{{}}', subject) AS title, mitre_techniques, confidence::DOUBLE AS confidence FROM ruled JOIN texts USING (scope, rule)
)"""
_NORMAL = """regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ';[^/]*$', '')"""
_PATH = "regexp_replace(regexp_extract(url, '(?s)^([^?#]*)', 1), ';[^/]*$', '')"
_LINE = "event_ord % 50 <> 49"

ORACLE: dict[str, str] = {
    "event_features": _all(FEATURES) + " SELECT event_ord, url, round(entropy, 6) AS entropy, url_length, path_depth, query_params_count FROM features",
    "heuristic_flags": _all(FEATURES) + " SELECT event_ord, array_to_string(flags, ',') AS heuristic_flags, len(flags) > 0 AS is_suspicious FROM features",
    "flag_counts": _all(FEATURES) + f", names AS (SELECT unnest([{', '.join(_q(f) for f in _FLAGS)}]) AS flag) SELECT n.flag, count(*) FILTER (WHERE list_contains(flags, n.flag)) AS events FROM names n, features GROUP BY n.flag",
    "url_normalize": f"SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) || '://' || regexp_extract(url, '://([^/?#]*)', 1) || {_NORMAL} AS url_normalized FROM pages",
    "parsed_log": _all(WEBLOG) + f", lines AS (SELECT * REPLACE (split_part(url, ' ', 1) AS url, date_trunc('second', timestamp) AS timestamp, coalesce(user_agent, '') AS user_agent) FROM weblog WHERE {_LINE}) SELECT event_ord, timestamp, source_ip, url, '://' || {_PATH} AS url_normalized, method, status_code, user_agent FROM lines",
    "rejected_lines": _all(WEBLOG) + f" SELECT event_ord FROM weblog WHERE NOT ({_LINE})",
    "actor_metrics": _all(FEATURES, METRICS) + " SELECT source_ip, actor_ord, total_requests, unique_urls, round(avg_entropy, 6) AS avg_entropy, round(max_entropy, 6) AS max_entropy, round(url_diversity_ratio, 6) AS url_diversity_ratio, first_seen, last_seen FROM metrics",
    "top_suspicious": _all(FEATURES) + " SELECT source_ip, count(*) AS requests, count(*) FILTER (WHERE len(flags) > 0) AS suspicious, round(count(*) FILTER (WHERE len(flags) > 0) / count(*), 6) AS ratio FROM features GROUP BY 1 ORDER BY ratio DESC, requests DESC, source_ip LIMIT 10",
    "actor_signatures": _all(WEBLOG) + f""" SELECT source_ip, count(*) AS total_urls_count, count(DISTINCT '://' || {_PATH}) AS unique_urls_count, count(DISTINCT user_agent) + max((user_agent IS NULL)::INT) AS unique_user_agents,
  round((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6, 6) AS time_span_seconds, round(count(*) / greatest((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6, 1.0), 6) AS avg_events_per_second,
  round(count(DISTINCT '://' || {_PATH}) / count(*), 6) AS url_diversity_ratio, round((count(DISTINCT user_agent) + max((user_agent IS NULL)::INT)) / count(*), 6) AS user_agent_diversity FROM weblog GROUP BY 1""",
    "method_distribution": _all(WEBLOG) + " SELECT source_ip, method, count(*) AS n FROM weblog GROUP BY 1, 2",
    "status_distribution": _all(WEBLOG) + " SELECT source_ip, status_code, count(*) AS n FROM weblog GROUP BY 1, 2",
    "url_frequencies": _all(WEBLOG) + " SELECT source_ip, url, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY source_ip), 6) AS frequency FROM weblog GROUP BY 1, 2",
    "behavior_vector_topk": _all(WEBLOG, VECTORS) + " SELECT source_ip, rank, round(value, 6) AS value FROM vector_values",
    "interval_cv": _all(WEBLOG, CADENCE) + " SELECT source_ip, events, hits, round(mean_interval, 6) AS mean_interval, round(std_interval, 6) AS std_interval, round(cv, 6) AS cv FROM cadence",
    "cadence_tags": _all(WEBLOG, CADENCE) + " SELECT source_ip, rhythmic, manual FROM cadence_tags",
    "cadence_summary": _all(WEBLOG, CADENCE) + " SELECT count(*) AS total_actors, count(*) FILTER (WHERE rhythmic) AS total_rhythmic_actors, count(*) FILTER (WHERE manual) AS total_manual_actors, round(count(*) FILTER (WHERE rhythmic) / count(*), 6) AS prevalence, count(*) FILTER (WHERE rhythmic) > 0 AS is_rhythmic FROM cadence_tags",
    "actor_similarity_edges": _all(WEBLOG, GRAPH) + " SELECT src, dst, round(weight, 6) AS weight FROM edges",
    "clustering_coefficient": _all(WEBLOG, GRAPH) + " SELECT source_ip, degree, triangles, round(clustering, 6) AS clustering FROM clustering",
    "betweenness": _all(WEBLOG, GRAPH) + " SELECT source_ip, round(centrality, 6) AS centrality FROM centrality",
    "graph_tags": _all(WEBLOG, GRAPH) + " SELECT source_ip, round(centrality, 6) AS centrality, CASE WHEN leads THEN 'COORDINATOR' WHEN member THEN 'CLUSTER_MEMBER' ELSE '' END AS tags FROM graph",
    "graph_summary": _all(WEBLOG, GRAPH) + " SELECT count(*) AS total_actors, count(*) FILTER (WHERE leads) AS coordinators, count(*) FILTER (WHERE member) AS cluster_members, round(avg(centrality), 6) AS avg_centrality FROM graph",
    "anomaly_scores": _all(FEATURES, METRICS, GRAPH, ANOMALY) + " SELECT source_ip, round(anomaly_ratio, 6) AS anomaly_ratio, anomaly_ratio >= 0.7 AS anomalous, anomaly_ratio >= 0.4 AND anomaly_ratio < 0.7 AS suspicious FROM anomaly",
    "anomaly_summary": _all(FEATURES, METRICS, GRAPH, ANOMALY) + " SELECT count(*) AS total_actors, count(*) FILTER (WHERE anomaly_ratio >= 0.7) AS anomalies, count(*) FILTER (WHERE anomaly_ratio >= 0.4 AND anomaly_ratio < 0.7) AS suspicious, round(count(*) FILTER (WHERE anomaly_ratio >= 0.7) / count(*), 6) AS anomaly_rate FROM anomaly",
    "leader_clusters": _all(WEBLOG, LEADERS) + " SELECT source_ip, leader FROM leader_clusters",
    "clustering_summary": _all(WEBLOG, LEADERS) + " SELECT count(DISTINCT leader) AS total_clusters, max(size) AS largest_cluster FROM leader_clusters",
    "cross_validation": _all(*_FULL[:-1]) + " SELECT source_ip, array_to_string(tags, ',') AS tags FROM tagged",
    "score_components": _all(*_FULL) + " SELECT source_ip, round(base_score, 6) AS base_score, round(combination_modifier, 6) AS combination_modifier, round(contextual_modifier, 6) AS contextual_modifier, round(global_modifier, 6) AS global_modifier, round(threat_score, 6) AS threat_score FROM scored",
    "threat_scores": _all(*_FULL) + " SELECT source_ip, actor_ord, round(threat_score, 6) AS threat_score, array_to_string(tags, ',') AS tags FROM scored",
    "top_actors": _all(*_FULL) + " SELECT source_ip, round(threat_score, 6) AS threat_score, actor_ord FROM scored ORDER BY 2 DESC, 3 LIMIT 10",
    "density_clusters": _all(WEBLOG, LEADERS, DENSITY) + " SELECT source_ip, cluster FROM density",
    "campaign_rollup": _all(*_FULL, CAMPAIGNS) + " SELECT campaign_id, actors, round(threat_score, 6) AS threat_score, array_to_string(tags, ',') AS primary_tags, campaign_type FROM campaigns",
    "isolated_actors": _all(*_FULL, CAMPAIGNS) + " SELECT source_ip FROM finals WHERE list_contains(tags, 'ISOLATED_ATTACKER')",
    "mitre_by_actor": _all(*_FULL, CAMPAIGNS, MITRE) + " SELECT source_ip, technique_id, name, tactic, 'https://attack.mitre.org/techniques/' || replace(technique_id, '.', '/') AS url FROM mitre",
    "technique_summary": _all(*_FULL, CAMPAIGNS, MITRE) + " SELECT tactic, array_to_string(list_sort(list(DISTINCT technique_id)), ',') AS technique_ids, count(DISTINCT source_ip) AS actors FROM mitre GROUP BY tactic",
    "recommendations": _all(*_FULL, CAMPAIGNS, ADVICE) + " SELECT * FROM advice",
    "recommendation_summary": _all(*_FULL, CAMPAIGNS, ADVICE) + """ SELECT count(*) AS total_recommendations, count(*) FILTER (WHERE priority = 'HIGH') AS high_priority, count(*) FILTER (WHERE priority = 'MEDIUM') AS medium_priority, count(*) FILTER (WHERE priority = 'LOW') AS low_priority,
  count(*) FILTER (WHERE category = 'IMMEDIATE_ACTION') AS immediate_actions, count(*) FILTER (WHERE category = 'INVESTIGATION') AS investigations, count(*) FILTER (WHERE category = 'MONITORING') AS monitoring FROM advice""",
    "report_summary": _all(*_FULL, CAMPAIGNS) + " SELECT count(*) AS total_actors, (SELECT count(*) FROM campaigns) AS total_campaigns, count(*) FILTER (WHERE threat_score > 7) AS high_threat_actors, count(*) FILTER (WHERE len(tags) > 0) AS tagged_actors FROM finals",
    "feed_stats": "SELECT CAST(7 AS BIGINT) AS total_feeds, CAST(6 AS BIGINT) AS enabled_feeds, CAST(13 AS BIGINT) AS total_patterns",
    "ioc_matches": _all(WEBLOG) + """, feeds(ord, feed, feed_type, pattern, confidence, says) AS (
  VALUES (0, 'bad_agents', 'user_agent', 'sqlmap', 0.9::DOUBLE, 'Malicious user agent'), (0, 'bad_agents', 'user_agent', 'nikto', 0.9, 'Malicious user agent'),
    (1, 'scripted_agents', 'user_agent', 'python-requests', 0.9, 'Malicious user agent'), (1, 'scripted_agents', 'user_agent', 'map', 0.9, 'Malicious user agent'),
    (2, 'paths', 'url_path', '/.git', 0.8, ''), (2, 'paths', 'url_path', '/wp-admin', 0.8, ''), (2, 'paths', 'url_path', '/admin', 0.8, ''),
    (3, 'hosts', 'ip_address', '10.0.0.1', 0.95, ''), (3, 'hosts', 'ip_address', '10.0.0.25', 0.95, ''),
    (4, 'lfi_list', 'url_pattern', '../..', 0.85, 'LFI'), (4, 'lfi_list', 'url_pattern', '/etc/passwd', 0.85, 'LFI'), (5, 'xss_list', 'url_pattern', '<script', 0.85, 'XSS')
), candidates AS (
  SELECT DISTINCT 'user_agent' AS feed_type, user_agent AS value FROM weblog UNION SELECT 'url_path', url FROM weblog UNION SELECT 'ip_address', source_ip FROM weblog UNION SELECT 'url_pattern', url FROM weblog
), hits AS (
  SELECT c.*, f.ord, f.feed, f.pattern, f.confidence, f.says, row_number() OVER (PARTITION BY c.feed_type, c.value ORDER BY f.ord, f.pattern) AS k FROM candidates c JOIN feeds f ON f.feed_type = c.feed_type AND contains(c.value, f.pattern)
) SELECT feed_type, value, feed, pattern, confidence, CASE feed_type WHEN 'user_agent' THEN 'Malicious user agent pattern detected: ' WHEN 'url_path' THEN 'Suspicious URL path detected: ' WHEN 'ip_address' THEN 'Malicious IP address detected: ' ELSE says || ' attack pattern detected: ' END || pattern AS description FROM hits WHERE k = 1""",
}
