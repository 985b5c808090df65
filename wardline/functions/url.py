"""Request features as columns: entropy, URL structure, attack patterns. No Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The attack patterns that flags stand for. (?iuU) gives Java the Unicode-aware classes of the pattern language.
FLAG_PATTERNS = {
    "LFI_RFI": (r"\.\./", r"\.\.\\", r"file://", r"ftp://", r"http://", r"php://", r"data://", r"zip://"),
    "SQL_INJECTION": (r"('|\")(\s|%20)*(OR|AND)(\s|%20)*(\d+|'[^']*')", r"UNION(\s|%20)*SELECT", r"DROP(\s|%20)*TABLE", r"EXEC(\s|%20)*xp_"),
    "XSS": (r"<script[^>]*>", r"javascript:", r"on\w+\s*=", r"<iframe[^>]*>", r"<object[^>]*>"),
    "COMMAND_INJECTION": (
        r"(\||&|;|`|\$\(|\$\{)\s*(cat|ls|pwd|whoami|id|uname)\b", r"(\||&|;|`|\$\(|\$\{)\s*(wget|curl|nc|telnet|bash|sh)\b",
        r"(\||&|;|`|\$\(|\$\{)\s*(rm|del|format|chmod|chown)\b", r"/etc/passwd|/etc/shadow|/proc/self/environ", r"\b(cat|ls|whoami|uname)\b\s+/[A-Za-z]",
    ),
}
AGENT_PATTERN = r"bot|crawler|spider|scraper|nmap|sqlmap|nikto|dirb|python|curl|wget|lynx"
EXTENSIONS = ("php", "asp", "aspx", "jsp", "cgi", "pl", "py", "exe", "bat", "cmd", "com", "pif", "scr")
PROBED_PATHS = ("/admin", "/login", "/wp-admin", "/phpmyadmin", "/config", "/.env", "/.git")
ENTROPY_LIMIT, LENGTH_LIMIT, PARAMETER_LIMIT = 4.5, 2000, 10
ATTACK_FLAGS = tuple(FLAG_PATTERNS)


def entropy(text: Column) -> Column:
    """Shannon entropy over the characters, in bits; empty is 0, null stays null."""
    letters = F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1)))
    n = F.length(text)
    share = F.transform(letters, lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.when(text == "", F.lit(0.0)).otherwise(F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p)))


def path_depth(url: Column) -> Column:
    """Non-empty segments before the first question mark."""
    return F.size(F.filter(F.split(F.substring_index(url, "?", 1), "/"), lambda x: x != ""))


def parameters(url: Column) -> Column:
    """Pieces between the first and the second question mark, cut at ``&``; an empty query counts as one."""
    return F.when(F.instr(url, "?") > 0, F.size(F.split(F.get(F.split(url, r"\?"), F.lit(1)), "&"))).otherwise(0)


def normalize_url(url: Column) -> Column:
    """scheme://host/path, without parameters of the last segment, query and fragment; parts that are missing are empty."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*:", "")
    host = F.regexp_extract(rest, r"^//([^/?#]*)", 1)
    path = F.regexp_extract(F.regexp_replace(rest, r"^//[^/?#]*", ""), r"(?s)^([^?#]*)", 1)
    return F.concat(scheme, F.lit("://"), host, F.regexp_replace(path, r";[^/]*$", ""))


def any_of(patterns) -> str:
    """One expression for a family: its patterns are tried in one pass, so the first match ends the search."""
    return "(?iuU)(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"


def probes_known_path(url: Column) -> Column:
    """Does the URL contain one of the paths that people probe by hand?"""
    lower = F.lower(url)
    out = F.lit(False)
    for p in PROBED_PATHS:
        out = out | lower.contains(p)
    return out


def flag_conditions() -> dict[str, Column]:
    """Conditions of the nine flags over url, user_agent and the features."""
    url = F.col("url")
    out = {flag: url.rlike(any_of(patterns)) for flag, patterns in FLAG_PATTERNS.items()}
    out["SUSPICIOUS_EXTENSION"] = F.lower(url).rlike(r"\.(" + "|".join(EXTENSIONS) + ")")
    out["HIGH_ENTROPY"] = F.col("entropy") > ENTROPY_LIMIT
    out["LONG_URL"] = F.col("url_length") > LENGTH_LIMIT
    out["MANY_PARAMS"] = F.col("query_params_count") > PARAMETER_LIMIT
    out["SUSPICIOUS_USER_AGENT"] = F.col("user_agent").rlike(f"(?iuU)(?:{AGENT_PATTERN})")
    return out


def add_features(events: DataFrame) -> DataFrame:
    """Events with entropy, url_length, path_depth, query_params_count, heuristic_flags (sorted) and is_suspicious."""
    url = F.col("url")
    measured = events.withColumns({"entropy": entropy(url), "url_length": F.length(url), "path_depth": path_depth(url), "query_params_count": parameters(url)})
    flags = F.array_sort(F.array_compact(F.array(*(F.when(c, F.lit(f)) for f, c in flag_conditions().items()))))
    return measured.withColumn("heuristic_flags", flags).withColumn("is_suspicious", F.size("heuristic_flags") > 0)
