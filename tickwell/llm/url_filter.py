"""URL filtering: host/path rules and glob patterns, indexed by their rarest literal token. DataFrame operations only.

Every rule becomes a regular expression over `host`, U+0001, `path`, and a list of literal tokens (runs of letters
and digits) that any matching URL must hold as whole tokens. The rarest of them, counted over the URLs, is the
rule's key. The distinct tokens of a URL fetch candidate rules from this index, and only those expressions run.
Rules without a sure literal are candidates for every URL. The index is broadcast while it has at most
`broadcast_rules` rows and joined by a shuffle beyond that; URLs themselves are never grouped by host or token,
so a hot host stays spread, and the fetched rules of a URL meet in an aggregate with map-side combine.

Defined cases: null URLs and those without `://` have empty host and path and fit no host rule; a rule's verdict
outranks patterns, the longest fitting rule wins, and among patterns `allow` outranks `block`; every input row
comes back, repeated ones too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii

#: (host/path rule, verdict): fits the host and its subdomains where the path starts with the rule's path.
HOST_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
#: Glob patterns over host and path; `|` at the start anchors at the start of a host label, `*` is any run.
PATTERNS = [
    ("|ads-track.", "block"), ("|spam-farm.", "block"), ("|ads.", "block"), ("|adserver.", "block"), ("|doubleclick.", "block"),
    ("|casino-", "block"), ("|adult-", "block"), ("|cheap-pills.", "block"), ("|free-bets.", "block"), ("|track.*/pixel/", "block"), ("/ads/", "block"), ("/popup/", "block"), ("/wp-login.", "block"),
]
MARK = "\u0001"


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL: after the first `://`, host up to / ? # in lower case, path up to ? or #."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)://(.*)$", 1), F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def compile_rules(host_rules: list[tuple[str, str]], patterns: list[tuple[str, str]]) -> list[tuple]:
    """Rows (rule, verdict, expression, sure tokens, rank): rank is the rule's length, or 0 for patterns."""
    import re

    def tokens(text: str) -> list[str]:
        # a run is sure where something other than a letter or digit bounds it on both sides
        return sorted({m[1].lower() for m in re.finditer(r"(?<![A-Za-z0-9*])([A-Za-z0-9]+)(?=[^A-Za-z0-9*])", text)})

    def quoted(text: str) -> str:
        return re.sub(r"([^A-Za-z0-9\u0001/])", r"\\\1", text)

    out = []
    for rule, verdict in host_rules:
        host, slash, path = rule.partition("/")
        own = lower(host) + MARK + slash + path
        out.append((rule, verdict, rf"(?s)^(.*\.)?{quoted(own)}", tokens("." + own), len(rule)))
    for text, verdict in patterns:
        body = text.removeprefix("|")
        head = rf"(^|\.)(?=[^{MARK}]*{MARK})" if text != body else ""
        out.append((text, verdict, "(?s)" + head + ".*".join(quoted(x) for x in body.split("*")), tokens(("." if head else "*") + body + "*"), 0))
    return out


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def url_tokens(subject: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(subject), "[^a-z0-9]+"), lambda t: t != ""))


def rule_index(spark: SparkSession, rules: list[tuple], urls: DataFrame) -> DataFrame:
    """(token, rule, verdict, expression, rank): each rule under its rarest sure token in `urls(tokens)`, or under ''."""
    table = spark.createDataFrame(rules, "rule string, verdict string, expression string, tokens array<string>, rank int")
    wanted = table.select(F.explode("tokens").alias("token")).distinct()
    counts = urls.select(F.explode("tokens").alias("token")).join(F.broadcast(wanted), "token").groupBy("token").agg(F.count("*").alias("n"))
    keyed = table.select("*", F.explode_outer("tokens").alias("token")).join(counts, "token", "left")
    best = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("token", F.lit("")).alias("token"))).alias("best")
    return keyed.groupBy("rule", "verdict", "expression", "rank").agg(best).select(F.col("best.token").alias("token"), "rule", "verdict", "expression", "rank")


def filter_urls(pages: DataFrame, host_rules=HOST_RULES, patterns=PATTERNS, default: str = "allow", id_col: str = "page_id", url_col: str = "url", broadcast_rules: int = 100_000) -> DataFrame:
    """(id, host, path, rule, verdict) for every row. `rule` is the deciding host/path rule, else null."""
    host, path = parts(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path")).withColumn("_row", F.monotonically_increasing_id())
    urls = urls.withColumn("subject", F.concat("host", F.lit(MARK), "path")).withColumn("tokens", url_tokens(F.col("subject")))
    rules = compile_rules(host_rules, patterns)
    index = rule_index(pages.sparkSession, rules, urls)
    if len(rules) <= broadcast_rules:
        index = F.broadcast(index)
    fetched = urls.select("_row", "_id", "host", "path", "subject", F.explode(F.concat("tokens", F.array(F.lit("")))).alias("token")).join(index, "token", "left")
    fits = F.coalesce(F.regexp_like("subject", F.col("expression")), F.lit(False))
    told = fetched.select(
        "_row", "_id", "host", "path",
        F.when(fits & (F.col("rank") > 0), F.struct("rank", "rule", "verdict")).alias("own"),
        F.when(fits & (F.col("rank") == 0), F.col("verdict")).alias("pattern"),
    )
    best = told.groupBy("_row").agg(F.first("_id").alias(id_col), F.first("host").alias("host"), F.first("path").alias("path"), F.max("own").alias("own"), F.min("pattern").alias("pattern"))
    return best.select(id_col, "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "pattern", F.lit(default)).alias("verdict"))


def oracle(host_rules=HOST_RULES, patterns=PATTERNS, default: str = "allow") -> str:
    """The same decision as one SQL statement, every rule tried on every URL."""
    rows = ", ".join(f"('{r}', '{v}', '{e}', {k})" for r, v, e, _, k in ((r, v, e.replace(f"(?=[^{MARK}]*{MARK})", ""), t, k) for r, v, e, t, k in compile_rules(host_rules, patterns)))
    return f"""
WITH rules(rule, verdict, expression, rank) AS (VALUES {rows.replace(MARK, "' || chr(1) || '")}),
rest AS (SELECT page_id, coalesce(regexp_extract(url, '://(.*)$', 1, 's'), '') AS r FROM pages),
u AS (SELECT row_number() OVER () AS n, page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM rest),
f AS (SELECT n, rule, verdict, rank FROM u, rules WHERE regexp_matches(host || chr(1) || path, expression))
SELECT page_id, host, path, (SELECT arg_max(rule, rank) FROM f WHERE f.n = u.n AND rank > 0) AS rule,
  coalesce((SELECT arg_max(verdict, rank) FROM f WHERE f.n = u.n AND rank > 0), (SELECT min(verdict) FROM f WHERE f.n = u.n AND rank = 0), '{default}') AS verdict
FROM u"""
