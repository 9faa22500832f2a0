"""URL filters: pattern rules indexed by their rarest literal token; a URL's tokens fetch the rules that run as regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionquarry.llm.common import ascii_lower, chosen_name, cut

#: tier, host, path, verdict; the lowest tier with a fitting rule decides.
RULES = [
    (0, "com", "/en/", "block"),
    (0, "example.com", "/en/7", "allow"),
    (0, "net", "/de/", "allow"),
    (0, "example.net", "/de/8", "block"),
    (0, "org", "/es/", "block"),
    (1, "spam-farm.*", "", "block"),
    (1, "casino.*", "", "block"),
    (1, "", "/*/porn/", "block"),
    (1, "", "/wp-login.php", "block"),
]
#: Rules with at most so many bytes are broadcast; larger tables are joined by a shuffle.
BROADCAST_BYTES = 8 << 20
_RULE = "tier int, host string, path string, verdict string"
_ADDED = ("host", "path", "rule", "tier", "verdict")
_TOKEN = "[0-9A-Za-z]+"


def rules_table(spark: SparkSession, rules: list[tuple[int, str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, _RULE)


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def _escaped(text: Column, any_run: str) -> Column:
    return F.replace(F.regexp_replace(text, r"([^0-9A-Za-z*/_])", r"\\$1"), F.lit("*"), F.lit(any_run))


def index_rules(rules: DataFrame, keys: DataFrame) -> DataFrame:
    """``rules`` with pattern, name and token: the literal token that the fewest ``keys`` (token) hold.

    Only tokens that every fitting URL holds whole are considered: those closed on both sides inside the rule. A rule
    without any goes under the empty token, which every URL holds.
    """
    named = rules.select(
        "tier", F.concat("host", "path").alias("name"), "verdict",
        F.concat(F.lit("(?s)^"), F.when(F.col("host") == "", F.lit("[^/]*")).otherwise(F.concat(F.lit(r"([^/]*\.)?"), _escaped(F.col("host"), "[^/]*"))), F.when(F.col("path") == "", F.lit("(/|$)")).otherwise(_escaped(F.col("path"), ".*"))).alias("pattern"),
        F.regexp_extract_all(F.concat("host", F.when(F.col("path") == "", F.lit("/")).otherwise(F.col("path"))), F.lit(f"(?<![*0-9A-Za-z])({_TOKEN})(?=[^*0-9A-Za-z])"), F.lit(1)).alias("tokens"),
    ).distinct()
    wanted = named.select(F.explode("tokens").alias("token")).distinct()
    held = keys.join(wanted, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("held"))
    offered = named.withColumn("token", F.explode("tokens")).join(held, "token", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    chosen = offered.groupBy("tier", "name", "verdict", "pattern").agg(F.min_by("token", F.struct("held", "token")).alias("token"))
    return chosen.unionByName(named.filter(F.size("tokens") == 0).select("tier", "name", "verdict", "pattern", F.lit("").alias("token")))


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (host and path of the rule that decides), its tier and verdict, or nulls.

    A rule (tier, host, path, verdict) fits the URLs of its host and all subdomains whose path starts with its own; ``*``
    stands for any run of characters, an empty host for all hosts, an empty path for all paths. The lowest tier decides,
    in it the longest rule, then the name that sorts first, block before allow. Each distinct host and path is tokenised
    once; only the rules under one of its tokens are run.

    A null URL and one without ``://`` have empty host and path. Rules with a null column are left out, repeated rules
    count once. Repeated pages are judged alike. Columns of ``pages`` with an added name are replaced.
    """
    rules = rules.select(_RULE.replace(" int", "").replace(" string", "").split(", ")).dropna()
    out = pages.drop(*[c for c in pages.columns if c.lower() in _ADDED])
    key, decided_key = chosen_name(out, "url_key"), chosen_name(out, "decided_key")
    out = out.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))}).withColumn(key, F.concat("host", "path"))
    keys = cut(out.select(F.col(key).alias("url_key")).distinct())
    tokens = F.array_union(F.array(F.lit("")), F.regexp_extract_all("url_key", F.lit(f"({_TOKEN})"), F.lit(1)))
    entries = keys.filter("url_key <> ''").select("url_key", F.explode(tokens).alias("token"))
    index = cut(index_rules(rules, entries.select("token")))
    size = index.agg(F.sum(F.length("pattern") + F.length("name") + F.length("token"))).first()[0] or 0
    fits = entries.join(F.broadcast(index) if size <= BROADCAST_BYTES else index, "token").filter(F.expr("url_key RLIKE pattern"))
    best = F.min_by(F.struct(F.col("name").alias("rule"), "tier", "verdict"), F.struct("tier", -F.length("name"), "name", F.col("verdict") != "block"))
    decided = fits.groupBy("url_key").agg(best.alias("best")).select(F.col("url_key").alias(decided_key), "best.*")
    return out.join(decided, F.col(key) == F.col(decided_key), "left").drop(key, decided_key)


def verdict_report(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule (of tier 0), verdict, own_rule (of the further tiers); without a fitting rule, allow."""
    found = filter_urls(pages.select("page_id", "url"), rules_table(pages.sparkSession))
    return found.select("page_id", "host", "path", F.when(F.col("tier") == 0, F.col("rule")).alias("rule"), F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.when(F.col("tier") > 0, F.col("rule")).alias("own_rule"))


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
q AS (
  SELECT *, CASE
      WHEN regexp_matches(host, '(^|\.)example\.com$') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
      WHEN regexp_matches(host, '(^|\.)example\.net$') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
      WHEN regexp_matches(host, '(^|\.)com$') AND starts_with(path, '/en/') THEN 'com/en/'
      WHEN regexp_matches(host, '(^|\.)net$') AND starts_with(path, '/de/') THEN 'net/de/'
      WHEN regexp_matches(host, '(^|\.)org$') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule,
    CASE
      WHEN regexp_matches(host, '(^|\.)spam-farm\.') THEN 'spam-farm.*'
      WHEN path LIKE '/%/porn/%' THEN '/*/porn/'
      WHEN regexp_matches(host, '(^|\.)casino\.') THEN 'casino.*'
      WHEN starts_with(path, '/wp-login.php') THEN '/wp-login.php' END AS own
  FROM p)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN own IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN rule IS NULL THEN own END AS own_rule
FROM q
"""
