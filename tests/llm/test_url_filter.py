import re

import pytest

from ionquarry.llm import url_filter as U

SCHEMA = "page_id long, url string"
HOSTS = ["com", "example.com", "EXAMPLE.com", "a.example.com", "notexample.com", "example.net", "x.example.net", "b.org", "orgs", "spam-farm.io", "www.spam-farm.co.uk", "my-spam-farm.io", "casino.biz", "user@h.com:80", ""]
PATHS = ["", "/", "/en/", "/en/7", "/en/71/x", "/en/8", "/de/8", "/de/9", "/es/", "/ES/", "/x/porn/y", "/porn/", "/wp-login.php?x=1", "/a#/en/", "?q=/en/"]


def brute(url, rules):
    """(host, path, name and verdict of the deciding rule), by running each rule."""
    rest = (url or "").partition("://")[2]
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    host = "".join(c.lower() if c < "\x80" else c for c in host)
    if not host + path:
        return host, path, None, None
    fits = []
    for tier, h, p, verdict in rules:
        of_host = "[^/]*" if not h else r"([^/]*\.)?" + re.escape(h).replace(r"\*", "[^/]*")
        of_path = "(/|$)" if not p else re.escape(p).replace(r"\*", ".*")
        if re.match(of_host + of_path, host + path, re.S):
            fits.append((tier, -len(h + p), h + p, verdict != "block", verdict))
    best = min(fits, default=(None, None, None, None, None))
    return host, path, best[2], best[4]


@pytest.mark.parametrize("rules", [U.RULES, [(0, "c*m", "/en/*7", "block"), (0, "", "", "allow"), (1, "", "/a.b+c", "block"), (0, "example.com", "", "block"), (0, "example.com", "", "allow")]])
def test_verdicts_equal_those_of_all_rules(spark, rules):
    urls = [f"{s}{h}{p}" for s in ("http://", "x://", "") for h in HOSTS for p in PATHS] + [None, "", "://", "http://a://b/en/", "http://a.com/a.b+c", "http://a.com/aXb+c", "http://é.com/en/\n"]
    rows = list(enumerate([*urls, urls[0]]))
    found = U.filter_urls(spark.createDataFrame(rows, SCHEMA), U.rules_table(spark, rules)).collect()
    assert len(found) == len(rows)
    assert {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in found} == {i: brute(u, rules) for i, u in rows}


def test_clashing_names_null_rules_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/x", "k", "d", "b", "t", 0)], SCHEMA + ", url_key string, decided_key string, best string, token string, Tier int")
    rules = spark.createDataFrame([(0, "com", "/en/", "block"), (0, "com", "/en/", "block"), (0, None, "/en/x", "allow")], U._RULE)
    out = U.filter_urls(pages, rules)
    assert set(out.columns) == {"page_id", "url", "url_key", "decided_key", "best", "token", "host", "path", "rule", "tier", "verdict"}
    assert [(x.url_key, x.decided_key, x.rule, x.verdict) for x in out.collect()] == [("k", "d", "com/en/", "block")]
    assert U.verdict_report(spark.createDataFrame([], SCHEMA)).collect() == []
    none = spark.createDataFrame([], U._RULE)
    assert [x.rule for x in U.filter_urls(pages, none).collect()] == [None]
