from datetime import datetime

import duckdb

from ionquarry.llm import warc

SCHEMA = "record_id long, url string, at timestamp, kind string, etag string, last_modified string, headers map<string,string>, payload string"


def test_resolution(spark):
    t = lambda d, h=0: datetime(2024, 1, d, h)
    rows = [
        (1, "http://A.com/x#f", t(1), "response", "e1", None, {"ETag": "e1", "Type": "h"}, "one"),
        (2, "https://a.com:443/x/", t(2), "response", "e2", None, {"ETag": "e2", "Type": "h"}, "two"),
        (3, "http://a.com/x", t(2), "revisit", "e1", None, {"Date": "d", "Type": "no"}, None),
        (4, "http://a.com/x", t(9), "revisit", "e2", None, None, None),
        (5, "http://a.com/x", t(9, 1), "revisit", "e1", None, {}, None),
        (6, "http://b.com/", t(1), "revisit", None, None, {}, None),
        (7, None, t(1), "revisit", None, None, {}, None),
    ]
    got = {x.record_id: (x.status, x.source_id, x.payload, x.headers) for x in warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {
        3: ("resolved", 1, "one", {"ETag": "e1", "Type": "h", "Date": "d"}),
        4: ("resolved", 2, "two", {"ETag": "e2", "Type": "h"}),
        5: ("mismatch", 2, None, None),
        6: ("missing", None, None, None),
        7: ("missing", None, None, None),
    }


def test_repeated_records_give_one_row_each(spark):
    t = lambda h: datetime(2024, 1, 1, h)
    response = (1, "http://a.com/", t(1), "response", "e", None, {"Type": "h"}, "one")
    revisit = (2, "http://a.com/", t(2), "revisit", "e", None, {"Date": "d"}, None)
    rows = [response, response, (1, "http://b.com/", t(1), "response", "x", None, None, "b"), revisit, revisit, (2, "http://b.com/", t(2), "revisit", "x", None, None, None)]
    rows += [(9, "http://c.com/", t(1), "response", "1", None, None, "low"), (10, "http://c.com/", t(1), "response", "2", None, None, "high"), (11, "http://c.com/", t(3), "revisit", None, None, None, None)]
    got = sorted((x.record_id, x.status, x.source_id, x.payload) for x in warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(2, "resolved", 1, "b"), (2, "resolved", 1, "one"), (2, "resolved", 1, "one"), (11, "resolved", 10, "high")]


def test_clashing_columns(spark):
    row = (1, "http://a.com/", datetime(2024, 1, 1), "revisit", None, None, None, None, 5, 6, 7)
    got = warc.resolve_revisits(spark.createDataFrame([row], SCHEMA + ", _url int, status int, _k1 int"))
    assert [tuple(x) for x in got.collect()] == [(1, "missing", None, None, None)]


def test_report_equals_its_sql(spark, tmp_path):
    rows = [(i, [f"http://h{i % 9}.com/a?b=1/", f"HTTPS://www.H{i % 9}.com:443/a?b=1#f", None, "no scheme", "ftp://x.org:80/"][i % 5], None if i % 13 == 0 else f"<p>{i}</p>") for i in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.coalesce(1).write.parquet(str(tmp_path / "pages"))
    duck = duckdb.connect()
    duck.sql("SET timezone = 'UTC'")
    duck.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages/*.parquet'")
    found = warc.revisit_report(pages)
    expected = duck.sql(warc.ORACLE_SQL)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, expected.select(*found.columns).fetchall()))


def test_empty_table(spark):
    assert warc.resolve_revisits(spark.createDataFrame([], SCHEMA)).collect() == []


def test_records_of_pages_are_interleaved(spark):
    pages = spark.createDataFrame([(i, f"http://h{i}.com/", f"<p>{i}</p>") for i in (3, 5, 7)], "page_id long, url string, html string")
    records = warc.records_of_pages(pages)
    found = {x.record_id: x for x in warc.resolve_revisits(records).collect()}
    for i in (3, 5, 7):
        got = {k: (found[8 * i + k].status, found[8 * i + k].source_id, found[8 * i + k].payload) for k in (0, 2, 4, 5)}
        assert got == {
            0: ("missing", None, None),
            2: ("resolved", 8 * i + 1, f"<p>{i}</p>"),
            4: ("resolved", 8 * i + 3, f"<p>{i}</p><!-- changed -->"),
            5: ("mismatch", 8 * i + 3, None),
        }
    rows = records.collect()
    assert all(x.last_modified for x in rows) and {x.etag is None for x in rows} == {True, False}


def test_pages_of_one_url_share_its_responses(spark):
    pages = spark.createDataFrame([(i, "http://hot.com/", f"<p>{i}</p>") for i in range(60)], "page_id long, url string, html string")
    records = warc.records_of_pages(pages)
    rows, found = records.collect(), {x.record_id: x for x in warc.resolve_revisits(records).collect()}
    for x in rows:
        if x.kind == "revisit":
            before = [y for y in rows if y.kind == "response" and y.at < x.at]
            last = max(before, key=lambda y: (y.at, y.record_id), default=None)
            same = last and (x.etag == last.etag if x.etag and last.etag else x.last_modified == last.last_modified)
            assert found[x.record_id].status == ("missing" if not last else "resolved" if same else "mismatch")
            assert found[x.record_id].source_id == (last.record_id if last else None)
