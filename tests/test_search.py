"""Article scan and entity search on odd rows."""

import datetime as dt

import pytest

from presage.functions import web as W
from presage.operators import search as SE

LONG = "w " * 300
D = dt.date
SCHEMA = "page_id long, url string, host string, body string, published date"


def test_article_scan(spark):
    rows = [(1, "http://a/x", "a", LONG, D(2024, 1, 10)), (2, "http://a/LiveBlog/y", "a", LONG, D(2024, 1, 10)), (3, "http://a/z", "a", "short", D(2024, 1, 10)),
            (4, "http://a/q", "a", "Bloomberg Quicktake " + LONG, D(2024, 1, 10)), (5, None, "a", LONG, None), (6, "u", "a", LONG, D(2024, 2, 1)), (7, "u", "a", None, None)]
    got = SE.article_scan(spark.createDataFrame(rows, SCHEMA), "body", "url", "published", "2024-01-01", "2024-01-31")
    assert sorted(r["page_id"] for r in got.collect()) == [1, 5]


def search(spark, rows, query, **more):
    return [r["page_id"] for r in SE.entity_search(spark.createDataFrame(rows, SCHEMA), query, ["body", "url"], "page_id", "url", "published", "2024-01-01", "2024-01-31", "host", **more).collect()]


def test_entity_search(spark):
    day = lambda d: D(2024, 1, d)
    rows = [(1, "u1", "a.org", "about NORWAY today", day(3)), (2, "u2", "a.org", None, day(4)), (3, "http://x/norway-votes", "b.org", None, day(5)), (4, "u1", "a.org", "norway again", day(6)),
            (5, "", "a.org", "norway", day(7)), (6, "u6", "a.org", "norway", None), (7, "u7", "a.org", "norway", D(2024, 3, 1)), (8, "u8", "a.org", "Oslo and the (North) sea", day(6)), (9, None, "a.org", "norway", day(8))]
    assert search(spark, rows, "Will Norway win?") == [4, 3]
    assert search(spark, rows, "Norway Oslo", domains=["http://B.org"]) == [3]
    assert search(spark, rows, "Norway or Oslo", domains=["https://www.A.org/path", " "]) == [4, 8]
    assert search(spark, rows, "Norway", limit=1) == [4]
    assert search(spark, rows, "Norway", max_rows=1) == [4]
    assert search(spark, [], "Norway") == []
    with pytest.raises(Exception, match="no entity terms"):
        search(spark, rows, "will it rain?")


def test_pages_are_read_one_at_a_time(spark):
    """As Arrow arrays, longer than one run; a null page stays null. It took whole batches as Python strings before."""
    from pyspark.util import PythonEvalType

    pages = [(i, None if i % 7 == 0 else f"<html><body><p>page {i}</p></body></html>") for i in range(600)]
    got = spark.createDataFrame(pages, "i int, html string").coalesce(1).select("i", W.page_text("html").alias("t")).collect()
    assert {r.i: r.t for r in got} == {i: None if h is None else f"page {i}" for i, h in pages}
    assert W.page_text.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF
