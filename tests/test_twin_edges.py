"""Rows on which an operator and its SQL twin read text or time differently."""

import duckdb
import pytest
from twin import compare

import __spark_entry__ as entry

DOCS = [(0, "Der Maß ßöder", None), (1, "acht 120.103 éch", None), (2, None, None), (4, "ßöne, Straße; İstan", None), (9, "rate £ 5 ₪3 €7 \U0001F600 km 4,000 \U0001F600\u20ad", None), (8, "plain words / é 4", None)]
ITEMS = [(0, "SSö Der Maß Straße"), (1, "Zürich Über Maß"), (2, "İstan ΣΑΣ Straße"), (3, "Ab")]
BODY = "word and word " * 30
PAGES = [(1, "http://www.a.example/x", f"<html><title>one &&&amp two</title><body><p>{BODY}</p></body></html>"), (2, "http://b.example/", f"<article>{BODY}a&nbsp;b &#8217; &amp;lt; &lt;b&gt; &copy c</article>")]
EVENTS = [(0, "2024-01-01 23:59:59.7", 1), (1, "2024-01-01 23:59:59.2", 1), (2, "2024-01-03 23:59:58.5", 2), (3, "2024-01-03 23:59:59.5", 2), (4, "2024-01-02 00:00:00", 1)]


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    """Folder of the four tables, and a DuckDB connection that sees them."""
    folder, con = tmp_path_factory.mktemp("edges"), duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    tables = {"documents": ("doc_id BIGINT, text VARCHAR, source VARCHAR", DOCS), "benchmark": ("item_id BIGINT, text VARCHAR", ITEMS), "pages": ("page_id BIGINT, url VARCHAR, html VARCHAR", PAGES),
              "events": ("event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR", [(*e, "view", 60.0, '{"k": 3}') for e in EVENTS])}
    for name, (columns, rows) in tables.items():
        con.execute(f"CREATE TABLE {name} ({columns})")
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
        con.execute(f"COPY {name} TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder), con


@pytest.mark.parametrize("name", ["document_aliases", "page_articles", "threshold_questions", "stream_fixed_windows"])
def test_edge_rows(spark, made, name):
    folder, con = made
    assert compare(spark, con, folder, entry.queries()[name], entry.oracle_sql()[name]) is None
