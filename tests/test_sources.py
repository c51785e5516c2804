"""Readers and sinks on small stored files, and the stream sinks."""

import json

from pyspark.sql import functions as F

from presage.sources import readers as RD
from presage.streaming import jobs as J


def test_ledger_skips_blank_and_counts_torn_lines(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"id": "a", "v": 1}\n\n  \n{"id": "b", "v"\n{"id": "c", "v": 3}\n')
    led = RD.read_ledger(spark, str(tmp_path / "l.jsonl"), "id string, v int")
    assert sorted((r.id, r.v) for r in RD.good_rows(led).collect()) == [("a", 1), ("c", 3)]
    assert RD.bad_count(led).first().bad == 1


def test_entries_take_their_keys_from_the_path(spark, tmp_path):
    d = tmp_path / "E1" / "s9"
    d.mkdir(parents=True)
    (d / "entry_1.json").write_text(json.dumps({"headline": "h"}))
    r = RD.read_entries(spark, str(tmp_path), "headline string").first()
    assert (r.headline, r.event_id, r.source_id) == ("h", "E1", "s9")


def test_markets(spark):
    rows = [{"id": "1", "outcomes": '["Yes","No"]', "outcomePrices": '["0.995","0.005"]', "closed": True}, {"id": "2", "outcomes": '["Yes","No"]', "outcomePrices": '["1.7","0"]', "lastTradePrice": 0.4, "closed": False},
            {"id": "3", "outcomes": '["A","B","C"]', "outcomePrices": "[]", "closed": False}]
    got = {r.market_id: r for r in RD.parse_markets(spark.createDataFrame([(json.dumps(r),) for r in rows], "j string"), "j").collect()}
    assert set(got) == {"1", "2"} and got["1"].resolved_outcome == "YES" and got["2"].yes_price is None and got["2"].current_yes == 0.4


def test_sitemap_and_feed(spark, tmp_path):
    (tmp_path / "s.xml").write_text("<urlset><url><loc>http://a/1</loc><lastmod>2024-01-05</lastmod></url><url><loc>http://a/2</loc></url><url><loc>http://a/3</loc><lastmod>2023-01-05</lastmod></url></urlset>")
    assert [r.url for r in RD.read_sitemap(spark, str(tmp_path / "s.xml"), "2024-01-01", "2024-01-31").collect()] == ["http://a/1"]
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>Rates fall - The Paper</title><link>http://b/1</link><pubDate>Fri, 05 Jan 2024 10:00:00 GMT</pubDate></item><item><title>Old</title><link>http://b/2</link></item></channel></rss>")
    got = {r.url: (r.title, str(r.date)) for r in RD.read_feed(spark, str(tmp_path / "f.xml"), "2024-01-01", "2024-01-31").collect()}
    assert got == {"http://b/1": ("Rates fall", "2024-01-05"), "http://b/2": ("Old", "2024-01-01")}


def test_board_sink_replaces_only_its_date(spark, tmp_path):
    b = spark.createDataFrame([("a", 1.0)], "id string, s double")
    for day in ("2024-01-01", "2024-01-02", "2024-01-02"):
        RD.write_board(b, str(tmp_path / "b"), day)
    assert spark.read.json(str(tmp_path / "b")).count() == 2


def test_ledger_sink_repeats_a_replayed_batch(spark, tmp_path):
    sink = J.append_once_sink(str(tmp_path / "led"), "k")
    mk = lambda rows: spark.createDataFrame(rows, "k string, v int")
    sink(mk([("a", 1), ("b", 2)]), 0)
    sink(mk([("b", 9), ("c", 3)]), 1)
    sink(mk([("b", 9), ("c", 3)]), 1)
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "led")).select("k", "v").collect()) == [("a", 1), ("b", 2), ("c", 3)]


def test_a_table_of_many_splits_comes_in_as_many_batches(spark):
    """One micro-batch an arrival, in order, though the table has more splits than arrivals."""
    seen = []
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        stream = J.table_stream(spark, "/root/testdata/sf0.001", "events")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert spark.read.parquet("/root/testdata/sf0.001/events.parquet").count() >= 60

    def write(batch, epoch):
        seen.append(batch.agg(F.min("event_id"), F.max("event_id"), F.count("event_id")).first())

    stream.writeStream.trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    assert len(seen) == 6 and sum(x[2] for x in seen) == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    assert all(a[1] < b[0] for a, b in zip(seen, seen[1:]))
