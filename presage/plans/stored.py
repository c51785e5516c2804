"""Stored forms: rows of the given tables written as JSON, lines, XML or boards, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from presage.functions import web as W
from presage.plans.registry import Registry
from presage.session import checkpoint_dir, rounded, table
from presage.sources import fixtures as fx, readers as RD
from presage.sources.fixtures import with_views

Q = Registry()
_K = "(SELECT *, CAST(props->>'$.k' AS INTEGER) AS k FROM events)"


def _folder(spark, name: str) -> str:
    path = f"{checkpoint_dir(spark)}/presage-stored-{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def _events(spark, sf) -> DataFrame:
    return table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


@Q.add("stored_events", with_views("outcomes prices", """
SELECT market_id, outcome, n AS days, round(p, 10) AS last_price FROM outcomes JOIN (SELECT series_id, count(*) AS n, arg_max(probability, date) AS p FROM prices GROUP BY 1) s
  ON s.series_id = ['1-URGENT', '2-HIGH', '3-MEDIUM', 'none'][market_id % 4 + 1]"""))
def stored_events(spark, sf):
    """Event catalogue stored as JSON, read with the price series of its events; events without one are left out."""
    path = _folder(spark, "events")
    series = F.get(F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "none")]), (F.col("market_id") % 4).cast("int"))
    fx.outcomes(spark, sf).select("market_id", "outcome", series.alias("event_id")).write.json(path)
    prices = fx.prices(spark, sf).withColumnRenamed("series_id", "event_id")
    ev = RD.read_events(spark, path, "market_id long, outcome boolean, event_id string", prices, multi_line=False).filter("points is not null")
    last = F.array_max(F.map_keys("points"))
    return ev.select("market_id", "outcome", F.size("points").cast("long").alias("days"), rounded(F.try_element_at("points", last)).alias("last_price"))


@Q.add("stored_entries", with_views("claims", "SELECT source_id, count(*) AS n, round(avg(stance), 10) AS stance FROM claims GROUP BY 1"))
def stored_entries(spark, sf):
    """Claims stored in a folder per source, the source taken from the path."""
    path = _folder(spark, "entries")
    fx.claims(spark, sf).select("source_id", "claim_ix", "stance").write.partitionBy("source_id").json(path)
    e = RD.read_by_source(spark, path, "claim_ix long, stance double")
    return e.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("stance")).alias("stance"))


@Q.add("stored_ledger", f"""
SELECT event_type, count(*) AS good, sum(k)::BIGINT AS total, (SELECT count(*) FROM {_K} WHERE k % 7 <> 2) AS lines, (SELECT count(*) FROM {_K} WHERE k % 7 = 3) AS bad FROM {_K} WHERE k % 7 NOT IN (2, 3) GROUP BY 1""")
def stored_ledger(spark, sf):
    """JSON lines with blank and torn ones among them: good rows per type, and how many lines were bad."""
    path = _folder(spark, "ledger")
    line = F.to_json(F.struct("event_id", "event_type", "k"))
    m = F.col("k") % 7
    _events(spark, sf).select(F.when(m == 2, "  ").when(m == 3, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(path)
    led = RD.read_ledger(spark, path, "event_id long, event_type string, k int")
    return RD.good_rows(led).groupBy("event_type").agg(F.count(F.lit(1)).alias("good"), F.sum("k").alias("total")).crossJoin(F.broadcast(RD.bad_count(led)))


@Q.add("source_strata", with_views("registry", "SELECT source_id, country || ':' || language AS stratum FROM registry WHERE country IS NOT NULL"))
def source_strata(spark, sf):
    return RD.strata(fx.registry(spark, sf))


@Q.add("outlet_domains", r"""
SELECT host, 's' || arg_min(page_id % 50, page_id) AS source_id FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)), '^www\.', '') AS host FROM pages)
WHERE host <> '' AND page_id % 50 IN (SELECT DISTINCT user_id % 40 FROM events) GROUP BY 1""")
def outlet_domains(spark, sf):
    """Known source of each host, the first page's."""
    known = table(spark, sf, "events").select(F.concat(F.lit("s"), (F.col("user_id") % 40).cast("string")).alias("source_id")).distinct()
    p = table(spark, sf, "pages").select(W.host(F.col("url")).alias("host"), F.concat(F.lit("s"), (F.col("page_id") % 50).cast("string")).alias("source_id"), F.col("page_id").alias("ix"))
    return RD.outlet_domains(p, known)


def _raw_markets(spark, sf) -> DataFrame:
    k = F.col("k")
    yes = F.when(k % 4 == 0, "0.995").when(k % 4 == 1, "0.004").when(k % 4 == 2, "1.7").otherwise(F.format_string("0.%02d", k % 100))
    no = F.when(k % 4 == 0, "0.005").when(k % 4 == 1, "0.996").otherwise("0.5")
    names = F.when(k % 9 == 0, '["A","B","C"]').when(k % 9 == 1, '["Yes","Maybe"]').otherwise('["Yes","No"]')
    prices = F.concat(F.lit('["'), yes, F.lit('","'), no, F.lit('"]'))
    return _events(spark, sf).select(F.to_json(F.struct(
        F.col("event_id").cast("string").alias("id"), names.alias("outcomes"), prices.alias("outcomePrices"), (F.col("user_id") % 100 / 100).alias("lastTradePrice"),
        (F.col("user_id") % 2 == 0).alias("closed"), F.col("event_type").alias("question"), F.col("value").alias("volume"))).alias("j"))


_MARKETS = f"""m AS (SELECT event_id::VARCHAR AS market_id, user_id % 2 = 0 AS closed, CASE k % 4 WHEN 0 THEN 0.995 WHEN 1 THEN 0.004 WHEN 3 THEN (k % 100) / 100.0 END::DOUBLE AS yes_price, (user_id % 100) / 100.0::DOUBLE AS last, value, k,
  CASE WHEN user_id % 2 = 0 AND k % 4 = 0 THEN 'YES' WHEN user_id % 2 = 0 AND k % 4 = 1 THEN 'NO' END AS resolved_outcome FROM {_K} WHERE k % 9 > 1)"""


@Q.add("market_rows", f"WITH {_MARKETS} SELECT market_id, closed, yes_price, coalesce(yes_price, last) AS current_yes, resolved_outcome FROM m")
def market_rows(spark, sf):
    """Binary markets out of raw JSON with their price and resolution."""
    return RD.parse_markets(_raw_markets(spark, sf), "j").select("market_id", "closed", "yes_price", "current_yes", "resolved_outcome")


@Q.add("market_views", f"""WITH {_MARKETS} SELECT market_id, round_even(coalesce(yes_price, last) * 100, 0)::INT AS percent, round_even(value, 0)::BIGINT AS volume,
  CASE WHEN resolved_outcome IS NOT NULL THEN 'resolved ' || resolved_outcome WHEN closed THEN 'closed' ELSE 'open' END AS state FROM m""")
def market_views(spark, sf):
    return RD.market_summary(RD.parse_markets(_raw_markets(spark, sf), "j"))


_DAY = "DATE '2024-01-01' + CAST(page_id % 60 AS INTEGER)"


@Q.add("sitemap_urls", f"SELECT trim(url) AS url, {_DAY} AS date FROM pages WHERE page_id % 6 <> 5 AND {_DAY} BETWEEN DATE '2024-01-10' AND DATE '2024-02-10'")
def sitemap_urls(spark, sf):
    """Pages listed in a stored sitemap inside a date window; some have only a change date, some none."""
    path = _folder(spark, "sitemap")
    k, day = F.col("page_id"), F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("page_id") % 60).cast("int")).cast("string")
    rows = table(spark, sf, "pages").select(
        F.col("url").alias("loc"), F.when(k % 6 < 2, day).when(k % 6 < 5, "2020-05-05").alias("lastmod"),
        F.when((k % 6 > 1) & (k % 6 < 5), F.struct(F.concat(day, F.lit("T10:00:00Z")).alias("publication_date"))).alias("news"))
    rows.write.format("xml").option("rootTag", "urlset").option("rowTag", "url").save(path)
    return RD.read_sitemap(spark, path, "2024-01-10", "2024-02-10")


@Q.add("feed_items", f"""SELECT 'Page ' || page_id AS title, trim(url) AS url, CASE WHEN page_id % 4 = 3 THEN DATE '2024-01-10' ELSE {_DAY} END AS date FROM pages
WHERE page_id % 4 = 3 OR {_DAY} BETWEEN DATE '2024-01-10' AND DATE '2024-02-10'""")
def feed_items(spark, sf):
    """Items of a stored feed: the outlet is cut from the title, undated ones count as of the window's start."""
    path = _folder(spark, "feed")
    k, day = F.col("page_id"), F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("page_id") % 60).cast("int"))
    end = F.when(k % 3 == 0, " - The Paper").when(k % 3 == 1, " | Wire").otherwise(" — Daily")
    rows = table(spark, sf, "pages").select(
        F.concat(F.lit("Page "), k.cast("string"), end).alias("title"), F.col("url").alias("link"), F.when(k % 4 != 3, F.date_format(day, "EEE, d MMM yyyy '10:00:00 GMT'")).alias("pubDate"))
    rows.write.format("xml").option("rootTag", "channel").option("rowTag", "item").save(path)
    return RD.read_feed(spark, path, "2024-01-10", "2024-02-10")


@Q.add("stored_boards", with_views("claims", """
SELECT run_date, source_id, CASE run_date WHEN '2024-01-02' THEN n ELSE n + 1 END AS n FROM (SELECT source_id, count(*) AS n FROM claims GROUP BY 1), (SELECT unnest(['2024-01-01', '2024-01-02']) AS run_date)"""))
def stored_boards(spark, sf):
    """A board written on two dates, the first one run again: a run replaces only its own date."""
    path = _folder(spark, "board")
    board = fx.claims(spark, sf).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    RD.write_board(board, path, "2024-01-01")
    RD.write_board(board, path, "2024-01-02")
    RD.write_board(board.withColumn("n", F.col("n") + 1), path, "2024-01-01")
    return spark.read.schema("source_id string, n long, run_date string").json(path)


@Q.add("vote_export", f"""
SELECT event_id, 'a' AS source, 0.5::DOUBLE AS stance, k % 2 = 0 AS occurred FROM {_K} WHERE k % 3 <> 0
UNION ALL SELECT event_id, event_type, -0.25, CASE WHEN k % 2 = 0 THEN true END FROM {_K} WHERE k % 3 <> 0""")
def vote_export(spark, sf):
    """Votes unnested from JSON arrays, flags stored as text, as booleans or not at all."""
    k = F.col("k")
    first = F.concat(F.lit('{"source": "a", "stance": 0.5, "occurred": "'), (k % 2 == 0).cast("string"), F.lit('"}'))
    second = F.concat(F.lit('{"source": "'), F.col("event_type"), F.lit('", "stance": -0.25'), F.when(k % 2 == 0, ', "occurred": true').otherwise(""), F.lit("}"))
    rows = _events(spark, sf).select("event_id", F.when(k % 3 == 0, "[]").otherwise(F.concat(F.lit("["), first, F.lit(", "), second, F.lit("]"))).alias("j"))
    return RD.unnest_votes(rows, "event_id", "j")
