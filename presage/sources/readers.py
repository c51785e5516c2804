"""Readers and writers for the stored forms: JSON, XML, log lines, boards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def series_maps(prices: DataFrame) -> DataFrame:
    """One date -> probability map per series; a day appears once, so the calendar bounds it."""
    return prices.groupBy("series_id").agg(F.map_from_entries(F.collect_list(F.struct("date", "probability"))).alias("points"))


def read_events(spark: SparkSession, path: str, schema: str, prices: DataFrame | None = None, require_prices: bool = False,
                multi_line: bool = True) -> DataFrame:
    """Event catalogue of one JSON document per file (or per line), with price series attached."""
    ev = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    if prices is None:
        return ev
    if require_prices:
        return ev.join(prices.select("event_id").distinct(), "event_id", "left_semi")
    return ev.join(series_maps(prices.withColumnRenamed("event_id", "series_id")).withColumnRenamed("series_id", "event_id"), "event_id", "left")


def read_entries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Entries laid out as ``event/source/entry_*.json``; the keys come from the path."""
    f = F.col("_metadata.file_path")
    raw = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return raw.select("*", F.regexp_extract(f, "([^/]+)/[^/]+/entry_[^/]*$", 1).alias("event_id"), F.regexp_extract(f, "([^/]+)/entry_[^/]*$", 1).alias("source_id"))


def read_by_source(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Entries as JSON lines in a folder per source; the source comes from the path."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).json(path).select(
        "*", F.regexp_extract(F.col("_metadata.file_path"), "/source_id=([^/]+)/", 1).alias("source_id"))


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines vanish and a line that is no JSON keeps its text in ``bad``."""
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    row = F.from_json("value", f"{schema}, bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    return lines.select(row.alias("r")).select("r.*")


def good_rows(ledger: DataFrame) -> DataFrame:
    return ledger.filter("bad is null").drop("bad")


def bad_count(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.count(F.lit(1)).alias("lines"), F.count("bad").alias("bad"))


def strata(registry: DataFrame) -> DataFrame:
    """source -> country:language; rows without either are dropped."""
    return registry.select("source_id", F.when(F.col("country").isNotNull() & F.col("language").isNotNull(), F.concat_ws(":", "country", "language")).alias("stratum")).dropna()


def parse_markets(raw: DataFrame, json: str) -> DataFrame:
    """Binary markets from raw JSON: arrays may be nested JSON strings.

    Non-binary rows are dropped, prices outside [0, 1] become null, and a closed
    market at 0.99 / 0.01 counts as resolved.
    """
    m = F.from_json(json, "id string, outcomes string, outcomePrices string, lastTradePrice double, closed boolean, question string, volume double")
    rows = raw.select(m.alias("m")).select("m.*")
    rows = rows.withColumns({"names": F.from_json("outcomes", "array<string>"), "quoted": F.from_json("outcomePrices", "array<string>")})
    valid = lambda x: F.when(x.between(0.0, 1.0), x)
    yes, no = F.get("quoted", F.lit(0)).try_cast("double"), F.get("quoted", F.lit(1)).try_cast("double")
    resolved = F.when(F.col("closed") & (yes >= 0.99) & (no <= 0.01), "YES").when(F.col("closed") & (no >= 0.99) & (yes <= 0.01), "NO")
    return rows.filter((F.size("names") == 2) & (F.lower(F.get("names", F.lit(0))) == "yes") & (F.lower(F.get("names", F.lit(1))) == "no")).select(
        F.col("id").alias("market_id"), "question", "closed", "volume", valid(yes).alias("yes_price"), F.coalesce(valid(yes), valid(F.col("lastTradePrice"))).alias("current_yes"), resolved.alias("resolved_outcome"))


def read_sitemap(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """URLs of stored sitemaps inside a date window; undated ones are dropped."""
    rows = spark.read.format("xml").option("rowTag", "url").option("ignoreNamespace", True).schema(
        "loc string, lastmod string, news struct<publication_date:string>").load(path)
    day = F.coalesce(F.try_to_date(F.substring("news.publication_date", 1, 10), "yyyy-MM-dd"), F.try_to_date(F.substring("lastmod", 1, 10), "yyyy-MM-dd"))
    return rows.select(F.trim("loc").alias("url"), day.alias("date")).filter(F.col("date").between(start, end))


def read_feed(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Items of stored feeds: outlet suffix cut from the title, undated at the window's start."""
    rows = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, pubDate string").load(path)
    day = F.coalesce(F.try_to_date(F.regexp_extract("pubDate", "(\\d{1,2} [A-Za-z]{3} \\d{4})", 1), "d MMM yyyy"), F.to_date(F.lit(start)))
    return rows.select(F.trim(F.regexp_replace("title", "^(.*)(?: - | \\| | — ).*$", "$1")).alias("title"), F.trim("link").alias("url"), day.alias("date")).filter(
        F.col("date").between(start, end))


def write_board(board: DataFrame, path: str, run_date: str, by: list[str] | None = None) -> None:
    """A board as JSON, partitioned by run date and further keys; a re-run replaces its own date."""
    board.withColumn("run_date", F.lit(run_date)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date", *(by or [])).json(path)


def outlet_domains(sources: DataFrame, known: DataFrame) -> DataFrame:
    """Host -> source among the known sources; the first one of a host wins."""
    named = sources.filter(F.coalesce("host", F.lit("")) != "").join(known.select("source_id"), "source_id", "left_semi")
    return named.groupBy("host").agg(F.min_by("source_id", "ix").alias("source_id"))


def market_summary(markets: DataFrame) -> DataFrame:
    """Compact view: price in whole percent, rounded volume, state."""
    state = F.when(F.col("resolved_outcome").isNotNull(), F.concat(F.lit("resolved "), "resolved_outcome")).when(F.col("closed"), "closed").otherwise("open")
    return markets.select("market_id", F.bround(F.col("current_yes") * 100, 0).cast("int").alias("percent"), F.bround("volume", 0).cast("long").alias("volume"), state.alias("state"))


def unnest_votes(rows: DataFrame, key: str, json: str) -> DataFrame:
    """One row per element of a JSON array of votes; flags come as text or as booleans."""
    votes = F.from_json(json, "array<struct<source:string, stance:double, occurred:string>>")
    flag = F.lower(F.col("v.occurred"))
    return rows.select(key, F.explode(votes).alias("v")).select(
        key, F.col("v.source").alias("source"), F.col("v.stance").alias("stance"), F.when(flag == "true", True).when(flag == "false", False).alias("occurred"))
