"""Not-modified captures resolved to the latest earlier full response of the same canonical URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from presage.session import cut_lineage

#: Fields a 304 response may update in the stored one.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path without trailing slashes, query without tracking fields; no scheme, no fragment."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"\?(.*)$", 1), r"(^|&)(utm_[^&=]*|fbclid|gclid)(=[^&]*)?", ""), r"^&", "")
    return F.nullif(F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")), F.lit(""))


def header(headers: Column, name: str) -> Column:
    return F.element_at(headers, F.lit(name))


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, url_key, status, response_id, headers.

    ``records``: record_id, url, at (time), kind ("response", "revisit"; others
    are ignored), headers (map with lower-case names). status is

    - ``no_url``: null or empty canonical URL,
    - ``no_response``: no full response strictly earlier under that URL,
    - ``no_validator``: the revisit has neither etag nor last-modified,
    - ``mismatch``: the latest earlier response has other validators (weak
      comparison of etags; last-modified counts where an etag is missing),
    - ``resolved``: then headers are the response's, updated by the revisit's
      permitted fields.

    response_id is the latest earlier response in all but the first two cases;
    headers are null unless resolved. Of responses of one time the largest
    record_id counts; rows with a null time come before all others. Repeated
    rows repeat. The as-of join keeps no URL in one task: rows are dealt by
    ranges of (URL, time), each range looks back inside itself, and the last
    response of earlier ranges comes from a table with a row per range.
    """
    key = canonical(F.col("url"))
    rows = records.filter(F.col("kind").isin("response", "revisit")).select(
        "record_id", key.alias("url_key"), F.col("at").alias("at"), (F.col("kind") == "response").alias("full"), "headers")
    lost = rows.filter("url_key is null and not full").select("record_id", "url_key", F.lit("no_url").alias("status"), F.lit(None).cast("long").alias("response_id"), F.lit(None).cast("map<string,string>").alias("headers"))
    dealt = cut_lineage(rows.filter("url_key is not null").repartitionByRange("url_key", F.col("at").asc_nulls_first(), "full", "record_id").withColumn("range", F.spark_partition_id()))
    answer = F.struct(F.col("record_id").alias("id"), F.col("headers").alias("headers"))
    order = [F.col("at").asc_nulls_first(), F.col("full"), F.col("record_id")]  # a revisit comes before responses of its time
    near = F.last(F.when(F.col("full"), answer), ignorenulls=True).over(Window.partitionBy("range", "url_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    spread = dealt.groupBy("url_key").agg(F.min("range").alias("low"), F.max("range").alias("high")).filter("low < high").select("url_key")
    ends = dealt.join(spread, "url_key").groupBy("url_key", "range").agg(
        F.max_by(F.when(F.col("full"), answer), F.when(F.col("full"), F.struct(F.coalesce(F.col("at").cast("double"), F.lit(float("-inf"))), "record_id"))).alias("end"))
    before = F.last("end", ignorenulls=True).over(Window.partitionBy("url_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.withColumn("far", before).select(F.col("url_key").alias("k"), F.col("range").alias("r"), "far")
    looked = dealt.withColumn("near", near).filter("not full").join(carried.hint("merge"), (F.col("url_key") == F.col("k")) & (F.col("range") == F.col("r")), "left")
    found = looked.withColumn("hit", F.coalesce("near", "far"))
    mine, theirs = F.col("headers"), F.col("hit.headers")
    tag, other = (F.regexp_replace(header(h, "etag"), "^W/", "") for h in (mine, theirs))
    since, other_since = header(mine, "last-modified"), header(theirs, "last-modified")
    same = F.when(tag.isNotNull() & other.isNotNull(), tag == other).when(since.isNotNull() & other_since.isNotNull(), since == other_since).otherwise(False)
    status = F.when(F.col("hit").isNull(), "no_response").when(tag.isNull() & since.isNull(), "no_validator").when(same, "resolved").otherwise("mismatch")
    fresh = F.map_filter(mine, lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~F.array_contains(F.map_keys(fresh), k)), fresh)
    told = found.select("record_id", "url_key", status.alias("status"), F.col("hit.id").alias("response_id"), "headers", "hit").select(
        "record_id", "url_key", "status", "response_id", F.when(F.col("status") == "resolved", merged).alias("headers"))
    return told.unionByName(lost)


def capture_log(pages: DataFrame) -> DataFrame:
    """Records a crawler would have written for the pages: a full response each, and later not-modified captures.

    Per page: the response, a revisit under another spelling of its URL (every
    seventh with another etag, every eleventh without validators), and for
    every third page a revisit before any response.
    """
    page = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("hash"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string").alias("size"))
    at = (F.col("page_id") * 1000).cast("long")
    full = page.select((F.col("page_id") * 4).alias("record_id"), "url", at.alias("at"), F.lit("response").alias("kind"), F.create_map(
        F.lit("etag"), F.concat(F.lit('"'), "hash", F.lit('"')), F.lit("date"), F.concat(F.lit("day "), at.cast("string")), F.lit("content-length"), F.col("size"), F.lit("content-type"), F.lit("text/html")).alias("headers"))
    spelled = F.concat(F.lit("HTTPS://www."), F.regexp_replace("url", "^https?://(www\\.)?", ""))
    tag = F.when(F.col("page_id") % 7 == 0, F.lit('"changed"')).otherwise(F.concat(F.lit('W/"'), "hash", F.lit('"')))
    headers = F.map_filter(F.create_map(F.lit("etag"), F.when(F.col("page_id") % 11 != 0, tag), F.lit("date"), F.concat(F.lit("day "), (at + 500).cast("string")), F.lit("content-length"), F.lit("0")), lambda k, v: v.isNotNull())
    later = page.select((F.col("page_id") * 4 + 1).alias("record_id"), spelled.alias("url"), (at + 500).alias("at"), F.lit("revisit").alias("kind"), headers.alias("headers"))
    early = page.filter("page_id % 3 = 0").select((F.col("page_id") * 4 + 2).alias("record_id"), "url", F.lit(-1).cast("long").alias("at"), F.lit("revisit").alias("kind"), headers.alias("headers"))
    return full.unionByName(later).unionByName(early)
