"""Stored articles of a window, and search for the entities of a question."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from presage.functions import web as W


def article_scan(rows: DataFrame, text: str, url: str, day: str, start: str, end: str, min_chars: int = 500) -> DataFrame:
    """Rows inside the window, or undated, that are no liveblog, no stub page and not too short."""
    inside = F.coalesce(F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date")), F.lit(True))
    return rows.filter(inside & ~W.is_liveblog(F.col(url)) & (F.length(text) >= min_chars) & ~W.is_stub(F.col(text)))


def entity_search(rows: DataFrame, query: str, columns: Sequence[str], key: str, url: str, day: str, start: str, end: str,
                  domain: str | None = None, domains: Sequence[str] = (), limit: int = 25, max_rows: int | None = None) -> DataFrame:
    """A capped report: newest rows, one per URL, that hold one of the query's entity terms in any column.

    Terms are the capitalised phrases and names of ``query``, found as they
    stand in either case; a query without any fails. Undated rows and rows
    without a URL are not found. At most ``max_rows`` (four times the limit, at
    most 100) newest rows are looked at for distinct URLs.
    """
    terms = F.transform(W.query_terms(F.lit(query)), lambda t: F.lower(t))

    def holds(column: str) -> Column:
        return F.exists(terms, lambda t: F.coalesce(F.lower(column), F.lit("")).contains(t))

    held = reduce(lambda a, b: a | b, [holds(c) for c in columns])
    named = F.when(F.size(terms) == 0, F.raise_error(F.lit("no entity terms in the query"))).otherwise(held)
    found = rows.filter(F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date")) & (F.col(url) != ""))
    wanted = [d for d in dict.fromkeys(map(W.bare_domain, domains)) if d]
    if wanted:
        found = found.filter(F.col(domain).isin(wanted))
    newest = [F.desc(day), F.col(key)]
    top = found.filter(named).orderBy(*newest).limit(max_rows or min(limit * 4, 100))
    first = top.groupBy(url).agg(F.min_by(F.struct(*[c for c in top.columns if c != url]), F.struct(-F.unix_date(day), F.col(key))).alias("_r"))
    return first.select(url, "_r.*").orderBy(*newest).limit(limit)
