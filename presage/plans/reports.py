"""Pools at resolution, platform scores, pins, raters, samples and ordered reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from presage.functions.web import SLUG_SMALL_WORDS, slug_title, title_slug
from presage.operators import pooling as PL, reports as R, rules as RU, scoring as SC
from presage.operators.skew import with_rank
from presage.plans.registry import Registry
from presage.plans.scoring import SCORED_SQL, scored
from presage.session import rounded, table
from presage.sources import fixtures as fx
from presage.sources.fixtures import with_views

Q = Registry()
_K = "(SELECT *, CAST(props->>'$.k' AS INTEGER) AS k FROM events)"


@Q.add("pool_at_resolution", with_views("pools pool_rows rich_claims outcomes", """
SELECT pool_id, row_ix, as_of, claim_ix, stance, facet FROM (
  SELECT r.pool_id, r.row_ix, o.outcome_date AS as_of, c.claim_ix, c.stance, c.facet, (r.stance >= 0) = (r.claim_direction IS DISTINCT FROM 'survival') AS occ, settlement_event_date AS ev, r.claim_deadline AS dl, published_date AS pub, r.claim_created AS cr,
    coalesce(r.claim_deadline <= o.outcome_date, false) AS closed
  FROM pool_rows r JOIN outcomes o ON o.market_id = r.pool_id JOIN rich_claims c ON c.pool_id = r.pool_id AND c.claim_ix = r.row_ix
  WHERE r.settled AND coalesce(DATE '2024-01-01' + (row_ix % 30)::INT <= o.outcome_date, true))
WHERE CASE WHEN occ AND ev IS NULL THEN false WHEN occ AND ev > dl THEN false WHEN NOT occ AND ev IS NULL AND closed THEN NOT coalesce(pub > dl + 14, false) WHEN NOT occ AND ev IS NULL THEN false
  WHEN NOT occ AND ev > dl AND NOT closed THEN false WHEN NOT occ AND ev > dl AND ev > dl + 14 THEN false WHEN ev < cr THEN false WHEN ev > pub THEN false ELSE true END"""))
def pool_at_resolution(spark, sf):
    """Claims behind the valid settlement votes of each pool on the day its question resolved."""
    rows = fx.pool_rows(spark, sf).filter("settled").withColumn("added_at", F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("row_ix") % 30).cast("int")))
    claims = fx.rich_claims(spark, sf).select("pool_id", F.col("claim_ix").alias("row_ix"), "claim_ix", "stance", "facet")
    resolved = fx.outcomes(spark, sf).select(F.col("market_id").alias("pool_id"), F.col("outcome_date").alias("as_of"))
    return R.pool_as_of(rows, claims, resolved, PL.vote_reason(PL.PoolRules(), F.col("as_of"))).select("pool_id", "row_ix", "as_of", "claim_ix", "stance", "facet")


_FORECAST_SQL = """
f AS (SELECT market_id, CASE WHEN market_id % 17 <> 0 THEN (avg(stance) + 1) / 2 END AS p, CASE WHEN market_id % 13 = 0 THEN 'timeout' END AS error, CASE WHEN market_id % 5 <> 0 THEN (market_id % 19 + 1) / 20.0::DOUBLE END AS crowd_p,
  regexp_matches('top ' || (market_id % 4) || CASE WHEN market_id % 4 = 0 THEN '% of votes' WHEN market_id % 4 = 1 THEN ' at least 3' ELSE ' places' END, '(?i)\\d[\\d,.]*\\s*%|\\bat least\\b\\s*\\d') AS hard FROM claims GROUP BY 1),
t AS (SELECT f.*, coalesce(a.outcome, b.outcome) AS outcome, CASE WHEN a.outcome IS NOT NULL THEN 'official' WHEN b.outcome IS NOT NULL THEN 'own' END AS ground_truth
  FROM f LEFT JOIN (SELECT market_id, outcome FROM outcomes WHERE market_id % 3 <> 0) a USING (market_id) LEFT JOIN (SELECT market_id, outcome FROM outcomes WHERE market_id % 2 = 0) b USING (market_id))"""


def _truth(spark, sf):
    m = F.col("market_id")
    text = F.concat(F.lit("top "), (m % 4).cast("string"), F.when(m % 4 == 0, "% of votes").when(m % 4 == 1, " at least 3").otherwise(" places"))
    f = fx.claims(spark, sf).groupBy("market_id").agg(F.avg("stance").alias("s")).select(
        "market_id", F.when(m % 17 != 0, (F.col("s") + 1) / 2).alias("p"), F.when(m % 13 == 0, "timeout").alias("error"), F.when(m % 5 != 0, (m % 19 + 1) / 20).alias("crowd_p"),
        RU.hard_threshold(text).alias("hard"))
    o = fx.outcomes(spark, sf).select("market_id", "outcome")
    return R.with_ground_truth(f, o.filter(m % 3 != 0), o.filter(m % 2 == 0), "market_id")


@Q.add("outcome_fallback", with_views("claims outcomes", "SELECT market_id, outcome, ground_truth FROM t", _FORECAST_SQL))
def outcome_fallback(spark, sf):
    return _truth(spark, sf).select("market_id", "outcome", "ground_truth")


@Q.add("platform_scores", with_views("claims outcomes", """
SELECT ground_truth, hard, count(*) AS n, round(avg(b), 10) AS brier, round(avg(l), 10) AS log_score, count(crowd_p) AS n_crowd, round(avg(cb), 10) AS crowd_brier, round(avg(cl), 10) AS crowd_log_score, round(avg(b - cb), 10) AS delta
FROM (SELECT ground_truth, unnest([hard, NULL]) AS hard, crowd_p, pow(p - outcome::INT, 2) AS b, pow(crowd_p - outcome::INT, 2) AS cb,
   ln(greatest(0.000001, least(0.999999, CASE WHEN outcome THEN p ELSE 1 - p END))) AS l, CASE WHEN crowd_p IS NOT NULL THEN ln(greatest(0.000001, least(0.999999, CASE WHEN outcome THEN crowd_p ELSE 1 - crowd_p END))) END AS cl
   FROM t WHERE error IS NULL AND p IS NOT NULL AND ground_truth IS NOT NULL) GROUP BY 1, 2""", _FORECAST_SQL))
def platform_scores(spark, sf):
    """Scores against official and own outcomes apart, over all questions and by hard threshold."""
    out = R.platform_scores(_truth(spark, sf).filter("error is null and p is not null and ground_truth is not null"))
    return out.withColumns({c: rounded(F.col(c)) for c in ("brier", "log_score", "crowd_brier", "crowd_log_score", "delta")})


@Q.add("unscored_forecasts", with_views("claims outcomes", """
SELECT market_id, CASE WHEN error IS NOT NULL THEN 'error' WHEN p IS NULL THEN 'insufficient_data' ELSE 'no_resolution' END AS reason FROM t WHERE error IS NOT NULL OR p IS NULL OR ground_truth IS NULL""", _FORECAST_SQL))
def unscored_forecasts(spark, sf):
    """Forecasts left out of the scores, with the reason."""
    why = R.unscored_reason(F.col("error"), F.col("p"), F.col("ground_truth"))
    return _truth(spark, sf).select("market_id", why.alias("reason")).filter("reason is not null")


@Q.add("byline_people", with_views("pools rich_claims registry", """
SELECT claim_ix, CASE WHEN u % 10 = 9 THEN NULL ELSE coalesce(r.name, source_id || ' jr') END AS author FROM (SELECT claim_ix, source_id, user_id % 25 AS u FROM rich_claims) LEFT JOIN registry r USING (source_id)"""))
def byline_people(spark, sf):
    """Person behind each claim's byline, written with stray spaces and points."""
    u = F.col("user_id") % 25
    byline = F.when(u % 10 != 9, F.concat(F.lit("  "), F.col("source_id"), F.lit("ְ   jr ")))
    rows = fx.rich_claims(spark, sf).select("claim_ix", byline.alias("byline"))
    aliases = fx.registry(spark, sf).select(F.concat("source_id", F.lit(" jr")).alias("alias"), F.col("name").alias("person"))
    return R.canonical_names(rows, "byline", aliases).select("claim_ix", "author")


@Q.add("contradicted_pins", with_views("claims outcomes", """
SELECT market_id, mean, CASE WHEN mean >= 0 THEN 'yes' ELSE 'no' END AS direction, (mean >= 0) <> outcome AS contradicted
FROM (SELECT market_id, arg_min(stance, claim_ix) AS mean FROM claims WHERE abs(stance) >= 0.8 GROUP BY 1) JOIN outcomes USING (market_id)"""))
def contradicted_pins(spark, sf):
    pins = fx.claims(spark, sf).filter("abs(stance) >= 0.8").select("market_id", F.col("claim_ix").alias("seq"), F.col("stance").alias("mean"))
    return R.contradicted_pins(pins, fx.outcomes(spark, sf), "market_id")


@Q.add("unverified_pins", with_views("pools rich_claims", """
SELECT pool_id, CASE WHEN s >= 0 THEN up ELSE dn END AS votes, CASE WHEN s >= 0 THEN cu ELSE cd END = 0 AS unverified_only FROM (
  SELECT pool_id, sum(stance) AS s, count(*) FILTER (WHERE stance >= 0) AS up, count(*) FILTER (WHERE stance < 0) AS dn, count(verified) FILTER (WHERE stance >= 0) AS cu, count(verified) FILTER (WHERE stance < 0) AS cd
  FROM rich_claims WHERE settled GROUP BY 1)"""))
def unverified_pins(spark, sf):
    return R.unverified_pins(fx.rich_claims(spark, sf).filter("settled"), "pool_id")


@Q.add("class_overrides", with_views("pools rich_claims", """
SELECT source_id, count(*) AS claims, count(*) FILTER (WHERE b IS NOT NULL AND evidence_class IS DISTINCT FROM b) AS changed, count(*) FILTER (WHERE b IS NOT NULL AND b <> 'opinion' AND evidence_class = 'opinion') AS kept_opinion,
  count(*) FILTER (WHERE evidence_class IS NOT NULL AND evidence_class <> 'opinion' AND b IS NOT NULL AND b <> evidence_class) AS replaced
FROM (SELECT source_id, evidence_class, CASE claim_ix % 4 WHEN 0 THEN 'opinion' WHEN 1 THEN 'reporting' WHEN 2 THEN 'reported_fact' END AS b FROM rich_claims) GROUP BY 1"""))
def class_overrides(spark, sf):
    """Disagreements of two raters per source, opinions kept, and classes that enforcing would replace."""
    e = F.col("claim_ix") % 4
    rows = fx.rich_claims(spark, sf).select("source_id", F.col("evidence_class").alias("a"), F.when(e == 0, "opinion").when(e == 1, "reporting").when(e == 2, "reported_fact").alias("b"))
    new = R.override_class(F.col("a"), F.col("b"), True)
    replaced = rows.groupBy("source_id").agg(F.count_if(~new.eqNullSafe(F.col("a"))).alias("replaced"))
    return R.rater_counts(rows, ["source_id"], "a", "b").join(replaced, "source_id")


@Q.add("spread_sample", """
SELECT u, event_id FROM (SELECT user_id % 50 AS u, event_id, row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) - 1 AS place, count(*) OVER (PARTITION BY user_id % 50) AS n FROM events)
WHERE n <= 7 OR place IN (SELECT round_even(i * (n - 1) / 6.0::DOUBLE, 0)::BIGINT FROM (SELECT unnest(range(7)) AS i))""")
def spread_sample(spark, sf):
    """Seven events per source, spread evenly over its time line."""
    e = table(spark, sf, "events").select((F.col("user_id") % 50).alias("u"), "event_id", "ts")
    sizes = e.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    ranked = with_rank(e, ["u"], [F.unix_date(F.to_date("ts"))], [F.col("ts"), F.col("event_id")], "place")
    wanted = sizes.select("u", F.explode(R.spread_places(F.col("n"), 7)).alias("_p")).select("u", (F.col("_p") + 1).alias("place"))
    return ranked.withColumn("place", F.col("place").cast("long")).join(wanted, ["u", "place"], "left_semi").select("u", "event_id")


@Q.add("same_slug", """
WITH c AS (SELECT p_brand, p_partkey, replace(p_name, ' ', '-') || CASE WHEN p_partkey % 3 = 0 THEN '-' || p_partkey ELSE '' END AS slug FROM part), w AS (SELECT p_brand, arg_min(replace(p_name, ' ', '-'), p_partkey) AS wanted FROM part GROUP BY 1)
SELECT p_brand, slug, score FROM (SELECT p_brand, slug, p_partkey, CASE WHEN slug = wanted THEN 2 WHEN starts_with(slug, left(wanted, 30)) THEN 1 ELSE 0 END AS score FROM c JOIN w USING (p_brand))
QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) = 1""")
def same_slug(spark, sf):
    """Per brand the market whose slug fits the wanted one best."""
    slug = F.replace("p_name", F.lit(" "), F.lit("-"))
    p = table(spark, sf, "part")
    wanted = p.groupBy("p_brand").agg(F.min_by(slug, "p_partkey").alias("wanted"))
    c = p.select("p_brand", "p_partkey", F.concat(slug, F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("-"), F.col("p_partkey").cast("string"))).otherwise("")).alias("slug"))
    return R.best_slug(c.join(wanted, "p_brand"), "p_brand", "slug", "wanted", "p_partkey")


@Q.add("title_slugs", rf"""
WITH t AS (SELECT p_partkey, 'Prices of the ' || p_name || ': ' || p_brand || ' & co., ' || p_type || ' - 3rd' AS title FROM part),
s AS (SELECT *, regexp_replace(regexp_replace(trim(regexp_replace(lower(title), '[^a-z0-9\s-]', '', 'g')), '\s+', '-', 'g'), '-+', '-', 'g') AS slug FROM t),
u AS (SELECT *, 'https://www.example.com/news/' || CASE WHEN p_partkey % 2 = 0 THEN p_partkey || '-' ELSE '' END || slug || CASE WHEN p_partkey % 3 = 0 THEN '/' ELSE '' END || '?ref=a/b' AS url FROM s)
SELECT p_partkey, slug, url, array_to_string(list_transform(string_split(slug, '-'), lambda w: CASE WHEN w IN ({', '.join(f"'{w}'" for w in SLUG_SMALL_WORDS)}) THEN w ELSE upper(w[1]) || w[2:] END), ' ') AS headline FROM u""")
def title_slugs(spark, sf):
    """Addresses built from titles, and titles read back from addresses."""
    key = F.col("p_partkey")
    title = F.concat(F.lit("Prices of the "), "p_name", F.lit(": "), "p_brand", F.lit(" & co., "), "p_type", F.lit(" - 3rd"))
    slug = table(spark, sf, "part").select(key, title_slug(title).alias("slug"))
    number, end = F.when(key % 2 == 0, F.concat(key.cast("string"), F.lit("-"))).otherwise(""), F.when(key % 3 == 0, "/").otherwise("")
    made = slug.withColumn("url", F.concat(F.lit("https://www.example.com/news/"), number, "slug", end, F.lit("?ref=a/b")))
    return made.withColumn("headline", slug_title(F.col("url")))


_ARCHIVE_HOST = r"regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)), '^www\.', '')"


@Q.add("archive_candidates", rf"""
SELECT host, page_id, score FROM (
  SELECT {_ARCHIVE_HOST} AS host, page_id, (contains(lower(url), '/en/'))::INT + (contains(lower(url), 'page=2'))::INT AS score FROM pages
  WHERE NOT regexp_matches(url, '/authors/|/author/|/topics/|/tag/|/category/|/section/|/search/|/video/') AND page_id % 7 <> 6 AND page_id % 40 BETWEEN 3 AND 33)
QUALIFY row_number() OVER (PARTITION BY host ORDER BY score DESC, page_id) <= 15""")
def archive_candidates(spark, sf):
    """Fifteen archived addresses per host in a date window, best keyword score first."""
    from presage.functions import web as W

    k = F.col("page_id")
    stamp = F.when(k % 7 == 6, F.lit("unknown")).otherwise(F.concat(F.date_format(F.date_add(F.to_date(F.lit("2024-01-01")), (k % 40).cast("int")), "yyyyMMdd"), F.lit("120000")))
    index = table(spark, sf, "pages").select("page_id", "url", W.host(F.col("url")).alias("host"), stamp.alias("stamp"))
    fit = R.archive_candidates(index, ("/en/", "Page=2", "über"), "2024-01-04", "2024-02-03")
    ranked = with_rank(fit.select("host", "page_id", "score"), ["host"], [-F.col("score"), F.floor(F.col("page_id") / 1_000_000)], [F.desc("score"), F.col("page_id")], "place")
    return ranked.filter(F.col("place") <= R.ARCHIVE_LIMIT).select("host", "page_id", "score")


@Q.add("season_choice", """
SELECT arg_max('aib-' || c_custkey, s) AS slug, max(s) AS start FROM (SELECT c_custkey, DATE '2024-01-01' + c_custkey::INT AS s, DATE '2024-01-01' + (c_custkey + 90)::INT AS e FROM customer WHERE c_custkey % 4 = 0)
WHERE s <= DATE '2024-05-01' AND (c_custkey % 12 = 0 OR e > DATE '2024-05-01') HAVING count(*) > 0""")
def season_choice(spark, sf):
    """The running season among tournaments, one per customer."""
    k = F.col("c_custkey")
    start = F.date_add(F.to_date(F.lit("2024-01-01")), k.cast("int"))
    t = table(spark, sf, "customer").select(
        F.when(k % 2 == 0, F.concat(F.when(k % 4 == 0, "aib-").otherwise("cup-"), k.cast("string"))).otherwise("").alias("slug"), F.lit("Some Cup").alias("name"), start.alias("start"),
        F.when((k % 12 != 0) & (k % 8 == 0), F.date_add(start, 90)).alias("forecasting_end"), F.when(k % 12 != 0, F.date_add(start, 90)).alias("close_date"))
    return R.season(t, F.to_date(F.lit("2024-05-01")))


@Q.add("tracked_universe", with_views("snapshots", """
, l AS (SELECT market_id, arg_max(resolved_outcome IS NULL AND resolution_raw IS NULL, seq) AS live FROM snapshots GROUP BY 1),
t AS (SELECT market_id FROM l WHERE live)
SELECT market_id, true AS tracked FROM t UNION ALL SELECT p_partkey, false FROM part WHERE p_size >= 15 AND p_partkey NOT IN (SELECT market_id FROM t)""").replace("\n, l AS", ",\nl AS"))
def tracked_universe(spark, sf):
    """Markets of the ledger that are still open, and admitted new ones."""
    from presage.operators.skew import latest_per

    s = fx.snapshots(spark, sf).select("market_id", "seq", (F.col("resolved_outcome").isNull() & F.col("resolution_raw").isNull()).alias("live"))
    tracked = latest_per(s, ["market_id"], F.col("seq")).filter("live").select("market_id")
    new = table(spark, sf, "part").filter("p_size >= 15").select(F.col("p_partkey").alias("market_id"))
    return R.universe(tracked, new, "market_id")


@Q.add("node_series", with_views("prices", """
SELECT series_id, date, CASE WHEN day(date) % 6 <> 0 THEN round(probability, 4) END AS probability, CASE WHEN day(date) % 6 <> 0 AND day(date) % 5 <> 0 THEN round(probability - 0.005, 4) END AS low,
  last IS NULL OR date - last >= 3 AS due FROM (SELECT *, lag(date) OVER (PARTITION BY series_id ORDER BY date) AS last FROM prices)"""))
def node_series(spark, sf):
    """Series entries from stances with their interval, and whether a run was due that day.

    A series has one row per calendar day, which bounds its window."""
    from pyspark.sql import Window

    d, s = F.col("date"), F.col("probability") * 2 - 1
    low = F.when(F.day(d) % 5 != 0, s - 0.01)
    rec = R.node_record(s, low, s + 0.01, F.day(d) % 6 == 0)
    last = F.lag("date").over(Window.partitionBy("series_id").orderBy("date"))
    return fx.prices(spark, sf).select("series_id", "date", rec.alias("r"), R.run_due(d, last, 3).alias("due")).select(
        "series_id", "date", F.col("r.probability").alias("probability"), F.get("r.ci", F.lit(0)).alias("low"), "due")


@Q.add("ordered_leaderboard", with_views("claims outcomes registry", """
SELECT source_id, round(avg(brier), 10) AS brier_score, CASE WHEN length(source_id) > 2 THEN round(1 - avg(brier) / 0.25, 10) END AS skill FROM scored GROUP BY 1""", SCORED_SQL))
def ordered_leaderboard(spark, sf):
    """Sources by skill, the best first; one without skill counts as 0."""
    b = SC.board(SC.source_market_cells(scored(spark, sf)), ["source_id"]).select("source_id", "brier_score")
    rows = b.select("source_id", rounded(F.col("brier_score")).alias("brier_score"), F.when(F.length("source_id") > 2, rounded(1 - F.col("brier_score") / 0.25)).alias("skill"))
    return rows.orderBy(F.coalesce("skill", F.lit(0.0)).desc(), "source_id")


@Q.add("ordered_market_report", with_views("snapshots", """
SELECT event_slug, market_id, arg_max(market_yes, seq) AS price, arg_max(end_ts, seq) AS end_ts FROM snapshots WHERE market_yes IS NOT NULL GROUP BY 1, 2"""))
def ordered_market_report(spark, sf):
    """Latest priced snapshot of each market: soonest close first, then by event and falling price."""
    s = fx.snapshots(spark, sf).filter("market_yes is not null")
    r = s.groupBy("event_slug", "market_id").agg(F.max_by("market_yes", "seq").alias("price"), F.max_by("end_ts", "seq").alias("end_ts"))
    return r.orderBy(F.asc_nulls_last("end_ts"), "event_slug", F.desc("price"))


@Q.add("ordered_contributions", with_views("claims outcomes registry", """
SELECT source_id, round(avg(c), 10) AS contribution, count(*) AS events FROM (SELECT source_id, market_id, avg(stance * coalesce(certainty, 0.5)) AS c FROM claims GROUP BY 1, 2) GROUP BY 1"""))
def ordered_contributions(spark, sf):
    """Mean weighted stance per source over events, the largest in size first."""
    e = fx.claims(spark, sf).groupBy("source_id", "market_id").agg(F.avg(F.col("stance") * F.coalesce("certainty", F.lit(0.5))).alias("c"))
    r = e.groupBy("source_id").agg(F.avg("c").alias("m"), F.count(F.lit(1)).alias("events"))
    return r.select("source_id", rounded(F.col("m")).alias("contribution"), "events").orderBy(F.abs("contribution").desc(), "source_id")
