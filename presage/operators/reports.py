"""Joins and reports over forecasts, outcomes, pins, raters, universes and archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from presage.functions import scalars as S, text as X, web as W

ARCHIVE_LIMIT = 15


def pool_as_of(rows: DataFrame, claims: DataFrame, resolved: DataFrame, reason: Column) -> DataFrame:
    """Claims of the settlement votes a pool held when its question resolved.

    ``rows``: pool_id, row_ix, added_at and what ``reason`` reads; it is null for
    a vote that counts, judged on the day of resolution (``as_of``).
    """
    held = rows.join(resolved.select("pool_id", "as_of"), "pool_id").filter(F.coalesce(F.col("added_at") <= F.col("as_of"), F.lit(True)))
    return held.filter(reason.isNull()).select("pool_id", "row_ix", "as_of").join(claims, ["pool_id", "row_ix"])


def with_ground_truth(forecasts: DataFrame, official: DataFrame, own: DataFrame, key: str) -> DataFrame:
    """Outcome of each forecast with where it came from: the official one, else our own decisive one, else none."""
    joined = forecasts.join(official.select(key, F.col("outcome").alias("_o")), key, "left").join(own.select(key, F.col("outcome").alias("_s")), key, "left")
    source = F.when(F.col("_o").isNotNull(), "official").when(F.col("_s").isNotNull(), "own")
    return joined.withColumns({"outcome": F.coalesce("_o", "_s"), "ground_truth": source}).drop("_o", "_s")


def unscored_reason(error: Column, probability: Column, ground_truth: Column) -> Column:
    return F.when(error.isNotNull(), "error").when(probability.isNull(), "insufficient_data").when(ground_truth.isNull(), "no_resolution")


def platform_scores(scored: DataFrame) -> DataFrame:
    """Mean scores per ground truth, over all and by hard threshold (null: all).

    The delta to the crowd counts only questions where the crowd has a number."""
    won = F.col("outcome").cast("double")
    brier, crowd = F.pow(F.col("p") - won, 2), F.pow(F.col("crowd_p") - won, 2)
    own = lambda p: S.log_score(F.col(p), F.col("outcome"), 1e-6)
    sides = scored.withColumn("hard", F.explode(F.array(F.col("hard"), F.lit(None).cast("boolean"))))
    return sides.groupBy("ground_truth", "hard").agg(
        F.count(F.lit(1)).alias("n"), F.avg(brier).alias("brier"), F.avg(own("p")).alias("log_score"), F.count("crowd_p").alias("n_crowd"),
        F.avg(crowd).alias("crowd_brier"), F.avg(own("crowd_p")).alias("crowd_log_score"), F.avg(brier - crowd).alias("delta"))


def canonical_names(rows: DataFrame, byline: str, aliases: DataFrame) -> DataFrame:
    """Person behind each byline by the alias table, else the byline itself, else none.

    Bylines are reduced to their distinct keys before they meet the aliases."""
    keyed = rows.withColumn("_key", X.identity_key(F.col(byline)))
    known = aliases.select(X.identity_key(F.col("alias")).alias("_key"), "person").filter("_key <> ''").groupBy("_key").agg(F.max("person").alias("person"))
    found = keyed.select("_key").distinct().join(known, "_key", "left")
    return keyed.join(found, "_key").withColumn("author", F.when(F.col("_key") != "", F.coalesce("person", "_key"))).drop("_key", "person")


def contradicted_pins(pins: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """Pins, once per question, with their direction and whether the outcome went the other way."""
    once = pins.groupBy(key).agg(F.min_by("mean", "seq").alias("mean"))
    yes = F.col("mean") >= 0
    return once.join(outcomes.select(key, "outcome"), key).select(key, "mean", F.when(yes, "yes").otherwise("no").alias("direction"), (yes != F.col("outcome")).alias("contradicted"))


def unverified_pins(votes: DataFrame, key: str) -> DataFrame:
    """Votes on the winning side of each pin and whether none of them was ever checked."""
    side = votes.groupBy(key).agg(
        F.sum("stance").alias("_total"), *[F.count_if(s).alias(n) for n, s in (("_up", F.col("stance") >= 0), ("_down", F.col("stance") < 0))],
        *[F.count_if(s & F.col("verified").isNotNull()).alias(n) for n, s in (("_cup", F.col("stance") >= 0), ("_cdown", F.col("stance") < 0))])
    up = F.col("_total") >= 0
    return side.select(key, F.when(up, F.col("_up")).otherwise(F.col("_down")).alias("votes"),
                       (F.when(up, F.col("_cup")).otherwise(F.col("_cdown")) == 0).alias("unverified_only"))


def override_class(first: Column, second: Column, enforce: bool) -> Column:
    """The second rater's class where both have one; opinion is never replaced."""
    if not enforce:
        return first
    return F.when(first.isNotNull() & (first != "opinion") & second.isNotNull(), second).otherwise(first)


def rater_counts(rows: DataFrame, keys: list[str], first: str, second: str) -> DataFrame:
    differs = F.col(second).isNotNull() & ~F.col(first).eqNullSafe(F.col(second))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("claims"), F.count_if(differs).alias("changed"),
                                   F.count_if(differs & F.col(first).eqNullSafe(F.lit("opinion"))).alias("kept_opinion"))


def spread_places(n: Column, k: int) -> Column:
    """Places (from 0) of up to ``k`` items spread evenly over ``n``, ends included."""
    if k == 1:
        picked = F.array(F.floor(n / 2))
    else:
        step = (n - 1) / (k - 1)
        picked = F.array_distinct(F.array(*[F.bround(F.lit(i) * step, 0).cast("long") for i in range(k)]))
    return F.when(n > k, picked).otherwise(F.sequence(F.lit(0).cast("long"), n - 1))


def slug_score(slug: Column, wanted: Column) -> Column:
    return F.when(slug == wanted, 2).when(F.startswith(slug, F.substring(wanted, 1, 30)), 1).otherwise(0)


def best_slug(candidates: DataFrame, key: str, slug: str, wanted: str, order: str) -> DataFrame:
    """Candidate of each key with the best slug, the first at a tie."""
    score = slug_score(F.col(slug), F.col(wanted))
    return candidates.groupBy(key).agg(F.min_by(F.struct(F.col(slug).alias("slug"), score.alias("score")), F.struct(-score, F.col(order))).alias("_b")).select(key, "_b.slug", "_b.score")


def archive_candidates(index: DataFrame, keywords: tuple[str, ...], start: str, end: str) -> DataFrame:
    """Rows of a web archive's index that may be articles of their host, with their keyword score.

    ``index``: host, url, stamp (yyyyMMddHHmmss). A stamp that is no date is left out."""
    day = F.try_to_date(F.substring("stamp", 1, 8), "yyyyMMdd")
    low = F.lower("url")
    hits = [(F.contains(low, F.lit(k.replace(" ", "-"))) | F.contains(low, F.lit(k.replace(" ", "")))).cast("int") for k in map(str.lower, keywords) if k.isascii()]
    fit = index.filter(W.is_candidate(F.col("url"), F.col("host"), F.lit(None).cast("date")) & day.between(start, end))
    return fit.withColumn("score", sum(hits, F.lit(0)))


def season(tournaments: DataFrame, now: Column, markers: tuple[str, ...] = ("futureeval", "aib")) -> DataFrame:
    """The latest season that has started and not ended; no row when there is none."""
    hay = F.lower(F.concat_ws(" ", "slug", "name"))
    marked = F.lit(False)
    for m in markers:
        marked = marked | F.contains(hay, F.lit(m))
    end = F.coalesce("forecasting_end", "close_date")
    live = tournaments.filter((F.coalesce("slug", F.lit("")) != "") & marked & (F.col("start") <= now) & F.coalesce(end > now, F.lit(True)))
    return live.agg(F.max_by("slug", "start").alias("slug"), F.max("start").alias("start")).filter("slug is not null")


def universe(tracked: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Tracked markets and the new ones among the candidates; a tracked one wins."""
    fresh = candidates.join(tracked.select(key), key, "left_anti")
    return tracked.withColumn("tracked", F.lit(True)).unionByName(fresh.withColumn("tracked", F.lit(False)))


def node_record(mean: Column, low: Column, high: Column, insufficient: Column) -> Column:
    """Probability and interval of a series entry from stances; none when data did not suffice."""
    prob = lambda x: F.round((x + 1) / 2, 4)
    ci = F.when(low.isNotNull() & high.isNotNull(), F.array(prob(low), prob(high)))
    return F.struct(F.when(~insufficient, prob(mean)).alias("probability"), F.when(~insufficient, ci).alias("ci"))


def run_due(today: Column, last: Column, min_days: int) -> Column:
    """Nothing logged, a day half done, or the interval has passed."""
    if min_days <= 1:
        return F.lit(True)
    return last.isNull() | (last == today) | (F.datediff(today, last) >= min_days)
