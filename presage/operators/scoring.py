"""Scoring of stated forecasts against outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from presage.functions import scalars as S
from presage.operators.skew import with_totals

BOARD_SUMS = ("brier", "weighted_brier", "decayed_brier", "decay", "log_score", "hit")


def usable_claims(claims: DataFrame) -> DataFrame:
    """Claims with a numeric stance and certainty."""
    return claims.filter(F.col("stance").isNotNull() & F.col("certainty").isNotNull())


def malformed_counts(claims: DataFrame, keys: list[str]) -> DataFrame:
    bad = F.col("stance").isNull() | F.col("certainty").isNull()
    return claims.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("claims"), F.count_if(bad).alias("malformed"), F.count_if(~bad).alias("usable"))


def reduce_entries(claims: DataFrame) -> DataFrame:
    """Mean stance and certainty per (market, source, article date)."""
    return usable_claims(claims).groupBy("market_id", "source_id", "article_date").agg(
        F.avg("stance").alias("stance"), F.avg("certainty").alias("certainty"), F.count(F.lit(1)).alias("claims"))


def before_outcome(article: Column, outcome: Column) -> Column:
    """Undated rows pass; the outcome day itself passes."""
    return F.coalesce(article <= outcome, F.lit(True))


def score_entries(entries: DataFrame, outcomes: DataFrame, registry: DataFrame) -> DataFrame:
    """Per-entry scores for known sources whose article predates the outcome."""
    st, out = F.col("stance"), F.col("outcome")
    p = S.prob(st)
    return (
        entries.join(outcomes, "market_id")
        .join(registry.select("source_id"), "source_id", "left_semi")
        .filter(before_outcome(F.col("article_date"), F.col("outcome_date")))
        .withColumn("p", p)
        .withColumn("brier", S.brier(p, out))
        .withColumn("weighted_brier", F.col("brier") * S.certainty_weight(F.col("certainty")))
        .withColumn("decay", S.time_decay(F.col("article_date"), F.col("outcome_date")))
        .withColumn("decayed_brier", F.col("brier") * F.col("decay"))
        .withColumn("log_score", S.log_score(p, out))
        .withColumn("hit", S.directional_hit(st, out))
    )


def source_market_cells(scored: DataFrame) -> DataFrame:
    """Additive sums per (source, market); every board is a roll-up of these."""
    return scored.groupBy("source_id", "market_id", "category").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in BOARD_SUMS])


def board(cells: DataFrame, keys: list[str]) -> DataFrame:
    n = F.sum("n")
    return cells.groupBy(*keys).agg(
        (F.sum("brier") / n).alias("brier_score"),
        (F.sum("weighted_brier") / n).alias("weighted_brier_score"),
        (F.sum("decayed_brier") / F.sum("decay")).alias("time_decay_brier_score"),
        (F.sum("log_score") / n).alias("log_score"),
        (F.sum("hit") / n).alias("accuracy"),
        n.alias("predictions"),
        F.count(F.lit(1)).alias("events"),
    )


def category_board(cells: DataFrame) -> DataFrame:
    """Overall and per-category rows in one pass; ``category`` is null overall."""
    n = F.sum("n")
    spread = cells.withColumn("category", F.explode(F.array_union(F.array(F.lit("")), F.col("category"))))
    return spread.groupBy("source_id", F.nullif(F.col("category"), F.lit("")).alias("category")).agg(
        (F.sum("brier") / n).alias("brier_score"), (F.sum("weighted_brier") / n).alias("weighted_brier_score"),
        (F.sum("log_score") / n).alias("log_score"), (F.sum("hit") / n).alias("accuracy"),
        n.alias("predictions"), F.count(F.lit(1)).alias("events"))


def elo(cells: DataFrame, k: float = 32.0, start: float = 1200.0) -> DataFrame:
    """Zero-sum rating: winners gain k*wrong/n, losers give k*right/n, per entry."""
    joined = with_totals(cells, ["market_id"], {"right": F.sum("hit"), "all": F.sum("n")}, F.col("source_id"))
    wrong = F.col("all") - F.col("right")
    gain = F.when((F.col("right") > 0) & (wrong > 0),
                  k * (F.col("hit") * wrong - (F.col("n") - F.col("hit")) * F.col("right")) / F.col("all")).otherwise(0.0)
    return joined.groupBy("source_id").agg((start + F.sum(gain)).alias("elo"))


def murphy(pairs: DataFrame, p: str, o: str, bins: int = 5) -> DataFrame:
    """Reliability - resolution + uncertainty; no row below five pairs."""
    x, y = F.col(p), F.col(o).cast("double")
    b = F.least(F.floor(x * bins), F.lit(bins - 1)).alias("bin")
    per_bin = pairs.groupBy(b).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sp"), F.sum(y).alias("so"))
    pb, ob = F.col("sp") / F.col("n"), F.col("so") / F.col("n")
    tot = per_bin.agg(
        F.sum("n").alias("n"), (F.sum("so") / F.sum("n")).alias("o_bar"),
        (F.sum(F.col("n") * (pb - ob) * (pb - ob)) / F.sum("n")).alias("rel"),
        (F.sum(F.col("n") * ob * ob) / F.sum("n")).alias("_ob2"))
    res = F.col("_ob2") - F.col("o_bar") * F.col("o_bar")
    unc = F.col("o_bar") * (1 - F.col("o_bar"))
    return tot.filter(F.col("n") >= 5).select(
        (F.col("rel") - res + unc).alias("brier"), "rel", res.alias("res"), unc.alias("unc"), "n", "o_bar")


def _bins(pairs: DataFrame, x: Column, y: Column, bins: int) -> DataFrame:
    got = pairs.groupBy(F.least(F.floor(x * bins), F.lit(bins - 1)).cast("long").alias("bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(x).alias("_px"), F.avg(y).alias("_oy"))
    grid = pairs.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return grid.join(got, "bin", "left").withColumn("n", F.coalesce("_n", F.lit(0)))


def calibration_curve(pairs: DataFrame, p: str, o: str, bins: int = 10, min_total: int = 10) -> DataFrame:
    """All bins, an empty bin observed as 0.0; no rows below ``min_total`` pairs."""
    x, y = F.col(p), F.col(o).cast("double")
    out = _bins(pairs, x, y, bins)
    total = out.agg(F.sum("n").alias("_total"))
    lo = F.col("bin") / bins
    return out.crossJoin(F.broadcast(total)).filter(F.col("_total") >= min_total).select(
        "bin", F.round((lo + (F.col("bin") + 1) / bins) / 2, 3).alias("predicted"),
        F.coalesce("_oy", F.lit(0.0)).alias("actual"), "n")


def reliability_table(pairs: DataFrame, p: str, o: str, bins: int = 5) -> DataFrame:
    """Mean forecast and observed share per bin; both null where a bin is empty."""
    return _bins(pairs, F.col(p), F.col(o).cast("double"), bins).select(
        "bin", "n", F.col("_px").alias("mean_predicted"), F.col("_oy").alias("observed"))


def claim_level_brier(claims: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Event, source and overall Brier over single claims, with skill vs 0.25."""
    p = S.prob(F.coalesce(F.col("stance"), F.lit(0.0)))
    cells = claims.join(outcomes.select("market_id", "outcome"), "market_id").groupBy("market_id", "source_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(S.brier(p, F.col("outcome"))).alias("b"), F.sum(p).alias("p"))
    m, s = F.col("market_id"), F.col("source_id")
    return cells.groupingSets([[m], [s], []], m, s).agg(
        F.grouping_id().alias("_g"), F.sum("n").alias("n"), (F.sum("b") / F.sum("n")).alias("brier"),
        (F.sum("p") / F.sum("n")).alias("implied_p"),
    ).select(
        F.when(F.col("_g") == 1, "event").when(F.col("_g") == 2, "source").otherwise("overall").alias("level"),
        "market_id", "source_id", "n", "brier", "implied_p", (1 - F.col("brier") / 0.25).alias("skill"))


def competitive(claims: DataFrame, outcomes: DataFrame, hours: int = 48, min_sources: int = 2) -> DataFrame:
    """Brier over anchored windows in which at least ``min_sources`` sources spoke.

    An anchor is the first date after the previous window's end, so windows
    never overlap and each date belongs to exactly one. Only the distinct dates
    of an event (a bounded set) are folded; claims stay pre-aggregated rows.
    """
    days = hours // 24
    daily = (
        claims.filter(F.col("article_date").isNotNull()).join(outcomes.select("market_id", "outcome", "outcome_date"), "market_id")
        .filter(F.col("article_date") <= F.col("outcome_date"))
        .groupBy("market_id", "article_date", "source_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(S.brier(S.prob(F.col("stance")), F.col("outcome"))).alias("b"))
    )
    fold = F.aggregate(
        F.array_sort(F.collect_set("article_date")),
        F.array().cast("array<struct<d:date,a:date>>"),
        lambda acc, d: F.concat(acc, F.array(F.struct(
            d.alias("d"),
            F.when((F.size(acc) > 0) & (d <= F.date_add(F.try_element_at(acc, F.lit(-1))["a"], days)),
                   F.try_element_at(acc, F.lit(-1))["a"]).otherwise(d).alias("a")))),
    )
    anchors = (
        daily.select("market_id", "article_date").distinct().groupBy("market_id").agg(fold.alias("w"))
        .select("market_id", F.explode("w").alias("w")).select("market_id", F.col("w.d").alias("article_date"), F.col("w.a").alias("anchor"))
    )
    cells = daily.join(anchors, ["market_id", "article_date"]).groupBy("market_id", "anchor", "source_id").agg(
        F.sum("n").alias("n"), F.sum("b").alias("b"))
    contested = cells.groupBy("market_id", "anchor").agg(F.count(F.lit(1)).alias("sources")).filter(F.col("sources") >= min_sources)
    return cells.join(contested, ["market_id", "anchor"], "left_semi").groupBy("market_id", "source_id").agg(
        F.sum("n").alias("n"), (F.sum("b") / F.sum("n")).alias("brier")).withColumn("skill", 1 - F.col("brier") / 0.25)


def bootstrap_mean(values: DataFrame, row_id: str, value: str, draws: int = 2000, seed: int = 918) -> DataFrame:
    """95 % interval of the mean from a Poisson bootstrap.

    Each (row, replicate) weight is a Poisson(1) draw taken from a hash, so a
    re-run task repeats its draws, and replicates merge map-side into one sum
    pair per replicate.
    """
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(row_id).cast("string"), F.col("_b").cast("string"), F.lit(str(seed)))), 1, 8),
               16, 10).cast("double") / 4294967296.0
    steps, cum, term = [], 0.0, 2.718281828459045 ** -1
    for i in range(12):
        cum += term
        steps.append(round(cum, 12))
        term /= i + 1
    weight = F.lit(12)
    for i in reversed(range(12)):
        weight = F.when(u < steps[i], F.lit(i)).otherwise(weight)
    reps = (
        values.filter(F.col(value).isNotNull()).select(row_id, value)
        .withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_w", weight)
        .groupBy("_b").agg(F.sum(F.col("_w") * F.col(value)).alias("s"), F.sum("_w").alias("w"))
        .filter(F.col("w") > 0).select((F.col("s") / F.col("w")).alias("m"))
    )
    base = values.filter(F.col(value).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    # the replicate table has `draws` rows whatever the input size
    ends = reps.agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))
    return base.crossJoin(F.broadcast(ends)).filter(F.col("n") >= 2)
