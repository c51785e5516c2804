"""Prices as of a date, daily compaction, and comparison of two forecasters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from presage.functions import scalars as S


def last_per_day(ticks: DataFrame, until: Column | None = None) -> DataFrame:
    """Last tick of each day, optionally no later than a date."""
    kept = ticks if until is None else ticks.filter(F.col("date") <= until)
    return kept.groupBy("series_id", "date").agg(F.max_by("probability", "tick").alias("probability"))


def first_per_day(ticks: DataFrame) -> DataFrame:
    return ticks.groupBy("series_id", "date").agg(F.min_by("probability", "tick").alias("probability"))


def merge_series(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union by day; a new point replaces an old one."""
    both = old.select("series_id", "date", "probability", F.lit(0).alias("_new")).unionByName(
        new.select("series_id", "date", "probability", F.lit(1).alias("_new")))
    return both.groupBy("series_id", "date").agg(F.max_by("probability", "_new").alias("probability"))


def asof(prices: DataFrame, wanted: DataFrame) -> DataFrame:
    """Price on or before ``wanted.date`` and the one before it, per series.

    ``prices`` has one row per series and day and ``wanted`` is reduced to
    distinct days first, so the ordered window of a series is bounded by the
    calendar and not by the number of questions asked of it.
    """
    by_day = Window.partitionBy("series_id").orderBy("date")
    points = prices.select("series_id", "date", "probability").withColumn(
        "_pt", F.struct(F.col("date").alias("d"), F.col("probability").alias("p"), F.lag("probability").over(by_day).alias("prev")))
    days = wanted.select("series_id", "date").distinct().withColumn("_ask", F.lit(True))
    line = points.select("series_id", "date", "_pt").unionByName(days, allowMissingColumns=True)
    upto = Window.partitionBy("series_id").orderBy("date").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = line.withColumn("_hit", F.last("_pt", ignorenulls=True).over(upto)).filter("_ask").select(
        "series_id", "date", F.col("_hit.d").alias("price_date"), F.col("_hit.p").alias("price"), F.col("_hit.prev").alias("prev_price"))
    return wanted.join(found, ["series_id", "date"], "left")


def market_price_at(prices: DataFrame, events: DataFrame, horizons: DataFrame) -> DataFrame:
    """Market probability T days before the outcome, for every event and T.

    Without a price on or before the cutoff the earliest one is used; the
    ``after_cutoff`` column marks that. Inverted markets give 1 - price.
    """
    asked = events.crossJoin(F.broadcast(horizons)).withColumn("date", F.date_sub("outcome_date", F.col("t_days")))
    first = prices.groupBy("series_id").agg(F.min_by(F.struct("date", "probability"), "date").alias("_first"))
    at = asof(prices, asked).join(first, "series_id", "left")
    raw = F.coalesce("price", F.col("_first.probability"))
    return at.select(
        *[c for c in events.columns], "t_days",
        F.round(F.when(F.col("invert"), 1 - raw).otherwise(raw), 4).alias("market_p"),
        F.datediff("outcome_date", F.coalesce("price_date", F.col("_first.date"))).alias("price_days"),
        (F.col("price").isNull() & F.col("_first.probability").isNotNull()).alias("after_cutoff"))


def duel_rows(market: DataFrame, model: DataFrame) -> DataFrame:
    """Brier of market and model per (event, T), and who was closer."""
    both = market.join(model, ["market_id", "t_days"], "left")
    mb = F.round(S.brier(F.col("market_p"), F.col("outcome")), 4)
    ob = F.round(S.brier(F.col("model_p"), F.col("outcome")), 4)
    return both.withColumns({"market_brier": mb, "model_brier": ob}).withColumn(
        "winner", F.when(F.col("model_brier") < F.col("market_brier"), "model").when(F.col("market_brier") < F.col("model_brier"), "market")
        .when(F.col("model_brier") == F.col("market_brier"), "tie"))


def duel_sweep(rows: DataFrame, n_horizons: int) -> DataFrame:
    """Averages per T over the events that have both numbers at every T."""
    compared = rows.filter(F.col("market_p").isNotNull() & F.col("model_p").isNotNull())
    common = compared.groupBy("market_id").agg(F.count_distinct("t_days").alias("_t")).filter(F.col("_t") == n_horizons)
    return compared.join(common, "market_id", "left_semi").groupBy("t_days").agg(
        F.count(F.lit(1)).alias("n_common"), F.avg("model_brier").alias("model_brier"), F.avg("market_brier").alias("market_brier"),
        F.count_if(F.col("winner") == "model").alias("model_wins"), F.count_if(F.col("winner") == "market").alias("market_wins"))


def align(prices: DataFrame, edges: DataFrame) -> DataFrame:
    """Same-day prices of an edge's two series."""
    a = prices.select(F.col("series_id").alias("source"), "date", F.col("probability").alias("x"))
    b = prices.select(F.col("series_id").alias("target"), "date", F.col("probability").alias("y"))
    return edges.join(a, "source").join(b, ["target", "date"])


def first_difference(pred: DataFrame, keys: list[str], order: str, model: str, actual: str) -> DataFrame:
    """Squared error of predicted changes against actual and zero changes."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = pred.withColumn("_dm", F.col(model) - F.lag(model).over(w)).withColumn("_da", F.col(actual) - F.lag(actual).over(w)).filter("_da is not null")
    return d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col("_dm") - F.col("_da"), 2)).alias("mse_model"), F.avg(F.pow("_da", F.lit(2))).alias("mse_zero"))


def other_half_lines(pairs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each pair (x, y) predicted from x by the line through the other half of its group's days: ``half``, ``model``.

    The halves meet in the middle of the group's range of days. No line (null) where
    the other half's x does not vary.
    """
    ends = pairs.groupBy(*keys).agg(F.min(order).alias("_first"), F.max(order).alias("_last"))
    cut = pairs.join(ends, keys).withColumn("half", (2 * F.datediff(order, "_first") > F.datediff("_last", "_first")).cast("int")).drop("_first", "_last")
    lines = cut.groupBy(*keys, (1 - F.col("half")).alias("half")).agg(F.regr_slope("y", "x").alias("_slope"), F.regr_intercept("y", "x").alias("_base"))
    return cut.join(lines, [*keys, "half"], "left").withColumn("model", F.col("_base") + F.col("_slope") * F.col("x")).drop("_slope", "_base")


def coverage_dates(prices: DataFrame, share: float) -> DataFrame:
    """Dates on which at least ``share`` of all series have started."""
    starts = prices.groupBy("series_id").agg(F.min("date").alias("date")).groupBy("date").agg(F.count(F.lit(1)).alias("_starts"))
    total = prices.agg(F.count_distinct("series_id").alias("_all"))
    days = prices.select("date").distinct().join(starts, "date", "left")
    # one row per calendar day: the running sum is over the calendar, not the data
    run = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return days.withColumn("live", F.sum(F.coalesce("_starts", F.lit(0))).over(run)).crossJoin(F.broadcast(total)).filter(
        F.col("live") >= share * F.col("_all")).select("date", "live")


def thinned_dates(dates: DataFrame, gap: int) -> DataFrame:
    """Skip ``gap`` dates, then keep every ``gap``-th."""
    ix = F.row_number().over(Window.orderBy("date")) - 1
    return dates.withColumn("_ix", ix).filter((F.col("_ix") >= gap) & ((F.col("_ix") - gap) % gap == 0)).drop("_ix")
