"""Skill ratings in rating periods (Plackett-Luce, winners ahead of losers)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from presage.operators.skew import with_totals
from presage.session import cut_lineage

MU, SIGMA = 25.0, 25.0 / 3
BETA, TAU, KAPPA = 25.0 / 6, 25.0 / 300, 1e-4


def period_update(ratings: DataFrame, results: DataFrame) -> DataFrame:
    """Ratings after one period.

    ``results``: event, player, won (one row per player and event); events
    without both winners and losers change nothing. Every event reads the
    ratings from before the period and the changes are added up, so the events
    of a period run in parallel.
    """
    c = F.col
    rows = results.join(ratings, "player", "left").fillna({"mu": MU, "sigma": SIGMA})
    rows = rows.withColumn("v", c("sigma") * c("sigma") + TAU * TAU)
    rows = with_totals(rows, ["event"], {"_c2": F.sum(c("v") + BETA * BETA), "_nw": F.count_if("won"), "_nl": F.count_if(~c("won"))}, c("player"))
    rows = rows.filter((c("_nw") > 0) & (c("_nl") > 0)).withColumn("_cc", F.sqrt("_c2")).withColumn("_e", F.exp(c("mu") / c("_cc")))
    rows = with_totals(rows, ["event"], {"_all": F.sum("_e"), "_lose": F.sum(F.when(~c("won"), c("_e")))}, c("player"))
    a, b = c("_e") / c("_all"), c("_e") / c("_lose")
    omega = F.when(c("won"), 1.0 / c("_nw") - a).otherwise(-a + 1.0 / c("_nl") - b)
    delta = F.when(c("won"), a * (1 - a)).otherwise(a * (1 - a) + b * (1 - b))
    gamma = F.sqrt("v") / c("_cc")
    change = rows.groupBy("player").agg(
        F.sum(omega * c("v") / c("_cc")).alias("_dmu"), F.sum(delta * gamma * c("v") / c("_c2")).alias("_shrink"), F.max("v").alias("_v"))
    out = ratings.join(change, "player", "full")
    mu = F.coalesce("mu", F.lit(MU)) + F.coalesce("_dmu", F.lit(0.0))
    sigma = F.when(c("_v").isNull(), c("sigma")).otherwise(F.sqrt(c("_v") * F.greatest(1 - c("_shrink"), F.lit(KAPPA))))
    return out.select("player", mu.alias("mu"), sigma.alias("sigma"))


def rate(results: DataFrame, period: str, periods: Iterable) -> DataFrame:
    """Fold the periods in order; the loop is as long as the list of periods."""
    ratings = results.select("player").distinct().select("player", F.lit(MU).alias("mu"), F.lit(SIGMA).alias("sigma"))
    for p in periods:
        ratings = cut_lineage(period_update(ratings, results.filter(F.col(period) == F.lit(p)).drop(period)))
    return ratings.withColumn("conservative", F.col("mu") - 3 * F.col("sigma"))
