"""Scenario graphs, learned forecasts and skill ratings."""

from __future__ import annotations

from pyspark.sql import functions as F

from presage.functions import scalars as S
from presage.operators import asof as AS, graph as GR, models as M, rating as R, scoring as SC
from presage.plans.articles import backtest
from presage.plans.registry import Registry
from presage.plans.scoring import scored
from presage.session import rounded
from presage.sources import fixtures as fx
from presage.sources.fixtures import with_views

Q = Registry()
EDGES = (("1-URGENT", "3-MEDIUM", 0.62, 0.41, "primary"), ("2-HIGH", "3-MEDIUM", 0.58, 0.44, "primary"), ("1-URGENT", "4-NOT SPECIFIED", 0.57, 0.46, "secondary"),
         ("3-MEDIUM", "5-LOW", 0.66, 0.38, "primary"), ("4-NOT SPECIFIED", "5-LOW", 0.55, 0.45, "primary"))
EDGE_SQL = "edges AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {y}::DOUBLE, {n}::DOUBLE, '{t}')" for a, b, y, n, t in EDGES) + ") v(source, target, p_yes, p_no, type))"


def edges(spark):
    return spark.createDataFrame(list(EDGES), "source string, target string, p_yes double, p_no double, type string")


def nodes(spark, sf):
    """Every series is a node whose prior is its latest price."""
    return fx.prices(spark, sf).groupBy(F.col("series_id").alias("id")).agg(S.clamp(F.round(F.max_by("probability", "date"), 4), 0.01, 0.99).alias("prior"))


EST_SQL = EDGE_SQL + """,
al AS (SELECT source, target, e.p_yes, e.p_no, a.probability AS x, b.probability AS y FROM edges e JOIN prices a ON a.series_id = source JOIN prices b ON b.series_id = target AND a.date = b.date),
est0 AS (SELECT source, target, count(*) AS n, regr_slope(y, x) AS s, regr_intercept(y, x) AS i, regr_r2(y, x) AS r2, count(*) FILTER (WHERE x > 0.6) AS n_hi, count(*) FILTER (WHERE x < 0.4) AS n_lo,
   avg(y) FILTER (WHERE x > 0.6) AS yh, avg(y) FILTER (WHERE x < 0.4) AS yl, stddev_pop(y) FILTER (WHERE x > 0.6) AS sh, stddev_pop(y) FILTER (WHERE x < 0.4) AS sl FROM al GROUP BY 1, 2),
est AS (SELECT source, target, n, round(greatest(0.01, least(0.99, i + s)), 3) AS py_reg, round(greatest(0.01, least(0.99, i)), 3) AS pn_reg, round(r2, 4) AS r2, n_hi, n_lo,
   CASE WHEN n_hi >= 8 THEN round(yh, 3) END AS py_bin, CASE WHEN n_lo >= 8 THEN round(yl, 3) END AS pn_bin, CASE WHEN n_hi >= 8 THEN round(sh, 3) END AS std_hi, CASE WHEN n_lo >= 8 THEN round(sl, 3) END AS std_lo FROM est0)"""


@Q.add("edge_estimates", with_views("prices", "SELECT * FROM est", EST_SQL))
def edge_estimates(spark, sf):
    return GR.edge_estimates(AS.align(fx.prices(spark, sf), edges(spark)))


@Q.add("blended_edges", with_views("prices", """
SELECT source, target, round(greatest(0.01, least(0.99, raw)), 3) AS py, round(greatest(0.01, least(0.99, mid - half)), 3) AS py_lo, round(greatest(0.01, least(0.99, mid + half)), 3) AS py_hi
FROM (SELECT *, CASE WHEN py_bin IS NOT NULL THEN raw ELSE greatest(0.01, least(0.99, raw)) END AS mid, CASE WHEN py_bin IS NOT NULL THEN 1.645 * std_hi / sqrt(n_hi) * 1.5 ELSE 0.15 END AS half
  FROM (SELECT est.*, (p_yes + wt * coalesce(py_bin, CASE WHEN r2 > 0 THEN py_reg END, p_yes)) / (1 + wt) AS raw
    FROM (SELECT est.*, e.p_yes, CASE WHEN py_bin IS NOT NULL THEN n_hi / 10.0::DOUBLE WHEN r2 > 0 THEN r2 * 3 ELSE 0 END AS wt FROM est JOIN edges e USING (source, target)) est))""", EST_SQL))
def blended_edges(spark, sf):
    e = edge_estimates(spark, sf).join(edges(spark), ["source", "target"])
    c = F.col
    p, lo, hi = GR.blend(c("p_yes"), c("py_bin"), c("n_hi"), c("std_hi"), c("py_reg"), c("r2"))
    return e.select("source", "target", p.alias("py"), lo.alias("py_lo"), hi.alias("py_hi"))


@Q.add("first_differences", with_views("prices", """
, mm AS (SELECT source, target, min(date) AS a, max(date) AS z FROM pairs GROUP BY 1, 2),
hv AS (SELECT pairs.*, (2 * (date - a) > z - a)::INT AS half FROM pairs JOIN mm USING (source, target)),
ln AS (SELECT source, target, 1 - half AS half, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM hv GROUP BY 1, 2, half),
pr AS (SELECT hv.*, i + s * x AS model FROM hv LEFT JOIN ln USING (source, target, half)),
df AS (SELECT source, target, half, model - lag(model) OVER w AS dm, y - lag(y) OVER w AS da FROM pr WINDOW w AS (PARTITION BY source, target, half ORDER BY date))
SELECT source, target, half, count(*) AS n, round(avg((dm - da) * (dm - da)), 9) AS mse_model, round(avg(da * da), 9) AS mse_zero FROM df WHERE da IS NOT NULL GROUP BY 1, 2, 3""", EDGE_SQL + """,
pairs AS (SELECT source, target, a.date, a.probability AS x, b.probability AS y FROM edges e JOIN prices a ON a.series_id = source JOIN prices b ON b.series_id = target AND a.date = b.date)"""))
def first_differences(spark, sf):
    """Day-to-day changes of an edge's child told from its parent by the line of the other half, against no change.

    A series has one row per calendar day, which bounds its window."""
    lines = AS.other_half_lines(AS.align(fx.prices(spark, sf), edges(spark)), ["source", "target"], "date")
    d = AS.first_difference(lines, ["source", "target", "half"], "date", "model", "y")
    return d.select("source", "target", "half", "n", F.round("mse_model", 9).alias("mse_model"), F.round("mse_zero", 9).alias("mse_zero"))


def observations(spark, sf):
    """Root prices on every fourteenth date: one scenario per date."""
    pr = fx.prices(spark, sf)
    dates = AS.thinned_dates(AS.coverage_dates(pr, 0.9), 14)
    roots = spark.createDataFrame([("1-URGENT",), ("2-HIGH",)], "series_id string")
    at = AS.asof(pr, dates.select("date").crossJoin(F.broadcast(roots)))
    return at.filter("price is not null").select(F.col("date").cast("string").alias("scenario"), F.col("series_id").alias("id"), F.col("price").alias("p"))


@Q.add("graph_scenarios")
def graph_scenarios(spark, sf):
    n = nodes(spark, sf)
    return GR.what_if(GR.propagate(n, edges(spark), observations(spark, sf)), n)


@Q.add("graph_reconcile", with_views("prices", """
SELECT scenario, id, round(p, 10) AS p FROM (
  SELECT scenario, '1-URGENT' AS id, u AS p FROM l UNION ALL SELECT scenario, '2-HIGH', h FROM l UNION ALL SELECT scenario, '3-MEDIUM', m FROM l
  UNION ALL SELECT scenario, '4-NOT SPECIFIED', q FROM l UNION ALL SELECT scenario, '5-LOW', ((0.66 * m + 0.38 * (1 - m)) + (0.55 * q + 0.45 * (1 - q))) / 2 FROM l)""", """
cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS ix FROM (SELECT d.date, count(s.d) AS live FROM (SELECT DISTINCT date FROM prices) d LEFT JOIN (SELECT series_id, min(date) AS d FROM prices GROUP BY 1) s ON s.d <= d.date GROUP BY 1
   HAVING count(s.d) >= 0.9 * (SELECT count(DISTINCT series_id) FROM prices))),
ev AS (SELECT date, CAST(date AS VARCHAR) AS scenario FROM cal WHERE ix >= 14 AND (ix - 14) % 14 = 0),
ob AS (SELECT ev.scenario, u.probability AS u, h.probability AS h FROM ev ASOF JOIN (SELECT * FROM prices WHERE series_id = '1-URGENT') u ON ev.date >= u.date ASOF JOIN (SELECT * FROM prices WHERE series_id = '2-HIGH') h ON ev.date >= h.date),
l AS (SELECT *, ((0.62 * u + 0.41 * (1 - u)) + (0.58 * h + 0.44 * (1 - h))) / 2 AS m, 0.57 * u + 0.46 * (1 - u) AS q FROM ob)"""))
def graph_reconcile(spark, sf):
    v = GR.propagate(nodes(spark, sf), edges(spark), observations(spark, sf), reconcile=True)
    return v.select("scenario", "id", rounded(F.col("p")).alias("p"))


@Q.add("graph_faults", """
WITH n AS (SELECT 'c' || c_nationkey || '-' || (c_custkey % 40) AS id, c_acctbal / 9000 AS prior FROM customer), e AS (SELECT DISTINCT 'c' || c_nationkey || '-' || (c_custkey % 43) AS source, 'c' || (c_custkey % 7) || '-1' AS target,
  CASE WHEN c_custkey % 30 = 0 THEN 1.5 ELSE 0.6 END::DOUBLE AS p_yes FROM customer)
SELECT 'duplicate_id' AS fault, id FROM n GROUP BY id HAVING count(*) > 1 UNION SELECT 'prior_range', id FROM n WHERE NOT coalesce(prior BETWEEN 0 AND 1, false)
UNION SELECT 'unknown_node', x FROM (SELECT unnest([source, target]) AS x FROM e) WHERE x NOT IN (SELECT id FROM n) UNION SELECT 'edge_range', target FROM e WHERE p_yes > 1
UNION SELECT 'fan_in', target FROM e GROUP BY target HAVING count(*) > 16""")
def graph_faults(spark, sf):
    """Structural faults of a graph made from customers: equal names, odd priors, loose ends, odd weights, too many parents."""
    from presage.session import table

    c = table(spark, sf, "customer")
    name = lambda m: F.concat(F.lit("c"), F.col("c_nationkey").cast("string"), F.lit("-"), (F.col("c_custkey") % m).cast("string"))
    n = c.select(name(40).alias("id"), (F.col("c_acctbal") / 9000).alias("prior"))
    e = c.select(name(43).alias("source"), F.concat(F.lit("c"), (F.col("c_custkey") % 7).cast("string"), F.lit("-1")).alias("target"),
                 F.when(F.col("c_custkey") % 30 == 0, 1.5).otherwise(0.6).alias("p_yes"), F.lit(0.4).alias("p_no")).distinct()
    return GR.findings(n, e)


@Q.add("graph_backtest")
def graph_backtest(spark, sf):
    """Model against the frozen price and the previous price on child series."""
    pr, n, e = fx.prices(spark, sf), nodes(spark, sf), edges(spark)
    obs = observations(spark, sf)
    pred = GR.propagate(n, e, obs).join(F.broadcast(e.select(F.col("target").alias("id")).distinct()), "id", "left_semi").select(
        F.col("id").alias("series_id"), F.to_date("scenario").alias("date"), "p")
    start = pr.groupBy("series_id").agg(F.min_by("probability", "date").alias("frozen"))
    at = AS.asof(pr, pred).join(start, "series_id").filter("price is not null and prev_price is not null")
    sq = lambda x: rounded(F.avg(F.pow(F.col(x) - F.col("price"), 2)))
    return at.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), sq("p").alias("model"), sq("frozen").alias("persistence"), sq("prev_price").alias("previous"))


@Q.add("edge_refit")
def edge_refit(spark, sf):
    pr, e = fx.prices(spark, sf), GR.edge_weights(edges(spark))
    dates = AS.coverage_dates(pr, 0.9)
    split = dates.agg(F.date_add(F.min("date"), (F.datediff(F.max("date"), F.min("date")) * 0.6).cast("int")).alias("split"))
    y = pr.select(F.col("series_id").alias("target"), "date", F.col("probability").alias("y"))
    x = pr.select(F.col("series_id").alias("source"), "date", F.col("probability").alias("x"))
    # at most 16 parents per child and day
    rows = F.broadcast(e).join(y, "target").join(x, ["source", "date"]).groupBy("target", "date").agg(
        F.max("y").alias("y"), F.array_sort(F.collect_list(F.struct("source", "x", "w"))).alias("ps"))
    need = F.broadcast(e.groupBy("target").agg(F.count(F.lit(1)).alias("_k")))
    rows = rows.join(need, "target").filter(F.size("ps") == F.col("_k")).crossJoin(F.broadcast(split)).select(
        "target", "date", (F.col("date") > F.col("split")).alias("test"), "y", F.transform("ps", lambda q: q["x"]).alias("p"), F.transform("ps", lambda q: q["w"]).alias("w"))
    out = M.refit_edges(rows, [0.25 * i for i in range(0, 9)])
    return out.select("best_scale", *[rounded(F.col(c)).alias(c) for c in out.columns if c != "best_scale"])


@Q.add("pruned_edges", with_views("prices", """
SELECT source, target, score, score > 0 AND row_number() OVER (PARTITION BY target ORDER BY score DESC, source) <= 1 AS kept FROM (
  SELECT source, target, round(abs(p_yes - p_no) * p * (1 - p), 5) AS score FROM edges JOIN (SELECT series_id, greatest(0.01, least(0.99, round(arg_max(probability, date), 4))) AS p FROM prices GROUP BY 1) ON series_id = source)""", EDGE_SQL))
def pruned_edges(spark, sf):
    e = edges(spark).join(nodes(spark, sf).select(F.col("id").alias("source"), F.col("prior").alias("p")), "source")
    return GR.prune_edges(e, 1).select("source", "target", "score", "kept")


@Q.add("boosted_backtest")
def boosted_backtest(spark, sf):
    """Boosted trees over ten folds of whole events; every feature of an entry is the mean of its claims."""
    claims = SC.usable_claims(fx.claims(spark, sf))
    stated = lambda c, other: F.avg(F.coalesce(F.col(c).cast("double"), F.lit(other))) if c in claims.columns else F.lit(other)
    entries = claims.groupBy("market_id", "source_id", "article_date").agg(
        F.avg("stance").alias("stance"), F.avg("certainty").alias("certainty"), F.count(F.lit(1)).cast("double").alias("prediction_count"),
        *[stated(c, other).alias(c) for c, other in M.UNSTATED.items()])
    known = SC.board(SC.source_market_cells(scored(spark, sf)), ["source_id"]).select("source_id", F.col("brier_score").alias("source_brier"))
    rows = entries.join(fx.outcomes(spark, sf).select("market_id", "outcome", "outcome_date"), "market_id").filter(
        F.col("article_date").between(F.date_sub("outcome_date", 30), F.date_sub("outcome_date", 3))).join(known, "source_id", "left")
    rows = rows.withColumn("days_before", F.datediff("outcome_date", "article_date").cast("double")).fillna({"source_brier": 0.25})
    return M.boosted_by_fold(rows, "market_id", folds=10).select("market_id", "outcome", rounded(F.col("p")).alias("p"))


@Q.add("isotonic_calibration")
def isotonic_calibration(spark, sf):
    c = M.isotonic(backtest(spark, sf), "p", "outcome")
    return c.select("market_id", "outcome", rounded(F.col("p")).alias("p"), rounded(F.col("calibrated")).alias("calibrated"))


@Q.add("skill_ratings")
def skill_ratings(spark, sf):
    """One team per (event, source), one rating period per outcome date."""
    cells = scored(spark, sf).groupBy("market_id", "source_id").agg(F.avg("stance").alias("s"), F.max("outcome").alias("o"), F.max("outcome_date").alias("day"))
    results = cells.select(F.col("market_id").alias("event"), F.col("source_id").alias("player"), ((F.col("s") > 0) == F.col("o")).alias("won"), "day")
    from presage.session import cut_lineage

    results = cut_lineage(results)
    days = [r.day for r in results.select("day").distinct().orderBy("day").collect()]  # one value per calendar day
    return R.rate(results, "day", days).select("player", *[rounded(F.col(c)).alias(c) for c in ("mu", "sigma", "conservative")])
