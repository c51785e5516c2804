"""What-if studies over pools: fact lane, strata thresholds, outliers, date mentions."""

from __future__ import annotations

from pyspark.sql import functions as F

from presage.functions import scalars as S
from presage.functions.mentions import date_mentions
from presage.operators import articles as A, pooling as PL, skew
from presage.plans.articles import ARTICLE_SQL
from presage.plans.pooling import EVIDENCE_SQL, PLAIN, evidence
from presage.plans.registry import Registry
from presage.session import rounded, table
from presage.sources import fixtures as fx
from presage.sources.fixtures import with_views

Q = Registry()


@Q.add("fact_lane_backtest", with_views("pools rich_claims outcomes", """
SELECT count(*) AS pools, round(avg(pf - ps), 10) AS mean_change, round(avg(abs(pf - ps)), 10) AS mean_abs_change, count(*) FILTER (WHERE pf > ps + 1e-9) AS raised, count(*) FILTER (WHERE pf < ps - 1e-9) AS lowered,
  round(avg(pow(ps - outcome::INT, 2)), 10) AS brier_stance, round(avg(pow(pf - outcome::INT, 2)), 10) AS brier_fact
FROM (SELECT pool_id, 1 / (1 + exp(-sum(w * ln(q / (1 - q))) / sum(w))) AS ps, 1 / (1 + exp(-sum(w * ln(r / (1 - r))) / sum(w))) AS pf FROM (
  SELECT pool_id, evidence_weight AS w, greatest(0.01, least(0.99, (stance + 1) / 2)) AS q, greatest(0.01, least(0.99, (fact_signal + 1) / 2)) AS r FROM art WHERE fact_signal IS NOT NULL AND evidence_weight > 0) GROUP BY 1)
JOIN outcomes ON pool_id = market_id""", ARTICLE_SQL))
def fact_lane_backtest(spark, sf):
    a = A.reduce_articles(fx.rich_claims(spark, sf)).filter("fact_signal is not null and evidence_weight > 0").select("pool_id", "stance", "fact_signal", F.col("evidence_weight").alias("weight"))
    lanes = a.select("pool_id", "weight", F.explode(F.create_map(F.lit("ps"), F.col("stance"), F.lit("pf"), F.col("fact_signal"))).alias("lane", "stance"))
    pooled = PL.pool_sources(lanes, ["pool_id", "lane"], PLAIN).withColumn("p", S.prob(F.col("mean")))
    wide = pooled.groupBy("pool_id").agg(F.max(F.when(F.col("lane") == "ps", F.col("p"))).alias("ps"), F.max(F.when(F.col("lane") == "pf", F.col("p"))).alias("pf"))
    both = wide.join(fx.outcomes(spark, sf).select(F.col("market_id").alias("pool_id"), "outcome"), "pool_id")
    d = F.col("pf") - F.col("ps")
    return both.agg(F.count(F.lit(1)).alias("pools"), rounded(F.avg(d)).alias("mean_change"), rounded(F.avg(F.abs(d))).alias("mean_abs_change"), F.count_if(d > 1e-9).alias("raised"), F.count_if(d < -1e-9).alias("lowered"),
                    rounded(F.avg(S.brier(F.col("ps"), F.col("outcome")))).alias("brier_stance"), rounded(F.avg(S.brier(F.col("pf"), F.col("outcome")))).alias("brier_fact"))


@Q.add("strata_threshold_sweep", with_views("pools pool_rows", """
, t AS (SELECT pool_id, th, coalesce(stratum, '#' || row_ix) AS st, weight0 AS w, greatest(0.01, least(0.99, (stance + 1) / 2)) AS p FROM w0, (SELECT unnest([0.05, 0.1, 0.2])::DOUBLE AS th)),
m AS (SELECT *, m / sum(m) OVER (PARTITION BY pool_id, th) < th AS small, sum(m) OVER (PARTITION BY pool_id, th) AS tt FROM (SELECT pool_id, th, st, sum(w) AS m FROM t GROUP BY 1, 2, 3)),
f AS (SELECT *, CASE WHEN small THEN sum(m) FILTER (WHERE small) OVER q ELSE m END AS own, count(*) FILTER (WHERE NOT small) OVER q + CASE WHEN count(*) FILTER (WHERE small) OVER q > 0 THEN 1 ELSE 0 END AS k FROM m WINDOW q AS (PARTITION BY pool_id, th))
SELECT pool_id, th AS threshold, round(2 / (1 + exp(-sum(w * tt / own / k * ln(p / (1 - p))) / sum(w * tt / own / k))) - 1, 10) AS mean FROM t JOIN f USING (pool_id, th, st) WHERE own > 0 GROUP BY 1, 2""", EVIDENCE_SQL).replace("\n\n, t AS", ",\nt AS"))
def strata_threshold_sweep(spark, sf):
    keys = ["pool_id", "threshold"]

    def sweep(rows, whole):
        rows = rows.withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in (0.05, 0.1, 0.2)])))
        return PL.pool_sources(PL.balance_strata(rows, keys, F.col("threshold"), whole), keys, PLAIN)

    return skew.by_size(evidence(spark, sf), ["pool_id"], sweep).filter("evidence_mass > 0").select(*keys, rounded(F.col("mean")).alias("mean"))


def outliers(spark, sf):
    """Signals per pool: pin gap, band, centre gap, weight concentration, near-zero rows."""
    def pooled(rows, whole):
        base = rows if whole else skew.fork(rows)
        shape = [F.try_divide(F.max("weight"), F.sum("weight")).alias("max_weight_share"), F.count_if(F.col("weight") < 0.01).alias("near_zero_rows"), F.avg(F.col("settled").cast("double")).alias("settled_share")]
        if whole:
            shaped = base.groupBy("pool_id").agg(*shape, F.percentile("stance", F.lit(0.5)).alias("median")).filter("median is not null")
        else:
            mid = skew.exact_quantiles(base, ["pool_id"], "stance", [0.5]).select("pool_id", F.col("q").alias("median"))
            shaped = base.groupBy("pool_id").agg(*shape).join(mid, "pool_id")
        # no factor of a weight looks at whether its row is settled, so both variants share the weights
        rows = PL.reweight(base, ["pool_id"], PLAIN, whole).withColumn("variant", F.explode(F.array(F.lit("live"), F.lit("unpinned"))))
        rows = rows.withColumn("settled", F.col("settled") & (F.col("variant") == "live"))
        return PL.pool_weighted(rows, ["pool_id", "variant"], PLAIN, whole).join(shaped, "pool_id")

    res = skew.by_size(evidence(spark, sf), ["pool_id"], pooled)
    live, free = F.col("variant") == "live", F.col("variant") == "unpinned"
    shape = ("max_weight_share", "near_zero_rows", "settled_share", "median")
    wide = res.groupBy("pool_id").agg(
        F.max(F.when(live, F.col("mean"))).alias("mean"), F.max(F.when(free & F.col("insufficient_reason").isNull(), F.col("mean"))).alias("free_mean"), F.max(F.when(live, F.col("settled"))).alias("settled"),
        F.max(F.when(live, (F.col("ci_high") - F.col("ci_low")) * 50)).alias("band_pct"), F.max(F.when(live, F.col("n_eff") / F.col("n"))).alias("n_eff_ratio"), F.max(F.when(live, F.col("max_swing"))).alias("max_swing"),
        *[F.max(c).alias(c) for c in shape])
    return wide.select(
        "pool_id", "settled", F.when(F.col("settled"), F.abs(F.col("mean") - F.col("free_mean")) / 2).alias("pin_gap"), "band_pct", (F.abs(F.col("mean") - F.col("median")) / 2).alias("centre_gap"),
        "n_eff_ratio", "max_weight_share", "near_zero_rows", "settled_share", "max_swing")


SIGNALS = ("pin_gap", "band_pct", "centre_gap", "n_eff_ratio", "max_weight_share", "max_swing")


@Q.add("outlier_scan")
def outlier_scan(spark, sf):
    return outliers(spark, sf).withColumns({c: rounded(F.col(c)) for c in (*SIGNALS, "settled_share")})


@Q.add("signal_distributions")
def signal_distributions(spark, sf):
    long = outliers(spark, sf).unpivot("pool_id", list(SIGNALS), "signal", "v").filter("v is not null")
    long = skew.fork(long)
    q = skew.exact_quantiles(long, ["signal"], "v", [0.1, 0.5, 0.9]).groupBy("signal").agg(
        *[F.max(F.when(F.col("prob") == p, rounded(F.col("q")))).alias(n) for p, n in ((0.1, "p10"), (0.5, "p50"), (0.9, "p90"))])
    return long.groupBy("signal").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("v")).alias("mean"), rounded(F.max("v")).alias("max")).join(q, "signal")


@Q.add("top_swings", with_views("pools pool_rows", "SELECT pool_id, row_ix, round(weight0, 10) AS weight FROM w0 ORDER BY weight0 DESC, row_ix LIMIT 10", EVIDENCE_SQL))
def top_swings(spark, sf):
    """The ten heaviest evidence rows, a capped report."""
    return evidence(spark, sf).filter("weight is not null").orderBy(F.desc("weight"), "row_ix").limit(10).select("pool_id", "row_ix", rounded(F.col("weight")).alias("weight"))


@Q.add("document_date_mentions")
def document_date_mentions(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("doc_id") % 90).cast("int")).alias("published"))
    return date_mentions(d, "doc_id", "text", "published")
