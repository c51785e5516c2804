"""Pooled forecasts under plain and full weighting, and their parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from presage.functions import scalars as S, text as X
from presage.operators import pooling as PL, skew
from presage.operators.pooling import PoolRules
from presage.plans.registry import Registry
from presage.session import rounded
from presage.sources import fixtures as fx
from presage.sources.fixtures import with_views

Q = Registry()
FULL = PoolRules(cluster_exponent=0.5, harmonic=True, max_source_share=0.2, strata=True, min_stratum_share=0.1, defer_thin=True, base_rate=0.15)
PLAIN = PoolRules(base_rate=0.15)
LEGACY = PoolRules(revalidate=False, event_collapse=False)


def evidence(spark, sf):
    """Pool rows with weights and event keys."""
    rows = PL.row_weights(fx.pool_rows(spark, sf), PLAIN)
    key = X.event_key(F.col("event_actors"), F.col("event_target"), F.coalesce("settlement_event_date", "published_date"))
    return rows.withColumn("event_key", key)


def _alias_map() -> str:
    return "map {" + ", ".join(f"'{k}': '{v}'" for k, v in X.ENTITY_ALIASES.items()) + "}"


def _norm(col: str) -> str:
    clean = ("trim(regexp_replace(trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')), '^(the|a|an) ', ''))")
    return (f"nullif(array_to_string(list_sort(list_distinct(list_transform(list_filter(list_transform(string_split({col}, ','), "
            f"lambda x: {clean}), lambda x: x <> ''), lambda x: coalesce({_alias_map()}[x], x)))), ', '), '')")


EVIDENCE_SQL = f"""
keyed AS (SELECT *, CASE WHEN a IS NOT NULL AND t IS NOT NULL AND d IS NOT NULL THEN a || chr(31) || t || chr(31) || d END AS event_key
  FROM (SELECT *, {_norm('event_actors')} AS a, {_norm('event_target')} AS t,
               CAST(coalesce(settlement_event_date, published_date) AS VARCHAR) AS d FROM pool_rows)),
w0 AS (SELECT *, base * CASE WHEN published_date IS NULL THEN 0.02 ELSE greatest(0.02, pow(0.5, age / 7.0)) END AS weight0,
              base * CASE WHEN published_date IS NULL THEN 0.0 ELSE greatest(0.0, pow(0.5, age / 7.0)) END AS valve0, base AS age0,
              CASE WHEN claim_archetype IS DISTINCT FROM 'scheduled' AND claim_created IS NOT NULL AND day IS NOT NULL THEN
                CASE WHEN day < claim_created - 30 THEN 'before_window' WHEN day > claim_deadline THEN 'after_deadline' END END AS window_reason
  FROM (SELECT *, greatest(0, DATE '2024-01-20' - published_date) AS age, coalesce(settlement_event_date, published_date) AS day,
               credibility_weight * coalesce(evidence_weight, least(certainty, 0.25)) * relevance * relevance AS base FROM keyed)),
w1 AS (SELECT * EXCLUDE (weight0, valve0, age0), CASE WHEN window_reason IS NULL THEN weight0 ELSE 0 END AS weight,
              CASE WHEN window_reason IS NULL THEN valve0 ELSE 0 END AS valve_weight, CASE WHEN window_reason IS NULL THEN age0 ELSE 0 END AS age_weight,
              CASE WHEN settled THEN CASE
                WHEN occ AND ev IS NULL THEN 'missing_event_date' WHEN occ AND ev > dl THEN 'event_after_deadline'
                WHEN NOT occ AND ev IS NULL AND dl <= DATE '2024-01-20' THEN CASE WHEN published_date > dl + 14 THEN 'stale_undated_foreclosure' END
                WHEN NOT occ AND ev IS NULL THEN 'undated_foreclosure'
                WHEN NOT occ AND ev > dl AND NOT dl <= DATE '2024-01-20' THEN 'event_after_deadline'
                WHEN NOT occ AND ev > dl + 14 THEN 'post_window_occurrence'
                WHEN ev < claim_created THEN 'event_before_claim_window' WHEN ev > published_date THEN 'event_after_article' END END AS vote_reason
  FROM (SELECT *, settlement_event_date AS ev, claim_deadline AS dl, (stance >= 0) = (claim_direction IS DISTINCT FROM 'survival') AS occ FROM w0)),
w2 AS (SELECT * EXCLUDE (weight), CASE WHEN event_key IS NOT NULL AND count(*) OVER e >= 2 AND sum(weight) OVER e > 0
         THEN weight * max(weight) OVER e / sum(weight) OVER e ELSE weight END AS weight
  FROM w1 WINDOW e AS (PARTITION BY pool_id, event_key))
"""

FULL_SQL = """
w3 AS (SELECT * EXCLUDE (weight), weight * pow(count(*) OVER (PARTITION BY pool_id, cluster_id), -0.5)
              / CASE WHEN source_id IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY pool_id, source_id ORDER BY published_date DESC NULLS LAST, row_ix) END AS weight,
              coalesce(source_id, '#' || row_ix) AS src FROM w2),
mass(pool_id, src, orig, cur, cap, capped, round, live) AS (
  SELECT pool_id, src, m, m, 0.2::DOUBLE * sum(m) OVER (PARTITION BY pool_id), false, 0, true FROM (SELECT pool_id, src, sum(weight) AS m FROM w3 GROUP BY 1, 2)
  UNION ALL
  SELECT pool_id, src, orig, CASE WHEN off THEN cap WHEN NOT capped AND rest > 0 THEN cur * (rest + freed) / rest ELSE cur END, cap, capped OR off, round + 1, true
  FROM (SELECT *, sum(CASE WHEN NOT capped AND NOT off THEN cur ELSE 0 END) OVER p AS rest, sum(CASE WHEN off THEN cur - cap ELSE 0 END) OVER p AS freed,
               count(*) FILTER (WHERE off) OVER p AS n_off, count(*) FILTER (WHERE NOT capped AND NOT off) OVER p AS n_free
        FROM (SELECT *, NOT capped AND cur > cap AS off FROM mass) WINDOW p AS (PARTITION BY pool_id))
  WHERE n_off > 0 AND n_free > 0),
final_mass AS (SELECT pool_id, src, arg_max(cur, round) AS cur, max(orig) AS orig FROM mass GROUP BY 1, 2),
w4 AS (SELECT w3.* EXCLUDE (weight), CASE WHEN orig > 0 THEN weight * cur / orig ELSE weight END AS weight, coalesce(stratum, '#' || row_ix) AS st
       FROM w3 JOIN final_mass USING (pool_id, src)),
sm AS (SELECT *, m / sum(m) OVER (PARTITION BY pool_id) >= 0.1 AS q, sum(m) OVER (PARTITION BY pool_id) AS t
       FROM (SELECT pool_id, st, sum(weight) AS m FROM w4 GROUP BY 1, 2)),
sf AS (SELECT pool_id, st, CASE WHEN t > 0 AND own > 0 THEN t / own / k ELSE 1 END AS f
       FROM (SELECT *, CASE WHEN q THEN m ELSE sum(m) FILTER (WHERE NOT q) OVER p END AS own,
                    count(*) FILTER (WHERE q) OVER p + CASE WHEN count(*) FILTER (WHERE NOT q) OVER p > 0 THEN 1 ELSE 0 END AS k
             FROM sm WINDOW p AS (PARTITION BY pool_id))),
w5 AS (SELECT w4.* EXCLUDE (weight), weight * f AS weight FROM w4 JOIN sf USING (pool_id, st))
"""


def decide_sql(src: str, defer: bool) -> str:
    return f"""
rows AS (SELECT *, greatest(0.01, least(0.99, (stance + 1) / 2)) AS p, settled AND vote_reason IS NULL AS ok FROM {src}),
agg AS (
  SELECT pool_id, count(*) AS n, sum(weight) AS w, sum(weight * weight) AS w2, sum(weight * ln(p / (1 - p))) AS wl, avg(ln(p / (1 - p))) AS al,
         sum(relevance * relevance) AS rel, sum(valve_weight) AS valve, sum(age_weight) AS age, sum(least(weight, 0.5)) / 0.5 AS capn,
         count(*) FILTER (WHERE ok AND stance >= 0) AS pos, count(*) FILTER (WHERE ok AND stance < 0) AS neg,
         count(DISTINCT cluster_id) FILTER (WHERE ok AND stance >= 0) AS pc, count(DISTINCT cluster_id) FILTER (WHERE ok AND stance < 0) AS nc,
         coalesce(sum(weight) FILTER (WHERE ok AND stance >= 0), 0) AS pw, coalesce(sum(weight) FILTER (WHERE ok AND stance < 0), 0) AS nw,
         count(vote_reason) AS votes_demoted, count(window_reason) AS rows_outside_window, bool_or(settled) AS any_settled,
         any_value(claim_direction) AS claim_direction, any_value(claim_deadline) AS claim_deadline, any_value(claim_created) AS claim_created, any_value(claim_archetype) AS claim_archetype
  FROM rows GROUP BY 1),
pooled AS (SELECT a.*, 1 / (1 + exp(-CASE WHEN w > 0 THEN wl / w ELSE al END)) AS mp,
                  CASE WHEN w > 0 AND w2 > 0 THEN greatest(1, least(n, w * w / w2)) ELSE n END AS n_eff FROM agg a),
spread AS (SELECT r.pool_id, CASE WHEN max(w) > 0 THEN sum(weight * pow(p - mp, 2)) / max(w) ELSE avg(pow(p - mp, 2)) END AS v FROM rows r JOIN pooled USING (pool_id) GROUP BY 1),
loo AS (
  SELECT pool_id, CASE WHEN count(*) >= 2 THEN max(swing) END AS max_swing,
         CASE WHEN count(*) >= 2 AND max(swing) > 1e-12 THEN arg_max(source_id, (round(swing, 12), -ix)) END AS dominant_source
  FROM (SELECT s.pool_id, source_id, ix, abs(2 * mp - 1 - (2 / (1 + exp(-CASE WHEN w - sw > 1e-12 * w THEN (wl - swl) / (w - sw) ELSE al END)) - 1)) AS swing
        FROM (SELECT pool_id, source_id, sum(weight) AS sw, sum(weight * ln(p / (1 - p))) AS swl, min(row_ix) FILTER (WHERE weight > 0) AS ix
              FROM rows WHERE source_id IS NOT NULL GROUP BY 1, 2 HAVING sum(weight) > 0) s JOIN pooled USING (pool_id)) GROUP BY 1),
st AS (
  SELECT *, rel < 0.05 AS off, rel >= 0.05 AND w <= 0 AS now_, rel >= 0.05 AND valve < 0.5 AS thin,
         CASE WHEN pos > 0 AND neg > 0 THEN 'settlement_conflict'
              WHEN greatest(pc, nc) >= 2 AND CASE WHEN pos > neg THEN pw ELSE nw END < 0.2 THEN 'settlement_quality_floor' END AS suppression_reason
  FROM pooled JOIN spread USING (pool_id) LEFT JOIN loo USING (pool_id)),
st2 AS (
  SELECT *, CASE WHEN suppression_reason IS NULL AND greatest(pc, nc) >= 2 THEN CASE WHEN pos > 0 THEN 1 ELSE -1 END END AS dir,
         thin AND {str(defer).lower()} AND NOT now_ AND NOT coalesce(claim_deadline >= DATE '2024-01-20', false) AS nosig,
         1.96 * sqrt(v) / sqrt(n_eff) AS sem, greatest(0, least(1, (0.5 - valve) / 0.5)) * 0.45 AS extra,
         1.96 * 0.05 / sqrt(greatest(1, least(n_eff, capn))) AS half FROM st),
st3 AS (
  SELECT *, CASE WHEN dir IS NOT NULL THEN NULL WHEN off THEN 'all_articles_off_topic' WHEN now_ THEN 'no_usable_weight' WHEN nosig THEN 'no_decisive_signal' END AS reason,
         greatest(0.01, least(0.99, mp - sem)) AS lo0, greatest(0.01, least(0.99, mp + sem)) AS hi0 FROM st2),
st4 AS (SELECT *, CASE WHEN extra > 0 THEN greatest(0.01, least(0.99, least(lo0, mp) - extra)) ELSE lo0 END AS lo1,
                  CASE WHEN extra > 0 THEN greatest(0.01, least(0.99, greatest(hi0, mp) + extra)) ELSE hi0 END AS hi1 FROM st3)
"""


DECIDE = """
SELECT pool_id,
  round(CASE WHEN dir IS NOT NULL THEN 0.94 * dir WHEN reason IS NOT NULL THEN 0 ELSE 2 * mp - 1 END, 10)::DOUBLE AS mean,
  round(CASE WHEN dir IS NOT NULL THEN 0.06 WHEN reason IS NOT NULL THEN 0 ELSE greatest(2 * sqrt(v), 2 * extra, 0.1) END, 10)::DOUBLE AS std,
  round(CASE WHEN dir IS NOT NULL THEN 2 * CASE WHEN dir > 0 THEN 0.97 - 0.06 ELSE greatest(0.005, 0.03 - 0.025) END - 1 WHEN reason IS NOT NULL THEN 0
        ELSE 2 * greatest(0.01, least(0.99, least(lo1, mp - half))) - 1 END, 10)::DOUBLE AS ci_low,
  round(CASE WHEN dir IS NOT NULL THEN 2 * CASE WHEN dir > 0 THEN least(0.995, 0.97 + 0.025) ELSE 0.03 + 0.06 END - 1 WHEN reason IS NOT NULL THEN 0
        ELSE 2 * greatest(0.01, least(0.99, greatest(hi1, mp + half))) - 1 END, 10)::DOUBLE AS ci_high,
  dir IS NOT NULL AS settled, n, round(n_eff, 10)::DOUBLE AS n_eff, round(w, 10) AS evidence_mass, round(valve, 10) AS valve_mass, round(age, 10) AS age_adjusted_mass,
  thin AS thin_evidence, reason AS insufficient_reason, CASE WHEN dir IS NOT NULL THEN greatest(pc, nc) ELSE 0 END AS settled_sources,
  suppression_reason IS NOT NULL AS settlement_suppressed, suppression_reason, votes_demoted, rows_outside_window,
  CASE WHEN NOT (off OR now_ OR nosig) THEN round(max_swing, 10) END AS max_swing, CASE WHEN NOT (off OR now_ OR nosig) THEN dominant_source END AS dominant_source,
  CASE WHEN NOT (off OR now_ OR nosig) AND claim_archetype = 'diffuse' AND NOT any_settled AND claim_deadline > claim_created THEN
    round(2 * greatest(0, least(1, 0.15 + (mp - 0.15) * pow(0.5, greatest(0, least(claim_deadline - claim_created, DATE '2024-01-20' - claim_created))::DOUBLE
          / (claim_deadline - claim_created) / 0.5))) - 1, 10) END AS hazard_mean
FROM st4"""


def _out(df):
    return df.withColumns({c: rounded(F.col(c)) for c in (
        "mean", "std", "ci_low", "ci_high", "n_eff", "evidence_mass", "valve_mass", "age_adjusted_mass", "max_swing", "hazard_mean")})


@Q.add("pooled_forecasts", with_views("pools pool_rows", DECIDE, EVIDENCE_SQL + "," + decide_sql("w2", False)))
def pooled_forecasts(spark, sf):
    return _out(PL.aggregate_pool(evidence(spark, sf), ["pool_id"], PLAIN))


@Q.add("pooled_forecasts_full", with_views("pools pool_rows", DECIDE, EVIDENCE_SQL + "," + FULL_SQL + "," + decide_sql("w5", True)))
def pooled_forecasts_full(spark, sf):
    return _out(PL.aggregate_pool(evidence(spark, sf), ["pool_id"], FULL))


@Q.add("pool_row_weights", with_views("pools pool_rows", """
SELECT pool_id, row_ix, round(weight0, 10) AS weight, round(valve0, 10) AS valve_weight, round(age0, 10) AS age_weight, window_reason, event_key FROM w0""",
                                      EVIDENCE_SQL))
def pool_row_weights(spark, sf):
    return evidence(spark, sf).select("pool_id", "row_ix", rounded(F.col("weight")).alias("weight"), rounded(F.col("valve_weight")).alias("valve_weight"),
                                      rounded(F.col("age_weight")).alias("age_weight"), PL.window_reason(PLAIN).alias("window_reason"), "event_key")


@Q.add("settlement_votes", with_views("pools pool_rows", """
SELECT pool_id, row_ix, stance, vote_reason FROM w1 WHERE settled""", EVIDENCE_SQL))
def settlement_votes(spark, sf):
    return fx.pool_rows(spark, sf).filter("settled").select("pool_id", "row_ix", "stance", PL.vote_reason(PLAIN).alias("vote_reason"))


@Q.add("event_collapse_weights", with_views("pools pool_rows", "SELECT pool_id, row_ix, round(weight, 10) AS weight FROM w2", EVIDENCE_SQL))
def event_collapse_weights(spark, sf):
    rows = skew.by_size(evidence(spark, sf), ["pool_id"], lambda part, whole: PL.reweight(part, ["pool_id"], PLAIN, whole))
    return rows.select("pool_id", "row_ix", rounded(F.col("weight")).alias("weight"))


@Q.add("outlet_rank_discount", with_views("pools pool_rows", """
SELECT pool_id, row_ix, round(1.0::DOUBLE / CASE WHEN source_id IS NULL THEN 1 ELSE row_number() OVER (
  PARTITION BY pool_id, source_id ORDER BY published_date DESC NULLS LAST, row_ix) END, 10) AS factor FROM pool_rows"""))
def outlet_rank_discount(spark, sf):
    rows = fx.pool_rows(spark, sf).withColumn("weight", F.lit(1.0))
    return skew.by_size(rows, ["pool_id"], lambda part, whole: PL.harmonic_discount(part, ["pool_id"], whole)).select("pool_id", "row_ix", rounded(F.col("weight")).alias("factor"))


@Q.add("capped_source_weights", with_views("pools pool_rows", """
SELECT pool_id, row_ix, round(weight, 10) AS weight FROM w4""", EVIDENCE_SQL + "," + FULL_SQL))
def capped_source_weights(spark, sf):
    rules = PoolRules(cluster_exponent=0.5, harmonic=True, max_source_share=0.2)
    rows = skew.by_size(evidence(spark, sf), ["pool_id"], lambda part, whole: PL.reweight(part, ["pool_id"], rules, whole))
    return rows.select("pool_id", "row_ix", rounded(F.col("weight")).alias("weight"))


@Q.add("logit_pool", with_views("pools pool_rows", """
SELECT pool_id, n, round(w, 10) AS evidence_mass, round(n_eff, 10)::DOUBLE AS n_eff, round(2 * mp - 1, 10) AS mean, round(2 * sqrt(v), 10) AS std,
       round(2 * greatest(0.01, least(0.99, mp - 1.96 * sqrt(v) / sqrt(n_eff))) - 1, 10) AS ci_low,
       round(2 * greatest(0.01, least(0.99, mp + 1.96 * sqrt(v) / sqrt(n_eff))) - 1, 10) AS ci_high
FROM pooled JOIN spread USING (pool_id)""", EVIDENCE_SQL.replace("weight0", "weight0") + "," + decide_sql(
    "(SELECT w1.* EXCLUDE (weight), weight0 AS weight FROM w1 JOIN (SELECT row_ix, weight0 FROM w0) USING (row_ix))", False)))
def logit_pool(spark, sf):
    out = PL.pool_sources(evidence(spark, sf), ["pool_id"], PLAIN)
    return out.withColumns({c: rounded(F.col(c)) for c in ("evidence_mass", "n_eff", "mean", "std", "ci_low", "ci_high")})


@Q.add("legacy_settlement", with_views("pools pool_rows", """
, v AS (SELECT pool_id, count(*) FILTER (WHERE settled AND stance >= 0) AS pos, count(*) FILTER (WHERE settled AND stance < 0) AS neg,
             any_value(claim_direction) AS cd, any_value(claim_deadline) AS dl FROM pool_rows GROUP BY 1),
d AS (SELECT *, CASE WHEN pos > neg THEN 1 WHEN neg > pos THEN -1 END AS lead, greatest(pos, neg) >= 2 AS enough FROM v),
a AS (SELECT *, cd IS NULL OR dl IS NULL OR dl <= DATE '2024-01-20' OR CASE cd WHEN 'arrival' THEN lead > 0 ELSE lead < 0 END AS ok FROM d)
SELECT pool_id, lead IS NOT NULL AND enough AND ok AS settled,
       CASE WHEN lead IS NOT NULL AND enough AND ok THEN greatest(pos, neg) ELSE 0 END AS settled_sources,
       CASE WHEN lead IS NOT NULL AND enough AND NOT ok THEN 'settlement_direction' END AS suppression_reason FROM a""").replace("\n\n, v AS", ",\nv AS"))
def legacy_settlement(spark, sf):
    return PL.aggregate_pool(evidence(spark, sf), ["pool_id"], LEGACY).select("pool_id", "settled", "settled_sources", "suppression_reason")


@Q.add("pool_confidence", with_views("pools pool_rows", """
SELECT pool_id, CASE WHEN insufficient_reason IS NOT NULL THEN NULL WHEN settled THEN 'high' WHEN n >= 5 AND (ci_high - ci_low) / 2 <= 0.3 THEN 'high'
  WHEN (ci_high - ci_low) / 2 <= 0.5 THEN 'medium' ELSE 'low' END AS confidence FROM res""",
    EVIDENCE_SQL + "," + decide_sql("w2", False) + ", res AS (" + DECIDE + ")"))
def pool_confidence(spark, sf):
    res = _out(PL.aggregate_pool(evidence(spark, sf), ["pool_id"], PLAIN))
    c = F.col
    return res.select("pool_id", S.confidence_bucket(c("settled"), c("ci_low"), c("ci_high"), c("n"), c("insufficient_reason").isNotNull()).alias("confidence"))


@Q.add("weighted_median_stance", with_views("pools pool_rows", """
SELECT pool_id, round(min(stance) FILTER (WHERE cum + 1e-12 >= tw / 2), 10) AS median FROM (
  SELECT *, sum(w) OVER (PARTITION BY pool_id ORDER BY stance) AS cum, sum(w) OVER (PARTITION BY pool_id) AS tw
  FROM (SELECT pool_id, stance, sum(weight0) AS w FROM w0 GROUP BY 1, 2)) WHERE tw > 0 GROUP BY 1
UNION ALL SELECT pool_id, round(quantile_cont(stance, 0.5), 10) FROM w0 WHERE stance IS NOT NULL GROUP BY 1 HAVING sum(weight0) = 0""", EVIDENCE_SQL))
def weighted_median_stance(spark, sf):
    return skew.weighted_medians(evidence(spark, sf), ["pool_id"], "stance", "weight").withColumn("median", rounded(F.col("median")))


@Q.add("stance_quantiles", with_views("pools pool_rows", """
SELECT k AS source_id, prob, n, round(q, 10) AS q FROM (
  SELECT coalesce(source_id, '-') AS k, count(*) AS n, unnest([0.1, 0.5, 0.9, 1.0])::DOUBLE AS prob,
         unnest(quantile_cont(stance, [0.1, 0.5, 0.9, 1.0])) AS q FROM pool_rows GROUP BY 1)"""))
def stance_quantiles(spark, sf):
    rows = fx.pool_rows(spark, sf).withColumn("source_id", F.coalesce("source_id", F.lit("-")))
    return skew.exact_quantiles(rows, ["source_id"], "stance", [0.1, 0.5, 0.9, 1.0]).withColumn("q", rounded(F.col("q")))
