"""Who was right: boards, calibration, decomposition, ratings."""

from __future__ import annotations

from pyspark.sql import functions as F

from presage.functions import scalars as S
from presage.operators import scoring as SC
from presage.plans.registry import Registry
from presage.session import rounded
from presage.sources import fixtures as fx
from presage.sources.fixtures import with_views

Q = Registry()

SCORED_SQL = """
entries AS (SELECT market_id, source_id, article_date, avg(stance) AS stance, avg(certainty) AS certainty, count(*) AS claims
            FROM claims WHERE stance IS NOT NULL AND certainty IS NOT NULL GROUP BY 1, 2, 3),
scored AS (
  SELECT e.*, o.outcome, o.outcome_date, o.category, (stance + 1) / 2 AS p,
         pow((stance + 1) / 2 - o.outcome::INT, 2) AS brier,
         pow((stance + 1) / 2 - o.outcome::INT, 2) * (0.5 + 1.5 * greatest(0, least(1, certainty))) AS weighted_brier,
         coalesce(pow(2.0, -greatest(0, o.outcome_date - e.article_date) / 30.0), 1.0) AS decay,
         CASE WHEN o.outcome THEN ln(greatest(0.01, least(0.99, (stance + 1) / 2)))
              ELSE ln(1 - greatest(0.01, least(0.99, (stance + 1) / 2))) END AS log_score,
         ((stance > 0) = o.outcome)::INT AS hit
  FROM entries e JOIN outcomes o USING (market_id)
  WHERE e.source_id IN (SELECT source_id FROM registry) AND coalesce(e.article_date <= o.outcome_date, true))
"""


def scored(spark, sf):
    return SC.score_entries(SC.reduce_entries(fx.claims(spark, sf)), fx.outcomes(spark, sf), fx.registry(spark, sf))


def _round(df, cols):
    return df.withColumns({c: rounded(F.col(c)) for c in cols})


BOARD = ["brier_score", "weighted_brier_score", "time_decay_brier_score", "log_score", "accuracy"]


@Q.add("source_leaderboard", with_views("claims outcomes registry", """
SELECT source_id, round(avg(brier), 10) AS brier_score, round(avg(weighted_brier), 10) AS weighted_brier_score,
       round(sum(brier * decay) / sum(decay), 10) AS time_decay_brier_score, round(avg(log_score), 10) AS log_score,
       round(avg(hit), 10) AS accuracy, count(*) AS predictions, count(DISTINCT market_id) AS events
FROM scored GROUP BY 1""", SCORED_SQL))
def source_leaderboard(spark, sf):
    return _round(SC.board(SC.source_market_cells(scored(spark, sf)), ["source_id"]), BOARD)


@Q.add("category_leaderboard", with_views("claims outcomes registry", """
SELECT source_id, category, round(avg(brier), 10) AS brier_score, round(avg(weighted_brier), 10) AS weighted_brier_score,
       round(avg(log_score), 10) AS log_score, round(avg(hit), 10) AS accuracy, count(*) AS predictions,
       count(DISTINCT market_id) AS events
FROM (SELECT s.* EXCLUDE (category), NULL AS category FROM scored s
      UNION ALL SELECT s.* EXCLUDE (category), unnest(s.category) AS category FROM scored s)
GROUP BY 1, 2""", SCORED_SQL))
def category_leaderboard(spark, sf):
    return _round(SC.category_board(SC.source_market_cells(scored(spark, sf))),
                  ["brier_score", "weighted_brier_score", "log_score", "accuracy"])


@Q.add("source_elo", with_views("claims outcomes registry", """
SELECT source_id, round(1200 + sum(CASE WHEN nc = 0 OR nc = n THEN 0 WHEN hit = 1 THEN 32.0::DOUBLE * (n - nc) / n ELSE -32.0::DOUBLE * nc / n END), 10) AS elo
FROM (SELECT *, count(*) OVER m AS n, sum(hit) OVER m AS nc FROM scored WINDOW m AS (PARTITION BY market_id)) GROUP BY 1""", SCORED_SQL))
def source_elo(spark, sf):
    return _round(SC.elo(SC.source_market_cells(scored(spark, sf))), ["elo"])


@Q.add("brier_decomposition", with_views("claims outcomes registry", """
, per_bin AS (SELECT least(floor(p * 5), 4) AS bin, count(*) AS n, avg(p) AS pb, avg(outcome::INT) AS ob FROM scored GROUP BY 1),
t AS (SELECT sum(n) AS n, sum(n * ob) / sum(n) AS o_bar FROM per_bin)
SELECT round(rel - res + o_bar * (1 - o_bar), 10) AS brier, round(rel, 10) AS rel, round(res, 10) AS res,
       round(o_bar * (1 - o_bar), 10) AS unc, n, round(o_bar, 10) AS o_bar
FROM (SELECT max(t.n)::BIGINT AS n, max(o_bar) AS o_bar, sum(b.n * (pb - ob) * (pb - ob)) / max(t.n) AS rel,
             sum(b.n * (ob - o_bar) * (ob - o_bar)) / max(t.n) AS res FROM per_bin b, t) WHERE n >= 5""", SCORED_SQL).replace("\n\n,", ",").replace(")\n\n,", "),"))
def brier_decomposition(spark, sf):
    return _round(SC.murphy(scored(spark, sf), "p", "outcome"), ["brier", "rel", "res", "unc", "o_bar"])


@Q.add("calibration_curve", with_views("claims outcomes registry", """
SELECT bin, round((bin / 10.0 + (bin + 1) / 10.0) / 2, 3)::DOUBLE AS predicted, round(coalesce(a, 0), 10) AS actual, coalesce(n, 0) AS n
FROM (SELECT unnest(range(10)) AS bin) LEFT JOIN
     (SELECT least(floor(p * 10), 9)::BIGINT AS bin, avg(outcome::INT) AS a, count(*) AS n FROM scored GROUP BY 1) USING (bin)
WHERE (SELECT count(*) FROM scored) >= 10""", SCORED_SQL))
def calibration_curve(spark, sf):
    return _round(SC.calibration_curve(scored(spark, sf), "p", "outcome"), ["actual"])


@Q.add("reliability_table", with_views("claims outcomes registry", """
SELECT bin, coalesce(n, 0) AS n, round(m, 10) AS mean_predicted, round(a, 10) AS observed
FROM (SELECT unnest(range(5)) AS bin) LEFT JOIN
     (SELECT least(floor(p * 5), 4)::BIGINT AS bin, avg(p) AS m, avg(outcome::INT) AS a, count(*) AS n FROM scored GROUP BY 1) USING (bin)""", SCORED_SQL))
def reliability_table(spark, sf):
    return _round(SC.reliability_table(scored(spark, sf), "p", "outcome"), ["mean_predicted", "observed"])


@Q.add("claim_level_brier", with_views("claims outcomes", """
SELECT level, market_id, source_id, n, round(brier, 10) AS brier, round(implied_p, 10) AS implied_p, round(1 - brier / 0.25, 10) AS skill
FROM (SELECT CASE grouping(market_id, source_id) WHEN 1 THEN 'event' WHEN 2 THEN 'source' ELSE 'overall' END AS level,
             market_id, source_id, count(*) AS n, avg(pow((stance + 1) / 2 - outcome::INT, 2)) AS brier, avg((stance + 1) / 2) AS implied_p
      FROM claims JOIN outcomes USING (market_id) GROUP BY GROUPING SETS ((market_id), (source_id), ()))"""))
def claim_level_brier(spark, sf):
    return _round(SC.claim_level_brier(fx.claims(spark, sf), fx.outcomes(spark, sf)), ["brier", "implied_p", "skill"])


@Q.add("competitive_brier", with_views("claims outcomes", """
SELECT market_id, source_id, count(*) AS n, round(avg(b), 10) AS brier, round(1 - avg(b) / 0.25, 10) AS skill
FROM (SELECT *, count(DISTINCT source_id) OVER (PARTITION BY market_id, a) AS srcs FROM
       (SELECT r.*, (SELECT max(anchor) FROM w WHERE w.market_id = r.market_id AND w.anchor <= r.article_date) AS a FROM raw r))
WHERE srcs >= 2 GROUP BY 1, 2""", """
raw AS (SELECT market_id, source_id, article_date, pow((stance + 1) / 2 - outcome::INT, 2) AS b
        FROM claims JOIN outcomes USING (market_id) WHERE article_date <= outcome_date),
w(market_id, anchor) AS (
  SELECT market_id, min(article_date) FROM raw GROUP BY 1
  UNION ALL SELECT w.market_id, (SELECT min(r.article_date) FROM raw r WHERE r.market_id = w.market_id AND r.article_date > w.anchor + 2)
  FROM w WHERE w.anchor IS NOT NULL)"""))
def competitive_brier(spark, sf):
    return _round(SC.competitive(fx.claims(spark, sf), fx.outcomes(spark, sf)), ["brier", "skill"])


@Q.add("malformed_claims", with_views("claims", """
SELECT source_id, count(*) AS claims, count(*) FILTER (WHERE stance IS NULL OR certainty IS NULL) AS malformed,
       count(*) FILTER (WHERE stance IS NOT NULL AND certainty IS NOT NULL) AS usable FROM claims GROUP BY 1"""))
def malformed_claims(spark, sf):
    return SC.malformed_counts(fx.claims(spark, sf), ["source_id"])


@Q.add("bootstrap_interval", with_views("claims outcomes registry", """
, d AS (SELECT market_id, avg(brier) - 0.25 AS v FROM scored GROUP BY 1),
u AS (SELECT b, v, ('0x' || substr(md5(market_id || '|' || b || '|918'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
      FROM d, (SELECT unnest(range(2000)) AS b)),
reps AS (SELECT b, sum(w * v) / sum(w) AS m FROM (SELECT *, (SELECT count(*) FROM cdf WHERE u >= c) AS w FROM u) GROUP BY 1 HAVING sum(w) > 0),
SELECT (SELECT count(*) FROM d) AS n, round((SELECT avg(v) FROM d), 10) AS mean,
       round(quantile_cont(m, 0.025), 10) AS lo, round(quantile_cont(m, 0.975), 10) AS hi FROM reps""", SCORED_SQL + """,
cdf AS (SELECT round(exp(-1) * s, 12) AS c FROM (SELECT i, sum(1.0::DOUBLE / gamma(i + 1)) OVER (ORDER BY i) AS s FROM (SELECT unnest(range(12)) AS i)))""")
      .replace("\n, d AS", ",\nd AS").replace("HAVING sum(w) > 0),\nSELECT", "HAVING sum(w) > 0)\nSELECT"))
def bootstrap_interval(spark, sf):
    d = scored(spark, sf).groupBy("market_id").agg((F.avg("brier") - 0.25).alias("v"))
    return _round(SC.bootstrap_mean(d, "market_id", "v"), ["mean", "lo", "hi"])


@Q.add("scalar_scores", with_views("claims outcomes", """
SELECT claim_ix, round(p, 10) AS p, greatest(1, least(99, round_even(p * 100, 0)))::INT AS pct,
       round(pow(p - outcome::INT, 2), 10) AS brier,
       round(ln(greatest(0.000001, least(0.999999, CASE WHEN outcome THEN p ELSE 1 - p END))), 10) AS log6,
       round(-ln(greatest(0.0001, least(0.9999, CASE WHEN outcome THEN p ELSE 1 - p END))), 10) AS log_loss,
       round(log2(greatest(0.05, least(0.95, CASE WHEN outcome THEN p ELSE 1 - p END)) / 0.5), 10) AS bits,
       round(0.5 + 1.5 * certainty, 10) AS certainty_weight, ((stance > 0) = outcome)::INT AS hit,
       round(CASE WHEN article_date IS NULL THEN 0.02 ELSE greatest(0.02, pow(0.5, greatest(0, outcome_date - article_date) / 7.0)) END, 10) AS recency,
       CASE WHEN stance > 0 THEN 'positive' WHEN stance < 0 THEN 'negative' WHEN stance = 0 THEN 'zero' END AS sign,
       CASE WHEN p >= 0.9 - 1e-9 THEN 'yes' WHEN p <= 0.1 + 1e-9 THEN 'no' END AS close_call
FROM (SELECT *, (stance + 1) / 2 AS p FROM claims) JOIN outcomes USING (market_id)"""))
def scalar_scores(spark, sf):
    c = fx.claims(spark, sf).join(fx.outcomes(spark, sf), "market_id").withColumn("p", S.prob(F.col("stance")))
    p, o = F.col("p"), F.col("outcome")
    return c.select(
        "claim_ix", rounded(p).alias("p"), S.percent(p).alias("pct"), rounded(S.brier(p, o)).alias("brier"),
        rounded(S.log_score(p, o, 1e-6)).alias("log6"), rounded(S.log_loss(p, o)).alias("log_loss"),
        rounded(S.bits_vs_coin(p, o)).alias("bits"), rounded(S.certainty_weight(F.col("certainty"))).alias("certainty_weight"),
        S.directional_hit(F.col("stance"), o).alias("hit"),
        rounded(S.recency(F.col("article_date"), F.col("outcome_date"))).alias("recency"),
        S.sign_of(F.col("stance")).alias("sign"), S.close_call(p).alias("close_call"))
