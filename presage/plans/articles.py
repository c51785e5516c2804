"""Articles, cells, antecedents, credibility and backtests."""

from __future__ import annotations

from pyspark.sql import functions as F

from presage.functions import scalars as S
from presage.operators import articles as A, pooling as PL, scoring as SC
from presage.operators.skew import with_totals
from presage.plans.pooling import EVIDENCE_SQL, PLAIN, evidence
from presage.plans.registry import Registry
from presage.plans.scoring import SCORED_SQL, scored
from presage.session import rounded
from presage.sources import fixtures as fx
from presage.sources.fixtures import with_views

Q = Registry()

_CW = "CASE evidence_class WHEN 'cited_probability' THEN 4.0::DOUBLE WHEN 'reported_fact' THEN 1.0 WHEN 'cited_share' THEN 1.5 WHEN 'reporting' THEN 0.6 WHEN 'opinion' THEN 0.25 ELSE 0.6 END"
ARTICLE_SQL = f"""
c0 AS (SELECT *, CASE WHEN cited THEN 2 * quantitative_estimate - 1 ELSE stance END AS st, CASE WHEN cited THEN greatest(certainty, 0.9) ELSE certainty END AS ce
       FROM (SELECT *, quantitative_estimate IS NOT NULL AND evidence_class IS NOT DISTINCT FROM 'cited_probability' AS cited FROM rich_claims)),
c1 AS (SELECT *, settled AND abs(st) >= 0.9 AND ce >= 0.9 AS grade, ce * coalesce(specificity, 1.0) AS w,
         coalesce(CASE WHEN is_conditional THEN coalesce(stated_probability, CASE strength WHEN 'certain' THEN 0.9::DOUBLE WHEN 'likely' THEN 0.7 WHEN 'possible' THEN 0.5 WHEN 'unlikely' THEN 0.3 END, 0.5) END, 1.0) AS coef FROM c0),
c2 AS (SELECT *, grade OR count(*) FILTER (WHERE grade) OVER (PARTITION BY article_id) = 0 AS sc FROM c1),
modal AS (SELECT article_id, arg_max(evidence_class, (c, -i)) AS evidence_class FROM (SELECT article_id, evidence_class, count(*) AS c, min(claim_ix) AS i FROM c2 WHERE evidence_class IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
trapped AS (SELECT article_id, string_agg(trap, ',' ORDER BY i) AS traps FROM (SELECT article_id, trap, min(claim_ix) AS i FROM c2 WHERE trap IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
art AS (SELECT pool_id, article_id, count(*) AS claims,
  CASE WHEN sum(w) FILTER (WHERE sc) = 0 THEN avg(st) FILTER (WHERE sc) ELSE sum(st * w) FILTER (WHERE sc) / sum(w) FILTER (WHERE sc) END AS stance,
  CASE WHEN bool_or(sc AND is_conditional) THEN CASE WHEN sum(w * coef) FILTER (WHERE sc) = 0 THEN avg(st) FILTER (WHERE sc) ELSE sum(st * w * coef) FILTER (WHERE sc) / sum(w * coef) FILTER (WHERE sc) END END AS stance_conditional,
  avg(ce) AS certainty, avg(CASE WHEN evidence_class IS NULL THEN least(ce, 0.25) ELSE {_CW} END) AS evidence_weight, bool_or(grade) AS settled,
  count(*) FILTER (WHERE settled) - count(*) FILTER (WHERE grade) AS settlement_demoted,
  arg_min(quantitative_estimate, claim_ix) FILTER (WHERE quantitative_estimate IS NOT NULL) AS quantitative_estimate,
  CASE WHEN sum(w) FILTER (WHERE sc AND fact_signal IS NOT NULL) = 0 THEN avg(fact_signal) FILTER (WHERE sc) ELSE sum(fact_signal * w) FILTER (WHERE sc) / sum(w) FILTER (WHERE sc AND fact_signal IS NOT NULL) END AS fact_signal,
  arg_max(claim_ix, (abs(fact_signal), -claim_ix)) FILTER (WHERE sc AND fact_signal IS NOT NULL) AS dom,
  ['high', 'medium', 'low'][max(list_position(['high', 'medium', 'low'], level))] AS confidence_level,
  arg_min(event_date, (-ce, event_date)) FILTER (WHERE grade AND st >= 0 AND event_date IS NOT NULL) AS pd, arg_min(event_date, (-ce, event_date)) FILTER (WHERE grade AND st < 0 AND event_date IS NOT NULL) AS nd
  FROM c2 GROUP BY 1, 2)
"""


@Q.add("article_reduction", with_views("pools rich_claims", """
SELECT a.pool_id, a.article_id, a.claims, round(a.stance, 10) AS stance, round(stance_conditional, 10) AS stance_conditional, round(a.certainty, 10) AS certainty, round(evidence_weight, 10) AS evidence_weight,
  m.evidence_class, a.settled, settlement_demoted, CASE WHEN a.stance >= 0 THEN pd ELSE nd END AS settlement_event_date, a.quantitative_estimate, round(a.fact_signal, 10) AS fact_signal,
  d.event_actors, d.event_target, d.is_occurrence, d.verified, d.facet, confidence_level, traps
FROM art a LEFT JOIN modal m USING (article_id) LEFT JOIN trapped USING (article_id) LEFT JOIN rich_claims d ON d.claim_ix = dom""", ARTICLE_SQL))
def article_reduction(spark, sf):
    a = A.reduce_articles(fx.rich_claims(spark, sf))
    return a.withColumns({c: rounded(F.col(c)) for c in ("stance", "stance_conditional", "certainty", "evidence_weight", "fact_signal")})


@Q.add("cell_signals", with_views("pools rich_claims", """
SELECT source_id, pool_id, count(*) AS claim_count, round(CASE WHEN sum(w) = 0 THEN avg(stance) ELSE sum(stance * w) / sum(w) END, 10) AS stance,
  round(CASE WHEN sum(w) = 0 THEN avg(certainty) ELSE sum(certainty * w) / sum(w) END, 10) AS certainty,
  round(CASE WHEN sum(w) FILTER (WHERE specificity IS NOT NULL) = 0 THEN avg(specificity) ELSE sum(specificity * w) / sum(w) FILTER (WHERE specificity IS NOT NULL) END, 10) AS specificity, any_value(mf) AS facet
FROM (SELECT *, certainty * coalesce(specificity, 1.0) AS w FROM rich_claims) LEFT JOIN
  (SELECT source_id, pool_id, arg_max(facet, (c, -i)) AS mf FROM (SELECT source_id, pool_id, facet, count(*) AS c, min(claim_ix) AS i FROM rich_claims WHERE facet IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (source_id, pool_id)
GROUP BY 1, 2"""))
def cell_signals(spark, sf):
    s = A.cell_signals(fx.rich_claims(spark, sf), ["source_id", "pool_id"], ["stance", "certainty", "specificity"], ["facet"], [])
    return s.withColumns({c: rounded(F.col(c)) for c in ("stance", "certainty", "specificity")})


@Q.add("entry_spread", with_views("claims", """
SELECT market_id, source_id, count(*) AS claims, round(max(stance) - min(stance), 10) AS spread FROM claims GROUP BY 1, 2 HAVING count(*) > 1 AND max(stance) - min(stance) > 0.4"""))
def entry_spread(spark, sf):
    return A.spread(fx.claims(spark, sf), ["market_id", "source_id"]).withColumn("spread", rounded(F.col("spread")))


@Q.add("lead_claims", with_views("pools rich_claims", """
SELECT article_id, arg_min(claim_ix, (abs(r.stance - s), claim_ix)) FILTER (WHERE sign(r.stance) = sign(s) AND s <> 0) AS lead_claim,
  arg_max(level, (list_position(['high', 'medium', 'low'], level), -claim_ix)) FILTER (WHERE level IS NOT NULL) AS worst_level,
  arg_max(coalesce(trap, '~'), (list_position(['high', 'medium', 'low'], level), -claim_ix)) FILTER (WHERE level IS NOT NULL) AS worst_trap
FROM rich_claims r JOIN (SELECT article_id, stance AS s FROM art) USING (article_id) GROUP BY 1""", ARTICLE_SQL))
def lead_claims(spark, sf):
    c = fx.rich_claims(spark, sf)
    out = A.lead_claim(c, A.reduce_articles(c).select("article_id", "stance"), ["article_id"])
    return out.withColumn("worst_trap", F.when(F.col("worst_level").isNotNull(), F.coalesce("worst_trap", F.lit("~"))))


def _bigrams(text: str) -> str:
    w = f"regexp_extract_all(lower({text}), '[a-z0-9]+')"
    return f"list_distinct(list_transform(range(1, greatest(len({w}), 2)), lambda i: array_to_string(({w})[i:i + 1], ' ')))"


_ANTECEDENT = "CASE WHEN antecedent_text_en IS NOT NULL THEN claim || CASE WHEN facet IS NULL THEN ' and more words to follow' ELSE ' ' || facet END END"
_ASKED = f"{fx._sql_list(fx.CLAIM_TEXTS)}[pool_id % {len(fx.CLAIM_TEXTS)} + 1]"


@Q.add("antecedent_filter", with_views("pools rich_claims", f"""
SELECT pool_id, source_id, count(*) AS claims, bool_or(NOT is_conditional OR coalesce(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y)))::DOUBLE >= 0.25 AND coalesce(antecedent_polarity, true), false)) AS keep
FROM (SELECT *, {_bigrams(_ANTECEDENT)} AS x, {_bigrams(_ASKED)} AS y FROM rich_claims) GROUP BY 1, 2"""))
def antecedent_filter(spark, sf):
    """Sources of a pool with an unconditional claim, or a condition like the one asked about."""
    c = fx.rich_claims(spark, sf)
    more = F.when(F.col("facet").isNull(), " and more words to follow").otherwise(F.concat(F.lit(" "), "facet"))
    c = c.withColumn("antecedent_text_en", F.when(F.col("antecedent_text_en").isNotNull(), F.concat("claim", more)))
    asked = F.get(F.array(*[F.lit(t) for t in fx.CLAIM_TEXTS]), (F.col("pool_id") % len(fx.CLAIM_TEXTS)).cast("int"))
    return A.antecedent_keep(c.withColumn("asked", asked), ["pool_id", "source_id"], F.col("asked"), F.lit(True))


@Q.add("source_credibility", with_views("claims outcomes registry", """
SELECT source_id, round(greatest(0.25, least(2.0, 1.0 + (0.25 - (b * n + 10 * 0.25) / (n + 10)) * 2.0)), 10) AS from_brier,
  round(1200.0::DOUBLE / (1200.0::DOUBLE + b * 200.0), 10) AS from_elo FROM (SELECT source_id, avg(brier) AS b, count(*) AS n FROM scored GROUP BY 1)""", SCORED_SQL))
def source_credibility(spark, sf):
    b = SC.board(SC.source_market_cells(scored(spark, sf)), ["source_id"])
    none = F.lit(None).cast("double")
    return b.select("source_id", rounded(S.brier_credibility(F.col("brier_score"), F.col("predictions"), 10.0, 2.0, 0.25, 2.0)).alias("from_brier"),
                    rounded(S.skill_credibility(none, none, F.col("brier_score"), F.lit(True))).alias("from_elo"))


BACKTEST_SQL = SCORED_SQL + """,
src AS (SELECT source_id, round(avg(brier), 10) AS b FROM scored GROUP BY 1),
win AS (SELECT e.market_id, source_id, stance, greatest(0.01, 1 - coalesce(b, 0.25)) AS w, outcome FROM entries e JOIN outcomes USING (market_id) LEFT JOIN src USING (source_id)
        WHERE article_date BETWEEN outcome_date - 30 AND outcome_date - 3),
pred AS (SELECT market_id, any_value(outcome) AS outcome, count(*) AS entries, coalesce((sum(stance * w) / nullif(sum(w), 0) + 1) / 2, 0.5) AS p FROM win GROUP BY 1)
"""


def backtest(spark, sf):
    entries = SC.reduce_entries(fx.claims(spark, sf))
    known = SC.board(SC.source_market_cells(scored(spark, sf)), ["source_id"]).select("source_id", F.round("brier_score", 10).alias("b"))
    rows = entries.join(fx.outcomes(spark, sf).select("market_id", "outcome", "outcome_date"), "market_id").filter(
        F.col("article_date").between(F.date_sub("outcome_date", 30), F.date_sub("outcome_date", 3)))
    rows = rows.join(known, "source_id", "left").withColumn("w", F.greatest(F.lit(0.01), 1 - F.coalesce("b", F.lit(0.25))))
    p = F.coalesce(S.prob(F.sum(F.col("stance") * F.col("w")) / F.nullif(F.sum("w"), F.lit(0.0))), F.lit(0.5))
    return rows.groupBy("market_id").agg(F.max("outcome").alias("outcome"), F.count(F.lit(1)).alias("entries"), p.alias("p"))


@Q.add("backtest_predictions", with_views("claims outcomes registry", "SELECT market_id, outcome, entries, round(p, 10) AS p, round(pow(p - outcome::INT, 2), 10) AS brier FROM pred", BACKTEST_SQL))
def backtest_predictions(spark, sf):
    return backtest(spark, sf).select("market_id", "outcome", "entries", rounded(F.col("p")).alias("p"), rounded(S.brier(F.col("p"), F.col("outcome"))).alias("brier"))


@Q.add("backtest_summary", with_views("claims outcomes registry", """
SELECT count(*) AS events, round(avg(pow(p - outcome::INT, 2)), 10) AS brier, round(avg(outcome::INT), 10) AS base_rate, round(avg(outcome::INT) * (1 - avg(outcome::INT)), 10) AS base_rate_brier FROM pred""", BACKTEST_SQL))
def backtest_summary(spark, sf):
    b = backtest(spark, sf)
    rate = F.avg(F.col("outcome").cast("double"))
    return b.agg(F.count(F.lit(1)).alias("events"), rounded(F.avg(S.brier(F.col("p"), F.col("outcome")))).alias("brier"), rounded(rate).alias("base_rate"), rounded(rate * (1 - rate)).alias("base_rate_brier"))


@Q.add("leave_one_out_credibility", with_views("claims outcomes registry", """
SELECT count(*) AS records, round(avg(pow(ps - o, 2)), 10) AS brier_weighted, round(avg(pow(pf - o, 2)), 10) AS brier_flat,
  count(*) FILTER (WHERE pow(ps - o, 2) < pow(pf - o, 2) - 1e-9) AS wins, count(*) FILTER (WHERE pow(ps - o, 2) > pow(pf - o, 2) + 1e-9) AS losses
FROM (SELECT market_id, any_value(o) AS o, 1 / (1 + exp(-sum(w * l) / sum(w))) AS ps, 1 / (1 + exp(-avg(l))) AS pf FROM (
  SELECT *, ln(q / (1 - q)) AS l, greatest(0.25, least(2.0, 1.0 + (0.25 - (tb - b + 2.5) / (tn - n + 10)) * 2)) AS w FROM (
    SELECT market_id, source_id, any_value(outcome::INT) AS o, avg(brier) AS b, 1 AS n, greatest(0.01, least(0.99, (avg(stance) + 1) / 2)) AS q FROM scored GROUP BY 1, 2)
  JOIN (SELECT source_id, sum(b) AS tb, count(*) AS tn FROM (SELECT source_id, market_id, avg(brier) AS b FROM scored GROUP BY 1, 2) GROUP BY 1) USING (source_id)) GROUP BY 1)""", SCORED_SQL))
def leave_one_out_credibility(spark, sf):
    """Each record weighted by what its sources did elsewhere: totals minus own part."""
    cells = scored(spark, sf).groupBy("market_id", "source_id").agg(F.max("outcome").alias("o"), F.avg("brier").alias("b"), F.avg("stance").alias("stance"))
    cells = with_totals(cells, ["source_id"], {"tb": F.sum("b"), "tn": F.count(F.lit(1))}, F.col("market_id"))
    q = S.clamp(S.prob(F.col("stance")), 0.01, 0.99)
    n = F.col("tn") - 1
    w = S.clamp(1.0 + (0.25 - (F.col("tb") - F.col("b") + 2.5) / (n + 10)) * 2.0, 0.25, 2.0)
    cells = cells.withColumns({"l": S.logit(q), "w": w})
    per = cells.groupBy("market_id").agg(F.max("o").alias("o"), S.sigmoid(F.sum(F.col("w") * F.col("l")) / F.sum("w")).alias("ps"), S.sigmoid(F.avg("l")).alias("pf"))
    bs, bf = S.brier(F.col("ps"), F.col("o")), S.brier(F.col("pf"), F.col("o"))
    return per.agg(F.count(F.lit(1)).alias("records"), rounded(F.avg(bs)).alias("brier_weighted"), rounded(F.avg(bf)).alias("brier_flat"),
                   F.count_if(bs < bf - 1e-9).alias("wins"), F.count_if(bs > bf + 1e-9).alias("losses"))


@Q.add("archetype_base_rates", with_views("pools outcomes", """
SELECT claim_archetype, count(*) AS n, round((count(*) FILTER (WHERE outcome) + 10 * 0.15::DOUBLE) / (count(*) + 10), 10) AS base_rate FROM pools JOIN outcomes ON pool_id = market_id GROUP BY 1"""))
def archetype_base_rates(spark, sf):
    r = fx.pools(spark, sf).join(fx.outcomes(spark, sf).withColumnRenamed("market_id", "pool_id"), "pool_id")
    n = F.count(F.lit(1))
    return r.groupBy("claim_archetype").agg(n.alias("n"), rounded((F.count_if("outcome") + 1.5) / (n + 10)).alias("base_rate"))


RES_SQL = """
u AS (SELECT p.pool_id, source_id, avg(stance) AS m, count(*) AS a, any_value(outcome) AS o FROM pool_rows p JOIN outcomes ON p.pool_id = market_id
      WHERE event_type <> 'click' AND source_id IS NOT NULL AND stance IS NOT NULL GROUP BY 1, 2)"""


@Q.add("resolution_board", with_views("pools pool_rows outcomes", """
SELECT source_id, count(*) AS predictions, sum(a)::BIGINT AS articles, round(avg(pow((m + 1) / 2 - o::INT, 2)), 10) AS brier_score,
  round(sum(log2(greatest(0.05, least(0.95, CASE WHEN o THEN (m + 1) / 2 ELSE 1 - (m + 1) / 2 END)) / 0.5)), 10) AS bits FROM u GROUP BY 1""", RES_SQL))
def resolution_board(spark, sf):
    p = S.prob(F.col("m"))
    return resolved_cells(spark, sf).groupBy("source_id").agg(
        F.count(F.lit(1)).alias("predictions"), F.sum("a").alias("articles"), rounded(F.avg(S.brier(p, F.col("o")))).alias("brier_score"), rounded(F.sum(S.bits_vs_coin(p, F.col("o")))).alias("bits"))


def resolved_cells(spark, sf):
    rows = fx.pool_rows(spark, sf).filter("event_type <> 'click' and source_id is not null and stance is not null")
    o = fx.outcomes(spark, sf).select(F.col("market_id").alias("pool_id"), "outcome")
    return rows.groupBy("pool_id", "source_id").agg(F.avg("stance").alias("m"), F.count(F.lit(1)).alias("a")).join(o, "pool_id").withColumnRenamed("outcome", "o")


@Q.add("resolution_run_summary", with_views("pools pool_rows outcomes", """
SELECT (SELECT count(*) FROM outcomes) AS resolutions_total, count(*) AS resolutions_scored, count(*) FILTER (WHERE s < 2) AS resolutions_single_source,
  (SELECT count(*) FROM pool_rows WHERE event_type = 'click') AS articles_skipped_opinion, count(*) >= 15 AS gate_open FROM (SELECT pool_id, count(*) AS s FROM u GROUP BY 1)""", RES_SQL))
def resolution_run_summary(spark, sf):
    per = resolved_cells(spark, sf).groupBy("pool_id").agg(F.count(F.lit(1)).alias("s"))
    a = per.agg(F.count(F.lit(1)).alias("resolutions_scored"), F.count_if(F.col("s") < 2).alias("resolutions_single_source"), (F.count(F.lit(1)) >= 15).alias("gate_open"))
    t = fx.outcomes(spark, sf).agg(F.count(F.lit(1)).alias("resolutions_total"))
    o = fx.pool_rows(spark, sf).filter("event_type = 'click'").agg(F.count(F.lit(1)).alias("articles_skipped_opinion"))
    return a.crossJoin(F.broadcast(t)).crossJoin(F.broadcast(o))


@Q.add("author_board_by_tag", with_views("pools rich_claims outcomes", """
SELECT tag, author, outlet, count(*) AS predictions, round(avg(pow((m + 1) / 2 - o::INT, 2)), 10) AS brier_score FROM (
  SELECT r.pool_id, unnest(['all', 'q' || (r.pool_id % 3)]) AS tag, CASE WHEN k % 11 = 0 THEN '(no byline)' ELSE 'a' || (user_id % 9) END AS author, source_id AS outlet,
    avg(author_lean) AS m, any_value(outcome) AS o FROM rich_claims r JOIN outcomes ON r.pool_id = market_id WHERE author_lean IS NOT NULL GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3"""))
def author_board_by_tag(spark, sf):
    author = F.when(F.col("k") % 11 == 0, "(no byline)").otherwise(F.concat(F.lit("a"), (F.col("user_id") % 9).cast("string")))
    rows = fx.rich_claims(spark, sf).filter("author_lean is not null").groupBy("pool_id", author.alias("author"), F.col("source_id").alias("outlet")).agg(F.avg("author_lean").alias("m"))
    o = fx.outcomes(spark, sf).select(F.col("market_id").alias("pool_id"), "outcome")
    tags = F.array(F.lit("all"), F.concat(F.lit("q"), (F.col("pool_id") % 3).cast("string")))
    return rows.join(o, "pool_id").withColumn("tag", F.explode(tags)).groupBy("tag", "author", "outlet").agg(
        F.count(F.lit(1)).alias("predictions"), rounded(F.avg(S.brier(S.prob(F.col("m")), F.col("outcome")))).alias("brier_score"))


@Q.add("expert_probabilities", with_views("pools rich_claims outcomes", """
SELECT pool_id, any_value(o) AS outcome, count(*) AS bylines, round(avg((m + 1) / 2), 10) AS experts_prob FROM (
  SELECT r.pool_id, user_id % 9 AS a, source_id, avg(author_lean) AS m, any_value(outcome) AS o FROM rich_claims r JOIN outcomes ON r.pool_id = market_id WHERE author_lean IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1"""))
def expert_probabilities(spark, sf):
    per = fx.rich_claims(spark, sf).filter("author_lean is not null").groupBy("pool_id", (F.col("user_id") % 9).alias("a"), "source_id").agg(F.avg("author_lean").alias("m"))
    o = fx.outcomes(spark, sf).select(F.col("market_id").alias("pool_id"), "outcome")
    return per.groupBy("pool_id").agg(F.count(F.lit(1)).alias("bylines"), rounded(F.avg(S.prob(F.col("m")))).alias("experts_prob")).join(o, "pool_id")


@Q.add("relevance_variants", with_views("pools pool_rows", """
SELECT pool_id, variant, round(2 / (1 + exp(-CASE WHEN sum(w) > 0 THEN sum(w * l) / sum(w) ELSE avg(l) END)) - 1, 10) AS mean FROM (
  SELECT pool_id, variant, ln(p / (1 - p)) AS l, CASE WHEN variant = 'live' OR k % 3 = 0 THEN weight0 WHEN relevance > 0 THEN weight0 / (relevance * relevance) * CASE variant WHEN 'square' THEN pow(k / 100.0, 2) ELSE k / 100.0 END ELSE 0 END AS w
  FROM (SELECT *, greatest(0.01, least(0.99, (stance + 1) / 2)) AS p FROM w0), (SELECT unnest(['live', 'square', 'linear']) AS variant)) GROUP BY 1, 2""", EVIDENCE_SQL))
def relevance_variants(spark, sf):
    """Pool under a substituted relevance score and two curves, uncovered rows unchanged."""
    score = F.when(F.col("k") % 3 != 0, F.col("k") / 100.0)
    rows = evidence(spark, sf).withColumn("variant", F.explode(F.array(F.lit("live"), F.lit("square"), F.lit("linear"))))
    old = S.relevance_weight(F.col("relevance"))
    new = F.when(F.col("variant") == "square", score * score).otherwise(score)
    swapped = F.when(old > 0, F.col("weight") * new / old).otherwise(0.0)
    rows = rows.withColumn("weight", F.when((F.col("variant") == "live") | score.isNull(), F.col("weight")).otherwise(swapped))
    return PL.pool_sources(rows, ["pool_id", "variant"], PLAIN).select("pool_id", "variant", rounded(F.col("mean")).alias("mean"))


@Q.add("cell_matrix", with_views("claims", """
SELECT market_id, source_id, count(*) AS claims, round(avg(stance), 10) AS stance FROM claims GROUP BY 1, 2"""))
def cell_matrix(spark, sf):
    """Every filled cell of events by sources, in long form."""
    return fx.claims(spark, sf).groupBy("market_id", "source_id").agg(F.count(F.lit(1)).alias("claims"), rounded(F.avg("stance")).alias("stance"))


@Q.add("stance_timeline", with_views("claims outcomes", """
SELECT market_id, source_id, (outcome_date - article_date)::INT AS days_before, round(stance, 3) AS stance, round(certainty, 3) AS certainty, row_number() OVER (PARTITION BY market_id, source_id ORDER BY outcome_date - article_date DESC, claim_ix) AS position
FROM claims JOIN outcomes USING (market_id) WHERE article_date <= outcome_date"""))
def stance_timeline(spark, sf):
    from presage.operators.skew import with_rank

    rows = fx.claims(spark, sf).join(fx.outcomes(spark, sf).select("market_id", "outcome_date"), "market_id").withColumn("days_before", F.datediff("outcome_date", "article_date")).filter("days_before >= 0")
    ranked = with_rank(rows, ["market_id", "source_id"], [-F.col("days_before"), F.floor(F.col("claim_ix") / 1_000_000)], [F.desc("days_before"), F.col("claim_ix")], "position")
    return ranked.select("market_id", "source_id", "days_before", F.round("stance", 3).alias("stance"), F.round("certainty", 3).alias("certainty"), "position")
