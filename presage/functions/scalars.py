"""Probability arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Lookup tables of the scoring rules.
EVIDENCE_CLASS_WEIGHTS = {"cited_probability": 4.0, "reported_fact": 1.0, "cited_share": 1.5, "reporting": 0.6, "opinion": 0.25}
CONDITIONAL_STRENGTHS = {"certain": 0.9, "likely": 0.7, "possible": 0.5, "unlikely": 0.3}
RELEVANCE_BANDS = {0.0: 0.0, 0.05: 0.0025, 0.1: 0.01, 0.2: 0.04, 0.3: 0.09, 0.4: 0.16, 0.5: 0.25,
                   0.6: 0.36, 0.7: 0.49, 0.8: 0.64, 0.85: 0.7225, 0.9: 0.81, 1.0: 1.0}


def literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``; a lambda
    over a one-element array keeps Catalyst from copying the expression."""
    return F.transform(F.array(value), body)[0]


def clamp(x: Column, lo: float, hi: float) -> Column:
    """Clamp that keeps null (least/greatest alone would return the bound)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def bound(x: Column, lo: float, hi: float) -> Column:
    """Clamp for values that are never null; mentions ``x`` once, so nested bounds stay small."""
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def prob(stance: Column) -> Column:
    return (stance + 1.0) / 2.0


def stance(p: Column) -> Column:
    return p * 2.0 - 1.0


def percent(p: Column) -> Column:
    """Whole percent, half to even, kept inside 1..99."""
    return F.greatest(F.lit(1), F.least(F.lit(99), F.bround(p * 100, 0).cast("int")))


def logit(p: Column) -> Column:
    return F.ln(p / (1.0 - p))


def sigmoid(x: Column) -> Column:
    # exp overflows to infinity, which gives the right limit 0
    return 1.0 / (1.0 + F.exp(-x))


def brier(p: Column, outcome: Column) -> Column:
    d = p - outcome.cast("double")
    return d * d


def log_score(p: Column, outcome: Column, eps: float = 0.01) -> Column:
    q = clamp(p, eps, 1.0 - eps)
    return F.when(outcome, F.ln(q)).otherwise(F.ln(1.0 - q))


def log_loss(p: Column, outcome: Column, eps: float = 1e-4) -> Column:
    return -log_score(p, outcome, eps)


def bits_vs_coin(p: Column, outcome: Column, clip: float = 0.05) -> Column:
    q = clamp(p, clip, 1.0 - clip)
    return F.log2(F.when(outcome, q).otherwise(1.0 - q) / 0.5)


def certainty_weight(certainty: Column) -> Column:
    return 0.5 + 1.5 * clamp(certainty, 0.0, 1.0)


def directional_hit(stance_: Column, outcome: Column) -> Column:
    """1 when (stance > 0) equals the outcome; a zero stance hits a false outcome."""
    return ((stance_ > 0) == outcome).cast("int")


def time_decay(article: Column, outcome_date: Column, half_life: float = 30.0) -> Column:
    days = F.greatest(F.lit(0), F.datediff(outcome_date, article))
    return F.coalesce(F.pow(F.lit(2.0), -days / half_life), F.lit(1.0))


def recency(article: Column, ref: Column, half_life: float = 7.0, floor: float = 0.02) -> Column:
    age = F.greatest(F.lit(0), F.datediff(ref, article))
    w = F.greatest(F.lit(floor), F.pow(F.lit(0.5), age / half_life))
    return F.when(ref.isNull(), F.lit(1.0)).when(article.isNull(), F.lit(floor)).otherwise(w)


def relevance_weight(relevance: Column) -> Column:
    # two-decimal rounding first, then the banded table, then the plain square
    cents = F.bround(relevance * 100, 0).cast("int")
    table = literal_map({int(round(k * 100)): v for k, v in RELEVANCE_BANDS.items()})
    return F.coalesce(F.try_element_at(table, cents), relevance * relevance)


def class_weight(evidence_class: Column, certainty: Column, default: float = 0.6, cap: float = 0.25) -> Column:
    known = F.try_element_at(literal_map(EVIDENCE_CLASS_WEIGHTS), evidence_class)
    return F.when(evidence_class.isNull(), F.least(certainty, F.lit(cap))).otherwise(F.coalesce(known, F.lit(default)))


def conditional_coefficient(is_conditional: Column, strength: Column, stated: Column) -> Column:
    table = F.try_element_at(literal_map(CONDITIONAL_STRENGTHS), strength)
    return F.when(is_conditional, F.coalesce(stated, table, F.lit(0.5)))


def quantitative_override(stance_: Column, certainty: Column, estimate: Column, evidence_class: Column,
                          min_certainty: float = 0.9) -> tuple[Column, Column]:
    cited = estimate.isNotNull() & evidence_class.eqNullSafe(F.lit("cited_probability"))
    return (F.when(cited, stance(estimate)).otherwise(stance_),
            F.when(cited, F.greatest(certainty, F.lit(min_certainty))).otherwise(certainty))


def settlement_grade(stance_: Column, certainty: Column, min_stance: float = 0.9, min_certainty: float = 0.9) -> Column:
    return (F.abs(stance_) >= min_stance) & (certainty >= min_certainty)


def confidence_bucket(settled: Column, ci_low: Column, ci_high: Column, articles: Column, insufficient: Column) -> Column:
    width = prob(ci_high) - prob(ci_low)
    return (F.when(insufficient, F.lit(None).cast("string"))
            .when(settled, F.lit("high"))
            .when((articles >= 5) & (width <= 0.3), F.lit("high"))
            .when(width <= 0.5, F.lit("medium")).otherwise(F.lit("low")))


def hazard_mean(mean: Column, archetype: Column, created: Column, deadline: Column, base_rate: Column,
                half_life_fraction: float, occurrence_seen: Column, today: Column) -> Column:
    """Pooled mean decayed towards the base rate over the claim's window."""
    window = F.datediff(deadline, created)
    elapsed = F.greatest(F.lit(0), F.least(window, F.datediff(today, created)))
    decay = F.pow(F.lit(0.5), elapsed / window / half_life_fraction)
    p = base_rate + (prob(mean) - base_rate) * decay
    usable = (F.lower(F.trim(archetype)) == "diffuse") & ~occurrence_seen & (window > 0)
    return F.when(usable & base_rate.isNotNull(), stance(clamp(p, 0.0, 1.0)))


def brier_credibility(brier_mean: Column, n: Column, prior_n: float, slope: float, lo: float, hi: float) -> Column:
    shrunk = (brier_mean * n + prior_n * 0.25) / (n + prior_n)
    return F.coalesce(clamp(1.0 + (0.25 - shrunk) * slope, lo, hi), F.lit(1.0))


def skill_credibility(conservative: Column, elo: Column, brier_mean: Column, known: Column) -> Column:
    legacy = F.coalesce(elo, F.lit(1200.0)) / (1200.0 + F.coalesce(brier_mean, F.lit(0.25)) * 200.0)
    return (F.when(~known, F.lit(1.0))
            .when(conservative.isNotNull(), F.greatest(F.lit(0.1), 1.0 + conservative / 25.0))
            .otherwise(legacy))


def trade_side(model: Column, market: Column, threshold: float = 0.10, lo: float = 0.05, hi: float = 0.95) -> Column:
    edge = F.round(model - market, 4)
    return (F.when(~market.between(lo, hi), F.lit(None).cast("string"))
            .when(edge >= threshold, F.lit("YES")).when(edge <= -threshold, F.lit("NO")))


def close_call(p: Column, confidence: float = 0.9, slack: float = 1e-9) -> Column:
    """Post-close probability read as yes / no / undecided (null)."""
    return F.when(p >= confidence - slack, F.lit("yes")).when(p <= 1.0 - confidence + slack, F.lit("no"))


def sign_of(x: Column) -> Column:
    return F.when(x > 0, F.lit("positive")).when(x < 0, F.lit("negative")).when(x == 0, F.lit("zero"))
