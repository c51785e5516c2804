"""Claims reduced to one article stance, and articles to a cell signal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from presage.functions import scalars as S, text as X
from presage.operators.skew import weighted_medians, with_totals

LEVELS = ("high", "medium", "low")


def antecedent_similarity(text: Column, query: Column) -> Column:
    return X.jaccard(X.shingle_set(text, 2), X.shingle_set(query, 2))


def antecedent_keep(claims: DataFrame, keys: Sequence[str], query: Column, polarity: Column, threshold: float = 0.25) -> DataFrame:
    """Sources with an unconditional claim or a matching antecedent, per key."""
    match = (F.col("antecedent_text_en").isNotNull() & (F.coalesce("antecedent_polarity", F.lit(True)) == polarity)
             & (antecedent_similarity(F.col("antecedent_text_en"), query) >= threshold))
    plain = ~F.coalesce("is_conditional", F.lit(False))
    return claims.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("claims"), (F.bool_or(plain) | F.bool_or(F.coalesce(match, F.lit(False)))).alias("keep"))


def majority(rows: DataFrame, keys: Sequence[str], value: str, ix: str) -> DataFrame:
    """Most frequent value per key; the first seen wins a tie."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"), F.min(ix).alias("_i"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("_c", -F.col("_i"))).alias(value))


def reduce_articles(claims: DataFrame, keys: Sequence[str] = ("pool_id", "article_id"), attenuate: bool = False) -> DataFrame:
    """One row per article from its claims.

    Settlement-grade settled claims, when there are any, replace the set that
    stance and facts are drawn from; certainty, class weight, estimate and
    reader confidence use all claims.
    """
    keys = list(keys)
    c = F.col
    stance, certainty = S.quantitative_override(c("stance"), c("certainty"), c("quantitative_estimate"), c("evidence_class"))
    rows = claims.withColumns({"_st": stance, "_ce": certainty})
    rows = rows.withColumn("_grade", c("settled") & S.settlement_grade(c("_st"), c("_ce")))
    rows = with_totals(rows, keys, {"_graded": F.count_if(c("_grade"))}, c("claim_ix"))
    scored = c("_grade") | (c("_graded") == 0)
    coef = F.coalesce(S.conditional_coefficient(c("is_conditional"), c("strength"), c("stated_probability")), F.lit(1.0))
    w = c("_ce") * F.coalesce("specificity", F.lit(1.0))
    fact = scored & c("fact_signal").isNotNull()
    when = lambda cond, x: F.when(cond, x)

    def wmean(cond: Column, value: Column, weight: Column) -> Column:
        tw = F.sum(when(cond, weight))
        return F.when(tw == 0, F.avg(when(cond, value))).otherwise(F.sum(when(cond, value * weight)) / tw)

    first = lambda cond, x: F.min_by(x, when(cond, c("claim_ix")))
    dominant = F.max_by(F.struct("event_actors", "event_target", "is_occurrence", "verified", "facet"),
                        when(fact, F.struct(F.abs("fact_signal"), -c("claim_ix"))))
    rank = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), c("level"))
    shadow = F.when(F.bool_or(scored & c("is_conditional")), wmean(scored, c("_st"), w * coef))
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("claims"), wmean(scored, c("_st"), w).alias("stance"), shadow.alias("stance_conditional"),
        F.avg("_ce").alias("certainty"), F.avg(S.class_weight(c("evidence_class"), c("_ce"))).alias("evidence_weight"),
        (F.max("_graded") > 0).alias("settled"), (F.count_if("settled") - F.max("_graded")).alias("settlement_demoted"),
        first(c("quantitative_estimate").isNotNull(), c("quantitative_estimate")).alias("quantitative_estimate"),
        wmean(fact, c("fact_signal"), w).alias("fact_signal"), dominant.alias("_d"),
        F.max_by("level", F.when(c("level").isNotNull(), rank)).alias("confidence_level"),
        F.min_by("event_date", when(c("_grade") & (c("_st") >= 0) & c("event_date").isNotNull(), F.struct(-c("_ce"), c("event_date")))).alias("_pos_date"),
        F.min_by("event_date", when(c("_grade") & (c("_st") < 0) & c("event_date").isNotNull(), F.struct(-c("_ce"), c("event_date")))).alias("_neg_date"))
    # distinct traps of one article in first-seen order: a small fixed vocabulary
    traps = rows.filter("trap is not null").groupBy(*keys, "trap").agg(F.min("claim_ix").alias("_i")).groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "trap"))), lambda x: x["trap"]).alias("traps"))
    modal = majority(rows, keys, "evidence_class", "claim_ix")
    out = out.join(modal, keys, "left").join(traps, keys, "left")
    if attenuate:
        out = out.withColumn("stance", F.coalesce("stance_conditional", "stance"))
    return out.withColumn("settlement_event_date", F.when(c("stance") >= 0, c("_pos_date")).otherwise(c("_neg_date"))).select(
        *keys, "claims", "stance", "stance_conditional", "certainty", "evidence_weight", "evidence_class", "settled", "settlement_demoted",
        "settlement_event_date", "quantitative_estimate", "fact_signal", "_d.*", "confidence_level", F.array_join("traps", ",").alias("traps"))


def cell_signals(claims: DataFrame, keys: Sequence[str], means: Sequence[str], modes: Sequence[str], medians: Sequence[str]) -> DataFrame:
    """Claims of one cell as one signal: weighted means, first-seen modes, weighted medians."""
    keys = list(keys)
    rows = claims.withColumn("_w", F.col("certainty") * F.coalesce("specificity", F.lit(1.0)))

    def wmean(name: str) -> Column:
        known = F.col(name).isNotNull()
        tw = F.sum(F.when(known, F.col("_w")))
        return F.when(tw == 0, F.avg(name)).otherwise(F.sum(F.col(name) * F.col("_w")) / tw).alias(name)

    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("claim_count"), *[wmean(m) for m in means])
    for m in modes:
        out = out.join(majority(rows, keys, m, "claim_ix"), keys, "left")
    for m in medians:
        out = out.join(weighted_medians(rows, keys, m, "_w").withColumnRenamed("median", m), keys, "left")
    return out


def spread(claims: DataFrame, keys: Sequence[str], threshold: float = 0.4) -> DataFrame:
    """Entries with more than one claim whose stances lie apart."""
    gap = F.max("stance") - F.min("stance")
    return claims.groupBy(*keys).agg(F.count(F.lit(1)).alias("claims"), gap.alias("spread")).filter((F.col("claims") > 1) & (F.col("spread") > threshold))


def lead_claim(claims: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Claim of the summary's sign that lies nearest to it; worst reader confidence."""
    both = claims.join(summary.select(*keys, F.col("stance").alias("_sum")), list(keys))
    same = (F.signum("stance") == F.signum("_sum")) & (F.col("_sum") != 0)
    rank = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("level"))
    return both.groupBy(*keys).agg(
        F.min_by("claim_ix", F.when(same, F.struct(F.abs(F.col("stance") - F.col("_sum")), F.col("claim_ix")))).alias("lead_claim"),
        F.max_by(F.struct("level", "trap"), F.when(F.col("level").isNotNull(), F.struct(rank, -F.col("claim_ix")))).alias("_rc")
    ).select(*keys, "lead_claim", F.col("_rc.level").alias("worst_level"), F.col("_rc.trap").alias("worst_trap"))
