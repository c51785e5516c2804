"""Pooling of signed evidence rows into one probability per question.

A pool may hold a handful of rows or a third of the table. Pools that one task
may hold are dealt out whole, once, and every group-wise step is a window there.
For larger ones it is a partial aggregate joined back on a salted key, and the
result is folded from (pool, source) cells; nothing gathers those in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from presage.functions import scalars as S
from presage.operators.skew import attach, by_size, fork, with_rank, with_totals

Z95 = 1.96


@dataclass(frozen=True)
class PoolRules:
    """Pooling parameters with their usual values."""

    today: str = "2024-01-20"
    half_life: float = 7.0
    recency_floor: float = 0.02
    logit_clamp: float = 0.01
    relevance_floor: float = 0.05
    decisiveness: float = 0.5
    inflation: float = 0.45
    dispersion: float = 0.05
    defer_thin: bool = False
    min_sources: int = 2
    pin_stance: float = 0.94
    revalidate: bool = True
    grace_days: int = 14
    quality_floor: float = 0.20
    lookback_days: int = 30
    event_collapse: bool = True
    cluster_exponent: float = 0.0
    harmonic: bool = False
    max_source_share: float = 1.0
    strata: bool = False
    min_stratum_share: float = 0.0
    base_rate: float | None = None
    hazard_fraction: float = 0.5


def row_weights(rows: DataFrame, rules: PoolRules, evidence: str = "evidence_weight") -> DataFrame:
    """Credibility x evidence x recency x relevance, plus two variants of recency."""
    ev = F.coalesce(F.col(evidence), F.least(F.col("certainty"), F.lit(0.25)))
    base = F.col("credibility_weight") * ev * S.relevance_weight(F.col("relevance"))
    ref = F.to_date(F.lit(rules.today))
    return rows.withColumns({
        "weight": base * S.recency(F.col("published_date"), ref, rules.half_life, rules.recency_floor),
        "valve_weight": base * S.recency(F.col("published_date"), ref, rules.half_life, 0.0),
        "age_weight": base,
    })


def window_reason(rules: PoolRules) -> Column:
    """before_window / after_deadline, or null when the row counts."""
    day = F.coalesce("settlement_event_date", "published_date")
    active = (F.lit(rules.lookback_days >= 0) & ~F.col("claim_archetype").eqNullSafe(F.lit("scheduled"))
              & F.col("claim_created").isNotNull() & day.isNotNull())
    return F.when(active & (day < F.date_sub("claim_created", rules.lookback_days)), "before_window").when(
        active & (day > F.col("claim_deadline")), "after_deadline")


def vote_reason(rules: PoolRules, today: Column | None = None) -> Column:
    """Why a settlement vote does not count, or null when it does; judged on the rules' day or another."""
    today = F.to_date(F.lit(rules.today)) if today is None else today
    ev, dl, pub = F.col("settlement_event_date"), F.col("claim_deadline"), F.col("published_date")
    occurrence = (F.col("stance") >= 0) == ~F.col("claim_direction").eqNullSafe(F.lit("survival"))
    closed = F.coalesce(dl <= today, F.lit(False))
    late = F.coalesce(ev > dl, F.lit(False))
    grace = F.date_add(dl, rules.grace_days)
    undated_closed = ~occurrence & ev.isNull() & closed
    return (
        F.when(occurrence & ev.isNull(), "missing_event_date")
        .when(occurrence & late, "event_after_deadline")
        .when(undated_closed & F.coalesce(pub > grace, F.lit(False)), "stale_undated_foreclosure")
        .when(undated_closed, F.lit(None).cast("string"))
        .when(~occurrence & ev.isNull(), "undated_foreclosure")
        .when(~occurrence & late & ~closed, "event_after_deadline")
        .when(~occurrence & late & (ev > grace), "post_window_occurrence")
        .when(ev < F.col("claim_created"), "event_before_claim_window")
        .when(ev > pub, "event_after_article")
    )


def legacy_direction_allowed(direction: Column, today: Column) -> Column:
    """An open deadline blocks a direction that time alone could still reverse."""
    free = F.coalesce(~F.col("claim_direction").isin("arrival", "survival"), F.lit(True)) | F.col("claim_deadline").isNull() | (
        F.col("claim_deadline") <= today)
    return free | F.when(F.col("claim_direction") == "arrival", direction > 0).otherwise(direction < 0)


def _spread(group: str) -> Column:
    """Group key with every null row in a group of its own, so nulls never pile up."""
    return F.coalesce(F.col(group).cast("string"), F.concat(F.lit("\x00"), F.col("row_ix").cast("string")))


def collapse_events(rows: DataFrame, keys: Sequence[str], whole: bool = False) -> DataFrame:
    """Rows that report one event share the weight of the strongest of them."""
    totals = {"_mx": F.max("weight"), "_sm": F.sum("weight"), "_cnt": F.count(F.lit(1))}
    out = with_totals(rows.withColumn("_g", _spread("event_key")), [*keys, "_g"], totals, F.col("row_ix"), whole)
    factor = F.when((F.col("_cnt") >= 2) & (F.col("_sm") > 0), F.col("_mx") / F.col("_sm")).otherwise(1.0)
    return out.withColumn("weight", F.col("weight") * factor).drop("_g", *totals)


def downweight_clusters(rows: DataFrame, keys: Sequence[str], exponent: float, whole: bool = False) -> DataFrame:
    out = with_totals(rows.withColumn("_g", _spread("cluster_id")), [*keys, "_g"], {"_cnt": F.count(F.lit(1))}, F.col("row_ix"), whole)
    return out.withColumn("weight", F.col("weight") * F.pow(F.col("_cnt"), F.lit(-exponent))).drop("_g", "_cnt")


def harmonic_discount(rows: DataFrame, keys: Sequence[str], whole: bool = False) -> DataFrame:
    """1/rank inside an outlet, newest first, undated last; rows without outlet stay."""
    day = F.coalesce(-F.unix_date("published_date"), F.lit(2**31 - 1))
    ranked = with_rank(
        rows.withColumn("_src", F.coalesce("source_id", F.concat(F.lit("\x00"), F.col("row_ix").cast("string")))),
        [*keys, "_src"], [day, F.floor(F.col("row_ix") / 1_000_000)],
        [F.desc_nulls_last("published_date"), F.col("row_ix")], "_rank", whole)
    return ranked.withColumn("weight", F.col("weight") / F.col("_rank")).drop("_rank", "_src")


def cap_sources(rows: DataFrame, keys: Sequence[str], max_share: float, whole: bool = False) -> DataFrame:
    """No outlet keeps more than ``max_share`` of a pool's weight.

    Offenders are cut to the cap and the freed weight goes to the others pro
    rata, round by round. A round only ever caps the largest outlets left, and
    at most 1/max_share outlets can reach the cap, so the rounds are replayed on
    the few largest masses of each pool and the outcome is two factors.
    """
    if max_share >= 1.0:
        return rows
    top = int(1.0 / max_share) + 1
    keys = list(keys)
    keyed = with_totals(rows.withColumn("_src", _spread("source_id")), [*keys, "_src"], {"_m": F.sum("weight")}, F.col("row_ix"), whole)
    cap = F.col("_t") * max_share
    start = F.struct(F.lit(0).alias("k"), F.lit(1.0).alias("scale"), F.lit(False).alias("done"))

    def round_(st: Column, _: Column) -> Column:
        over = F.size(F.filter("_top", lambda m: m * st["scale"] > cap))
        over = F.greatest(over, st["k"])
        rest = F.col("_t") - F.aggregate(F.slice("_top", 1, over), F.lit(0.0), lambda a, m: a + m)
        stop = st["done"] | (over <= st["k"]) | (over >= F.col("_groups")) | (F.col("_least") * st["scale"] > cap)
        nxt = F.when(rest > 0, (F.col("_t") - over * cap) / rest).otherwise(st["scale"])
        return F.struct(F.when(stop, st["k"]).otherwise(over).alias("k"), F.when(stop, st["scale"]).otherwise(nxt).alias("scale"),
                        stop.alias("done"))

    state = F.when(F.col("_t") > 0, F.aggregate(F.sequence(F.lit(1), F.lit(top + 1)), start, round_))
    edge = F.when(F.col("_st.k") > 0, F.element_at("_top", F.greatest(F.col("_st.k"), F.lit(1))))
    factor = F.when(F.col("_m") >= F.col("_edge"), F.col("_cap") / F.col("_m")).otherwise(F.coalesce("_scale", F.lit(1.0)))
    if whole:
        pool, heaviest = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(F.desc("_m"), "_src")
        keyed = keyed.withColumn("_r", F.dense_rank().over(heaviest))
        keyed = keyed.withColumn("_new", ~F.lag("_r").over(heaviest).eqNullSafe(F.col("_r")))
        first = F.when(F.col("_new"), F.col("_m"))
        keyed = keyed.withColumns({"_t": F.sum(first).over(pool), "_groups": F.max("_r").over(pool), "_least": F.min("_m").over(pool),
                                   "_top": F.collect_list(F.when(F.col("_r") <= top, first)).over(pool)})
        # the rounds are replayed in one row of a pool and handed to the others
        keyed = keyed.withColumn("_top", F.when(F.col("_new") & (F.col("_r") == 1), F.sort_array("_top", asc=False)))
        keyed = keyed.withColumn("_st", F.when(F.col("_top").isNotNull(), state))
        keyed = keyed.withColumns({"_cap": cap, "_scale": F.max("_st.scale").over(pool), "_edge": F.max(edge).over(pool)})
        return keyed.withColumn("weight", F.col("weight") * factor).drop("_src", "_m", "_r", "_new", "_t", "_groups", "_least", "_top", "_st", "_cap", "_scale", "_edge")
    keyed = fork(keyed)
    mass = keyed.groupBy(*keys, "_src").agg(F.first("_m").alias("_m"), F.count(F.lit(1)).alias("_rows"))
    pool = mass.groupBy(*keys).agg(F.sum("_m").alias("_t"), F.sum("_rows").alias("_all"), F.count(F.lit(1)).alias("_groups"), F.min("_m").alias("_least"))
    biggest = (
        mass.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_m"), "_src")))
        .filter(F.col("_r") <= top)
        .groupBy(*keys).agg(F.sort_array(F.collect_list("_m"), asc=False).alias("_top"))
    )
    factors = pool.join(biggest, keys).withColumn("_st", state).select(*keys, "_all", cap.alias("_cap"), F.col("_st.scale").alias("_scale"), edge.alias("_edge"))
    return attach(keyed, factors, keys, "_all", F.col("row_ix")).withColumn("weight", F.col("weight") * factor).drop(
        "_src", "_m", "_cap", "_scale", "_edge")


def balance_strata(rows: DataFrame, keys: Sequence[str], min_share: float, whole: bool = False) -> DataFrame:
    """Equal weight for every stratum of at least ``min_share``; the rest is one more."""
    keys = list(keys)
    keyed = with_totals(rows.withColumn("_s", _spread("stratum")), [*keys, "_s"], {"_m": F.sum("weight")}, F.col("row_ix"), whole)
    keyed = with_totals(keyed, keys, {"_t": F.sum("weight")}, F.col("row_ix"), whole)
    small = F.try_divide("_m", "_t") < min_share
    keyed = keyed.withColumn("_small", F.coalesce(small, F.lit(True)))
    strata = F.col("_big") + F.col("_other").isNotNull().cast("int")
    own = F.when(F.col("_small"), F.col("_other")).otherwise(F.col("_m"))
    factor = F.when((F.col("_t") > 0) & (own > 0), F.col("_t") / own / strata).otherwise(1.0)
    if whole:
        pool = Window.partitionBy(*keys)
        keyed = keyed.withColumn("_r", F.dense_rank().over(pool.orderBy("_small", "_s")))
        keyed = keyed.withColumns({"_big": F.coalesce(F.max(F.when(~F.col("_small"), F.col("_r"))).over(pool), F.lit(0)),
                                   "_other": F.sum(F.when(F.col("_small"), F.col("weight"))).over(pool)})
        return keyed.withColumn("weight", F.col("weight") * factor).drop("_s", "_m", "_t", "_small", "_r", "_big", "_other")
    keyed = fork(keyed)
    strata_rows = keyed.groupBy(*keys, "_s").agg(F.first("_small").alias("_small"), F.first("_m").alias("_m"), F.count(F.lit(1)).alias("_rows"))
    shape = strata_rows.groupBy(*keys).agg(
        F.sum("_rows").alias("_all"), F.count_if(~F.col("_small")).alias("_big"), F.sum(F.when(F.col("_small"), F.col("_m"))).alias("_other"))
    return attach(keyed, shape, keys, "_all", F.col("row_ix")).withColumn("weight", F.col("weight") * factor).drop("_s", "_m", "_t", "_small", "_big", "_other")


def reweight(rows: DataFrame, keys: Sequence[str], rules: PoolRules, whole: bool = False) -> DataFrame:
    """Weight factors in their fixed order; later ones see the earlier results. ``whole``: a step of ``by_size`` on pools that one task may hold."""
    reason = window_reason(rules)
    rows = rows.withColumn("window_reason", reason)
    inside = F.col("window_reason").isNull()
    rows = rows.withColumns({c: F.when(inside, F.col(c)).otherwise(0.0) for c in ("weight", "valve_weight", "age_weight")})
    if rules.event_collapse:
        rows = collapse_events(rows, keys, whole)
    if rules.cluster_exponent > 0:
        rows = downweight_clusters(rows, keys, rules.cluster_exponent, whole)
    if rules.harmonic:
        rows = harmonic_discount(rows, keys, whole)
    rows = cap_sources(rows, keys, rules.max_source_share, whole)
    if rules.strata:
        rows = balance_strata(rows, keys, rules.min_stratum_share, whole)
    return rows


CLAIM_COLS = ("claim_direction", "claim_deadline", "claim_created", "claim_archetype")


SUMS = ("n", "w", "w2", "wl", "wp", "wpp", "l", "p", "pp", "wcap", "rel", "valve", "age", "pos", "neg", "pos_w", "neg_w",
        "settled_rows", "demoted", "outside")


def pool_cells(rows: DataFrame, keys: Sequence[str], rules: PoolRules) -> DataFrame:
    """Additive sums per (pool, source, voting cluster): all the pooled numbers need."""
    p = S.bound(S.prob(F.col("stance")), rules.logit_clamp, 1.0 - rules.logit_clamp)
    reason = vote_reason(rules) if rules.revalidate else F.lit(None).cast("string")
    rows = rows.withColumn("_p", p).withColumn("_l", S.logit(F.col("_p"))).withColumn(
        "_reason", F.when(F.col("settled"), reason)).withColumn("_ok", F.col("settled") & F.col("_reason").isNull())
    w, pp, ll, pos = F.col("weight"), F.col("_p"), F.col("_l"), F.col("stance") >= 0
    return rows.groupBy(*keys, "source_id", F.when(F.col("_ok") & pos, F.col("cluster_id")).alias("_pos_cluster"),
                        F.when(F.col("_ok") & ~pos, F.col("cluster_id")).alias("_neg_cluster")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), F.sum(w * w).alias("w2"), F.sum(w * ll).alias("wl"),
        F.sum(w * pp).alias("wp"), F.sum(w * pp * pp).alias("wpp"), F.sum(ll).alias("l"), F.sum(pp).alias("p"), F.sum(pp * pp).alias("pp"),
        F.sum(F.least(w, F.lit(rules.decisiveness))).alias("wcap"), F.sum(F.col("relevance") * F.col("relevance")).alias("rel"),
        F.sum("valve_weight").alias("valve"), F.sum("age_weight").alias("age"),
        F.count_if(F.col("_ok") & pos).alias("pos"), F.count_if(F.col("_ok") & ~pos).alias("neg"),
        F.sum(F.when(F.col("_ok") & pos, w).otherwise(0.0)).alias("pos_w"), F.sum(F.when(F.col("_ok") & ~pos, w).otherwise(0.0)).alias("neg_w"),
        F.count_if("settled").alias("settled_rows"), F.count_if(F.col("_reason").isNotNull()).alias("demoted"),
        F.count_if(F.col("window_reason").isNotNull()).alias("outside"),
        F.min(F.when(w > 0, F.col("row_ix"))).alias("first_ix"),
        *[F.max(c).alias(c) for c in CLAIM_COLS],
    )


def kish(w: Column, w2: Column, n: Column) -> Column:
    """Effective sample size inside [1, n]; n when no weight is left."""
    return F.when((w > 0) & (w2 > 0), F.greatest(F.lit(1.0), F.least(n.cast("double"), w * w / w2))).otherwise(n.cast("double"))


def with_swing(cells: DataFrame, keys: Sequence[str], whole: bool = False) -> DataFrame:
    """Change of the pooled mean when the cell's outlet is left out.

    The mean without an outlet follows from the pool's sums minus the outlet's,
    so nothing is pooled again.
    """
    cells = with_totals(cells, [*keys, "source_id"], {"_sw": F.sum("w"), "_swl": F.sum("wl"), "_six": F.min("first_ix")}, F.hash("_pos_cluster", "_neg_cluster"), whole)
    cells = with_totals(cells, keys, {"_tw": F.sum("w"), "_twl": F.sum("wl"), "_tl": F.sum("l"), "_tn": F.sum("n")}, F.hash("source_id", "_pos_cluster", "_neg_cluster"), whole)
    rest = F.col("_tw") - F.col("_sw")
    empty = rest <= F.col("_tw") * 1e-12
    full = S.stance(S.sigmoid(F.col("_twl") / F.col("_tw")))
    without = S.stance(S.sigmoid(F.when(empty, F.col("_tl") / F.col("_tn")).otherwise((F.col("_twl") - F.col("_swl")) / rest)))
    named = F.col("source_id").isNotNull() & (F.col("_sw") > 0)
    gap = F.abs(full - without)
    return cells.withColumn("_swing", F.when(named, F.when(gap > 1e-14, gap).otherwise(0.0)))


def pooled_interval(rules: PoolRules, w: Column, w2: Column, wl: Column, wp: Column, wpp: Column, n: Column,
                    l: Column, p: Column, pp: Column) -> dict[str, Column]:
    """Mean, spread and 95 % interval from a pool's sums; uniform without weight."""
    flat = w <= 0
    tw = F.when(flat, n.cast("double")).otherwise(w)
    mean_p = S.sigmoid(F.when(flat, l).otherwise(wl) / tw)
    s1, s2 = F.when(flat, p).otherwise(wp) / tw, F.when(flat, pp).otherwise(wpp) / tw
    std = F.sqrt(F.greatest(F.lit(0.0), s2 - 2 * mean_p * s1 + mean_p * mean_p))
    sem = std / F.sqrt(F.when(flat, n.cast("double")).otherwise(kish(w, w2, n)))
    e = rules.logit_clamp
    return {"mean": S.stance(mean_p), "std": 2.0 * std,
            "ci_low": S.stance(S.bound(mean_p - Z95 * sem, e, 1 - e)), "ci_high": S.stance(S.bound(mean_p + Z95 * sem, e, 1 - e))}


def pool_sources(rows: DataFrame, keys: Sequence[str], rules: PoolRules = PoolRules(), weight: str = "weight") -> DataFrame:
    """Plain logit pool of (stance, weight) rows: one partial aggregate per pool."""
    p = S.bound(S.prob(F.col("stance")), rules.logit_clamp, 1.0 - rules.logit_clamp)
    w = F.col(weight)
    rows = rows.withColumn("_p", p).withColumn("_l", S.logit(F.col("_p")))
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), F.sum(w * w).alias("w2"), F.sum(w * F.col("_l")).alias("wl"),
        F.sum(w * F.col("_p")).alias("wp"), F.sum(w * F.col("_p") * F.col("_p")).alias("wpp"),
        F.sum("_l").alias("l"), F.sum("_p").alias("p"), F.sum(F.col("_p") * F.col("_p")).alias("pp"))
    c = F.col
    cols = pooled_interval(rules, c("w"), c("w2"), c("wl"), c("wp"), c("wpp"), c("n"), c("l"), c("p"), c("pp"))
    return sums.select(*keys, "n", c("w").alias("evidence_mass"), kish(c("w"), c("w2"), c("n")).alias("n_eff"),
                       *[v.alias(k) for k, v in cols.items()])


def aggregate_pool(rows: DataFrame, keys: Sequence[str], rules: PoolRules = PoolRules()) -> DataFrame:
    """One result row per pool: abstain, settle, or pool with an interval."""
    return by_size(rows, keys, lambda part, whole: pool_weighted(reweight(part, keys, rules, whole), keys, rules, whole))


def pool_weighted(rows: DataFrame, keys: Sequence[str], rules: PoolRules, whole: bool = False) -> DataFrame:
    """``aggregate_pool`` of rows whose weights are final."""
    keys = list(keys)
    cells = with_swing(pool_cells(rows, keys, rules), keys, whole)
    # a count of distinct values would deal the cells of a whole pool out again
    distinct = (lambda c: F.size(F.collect_set(c)).cast("long")) if whole else F.count_distinct
    totals = cells.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in SUMS], *[F.max(c).alias(c) for c in CLAIM_COLS],
        distinct(F.col("_pos_cluster")).alias("pos_clusters"), distinct(F.col("_neg_cluster")).alias("neg_clusters"),
        distinct(F.when(F.col("_swing").isNotNull(), F.col("source_id"))).alias("_outlets"), F.max("_swing").alias("_swing"),
        F.max_by("source_id", F.when(F.col("_swing").isNotNull(), F.struct(F.round("_swing", 12), -F.col("_six")))).alias("_dom"))
    several = F.col("_outlets") >= 2
    totals = totals.withColumn("max_swing", F.when(several, F.col("_swing"))).withColumn(
        "dominant_source", F.when(several & (F.col("_swing") > 0), F.col("_dom")))
    return decide(totals, keys, rules)


def decide(t: DataFrame, keys: Sequence[str], rules: PoolRules) -> DataFrame:
    """Column arithmetic from a pool's sums to its published numbers."""
    c = F.col
    today = F.to_date(F.lit(rules.today))
    e = rules.logit_clamp
    t = t.withColumn("n_eff", kish(c("w"), c("w2"), c("n")))
    off_topic = c("rel") < rules.relevance_floor
    no_weight = ~off_topic & (c("w") <= 0)
    thin = ~off_topic & (c("valve") < rules.decisiveness)
    open_deadline = F.coalesce(c("claim_deadline") >= today, F.lit(False))
    no_signal = thin & F.lit(rules.defer_thin) & ~no_weight & ~open_deadline
    pc, nc = c("pos_clusters"), c("neg_clusters")
    pos, neg = c("pos"), c("neg")
    most = F.greatest(pc, nc)
    enough = most >= rules.min_sources
    if rules.min_sources <= 0:
        suppression = F.lit(None).cast("string")
        direction = F.lit(None).cast("double")
        votes = F.lit(0)
    elif rules.revalidate:
        conflict = (pos > 0) & (neg > 0)
        weak = enough & F.lit(rules.quality_floor > 0) & (F.when(pos > neg, c("pos_w")).otherwise(c("neg_w")) < rules.quality_floor)
        suppression = F.when(conflict, "settlement_conflict").when(weak, "settlement_quality_floor")
        direction = F.when(suppression.isNull() & enough, F.when(pos > 0, 1.0).otherwise(-1.0))
        votes = F.when(direction.isNotNull(), most).otherwise(0)
    else:
        lead = F.when(pos > neg, 1.0).when(neg > pos, -1.0)
        carried = lead.isNotNull() & (F.greatest(pos, neg) >= rules.min_sources)
        allowed = legacy_direction_allowed(lead, today)
        suppression = F.when(carried & ~allowed, "settlement_direction")
        direction = F.when(carried & allowed, lead)
        votes = F.when(direction.isNotNull(), F.greatest(pos, neg)).otherwise(0)
    t = t.withColumns({"_dir": direction, "suppression_reason": suppression, "settled_sources": votes.cast("long"), "thin_evidence": thin})
    settled = c("_dir").isNotNull()
    abstain = F.when(settled, F.lit(None).cast("string")).when(off_topic, "all_articles_off_topic").when(
        no_weight, "no_usable_weight").when(no_signal, "no_decisive_signal")
    t = t.withColumn("insufficient_reason", abstain)

    base = pooled_interval(rules, c("w"), c("w2"), c("wl"), c("wp"), c("wpp"), c("n"), c("l"), c("p"), c("pp"))
    t = t.withColumns({f"_{k}": v for k, v in base.items()})
    mean_p = S.prob(c("_mean"))
    lo, hi, std = S.prob(c("_ci_low")), S.prob(c("_ci_high")), c("_std")
    if rules.decisiveness > 0:
        deficit = (rules.decisiveness - c("valve")) / rules.decisiveness
        extra = S.bound(deficit, 0.0, 1.0) * rules.inflation
        widen = (deficit > 0) & F.lit(rules.inflation > 0)
        t = t.withColumns({
            "_lo": F.when(widen, S.bound(F.least(lo, mean_p) - extra, e, 1 - e)).otherwise(lo),
            "_hi": F.when(widen, S.bound(F.greatest(hi, mean_p) + extra, e, 1 - e)).otherwise(hi),
            "_sd": F.when(widen, F.greatest(std, 2.0 * extra)).otherwise(std)})
        floor_n = F.least(c("n_eff"), c("wcap") / rules.decisiveness)
    else:
        t = t.withColumns({"_lo": lo, "_hi": hi, "_sd": std})
        floor_n = c("n_eff")
    if rules.dispersion > 0:
        half = Z95 * rules.dispersion / F.sqrt(F.greatest(floor_n, F.lit(1.0)))
        t = t.withColumns({
            "_lo": S.bound(F.least(c("_lo"), mean_p - half), e, 1 - e), "_hi": S.bound(F.greatest(c("_hi"), mean_p + half), e, 1 - e),
            "_sd": F.greatest(c("_sd"), F.lit(2.0 * rules.dispersion))})
    pin = c("_dir") * rules.pin_stance
    pin_p = S.prob(pin)
    pin_lo = F.when(c("_dir") > 0, pin_p - 0.06).otherwise(F.greatest(F.lit(0.005), pin_p - 0.025))
    pin_hi = F.when(c("_dir") > 0, F.least(F.lit(0.995), pin_p + 0.025)).otherwise(pin_p + 0.06)
    gave_up = c("insufficient_reason").isNotNull()

    def pick(pinned: Column, pooled: Column) -> Column:
        return F.when(settled, pinned).when(gave_up, 0.0).otherwise(pooled)

    quiet = off_topic | no_weight | no_signal
    hazard = F.lit(None).cast("double") if rules.base_rate is None else S.hazard_mean(
        c("_mean"), c("claim_archetype"), c("claim_created"), c("claim_deadline"), F.lit(rules.base_rate), rules.hazard_fraction,
        c("settled_rows") > 0, today)
    return t.select(
        *keys, pick(pin, c("_mean")).alias("mean"), pick(F.lit(0.06), c("_sd")).alias("std"),
        pick(S.stance(pin_lo), S.stance(c("_lo"))).alias("ci_low"), pick(S.stance(pin_hi), S.stance(c("_hi"))).alias("ci_high"),
        settled.alias("settled"), "n", "n_eff", c("w").alias("evidence_mass"), c("valve").alias("valve_mass"),
        c("age").alias("age_adjusted_mass"), "thin_evidence", "insufficient_reason", "settled_sources",
        (c("suppression_reason").isNotNull()).alias("settlement_suppressed"), "suppression_reason",
        c("demoted").alias("votes_demoted"), c("outside").alias("rows_outside_window"),
        F.when(~quiet, c("max_swing")).alias("max_swing"), F.when(~quiet, c("dominant_source")).alias("dominant_source"),
        F.when(~quiet, hazard).alias("hazard_mean"),
    )
