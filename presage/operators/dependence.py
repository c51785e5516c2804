"""Which rows of a pool repeat one report, and what counting them once does to the pool.

Clusters come from the rows themselves: alike texts, one reported event, one
quoted voice. Groups are never listed pair by pair. Texts cluster first, and a
voice then links text clusters through the smallest of them, so a hot group
costs as many edges as it has unlike texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from presage.functions import scalars as S
from presage.operators.pooling import PoolRules, pool_sources
from presage.operators.similarity import components, text_clusters
from presage.operators.skew import attach, by_size, fork, with_totals
from presage.session import cut_lineage


def voice_key(name: Column) -> Column:
    """A quoted voice as a key: lower case, single spaces; null when empty."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(name), r"\s+", " ")), F.lit(""))


def with_text_clusters(rows: DataFrame, keys: Sequence[str], text: str, threshold: float = 0.4, size: int = 3) -> DataFrame:
    """``rows`` (with row_ix, unique over all pools) with ``cluster_id`` computed: smallest row_ix of the component of alike texts in its pool.

    Rows without words stand alone, so missing text never costs a row its weight.
    """
    rows = fork(rows.drop("cluster_id"))
    found = text_clusters(rows.select(F.col("row_ix").alias("id"), *keys, text), text, threshold, size, keys)
    return rows.join(found.select(F.col("id").alias("row_ix"), "cluster_id"), "row_ix")


def report_clusters(rows: DataFrame, keys: Sequence[str], event: str, voice: str, text: str, threshold: float = 0.4, size: int = 3) -> DataFrame:
    """row_ix, report_id: rows of one pool and one event that share the voice or have alike texts, transitively.

    Rows without an event key stand alone; ``report_id`` is the smallest row_ix.
    """
    rows = fork(rows.select("row_ix", *keys, event, voice, text))
    scope = [*keys, event]
    keyed = rows.filter(F.col(event).isNotNull()).withColumnRenamed("row_ix", "id")
    alike = cut_lineage(text_clusters(keyed, text, threshold, size, scope).select("id", "cluster_id"))
    sides = fork(keyed.filter(F.col(voice).isNotNull()).join(alike, "id").select(*scope, voice, "cluster_id").distinct())
    heads = sides.groupBy(*scope, voice).agg(F.min("cluster_id").alias("_head"), F.count(F.lit(1)).alias("_n"))
    edges = attach(sides, heads, [*scope, voice], "_n", F.col("cluster_id")).filter("cluster_id <> _head")
    edges = cut_lineage(edges.select(F.col("cluster_id").alias("a"), F.col("_head").alias("b")))
    sizes = alike.groupBy(F.col("cluster_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"))
    owner = components(sizes, edges).join(sizes, "id").select(F.col("id").alias("cluster_id"), F.col("comp").alias("report_id"), "_n")
    found = attach(alike, owner, ["cluster_id"], "_n", F.col("id")).select(F.col("id").alias("row_ix"), "report_id")
    return rows.select("row_ix").join(found, "row_ix", "left").withColumn("report_id", F.coalesce("report_id", "row_ix"))


def _own(group: str) -> Column:
    return F.coalesce(F.col(group).cast("string"), F.concat(F.lit("\x00"), F.col("row_ix").cast("string")))


def _spread(rows: DataFrame, keys: Sequence[str], group: str, name: str) -> DataFrame:
    """Groups, rows in groups of several, and the largest group of each pool."""
    sizes = rows.groupBy(*keys, _own(group).alias("_g")).agg(F.count(F.lit(1)).alias("_c"))
    return sizes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(f"{name}_groups"), F.coalesce(F.sum(F.when(F.col("_c") > 1, F.col("_c"))), F.lit(0)).alias(f"{name}_echoed"), F.max("_c").alias(f"{name}_largest"))


def study_weights(rows: DataFrame, keys: Sequence[str], half_life: float = 7.0, whole: bool = False) -> DataFrame:
    """``weight`` = credibility x evidence x recency x relevance, aged from the pool's newest row; what is missing counts as usual."""
    rows = with_totals(rows, keys, {"_newest": F.max("published_date")}, F.col("row_ix"), whole)
    weight = (F.coalesce("credibility_weight", F.lit(1.0)) * F.coalesce("evidence_weight", F.lit(0.6))
              * S.recency(F.col("published_date"), F.col("_newest"), half_life) * F.coalesce(S.relevance_weight(F.col("relevance")), F.lit(1.0)))
    return rows.withColumn("weight", weight).drop("_newest")


def collapsed_shift(rows: DataFrame, keys: Sequence[str], group: str, name: str, rules: PoolRules = PoolRules()) -> DataFrame:
    """``name``: points by which the pooled probability moves when each group is one row, with its weighted mean stance and greatest weight.

    Null where fewer than two rows, or two groups, have a stance.
    """
    usable = rows.filter(F.col("stance").isNotNull())
    w, s = F.col("weight"), F.col("stance")
    merged = usable.groupBy(*keys, _own(group).alias("_g")).agg(F.sum(w).alias("_w"), F.sum(w * s).alias("_ws"), F.avg(s).alias("_flat"), F.max(w).alias("weight")).withColumn(
        "stance", F.when(F.col("_w") == 0, F.col("_flat")).otherwise(F.col("_ws") / F.col("_w")))
    plain = pool_sources(usable, keys, rules).filter("n >= 2").select(*keys, F.col("mean").alias("_all"))
    once = pool_sources(merged, keys, rules).filter("n >= 2").select(*keys, F.col("mean").alias("_once"))
    return plain.join(once, list(keys)).select(*keys, ((S.prob(F.col("_once")) - S.prob(F.col("_all"))) * 100.0).alias(name))


def dependence_study(rows: DataFrame, keys: Sequence[str], event: str, voice: str, text: str) -> DataFrame:
    """Per pool: how far three rules group its rows, and how far two of them move the pooled probability."""
    keys = list(keys)
    weighed = by_size(rows, keys, lambda part, whole: study_weights(part, keys, whole=whole))
    rows = fork(weighed.select("row_ix", *keys, event, voice, text, "stance", "weight"))
    rows = cut_lineage(rows.drop(text).join(report_clusters(rows, keys, event, voice, text), "row_ix"))
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), (F.count(voice) / F.count(F.lit(1))).alias("voice_fill"))
    for group, name in ((voice, "voice"), (event, "event"), ("report_id", "report")):
        out = out.join(_spread(rows, keys, group, name), keys)
    for group, name in (("report_id", "report_shift"), (event, "event_shift")):
        out = out.join(collapsed_shift(rows, keys, group, name), keys, "left")
    return out
