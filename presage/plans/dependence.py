"""Pools over computed clusters, and the study of dependent rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from presage.functions import text as X
from presage.operators import dependence as D, pooling as PL
from presage.plans.pooling import DECIDE, EVIDENCE_SQL, FULL, FULL_SQL, _out, decide_sql
from presage.plans.registry import Registry
from presage.session import cut_lineage, rounded
from presage.sources import fixtures as fx
from presage.sources.fixtures import with_views

Q = Registry()

ALIKE_SQL = r"""
gram AS (SELECT DISTINCT report_text AS t, array_to_string(w[i:i + 2], ' ') AS s FROM (
  SELECT report_text, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM (
    SELECT DISTINCT report_text, regexp_extract_all(lower(report_text), '[a-z0-9]+') AS w FROM reported_rows WHERE report_text IS NOT NULL) WHERE len(w) > 0)),
gsize AS (SELECT t, count(*) AS n FROM gram GROUP BY 1),
alike AS (SELECT a, b FROM (SELECT x.t AS a, y.t AS b, count(*) AS i FROM gram x JOIN gram y USING (s) GROUP BY 1, 2) JOIN gsize p ON p.t = a JOIN gsize q ON q.t = b
          WHERE i / (p.n + q.n - i)::DOUBLE >= 0.4)"""

CLUSTER_SQL = ALIKE_SQL + """,
told AS (SELECT DISTINCT pool_id, report_text AS t FROM reported_rows WHERE report_text IS NOT NULL),
hop AS (SELECT x.pool_id, a, b FROM told x JOIN alike ON x.t = a JOIN told y ON y.pool_id = x.pool_id AND y.t = b),
reach(pool_id, a, b) AS (SELECT * FROM hop UNION SELECT r.pool_id, r.a, h.b FROM reach r JOIN hop h ON h.pool_id = r.pool_id AND h.a = r.b),
label AS (SELECT pool_id, a, min(b) AS l FROM reach GROUP BY 1, 2),
clustered_rows AS (SELECT r.* EXCLUDE (cluster_id), coalesce(l, '#' || row_ix) AS cluster_id FROM reported_rows r LEFT JOIN label ON label.pool_id = r.pool_id AND a = report_text)"""


@Q.add("pooled_forecasts_clustered", with_views(
    "pools pool_rows reported_rows", DECIDE, CLUSTER_SQL + "," + EVIDENCE_SQL.replace("FROM pool_rows))", "FROM clustered_rows))") + "," + FULL_SQL + "," + decide_sql("w5", True)))
def pooled_forecasts_clustered(spark, sf):
    """Pools under full weighting whose clusters are computed from the rows' texts."""
    rows = PL.row_weights(D.with_text_clusters(fx.reported_rows(spark, sf), ["pool_id"], "report_text"), FULL)
    key = X.event_key(F.col("event_actors"), F.col("event_target"), F.coalesce("settlement_event_date", "published_date"))
    rows = rows.withColumn("event_key", key).drop("report_text", "attributed_to", "event_actors", "event_target", "user_id", "event_type", "k")
    return _out(PL.aggregate_pool(cut_lineage(rows), ["pool_id"], FULL))


def _spread_sql(group: str, name: str) -> str:
    return (f"{name}_s AS (SELECT pool_id, count(*) AS {name}_groups, coalesce(sum(c) FILTER (WHERE c > 1), 0)::BIGINT AS {name}_echoed, max(c) AS {name}_largest "
            f"FROM (SELECT pool_id, coalesce({group}::VARCHAR, chr(1) || row_ix) AS g, count(*) AS c FROM study GROUP BY 1, 2) GROUP BY 1)")


def _shift_sql(group: str, name: str) -> str:
    p = "greatest(0.01, least(0.99, (stance + 1) / 2))"
    mean = f"1 / (1 + exp(-CASE WHEN sum(weight) > 0 THEN sum(weight * ln({p} / (1 - {p}))) / sum(weight) ELSE avg(ln({p} / (1 - {p}))) END))"
    return f"""
{name}_g AS (SELECT pool_id, coalesce({group}::VARCHAR, chr(1) || row_ix) AS g, CASE WHEN sum(weight) = 0 THEN avg(stance) ELSE sum(weight * stance) / sum(weight) END AS stance, max(weight) AS weight
  FROM study WHERE stance IS NOT NULL GROUP BY 1, 2),
{name}_d AS (SELECT pool_id, (b.m - a.m) * 100 AS {name} FROM (SELECT pool_id, {mean} AS m FROM study WHERE stance IS NOT NULL GROUP BY 1 HAVING count(*) >= 2) a
  JOIN (SELECT pool_id, {mean} AS m FROM {name}_g GROUP BY 1 HAVING count(*) >= 2) b USING (pool_id))"""


STUDY_SQL = ALIKE_SQL + "," + EVIDENCE_SQL.replace("FROM pool_rows))", "FROM reported_rows))") + r""",
voiced AS (SELECT *, nullif(trim(regexp_replace(lower(attributed_to), '\s+', ' ', 'g')), '') AS voice, max(published_date) OVER (PARTITION BY pool_id) AS newest FROM keyed),
weighed AS (SELECT *, credibility_weight * coalesce(evidence_weight, 0.6) * relevance * relevance * CASE WHEN newest IS NULL THEN 1
  WHEN published_date IS NULL THEN 0.02 ELSE greatest(0.02, pow(0.5, greatest(0, newest - published_date) / 7.0)) END AS weight FROM voiced),
hop AS (SELECT x.row_ix AS a, y.row_ix AS b FROM weighed x JOIN weighed y ON x.pool_id = y.pool_id AND x.event_key = y.event_key
  WHERE x.voice = y.voice OR EXISTS (SELECT 1 FROM alike l WHERE l.a = x.report_text AND l.b = y.report_text)),
reach(a, b) AS (SELECT * FROM hop UNION SELECT r.a, h.b FROM reach r JOIN hop h ON h.a = r.b),
study AS (SELECT w.*, coalesce(l, row_ix) AS report_id FROM weighed w LEFT JOIN (SELECT a AS own, min(b) AS l FROM reach GROUP BY 1) ON own = row_ix),
""" + ",".join([_spread_sql("voice", "voice"), _spread_sql("event_key", "event"), _spread_sql("report_id", "report"), _shift_sql("report_id", "report_shift"), _shift_sql("event_key", "event_shift")])


@Q.add("dependence_study", with_views("pools pool_rows reported_rows", """
SELECT pool_id, rows, round(voice_fill, 10) AS voice_fill, voice_groups, voice_echoed, voice_largest, event_groups, event_echoed, event_largest, report_groups, report_echoed, report_largest,
       round(report_shift, 8) AS report_shift, round(event_shift, 8) AS event_shift
FROM (SELECT pool_id, count(*) AS rows, count(voice) / count(*)::DOUBLE AS voice_fill FROM study GROUP BY 1)
JOIN voice_s USING (pool_id) JOIN event_s USING (pool_id) JOIN report_s USING (pool_id) LEFT JOIN report_shift_d USING (pool_id) LEFT JOIN event_shift_d USING (pool_id)""", STUDY_SQL))
def dependence_study(spark, sf):
    """How far voices, events and whole reports group each pool's rows, and what counting a group once changes."""
    key = X.event_key(F.col("event_actors"), F.col("event_target"), F.coalesce("settlement_event_date", "published_date"))
    rows = fx.reported_rows(spark, sf).withColumn("event_key", key).withColumn("voice", D.voice_key(F.col("attributed_to")))
    out = D.dependence_study(rows, ["pool_id"], "event_key", "voice", "report_text")
    shift = lambda c: (F.round(F.col(c), 8) + F.lit(0.0)).alias(c)
    return out.select("pool_id", "rows", rounded(F.col("voice_fill")).alias("voice_fill"),
                      *[f"{n}_{c}" for n in ("voice", "event", "report") for c in ("groups", "echoed", "largest")], shift("report_shift"), shift("event_shift"))
