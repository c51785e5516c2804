"""Near-duplicate texts, claim clusters, syndicated titles, event keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from presage.functions import text as X
from presage.operators import similarity as SM
from presage.plans.pooling import EVIDENCE_SQL, evidence
from presage.plans.registry import Registry
from presage.session import rounded, table
from presage.sources.fixtures import with_views

Q = Registry()


def documents(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "source", "lang")


CLOSURE = """
reach(a, b) AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT r.a, e2.b FROM reach r JOIN (SELECT a, b FROM e UNION SELECT b, a FROM e) e2 ON r.b = e2.a)"""

SIMHASH_SQL = """
grams AS (SELECT doc_id, md5(array_to_string(w[i:i + 2], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i
          FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents) WHERE len(w) >= 3)),
halves AS (SELECT doc_id, ('0x' || substr(h, 17, 8))::UBIGINT AS hi, ('0x' || substr(h, 25, 8))::UBIGINT AS lo, h FROM grams),
ones AS (SELECT doc_id, bit, count(*) FILTER (WHERE (CASE WHEN bit < 32 THEN lo >> bit ELSE hi >> (bit - 32) END) & 1 = 1) AS o, count(*) AS n
         FROM halves, (SELECT unnest(range(64))::UBIGINT AS bit) GROUP BY 1, 2),
fps AS (SELECT doc_id, coalesce(sum(CASE WHEN o * 2 > n THEN CASE WHEN bit = 63 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT << bit::INT) END ELSE 0 END), 0)::BIGINT AS fp
        FROM documents LEFT JOIN ones USING (doc_id) GROUP BY 1)"""


@Q.add("text_fingerprints", f"WITH {SIMHASH_SQL} SELECT doc_id, fp FROM fps")
def text_fingerprints(spark, sf):
    return SM.simhash(documents(spark, sf), "text").withColumnRenamed("id", "doc_id")


@Q.add("near_duplicate_documents", f"""WITH RECURSIVE {SIMHASH_SQL},
d AS (SELECT fp, min(doc_id) AS a FROM fps GROUP BY 1),
e AS (SELECT x.a AS a, y.a AS b FROM d x JOIN d y ON x.a < y.a AND bit_count(xor(x.fp, y.fp)) <= 8),
{CLOSURE}
SELECT f.doc_id, least(d.a, coalesce((SELECT min(b) FROM reach WHERE reach.a = d.a), d.a)) AS canonical FROM fps f JOIN d USING (fp)""")
def near_duplicate_documents(spark, sf):
    return SM.near_duplicates(documents(spark, sf), "text").select(F.col("id").alias("doc_id"), "canonical")


@Q.add("first_match_documents")
def first_match_documents(spark, sf):
    """The first kept text within eight bits, in doc_id order, instead of transitive components."""
    return SM.first_match_duplicates(documents(spark, sf), "text").select(F.col("id").alias("doc_id"), "canonical")


SHINGLE_SQL = """
toks AS (SELECT doc_id, source, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, source, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM toks WHERE len(w) > 0)),
sz AS (SELECT doc_id, source, count(*) AS n FROM sh GROUP BY 1, 2),
pr AS (SELECT x.source, x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM sh x JOIN sh y ON x.s = y.s AND x.source = y.source AND x.doc_id < y.doc_id GROUP BY 1, 2, 3),
jac AS (SELECT pr.*, i / (p.n + q.n - i)::DOUBLE AS j FROM pr JOIN sz p ON p.doc_id = a JOIN sz q ON q.doc_id = b)"""


@Q.add("text_clusters", f"""WITH RECURSIVE {SHINGLE_SQL},
e AS (SELECT a, b FROM jac WHERE j >= 0.4), {CLOSURE}
SELECT doc_id, source, least(doc_id, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id)) AS cluster_id FROM documents""")
def text_clusters(spark, sf):
    c = SM.text_clusters(documents(spark, sf), "text", 0.4, 3, ["source"])
    return c.select(F.col("id").alias("doc_id"), "source", "cluster_id")


@Q.add("similarity_histogram", f"""WITH {SHINGLE_SQL},
h AS (SELECT source, max(j) AS mx, {', '.join(f'count(*) FILTER (WHERE least(floor(j * 10), 9) = {i}) AS b{i}' for i in range(1, 10))} FROM jac GROUP BY 1)
SELECT source, rows, textful, pairs, round(coalesce(mx, 0), 10) AS max_jaccard, {', '.join(f'coalesce(b{i}, 0) AS b{i}' for i in range(1, 10))},
       pairs - ({' + '.join(f'coalesce(b{i}, 0)' for i in range(1, 10))}) AS b0
FROM (SELECT source, rows, textful, textful * (textful - 1) // 2 AS pairs FROM (SELECT source, count(*) AS rows, count(*) FILTER (WHERE len(w) > 0) AS textful FROM toks GROUP BY 1))
LEFT JOIN h USING (source)""")
def similarity_histogram(spark, sf):
    return SM.similarity_bands(documents(spark, sf), "text", ["source"]).withColumn("max_jaccard", rounded(F.col("max_jaccard")))


def titles(spark, sf):
    """First twelve words as title; a third of the rows share a URL with a neighbour."""
    d = F.col("id")
    return documents(spark, sf).select(
        "id", F.col("lang").alias("pool"), F.array_join(F.slice(F.split(F.trim(F.col("text")), "\\s+"), 1, 12), " ").alias("title"),
        F.when(d % 7 != 0, F.concat(F.lit("https://x.example/"), F.floor(d / 3).cast("string"), F.when(d % 3 == 2, "/b").otherwise("/a"))).alias("url"),
        ((d * 13) % 7).cast("int").alias("priority"))


@Q.add("syndicated_titles")
def syndicated_titles(spark, sf):
    rows = titles(spark, sf)
    return SM.kept_titles(rows, SM.dedupe_titles(rows, ["pool"], "title", "url", "priority"), "priority")


@Q.add("event_key_clusters", with_views("pools pool_rows", """
SELECT pool_id, sum(c)::BIGINT AS rows, sum(kd)::BIGINT AS keyed, count(*) AS clusters, coalesce(sum(c) FILTER (WHERE c > 1), 0)::BIGINT AS echoed_rows, max(c) AS largest
FROM (SELECT pool_id, coalesce(event_key, '#' || row_ix) AS k, count(*) AS c, count(event_key) AS kd FROM keyed GROUP BY 1, 2) GROUP BY 1""", EVIDENCE_SQL))
def event_key_clusters(spark, sf):
    return SM.event_key_stats(evidence(spark, sf), ["pool_id"], "event_key")


@Q.add("antecedent_matches", r"""
WITH s AS (SELECT item_id, list_distinct(list_transform(range(1, greatest(len(w), 2)), lambda i: array_to_string(w[i:i + 1], ' '))) AS g
           FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark)),
q AS (SELECT g AS qg FROM s WHERE item_id = 0)
SELECT item_id, round(coalesce(len(list_intersect(g, qg)) / nullif(len(g) + len(qg) - len(list_intersect(g, qg)), 0)::DOUBLE, 0), 10) AS jaccard FROM s, q""")
def antecedent_matches(spark, sf):
    from presage.operators.articles import antecedent_similarity

    b = table(spark, sf, "benchmark")
    q = b.filter("item_id = 0").select(F.col("text").alias("query"))
    return b.crossJoin(F.broadcast(q)).select("item_id", rounded(antecedent_similarity(F.col("text"), F.col("query"))).alias("jaccard"))
