"""Clusters of dependent rows against union-find in plain Python, hot groups and missing parts included."""

import random
import re

import pytest
from pyspark.sql import functions as F

from presage.functions import text as X
from presage.operators import dependence as D

WORDS = "rates rose again after the vote while talks stalled near the border on monday".split()


def shingles(text):
    w = re.findall("[a-z0-9]+", (text or "").lower())
    return {tuple(w[i:i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def alike(a, b):
    x, y = shingles(a), shingles(b)
    return bool(x and y) and len(x & y) / len(x | y) >= 0.4


def joined(rows, linked):
    """Smallest row_ix of each row's component."""
    head = {r[0]: r[0] for r in rows}

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i, a in enumerate(rows):
        for b in rows[i + 1:]:
            if linked(a, b):
                x, y = find(a[0]), find(b[0])
                head[max(x, y)] = min(x, y)
    return {i: find(i) for i in head}


def made(n, seed):
    """row_ix, pool_id, event, voice, text; a third of all rows share one event and voice of pool 0."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = rng.random() < 0.33
        at, k = rng.randrange(len(WORDS) - 4), rng.randrange(4, 9)
        text = None if rng.random() < 0.1 else rng.choice(["", " ".join(WORDS[at:at + k]), " ".join(rng.sample(WORDS, k)), " ".join(rng.sample(WORDS, k))])
        rows.append((i, 0 if hot else rng.randrange(3), "e0" if hot else rng.choice(["e0", "e1", "e2", None]), "v0" if hot and rng.random() < 0.5 else rng.choice(["v1", "v2", None, None, None]), text))
    return rows


SCHEMA = "row_ix long, pool_id long, event string, voice string, text string"


@pytest.mark.parametrize("hot", [False, True])
def test_report_clusters(spark, hot, request):
    if hot:
        request.getfixturevalue("big_input")
    rows = made(160, 3)
    got = {r["row_ix"]: r["report_id"] for r in D.report_clusters(spark.createDataFrame(rows, SCHEMA), ["pool_id"], "event", "voice", "text").collect()}
    want = joined(rows, lambda a, b: a[1] == b[1] and a[2] is not None and a[2] == b[2] and ((a[3] is not None and a[3] == b[3]) or alike(a[4], b[4])))
    assert got == want
    assert len(set(want.values())) < len(want)


def test_text_clusters_of_a_pool(spark):
    rows = made(160, 4)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("cluster_id", F.lit(-1))
    got = {r["row_ix"]: r["cluster_id"] for r in D.with_text_clusters(df, ["pool_id"], "text").collect()}
    assert got == joined(rows, lambda a, b: a[1] == b[1] and alike(a[4], b[4]))


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert D.report_clusters(none, ["pool_id"], "event", "voice", "text").count() == 0
    assert D.with_text_clusters(none, ["pool_id"], "text").count() == 0


def test_shift_needs_two_rows_and_two_groups(spark):
    rows = [(0, 0, 0.8, 1.0, "a"), (1, 0, 0.2, 1.0, "a"), (2, 0, -0.5, 1.0, "b"), (3, 1, 0.5, 1.0, "a"), (4, 1, 0.1, 1.0, "a"), (5, 2, None, 1.0, None), (6, 2, 0.4, 1.0, None), (7, 3, 0.4, 0.0, "a"), (8, 3, 0.8, 0.0, "a"), (9, 3, -0.2, 0.0, None)]
    df = spark.createDataFrame(rows, "row_ix long, pool_id long, stance double, weight double, g string")
    got = {r["pool_id"]: r["d"] for r in D.collapsed_shift(df, ["pool_id"], "g", "d").collect()}
    from math import exp, log

    pooled = lambda xs: 1 / (1 + exp(-sum(log(p / (1 - p)) for p in xs) / len(xs)))
    p = lambda s: (s + 1) / 2
    assert set(got) == {0, 3}
    assert got[0] == pytest.approx(100 * (pooled([p(0.5), p(-0.5)]) - pooled([p(0.8), p(0.2), p(-0.5)])))
    assert got[3] == pytest.approx(100 * (pooled([p(0.6), p(-0.2)]) - pooled([p(0.4), p(0.8), p(-0.2)])))


def test_a_null_text_has_no_grams(spark):
    got = spark.sql("SELECT CAST(NULL AS STRING) AS t UNION ALL SELECT '' UNION ALL SELECT 'a b'").select(X.shingle_set(F.col("t")).alias("s")).collect()
    assert sorted(r["s"] for r in got) == [[], [], ["a b"]]


def test_weights_of_small_pools_are_not_written(spark, monkeypatch):
    from presage.operators import skew

    rows = spark.sql("SELECT id AS row_ix, id % 3 AS k, 0.5D AS credibility_weight, 1.0D AS evidence_weight, 0.8D AS relevance, date_add(DATE '2024-01-01', CAST(id % 11 AS INT)) AS published_date FROM range(30)")
    written, cut = [], skew.cut_lineage
    monkeypatch.setattr(skew, "cut_lineage", lambda df: written.append(1) or cut(df))
    weights = lambda whole: {r.row_ix: r.weight for r in D.study_weights(rows, ["k"], whole=whole).collect()}
    small = weights(True)
    assert not written and len(small) == 30
    assert weights(False) == small and written
