"""MaxScore against all inner products."""

import math

import numpy as np
import pytest

from presage.llm import maxscore


def plain(rows, k):
    """(query vec_id, rank, vec_id, score) of (vec_id, embedding) rows; every row whose id is divisible by 50 asks."""
    left = [(i, v, [math.floor(256.0 * x) for x in e]) for i, (v, e) in enumerate(rows) if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, v, q in left:
        if v is not None and v % 50 == 0:
            found = sorted(((-sum(a * b for a, b in zip(q, w)), n is None, n or 0) for j, n, w in left if j != i))[:k]
            out += [(v, r + 1, None if none else n, max(-(1 << 63), min((1 << 63) - 1, -s))) for r, (s, none, n) in enumerate(found)]
    return sorted(out, key=repr)


def found(spark, rows, k):
    table = spark.createDataFrame([(v, e, 1, 2) for v, e in rows], "vec_id long, embedding array<double>, score int, shard int").repartition(3)
    index = maxscore.indexed(table)
    got = maxscore.top_k(index, index.filter("vec_id % 50 = 0"), k).select("query_id", "rank", "vec_id", "score")
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, list(map(float, rng.normal(size=6)))) for i in range(160)]
    rows += [(7, [1.0, 2.0, 0.0, 0.0, 0.0, 0.0])] * 4 + [(50, [1.0] * 6), (50, [1.0] * 6), (None, [9.0] * 6), (None, [9.0] * 6)]
    rows += [(900, None), (901, [1.0, None]), (950, [float("nan")] * 6), (951, [float("inf")] * 6), (952, []), (1000, []), (1050, [0.0] * 6), (1100, [-3.0] * 6), (1101, [2.0] * 9), (1150, [2.0, -1.0])]
    assert found(spark, rows, 5) == plain(rows, 5)
    assert found(spark, rows[:3], 5) == plain(rows[:3], 5)
    assert found(spark, [], 5) == [] == found(spark, [(0, [1.0])], 5)


def test_huge_values_stay_exact(spark):
    rows = [(0, [1e13, 3e12, -1.0]), (1, [1e13, 3e12, 1.0]), (2, [1e13, 3e12, 1.004]), (3, [-1e13, 1.0, 0.0]), (50, [1.0, 1.0, 1.0]), (4, [2e13, 0.0, 0.5])]
    assert found(spark, rows, 3) == plain(rows, 3)


@pytest.mark.parametrize("spread", [0.0, 0.3, 3.0])
def test_shard_skips_and_stays_right(monkeypatch, spread):
    """Clustered, loose and sparse vectors, blocks of every kind."""
    monkeypatch.setattr(maxscore, "FIRST_BLOCK", 16)
    monkeypatch.setattr(maxscore, "BLOCK", 50)
    rng = np.random.default_rng(int(10 * spread))
    base = rng.integers(-90, 90, (4, 24))
    values = base[rng.integers(0, 4, 600)] + (rng.normal(size=(600, 24)) * 30 * spread).astype(np.int64)
    if spread == 3.0:
        values[rng.random(values.shape) < 0.8] = 0
    rows, names, unnamed = rng.permutation(600), rng.integers(0, 300, 600), rng.random(600) < 0.05
    shard = maxscore.Shard(rows, names, unnamed, values)
    for row in range(0, 600, 7):
        q = values[np.flatnonzero(rows == row)[0]]
        other = rows != row
        want = sorted(zip((-(values[other] @ q)).tolist(), unnamed[other].tolist(), np.where(unnamed, 0, names)[other].tolist()))[:5]
        got = shard.search(q, row, 5)
        assert [(-s, v is None, v or 0) for s, v in got] == want


def test_only_essential_postings_are_read():
    """One strong dimension decides; the weak ones' postings are left alone once the bar is high."""
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.integers(200, 256, (5000, 1)), rng.integers(0, 3, (5000, 40))], axis=1)
    shard = maxscore.Shard(np.arange(5000), np.arange(5000), np.zeros(5000, bool), values)
    read = []

    class Watched(dict):
        def get(self, key):
            docs, impact, cuts, most = super().get(key)
            return Spy(docs, key), impact, cuts, most

    class Spy:
        def __init__(self, docs, key):
            self.docs, self.key = docs, key

        def __getitem__(self, x):
            read.append(self.key)
            return self.docs[x]

    shard.postings = Watched(shard.postings)
    query = np.concatenate([[100], np.ones(40, np.int64)])
    want = sorted(zip((-(values @ query)).tolist(), range(5000)))[:5]
    assert [(-s, v) for s, v in shard.search(query, -1, 5)] == want
    weak = [k for k in read if k[0] > 0]
    assert len(weak) <= 40 < 40 * (len(shard.blocks) - 1), "only the first block reads every term"
