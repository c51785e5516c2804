"""Parallel forms of sequential algorithms against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from presage.operators import audit as AU, models as M, skew

SF = "/root/testdata/sf0.001"


def paired(shadows, verdicts, seconds=120):
    """(shadow, verdict) ids: each shadow line (question, id, t) in order takes the nearest free verdict."""
    out, free = set(), dict.fromkeys(sorted(verdicts, key=lambda v: (v[2], v[1])))
    for q, i, t in sorted(shadows, key=lambda s: (s[2], s[1])):
        best = min((v for v in free if v[0] == q and abs(v[2] - t) <= seconds), key=lambda v: (abs(v[2] - t), v[2], v[1]), default=None)
        if best:
            del free[best]
        out.add((i, best and best[1]))
    return out | {(None, v[1]) for v in free}


def lines(n, seed, rate, questions):
    dice = random.Random(seed)
    return [(dice.choice(questions), seed * 100_000 + i, int(dice.random() * n / rate)) for i in range(n)]


@pytest.mark.parametrize("shadows, verdicts", [
    (lines(700, 1, 1.0, "q"), lines(700, 2, 1.0, "q")),  # one question that logs every second
    (lines(600, 3, 0.02, "pq"), lines(500, 4, 0.02, "pq")),
    (lines(300, 5, 4.0, "pqr"), lines(60, 6, 1.0, "pqr")),  # many want few
    ([("q", i, i) for i in range(900)], [("q", 5000 + i, i) for i in range(900)]),
    ([("q", i, 0) for i in range(40)], [("q", 5000 + i, i) for i in range(30)]),
    ([], [("q", 1, 1)]), ([("q", 1, 1)], []),
])
def test_pairs_equal_taking_turns(spark, shadows, verdicts):
    table = lambda rows: spark.createDataFrame(rows, "question string, id long, t long")
    got = AU.pair_nearest(table(shadows), table(verdicts)).collect()
    assert len(got) == len({(r.shadow_id, r.verdict_id) for r in got})
    assert {(r.shadow_id, r.verdict_id) for r in got} == paired(shadows, verdicts)


def test_log_pairs_query(spark):
    """The registered query on its table, and the agreement counted from it."""
    from presage.plans import operations

    lg = operations._paired(spark, SF)[0].collect()
    side = lambda e: [(r.question, r.id, r.t) for r in lg if r.event == e]
    want = paired(side("settlement_gates"), side("settlement_verifier"))
    got = entry.queries()["log_pairs"](spark, SF).collect()
    assert {(r.shadow_id, r.verdict_id) for r in got} == want and len(want) > 100
    blocks = {r.id: r.block for r in lg}
    both = [(blocks.get(a), blocks.get(b)) for a, b in want]
    counts = entry.queries()["gate_agreement"](spark, SF).first()
    assert tuple(counts) == (both.count((True, True)), both.count((True, False)), both.count((False, True)), both.count((False, False)),
                             sum(b is None for _, b in both), sum(a is None for a, _ in both))


def rising(rows):
    """p -> fitted value by pooling adjacent violators one after the other."""
    merged = {}
    for p, y in rows:
        h, n = merged.get(p, (0, 0))
        merged[p] = h + y, n + 1
    stack = []
    for p in sorted(merged):
        stack.append([[p], *merged[p]])
        while len(stack) > 1 and stack[-2][1] * stack[-1][2] >= stack[-1][1] * stack[-2][2]:
            ps, h, n = stack.pop()
            stack[-1] = [stack[-1][0] + ps, stack[-1][1] + h, stack[-1][2] + n]
    return {p: h / n for ps, h, n in stack for p in ps}


@pytest.mark.parametrize("n, kind, fan", [(4000, "noisy", 2), (3000, "falling", 3), (3000, "rising", 2), (500, "ties", 32), (1, "noisy", 2), (0, "noisy", 2)])
def test_isotonic_equals_sequential_pooling(spark, monkeypatch, n, kind, fan):
    monkeypatch.setattr(M, "FAN", fan)
    dice = random.Random(n)
    chance = {"noisy": lambda p: p, "falling": lambda p: 1 - p, "rising": lambda p: float(p > 0.5), "ties": lambda p: 0.5}[kind]
    rows = [(i, round(dice.random(), 1 if kind == "ties" else 9)) for i in range(n)]
    rows = [(i, p, dice.random() < chance(p)) for i, p in rows]
    odd = [(-1, None, True), (-2, 0.5, None)]
    table = spark.createDataFrame(rows + odd, "i long, p double, y boolean").repartition(4)
    got = {r.i: r.calibrated for r in M.isotonic(table, "p", "y").collect()}
    want = rising([(p, int(y)) for _, p, y in rows])
    assert len(got) == n + 2 and got[-1] is None and got[-2] is None
    assert all(got[i] == pytest.approx(want[p], abs=1e-12) for i, p, _ in rows)


def test_isotonic_query(spark):
    got = entry.queries()["isotonic_calibration"](spark, SF).collect()
    want = rising([(r.p, int(r.outcome)) for r in got])
    assert len(got) > 10 and all(r.calibrated == pytest.approx(want[r.p], abs=1e-9) for r in got)


def test_quantiles_behind_a_far_value(spark, monkeypatch):
    """One far value does not put the rest of its group into one cell, and cells are cut until they are small."""
    monkeypatch.setattr(skew, "CELL_VALUES", 50)
    sizes, cut = [], skew.cut_lineage

    def watched(df):
        out = cut(df)
        if any(c.startswith("_cell") for c in out.columns) and "_v" in out.columns and "_left" not in out.columns:
            sizes.append((len([c for c in out.columns if c.startswith("_cell")]), out.groupBy("k", *[c for c in out.columns if c.startswith("_cell")]).count().agg(F.max("count")).first()[0]))
        return out

    monkeypatch.setattr(skew, "cut_lineage", watched)
    dice = random.Random(9)
    values = {0: [dice.gauss(0, 1) for _ in range(20_000)] + [1e12], 1: [float(i % 7) for i in range(500)], 2: [3.0]}
    rows = spark.createDataFrame([(k, v, w % 5 / 4) for k, vs in values.items() for w, v in enumerate(vs)], "k int, v double, w double")
    probs = [0.0, 0.1, 0.5, 0.999, 1.0]
    got = {(r.k, r.prob): (r.q, r.n) for r in skew.exact_quantiles(rows, ["k"], "v", probs).collect()}
    for k, vs in values.items():
        vs = sorted(vs)
        for p in probs:
            pos = p * (len(vs) - 1)
            low = int(pos)
            assert got[k, p] == (pytest.approx(vs[low] + (vs[min(low + 1, len(vs) - 1)] - vs[low]) * (pos - low)), len(vs))
    assert sizes[0][1] <= 20_001 / 100
    medians = {r.k: r.median for r in skew.weighted_medians(rows, ["k"], "v", "w").collect()}
    for k, vs in values.items():
        weighted = sorted((v, w % 5 / 4) for w, v in enumerate(vs))
        half, run = sum(w for _, w in weighted) / 2, 0.0
        if half:
            for v, w in weighted:
                run += w
                if run + 1e-12 >= half:
                    break
            assert medians[k] == v
        else:
            assert medians[k] == 3.0


@pytest.mark.parametrize("shadows, verdicts", [(lines(4000, 7, 0.2, "q"), lines(4000, 8, 0.2, "q")), (lines(3000, 9, 0.1, "qr"), lines(2000, 10, 0.1, "qr"))])
def test_pairs_across_blocks(spark, monkeypatch, shadows, verdicts):
    """Several blocks a question, whose ends hand on what they took."""
    monkeypatch.setattr(AU, "BLOCK_ROWS", 1)
    table = lambda rows: spark.createDataFrame(rows, "question string, id long, t long")
    assert {(r.shadow_id, r.verdict_id) for r in AU.pair_nearest(table(shadows), table(verdicts)).collect()} == paired(shadows, verdicts)


def test_dense_log_makes_no_pairs_of_all_lines(spark, monkeypatch):
    """Two thousand lines of each side within one window: no step holds more rows than a few times the lines."""
    seen, fork = [], AU.fork

    def watched(rows):
        out = fork(rows)
        seen.append(out.count())
        return out

    monkeypatch.setattr(AU, "fork", watched)
    shadows, verdicts = lines(2000, 11, 40.0, "q"), lines(2000, 12, 40.0, "q")
    table = lambda rows: spark.createDataFrame(rows, "question string, id long, t long")
    assert {(r.shadow_id, r.verdict_id) for r in AU.pair_nearest(table(shadows), table(verdicts)).collect()} == paired(shadows, verdicts)
    assert max(seen) <= 4 * 4000
