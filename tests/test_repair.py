"""Lenient reading against plain Python on records damaged at random."""

import json
import random

from presage.operators import repair as R


def reparsed(v):
    if isinstance(v, str):
        try:
            inner = json.loads(v)
        except ValueError:
            return v
        return inner if isinstance(inner, dict) else v
    return v


def unwrapped(v):
    return v["properties"] if isinstance(v, dict) and v.keys() == {"properties"} and isinstance(v["properties"], dict) else v


def word(v, name):
    good = isinstance(v, str) and v in R.ALLOWED[name]
    return (v if good else None), v is not None and not good


def number(v):
    if isinstance(v, (dict, list)) or v is None:
        return None, v is not None
    try:
        return float(v), False
    except ValueError:
        return None, True


def read(raw):
    """Rows (pos, stance, tone, level, faults) of one record."""
    try:
        rec = json.loads(raw) if raw is not None else None
    except ValueError:
        rec = None
    rec = unwrapped(reparsed(rec))
    if not isinstance(rec, dict):
        return [(None, None, None, None, ("record",))]
    view = ["consensus_view"] if word(rec.get("consensus_view"), "consensus_view")[1] else []
    if not isinstance(rec.get("predictions"), list):
        return [(None, None, None, None, ("predictions", *view))]
    rows = []
    for pos, p in enumerate(rec["predictions"]):
        p = unwrapped(reparsed(p))
        if not isinstance(p, dict):
            rows.append((pos, None, None, None, ("prediction", *view)))
            continue
        stance, bad_stance = number(p.get("stance"))
        tone, bad_tone = word(p.get("tone"), "tone")
        c = reparsed(p.get("reader_confidence"))
        level = trap = None
        bad = c is not None
        if isinstance(c, dict):
            level, wrong = word(c.get("level"), "level")
            trap, trapped = word(c.get("trap"), "trap")
            bad = level is None or wrong or trapped
        faults = view + ["stance"] * bad_stance + ["tone"] * bad_tone + ["reader_confidence"] * bad
        rows.append((pos, stance, tone, None if bad else level, tuple(faults)))
    return rows


def made(n, seed):
    rng = random.Random(seed)
    out = [None, "", "null", "[]", "{}", '"x"', '{"predictions": []}', '{"predictions": [null, 1, "two", []]}', '{"predictions": {"0": {}}}', '{"properties": {"predictions": [{}]}, "more": 1}',
           json.dumps(json.dumps({"predictions": [{"stance": 1}]})), '{"properties": 5}', '{"predictions": [{"properties": {"properties": {"stance": 1}}}]}']
    maybe = lambda x: json.dumps(x) if rng.random() < 0.3 else x
    wrap = lambda x: {"properties": x} if rng.random() < 0.3 else x
    for _ in range(n):
        ps = []
        for _ in range(rng.randrange(4)):
            c = rng.choice([None, "high", {"level": "high"}, {"level": "low", "trap": "negation"}, {"level": 3}, {"trap": "negation"}, {"level": "low", "trap": "x"}, [1]])
            p = {"stance": rng.choice([None, 0.5, "0.25", "much", [1], {"a": 1}, -1]), "tone": rng.choice([None, "alarm", "loud", ["alarm"], 2]), "reader_confidence": maybe(c) if isinstance(c, dict) else c}
            ps.append(maybe(wrap({k: v for k, v in p.items() if rng.random() < 0.9})))
        text = json.dumps(wrap({"predictions": ps, "consensus_view": rng.choice(["divided", "odd", None])}))
        out.append(text[:rng.randrange(len(text))] if rng.random() < 0.1 else text)
    return out


def test_repaired_predictions(spark):
    raws = made(300, 7)
    df = spark.createDataFrame(list(enumerate(raws)), "id long, raw string")
    got = sorted(((r["id"], r["pos"], r["stance"], r["tone"], r["reader_confidence"] and r["reader_confidence"]["level"], tuple(r["faults"]))
                  for r in R.repaired_predictions(df, "id", "raw", numbers=("stance",), words=("tone",)).collect()), key=str)
    want = sorted(((i, *row) for i, raw in enumerate(raws) for row in read(raw)), key=str)
    assert got == want


def test_no_records(spark):
    assert R.repaired_predictions(spark.createDataFrame([], "id long, raw string"), "id", "raw").count() == 0


def test_text_is_parsed_once_per_level(spark):
    """Record, text in the record, in the prediction and in the nested object: each is parsed at one place of the plan, not once per field."""
    rows = spark.range(3).selectExpr("id", "concat('{\"predictions\":[{\"stance\":', id, '}]}') AS raw")
    plan = R.repaired_predictions(rows, "id", "raw")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("parsejson") == 4
