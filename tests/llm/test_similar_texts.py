"""Near copies by five-word shingles against all pairs in plain Python."""

from collections import Counter, defaultdict

import brute

import corpus_pipeline
from presage.llm import exact_dedup, similar_texts
from presage.session import table

SF = "/root/testdata/sf0.001"


def shingles(text, size=5):
    words = brute.WORD.findall(brute.lower(text))
    return {b" ".join(words[i:i + size]) for i in range(len(words) - size + 1)} or ({b" ".join(words)} if words else set())


def grouped(rows):
    """doc_id -> smallest doc_id reachable over pairs of Jaccard 0.8 or more; texts without words are one group."""
    sets, met, root = [shingles(t) for _, t in rows], defaultdict(list), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        common = Counter(j for g in s or {b""} for j in met[g])
        for j, n in common.items():
            if not s or 10 * n >= 8 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for g in s or {b""}:
            met[g].append(i)
    return {d: rows[find(i)][0] for i, (d, _) in enumerate(rows)}


def found(spark, rows):
    got = similar_texts.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return {r["doc_id"]: r["component_id"] for r in got}


def test_stage_drops_near_copies(spark):
    """Pairs at 0.8 differ in more than two bits of a three-word fingerprint, so op2's rule keeps both copies."""
    docs = exact_dedup.survivors(table(spark, SF, "documents"), exact_dedup.open_fresh(spark))
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    want = grouped(rows)
    assert sum(d != c for d, c in want.items()) == 2
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()) == sorted(set(want.values()))


def test_odd_rows(spark):
    base = [f"w{i}" for i in range(45)]
    cut = lambda n: " ".join(base[:n])
    # 41, 33 and 32 shingles: 33/41 is over 0.8, 32/41 is not
    rows = [(9, cut(45)), (8, cut(37).upper()), (7, cut(36).replace("w0 ", "v0 ")), (6, ""), (5, None), (4, " \n"), (3, "a b"), (2, "A  B"), (1, "b a"), (0, "ü b")]
    assert found(spark, rows) == grouped(sorted(rows, key=lambda r: r[0]))


def test_crowd_of_unequal_copies(spark):
    """Each copy has other words replaced; chains and several components share buckets."""
    import random

    dice = random.Random(7)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(w if dice.random() > 0.001 * (i % 40) else f"x{dice.random()}" for w in base)) for i in range(300)]
    want = grouped(rows)
    assert 5 < len(set(want.values())) < 250
    assert found(spark, rows) == want


def test_texts_around_one_passage(spark, monkeypatch):
    """Most of every text is one passage; only few are near copies, and only these are compared."""
    import random

    dice = random.Random(5)
    base = [f"w{i}" for i in range(110)]
    rows = [(i, " ".join(base + [f"x{dice.random()}" for _ in range(dice.randint(8, 60))])) for i in range(400)]
    compared, alike = [], similar_texts.alike
    monkeypatch.setattr(similar_texts, "alike", lambda pairs, sets, threshold: compared.append(pairs.count()) or alike(pairs, sets, threshold))
    want = grouped(rows)
    assert 50 < len(set(want.values())) < 390
    assert found(spark, rows) == want
    assert compared[1] < 400 * 399 / 2 / 8


def test_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = spark.createDataFrame([(None, text), (4, text + " end"), (None, "only nulls here"), (None, "only  nulls here")], "doc_id long, text string")
    got = Counter((r["doc_id"], r["component_id"]) for r in similar_texts.near_duplicates(rows).collect())
    assert got == {(None, 4): 1, (4, 4): 1, (None, None): 2}


def test_linked_fingerprints_propose(spark, monkeypatch):
    """SimHash links alone find copies that no band brings together, and the whole sets decide on them."""
    import numpy as np

    from presage.llm import simhash

    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(base[:400 - i])) for i in range(4)] + [(9, " ".join(f"v{i}" for i in range(300)))]
    monkeypatch.setattr(similar_texts, "sketches", lambda docs, size, plain=similar_texts.sketches: plain(docs, size).withColumn("bands", similar_texts.F.array(similar_texts.F.col("set_key"))))
    prints = [np.frombuffer(simhash.fingerprint_bytes(t.encode(), 3), ">u8")[0] for _, t in rows]
    near = {d for (d, _), p in zip(rows, prints) if int(p ^ prints[0]).bit_count() <= 2}
    got = found(spark, rows)
    assert len(near) > 1 and all(got[d] == 0 for d in near) and got[9] == 9


def test_all_linked_fingerprints_propose(spark, monkeypatch):
    """A crowd whose only like texts are neither the least nor the greatest linked fingerprint of each other."""
    from presage.llm import simhash

    lists = [[f"{c}{i}" for i in range(60)] for c in "uvwx"]
    texts = {" ".join(lists[0]): 0, " ".join(lists[1]): 4, " ".join([*lists[1], "end"]): 5, " ".join(lists[2]): 7}
    rows = list(enumerate(texts))
    code = similar_texts.F.create_map(*[similar_texts.F.lit(x) for t, p in texts.items() for x in (t, p)])

    def chosen(docs, shingle=3, id_col="doc_id", text_col="text"):
        text = similar_texts.F.col(text_col)
        return docs.select(similar_texts.F.col(id_col).alias("doc_id"), similar_texts.F.xxhash64(text).alias("text_key"), code[text].cast("long").alias("fingerprint"))

    monkeypatch.setattr(simhash, "fingerprints", chosen)
    monkeypatch.setattr(similar_texts, "sketches", lambda docs, size, plain=similar_texts.sketches: plain(docs, size).withColumn("bands", similar_texts.F.array(similar_texts.F.col("set_key"))))
    assert found(spark, rows) == grouped(rows) == {0: 0, 1: 1, 2: 1, 3: 3}
