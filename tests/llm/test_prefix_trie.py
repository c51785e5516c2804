"""Prefix trie against dictionaries of prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from presage.llm import prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversations(rows):
    """conv_id -> turns (role, text) in order; equal turn numbers by digest."""
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        found[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), (role, text)))
    return {c: [t[3] for t in sorted(ts, key=lambda t: t[:3])] for c, ts in found.items()}


def shared(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4 if c is not None else 0
        base = convs.get(c - c % 20, []) if c is not None else []
        out[c] = base[:h] + turns[h:]
    return out


def plain(convs):
    """Sorted rows of COLUMNS."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(WORD.findall(p[-1][1])) if p else 0
    least = {p: min((c for c in m if c is not None), default=None) for p, m in members.items()}
    sha = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(x for x in ends[p] if x is not None)).encode()).hexdigest()
    return sorted(((least[p], len(p), least[p[:-1]] if p else None, len(m), kids[p], leaves[p], saved[p], sha(p)) for p, m in members.items()), key=repr)


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def made(n, seed):
    dice = random.Random(seed)
    pool = ["be kind", "a b c", "x", "", None, "long  text\twith words", "é ü"]
    rows = []
    for c in range(n):
        depth = dice.choice([1, 1, 2, 3, 5, 8])
        turns = [("system", "be kind")] if dice.random() < 0.4 else []
        turns += [(dice.choice(["user", "assistant", None]), dice.choice(pool)) for _ in range(depth)]
        rows += [(c * 3, i if i or dice.random() < 0.5 else None, r, t) for i, (r, t) in enumerate(turns)]
    return rows


@pytest.mark.parametrize("cells, fan, parts", [(1 << 20, 64, 3), (60, 2, 9), (12, 3, 5)])
def test_trie(spark, cells, fan, parts):
    rows = made(150, parts)
    rows += [(10_000 + i, j, "user", "same") for i in range(200) for j in range(2)]  # a path with a third of all
    rows += [(20_000, i, "user", f"turn {i}") for i in range(90)] + [(20_001, i, "user", f"turn {i}") for i in range(60)]
    rows += [(None, 0, "user", "lone"), (None, 1, None, None), (5, 1, "user", "tie"), (5, 1, "user", "also"), (5, 1, "user", "tie")]
    table = spark.createDataFrame([(*r, 1, "d") for r in rows], "conv_id long, turn long, role string, text string, depth int, digest string").repartition(parts)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        lists = prefix_trie.turn_lists(table)
        assert rows_of(prefix_trie.trie(lists, cells, fan)) == plain(conversations(rows))
        assert rows_of(prefix_trie.trie(prefix_trie.with_shared_heads(lists), cells, fan)) == plain(shared(conversations(rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_turnless_and_empty(spark):
    lists = spark.createDataFrame([(4, []), (2, []), (7, [("0" * 32, 3)])], "conv_id long, turns array<struct<digest:string,words:int>>")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert rows_of(prefix_trie.trie(lists)) == sorted([(2, 0, None, 3, 1, 1, 0, sha("2,4")), (7, 1, 2, 1, 0, 1, 0, sha("7"))], key=repr)
    assert rows_of(prefix_trie.trie(lists.filter("conv_id < 5"))) == [(2, 0, None, 2, 0, 1, 0, sha("2,4"))]
    assert rows_of(prefix_trie.trie(lists.limit(0))) == []


def test_heads(spark):
    """Too few head turns, no head conversation, own turns fewer than the head's."""
    rows = [(0, i, "u", f"a{i}") for i in range(2)] + [(c, i, "u", f"{c}-{i}") for c in (1, 2, 3, 5, 41, 42) for i in range(c % 4 + 1)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = prefix_trie.with_shared_heads(prefix_trie.turn_lists(table)).select("conv_id", F.size("turns").alias("n")).collect()
    assert {r["conv_id"]: r["n"] for r in got} == {c: len(t) for c, t in shared(conversations(rows)).items()}
