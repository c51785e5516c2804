"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
PLAIN = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return (text or "").encode().lower()


def exact(rows):
    """(doc_id, text) rows -> (doc_id, keep_id, group_size, kept, sha)"""
    groups = defaultdict(list)
    for d, t in rows:
        groups[lower(t)].append(d)
    out = []
    for d, t in rows:
        ids = groups[lower(t)]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((d, keep, len(ids), d == keep, hashlib.sha256(lower(t)).hexdigest()))
    return out


def tokens(texts):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [e.ids + [2] for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check_pieces(rows, pieces, context=4096):
    """rows (doc_id, text) with distinct ids; pieces as dicts with ids_crc32. Returns the share of padding if all were padded to context."""
    ids = dict(zip([d for d, _ in rows], tokens([t for _, t in rows])))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_seq[p["sequence_id"]].append(p)
    assert set(by_doc) == set(ids)
    for d, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids[d])
            part = ids[d][at:at + p["length"]]
            assert p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            at += p["length"]
        assert at == len(ids[d])
    padded = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= context
        padded += 0 if at & (at - 1) == 0 else context - at
    return padded, len(by_seq)


def simhash(text):
    words = WORD.findall(lower(text))
    if not words:
        return 0
    runs = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashed = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def linked(ids, prints, distance=2):
    """Smallest id reachable, by position."""
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    x = np.array(prints, np.uint64)
    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1:] ^ x[i]) <= distance) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    best = {}
    for i, d in enumerate(ids):
        r = find(i)
        best[r] = d if best.get(r) is None else best[r] if d is None else min(best[r], d)
    return [best[find(i)] for i in range(len(ids))]


def contaminated(rows, items, window=10):
    """(doc_id, n_words, n_hit, n_items, sha, flag) per row."""
    runs = defaultdict(set)
    for item, t in items:
        w = PLAIN.findall(lower(t))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            runs[tuple(w[i:i + window])].add(str(item))
    sizes = sorted({len(r) for r in runs})
    out = []
    for d, t in rows:
        w = PLAIN.findall(lower(t))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                got = runs.get(tuple(w[i:i + n]))
                if got:
                    hit.update(range(i, i + n))
                    found |= got
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def substrings(rows, window=50):
    """(doc_id, n_words, n_removed, sha of the kept words) per row."""
    first = {}
    split = [(d, WORD.findall((t or "").encode())) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - window + 1):
            k = tuple(w[i:i + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < d:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
