"""Repeated long spans by a sparse, compacted De Bruijn graph.

Every window of ``window`` words owns its smallest k-mer by hash; these k-mers
are the graph's edges, so two equal windows always share one and only about
one in twenty of all k-mers is moved. An edge whose occurrences agree on all
words of all windows they own does not branch: they are copies of each other
there. Edges that follow each other in every occurrence compact into paths by
a join, and a path's occurrences are told by the coordinates of its first
edge. Windows of branching edges are compared one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from presage.llm.common import by_bytes, coded, ranges, strings, words_of
from presage.session import cut_lineage

SLICE_BYTES = 4 << 20
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
READ = ["doc_id", "text_key", "start", "one", "two", "edge", "digest"]
EDGES = "edge long, content long, next_edge long, gap int, doc_id long, text_key long, place int, before int, until int"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hashes of any run of words of a slice, from sums of word hashes times powers of an odd number."""

    def __init__(self, codes: np.ndarray, distinct: list[bytes], which: int) -> None:
        from xxhash import xxh64_intdigest

        word = np.array([xxh64_intdigest(w, which + 1) for w in distinct] or [0], np.uint64)[codes] if len(codes) else np.zeros(0, np.uint64)
        power = np.full(len(codes) + 1, ODD[which], np.uint64)
        power[0] = 1
        power = np.cumprod(power, dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word * power[:-1], dtype=np.uint64)])
        self.undo = np.full(len(codes) + 1, pow(ODD[which], -1, 1 << 64), np.uint64)
        self.undo[0] = 1
        self.undo = np.cumprod(self.undo, dtype=np.uint64)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.undo[start] + (stop - start).astype(np.uint64))


def slice_hashes(column: pa.Array) -> tuple[pa.Array, np.ndarray, Hashes, Hashes]:
    words, counts = words_of(strings(column))
    codes, distinct = coded(words)
    distinct = distinct.cast(pa.binary()).to_pylist()
    return words, counts, Hashes(codes, distinct, 0), Hashes(codes, distinct, 1)


def leftmost_smallest(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest value in each run of ``width``."""
    value, at, have = x, np.arange(len(x)), 1
    while have < width:
        step = min(have, width - have)
        right = value[step:] < value[:-step]
        value = np.where(right, value[step:], value[:-step])
        at = np.where(right, at[step:], at[:-step])
        have += step
    return at


def edges_of(docs: DataFrame, window: int, k: int) -> DataFrame:
    """One row per owned k-mer occurrence: its hash, a hash of all words of the windows it owns, what follows, and where it is.

    ``before`` and ``until``: how far the first and last owned window start before it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text", SLICE_BYTES):
            _, counts, one, two = slice_hashes(b.column("text"))
            starts = np.cumsum(counts) - counts
            long = counts >= window
            first_of = starts[long]
            if not len(first_of):
                continue
            total = int(counts.sum())
            mers = one.of(np.arange(total - k + 1), np.arange(k, total + 1))
            place = leftmost_smallest(mers, window - k + 1)[ranges(first_of, counts[long] - window + 1)]
            own = ranges(first_of, counts[long] - window + 1)
            edge = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            last = np.append(edge[1:], len(place)) - 1
            place, first, last = place[edge], own[edge], own[last]
            doc = np.searchsorted(starts + counts, place, "right")
            content = mix(two.of(first, last + window) + ((place - first) * window + (last - first)).astype(np.uint64))
            follows = np.append(doc[1:] == doc[:-1], False)
            gap = np.where(follows, np.append(place[1:], 0) - place, 0)
            then = np.where(follows, np.append(mers[place][1:], np.uint64(0)), np.uint64(0))
            yield pa.RecordBatch.from_arrays([
                pa.array(mers[place].view(np.int64)), pa.array(content.view(np.int64)), pa.array(then.view(np.int64)), pa.array(gap.astype(np.int32)),
                b.column("doc_id").take(pa.array(doc)), b.column("text_key").take(pa.array(doc)), pa.array((place - starts[doc]).astype(np.int32)),
                pa.array((place - first).astype(np.int32)), pa.array((place - last).astype(np.int32))],
                ["edge", "content", "next_edge", "gap", "doc_id", "text_key", "place", "before", "until"])

    return docs.filter("doc_id is not null").mapInArrow(run, EDGES)


def paths_of(nodes: DataFrame, window: int) -> DataFrame:
    """Compacts non-branching edges: head edge, source document and text, the words a path's windows cover from the head's place on, and in the source.

    ``nodes``: edge, n (occurrences), source (smallest doc_id), source_key (its
    text), place (first there), before, until, next_edge, gap (null unless all
    occurrences agree).
    """
    after = nodes.select(F.col("edge").alias("edge2"), F.col("n").alias("n2"))
    held = nodes.filter("next_edge is not null").join(after, (F.col("next_edge") == F.col("edge2")) & (F.col("n") == F.col("n2")))
    inner = held.select(F.col("edge2").alias("edge"), F.lit(True).alias("inner"))
    marked = nodes.join(inner.hint("merge"), "edge", "left")
    in_source = Window.partitionBy("source", "source_key").orderBy("place")
    numbered = marked.withColumn("path", F.sum(F.when(F.col("inner"), 0).otherwise(1)).over(in_source))
    ends = numbered.groupBy("source", "source_key", "path").agg(
        F.min("place").alias("start"), F.max(F.when(F.col("inner").isNull(), F.col("edge"))).alias("edge"),
        F.max(F.when(F.col("inner").isNull(), F.col("before"))).alias("before"), F.max(F.col("place") - F.col("until")).alias("last"))
    return ends.select(
        "edge", "source", "source_key", (-F.col("before")).alias("from"), (F.col("last") - F.col("start") + window).alias("to"),
        (F.col("start") - F.col("before")).alias("first"), (F.col("last") + window).alias("last"))


def read_again(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """Digests of words at given places, of the words themselves, joined by one space.

    ``wanted``: doc_id, text_key, runs of (edge, first, last). Without an edge
    every window from start first to start last gives a row: doc_id, text_key,
    start, and two halves of 128 bits of SHA-256. With an edge the words first to
    last (exclusive) give one: edge and digest, their whole SHA-256.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text", SLICE_BYTES):
            words, counts = words_of(strings(b.column("text")))
            starts = np.cumsum(counts) - counts
            words = words.cast(pa.binary()).to_pylist()
            at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
            text = memoryview(b" ".join(words))
            del words
            digest = lambda i, j: hashlib.sha256(text[i:j - 1]).digest()
            runs = b.column("runs")
            owner = np.repeat(np.arange(len(counts)), np.diff(runs.offsets.to_numpy()))
            flat = runs.flatten()
            first, last = (flat.field(x).to_numpy().astype(np.int64) + starts[owner] for x in ("first", "last"))
            whole = flat.field("edge").is_valid().to_numpy(zero_copy_only=False)
            place = ranges(first[~whole], (last - first + 1)[~whole])
            doc = np.repeat(owner[~whole], (last - first + 1)[~whole])
            halves = np.frombuffer(b"".join([digest(i, j)[:16] for i, j in zip(at[place].tolist(), at[place + window].tolist())]), np.int64).reshape(-1, 2)
            none = lambda n, t: pa.nulls(n, t)
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id").take(pa.array(doc)), b.column("text_key").take(pa.array(doc)), pa.array((place - starts[doc]).astype(np.int32)),
                pa.array(halves[:, 0]), pa.array(halves[:, 1]), none(len(doc), pa.int64()), none(len(doc), pa.binary())], READ)
            own, n = owner[whole], int(whole.sum())
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id").take(pa.array(own)), b.column("text_key").take(pa.array(own)), none(n, pa.int32()), none(n, pa.int64()), none(n, pa.int64()),
                flat.field("edge").filter(pa.array(whole)), pa.array([digest(i, j) for i, j in zip(at[first[whole]].tolist(), at[last[whole]].tolist())], pa.binary())], READ)

    return docs.join(wanted.hint("merge"), ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "runs").mapInArrow(
        run, "doc_id long, text_key long, start int, one long, two long, edge long, digest binary")


def repeated_spans(docs: DataFrame, window: int, k: int) -> DataFrame:
    """doc_id, text_key, from, to, digest: word spans that windows also found in a smaller doc_id cover; spans may overlap.

    ``digest`` is the SHA-256 of the words at the source's coordinates; null where
    it has been compared already.
    """
    edges = cut_lineage(edges_of(docs, window, k))
    agreed = lambda c: F.when(F.min(c) == F.max(c), F.min(c))
    shared = edges.groupBy("edge").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("source"), F.max("doc_id").alias("other"), (F.min("content") != F.max("content")).alias("branches"),
        agreed("next_edge").alias("next_edge"), agreed("gap").alias("gap")).filter("source < other").drop("other")
    shared = cut_lineage(shared)
    occurs = cut_lineage(edges.select("edge", "doc_id", "text_key", "place", "before", "until").join(shared.select("edge", "source", "branches").hint("merge"), "edge"))
    first = F.min(F.struct("text_key", "place", "before", "until"))
    plain = occurs.filter("not branches and doc_id = source").groupBy("edge").agg(first.alias("at")).select(
        "edge", F.col("at.text_key").alias("source_key"), "at.place", "at.before", "at.until")
    nodes = cut_lineage(plain.join(shared.filter("not branches").select("edge", "n", "source", F.when(F.col("gap") > 0, F.col("next_edge")).alias("next_edge")), "edge"))
    heads = cut_lineage(paths_of(nodes, window))
    branching = occurs.filter("branches").select(
        "doc_id", "text_key", F.lit(None).cast("long").alias("edge"), (F.col("place") - F.col("before")).alias("first"), (F.col("place") - F.col("until")).alias("last"))
    sources = heads.select(F.col("source").alias("doc_id"), F.col("source_key").alias("text_key"), "edge", "first", "last")
    wanted = branching.unionByName(sources).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("edge", "first", "last")).alias("runs"))
    read = cut_lineage(read_again(docs, wanted, window))
    digests = read.filter("edge is not null").groupBy("edge").agg(F.min("digest").alias("digest"))
    sure = occurs.filter("not branches and doc_id > source").select("edge", "doc_id", "text_key", "place").join(
        heads.select("edge", "from", "to").join(digests.hint("merge"), "edge").hint("merge"), "edge").select(
        "doc_id", "text_key", (F.col("place") + F.col("from")).alias("from"), (F.col("place") + F.col("to")).alias("to"), "digest")
    single = read.filter("edge is null")
    firsts = cut_lineage(single.groupBy("one", "two").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("other")).filter("source < other").drop("other"))
    found = single.join(firsts.hint("merge"), ["one", "two"]).filter("doc_id > source").select(
        "doc_id", "text_key", F.col("start").alias("from"), (F.col("start") + window).alias("to"), F.lit(None).cast("binary").alias("digest"))
    return sure.unionByName(found)


def remove_repeats(docs: DataFrame, window: int = 50, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, spans (removed word spans, merged), kept_text (kept words joined by one space) of every row.

    A word goes if some window of ``window`` consecutive words over it also
    starts in a document with a smaller doc_id; judged on the input. Words are
    runs of anything but 0x20 and 0x09-0x0D, unchanged. Null text: no words.
    A row with a null doc_id takes no part and keeps all its words. Rows with
    one doc_id never remove each other's words. An empty table: no rows. A span
    whose words are not its source's (hashes that met by chance) is not removed.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"), text.alias("text"))
    spans = repeated_spans(rows, window, k).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct(F.col("from").cast("long").alias("start"), F.col("to").cast("long").alias("stop"), "digest")).alias("found"))
    named = spans.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "found")
    met = rows.join(named.hint("merge"), (F.col("doc_id") == F.col("d")) & (F.col("text_key") == F.col("t")), "left").select("doc_id", "text", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text", SLICE_BYTES):
            counts, kept, gone = [], [], []
            for text, found in zip(b.column("text").cast(pa.binary()), b.column("found")):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                merged = merge(verified(words, found.values)) if found.is_valid else []
                left, at = [], 0
                for start, stop in merged:
                    left += words[at:start]
                    at = stop
                counts.append(len(words))
                gone.append([{"start": s, "stop": e} for s, e in merged])
                kept.append(b" ".join(left + words[at:]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(gone, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                                              pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "spans", "kept_text"])

    return met.mapInArrow(run, "doc_id long, n_words long, spans array<struct<start: long, stop: long>>, kept_text string")


def verified(words: list[bytes], found: pa.StructArray) -> list[tuple[int, int]]:
    """Spans (start, stop) whose words have the digest of their source's words; those without one were compared before."""
    spans = zip(found.field("start").to_pylist(), found.field("stop").to_pylist(), found.field("digest").to_pylist())
    return [(a, b) for a, b, digest in spans if digest is None or hashlib.sha256(b" ".join(words[a:b])).digest() == digest]


def merge(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with overlapping and touching ones joined."""
    out: list[list[int]] = []
    for start, stop in sorted(found):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]
