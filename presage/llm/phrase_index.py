"""Positional inverted index over documents, and exact phrase and proximity search in it.

The index is split by documents: a shard holds the posting lists of about
``SHARD_BYTES`` of text, one table row, so a search needs no shuffle. In each
shard a phrase starts from its rarest term's list and meets the others, each
list shifted by its term's place in the phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from presage.llm.common import by_bytes, coded, ranges, strings, translated, words_of
from presage.session import LARGE_ROWS, cut_lineage, row_by_row

SHARD_BYTES = 4 << 20
BLOCK_BYTES = 8 << 20
AT_ONCE = 1 << 21
SHARD = "shard long, doc_ids array<long>, text_keys array<long>, doc_starts array<long>, terms array<string>, list_starts array<int>, positions binary"
HITS = "shard long, nth int, doc_id long, text_key long, n_words long, spans array<struct<start: long, stop: long>>, items array<string>"

#: A-Z to a-z; every other ASCII byte but 0-9 and a-z separates words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def folded_words(column: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    return words_of(translated(strings(column), FOLD))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of whole texts as a table in the shared folder, one row per shard, read by a session that takes shards one by one.

    Words are runs of 0-9, a-z and bytes above ASCII after lower-casing A-Z.
    Null text has no words; null or repeated doc_ids are separate documents.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for b in by_bytes(batches, "text", SHARD_BYTES):
            words, counts = folded_words(b.column("text"))
            codes, terms = coded(words)
            order = np.argsort(codes.astype(np.int32), kind="stable").astype(np.int32)
            sizes = np.bincount(codes, minlength=len(terms))
            one = lambda x, t: pa.array([x], t)
            starts = np.concatenate([[0], np.cumsum(counts)])
            whole = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            yield pa.RecordBatch.from_arrays([
                one(shard, pa.int64()), whole(b.column("doc_id")), whole(b.column("text_key")), whole(pa.array(starts)), whole(terms),
                whole(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))), one(order.tobytes(), pa.binary())],
                ["shard", "doc_ids", "text_keys", "doc_starts", "terms", "list_starts", "positions"])
            shard += 1

    text = F.col(text_col).cast("string")
    shards = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"), text.alias("text")).mapInArrow(run, SHARD)
    return cut_lineage(shards, row_by_row(docs.sparkSession), **LARGE_ROWS)


class Phrases:
    """Windows of a block of items, ready to be looked up: every run of ``window`` words, or a shorter item whole."""

    def __init__(self, items: list[str], texts: list[str | None], window: int) -> None:
        words, counts = folded_words(pa.array(texts, pa.string()))
        codes, self.terms = coded(words)
        self.items, self.by_length = items, {}
        at, runs = 0, {}
        for k, n in enumerate(counts.tolist()):
            if n:
                size = min(window, n)
                runs.setdefault(size, []).append((np.lib.stride_tricks.sliding_window_view(codes[at:at + n], size), k))
            at += n
        for size, found in runs.items():
            self.by_length[size] = (np.concatenate([w for w, _ in found]), np.repeat([k for _, k in found], [len(w) for w, _ in found]))


def matches(terms: pa.StringArray, list_starts: np.ndarray, positions: np.ndarray, doc_starts: np.ndarray, phrases: Phrases, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(item, first word, word after the last) of every match in a shard, in word positions of the shard."""
    place = pc.index_in(phrases.terms, value_set=terms).to_pandas().fillna(-1).to_numpy().astype(np.int64)
    sizes = np.append(np.diff(list_starts), 0).astype(np.int64)
    width = np.int64(1) << 32
    keys = np.repeat(np.arange(len(terms), dtype=np.int64), sizes[:-1]) * width + positions
    for size, (windows, owner) in phrases.by_length.items():
        listed = place[windows]
        there = (listed >= 0).all(1)
        listed, item = listed[there], owner[there]
        many = sizes[listed]
        order = np.argsort(many, axis=1, kind="stable")
        rarest = np.take_along_axis(many, order[:, :1], 1)[:, 0]
        block = np.cumsum(rarest) // AT_ONCE
        for k in np.unique(block):
            rows = np.flatnonzero(block == k)
            lead = listed[rows, order[rows, 0]]
            row = np.repeat(rows, rarest[rows])
            base = positions[ranges(list_starts[lead].astype(np.int64), rarest[rows])].astype(np.int64) - order[row, 0]
            low, high = base + order[row, 0], base + order[row, 0]
            for j in range(1, size):
                off = order[row, j]
                term = listed[row, off]
                wanted = term * width + np.maximum(base + off - slop, 0)
                at = np.searchsorted(keys, wanted)
                got = keys[np.minimum(at, len(keys) - 1)]
                ok = (at < len(keys)) & (got <= term * width + base + off + slop) & (base + off + slop >= 0)
                row, base = row[ok], base[ok]
                got = got[ok] % width
                low, high = np.minimum(low[ok], got), np.maximum(high[ok], got)
            same = np.searchsorted(doc_starts, low, "right") == np.searchsorted(doc_starts, high, "right")
            yield item[row[same]], low[same], high[same] + 1


def search(index: DataFrame, items: DataFrame, window: int = 10, slop: int = 0, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Per indexed document: shard, nth, doc_id, text_key, n_words, spans (merged word spans that matches cover), items (distinct ids as text).

    A match is a window of ``window`` consecutive item words (a shorter item
    whole) whose every word stands at its place, or at most ``slop`` words off
    it (proximity; the span then runs from the first to the last word found).
    ``slop`` 0 finds exact phrases. Matches never cross documents.

    Items go to the tasks in blocks of at most ``BLOCK_BYTES`` of text (or one
    item), each searched against the whole index. Null or word-free items match
    nothing; repeated items count once; null item ids are searched as the text
    "null". Every document has a row, those without words or hits too.
    """
    spark = items.sparkSession
    items = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).cast("string").alias("text")).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-2 * size // BLOCK_BYTES))
    parts = []
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()
        shared = spark.sparkContext.broadcast(Phrases([r["item"] for r in rows], [r["text"] for r in rows], window))
        parts.append(cut_lineage(_search_block(index, shared, slop), spark))
        shared.destroy()  # one block at a time is held
    if len(parts) == 1:
        return parts[0]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("shard", "nth").agg(
        F.first("doc_id").alias("doc_id"), F.first("text_key").alias("text_key"), F.first("n_words").alias("n_words"),
        merged(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def merged(spans):
    """Spans sorted, overlapping and touching ones joined."""
    grow = lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["stop"] >= x["start"]),
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], x["stop"]).alias("stop"))))
    ).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(F.array_sort(spans), F.expr("cast(array() as array<struct<start: bigint, stop: bigint>>)"), grow)


def _search_block(index: DataFrame, shared, slop: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        for b in batches:
            for r in range(b.num_rows):
                get = lambda name: b.column(name)[r].values
                starts = get("doc_starts").to_numpy()
                total, docs = int(starts[-1]), len(starts) - 1
                positions = np.frombuffer(b.column("positions")[r].as_buffer(), np.int32)
                edge = np.zeros(total + 1, np.int32)
                found = []
                for item, low, high in matches(get("terms"), get("list_starts").to_numpy(), positions, starts[1:], phrases, slop) if total else ():
                    edge += np.bincount(low, minlength=total + 1).astype(np.int32) - np.bincount(high, minlength=total + 1).astype(np.int32)
                    doc = np.searchsorted(starts[1:], low, "right")
                    found.append(np.unique(doc * len(phrases.items) + item))
                # runs of covered words, cut at documents' ends
                hit = np.cumsum(edge[:-1]) > 0
                left = hit & np.concatenate([[True], ~hit[:-1]])[:total]
                left[starts[:-1][starts[:-1] < total]] |= hit[starts[:-1][starts[:-1] < total]]
                a = np.flatnonzero(left)
                off = np.flatnonzero(np.diff(np.concatenate([hit.astype(np.int8), [0]])) < 0) + 1
                z = np.minimum(off[np.searchsorted(off, a, "right")], np.append(a[1:], total)) if len(a) else a
                doc = np.searchsorted(starts[1:], a, "right")
                z = np.minimum(z, starts[1:][doc]) if len(a) else z
                pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
                where, which = np.divmod(pairs, max(1, len(phrases.items)))
                offsets = lambda d: pa.array(np.concatenate([[0], np.cumsum(np.bincount(d, minlength=docs))]).astype(np.int32))
                spans = pa.ListArray.from_arrays(offsets(doc), pa.StructArray.from_arrays([pa.array(a - starts[doc]), pa.array(z - starts[doc])], ["start", "stop"]))
                names = pa.array(phrases.items, pa.string()).take(pa.array(which.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(docs, b.column("shard")[r].as_py(), np.int64)), pa.array(np.arange(docs, dtype=np.int32)), get("doc_ids"), get("text_keys"),
                    pa.array(np.diff(starts)), spans, unique_lists(offsets(where), names)],
                    ["shard", "nth", "doc_id", "text_key", "n_words", "spans", "items"])

    return index.mapInArrow(run, HITS)


def unique_lists(offsets: pa.Array, names: pa.Array) -> pa.ListArray:
    """Lists of names, each name once per list."""
    at = offsets.to_numpy()
    lists = [sorted(set(names.slice(a, z - a).to_pylist())) if z - a > 1 else names.slice(a, z - a).to_pylist() for a, z in zip(at, at[1:])] if len(names) else [[]] * (len(at) - 1)
    return pa.array(lists, pa.list_(pa.string()))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, slop: int = 0, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``search`` of the items in an index built for the documents."""
    return search(build_index(docs, id_col, text_col), items, window, slop, item_col, text_col)


def clean(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without any match, whole rows with their own columns; repeated rows share their fate."""
    own = docs.columns
    hit = contamination(docs, items, window, id_col=id_col, text_col=text_col).filter(F.size("spans") > 0).select(
        F.col("doc_id").alias("__hit_id"), F.col("text_key").alias("__hit_key")).distinct()
    key = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.join(hit, F.col(id_col).cast("long").eqNullSafe(F.col("__hit_id")) & (key == F.col("__hit_key")), "left_anti").select(*[F.col(f"`{c}`") for c in own])
