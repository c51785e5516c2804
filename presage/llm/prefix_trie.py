"""Trie of conversation prefixes from padded turn-id matrices.

Conversations are range-partitioned by their paths (turn digests in a row), so
a node's members are neighbours. A task takes its sorted rows in runs that
become padded matrices of turn numbers: a lexsort, change masks accumulated
column by column to mark where nodes start, and one reduceat per depth. Nodes
on a run's first or last path may have members elsewhere; their sums so far
travel on as two spines, first within the task, then in groups of tasks, until
one group is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from presage.session import cut_lineage

#: Cells of a run's matrix (a longer conversation is a run of its own), and how many summaries meet in one step.
CELLS, FAN = 1 << 20, 64
NO_ID = (1 << 63) - 1
EMPTY = hashlib.sha256(b"").hexdigest()
SUMS = ("convs", "low", "kids", "leaves", "saved")
NODE = "pid long, conv_id long, depth long, parent_conv_id long, parent_key binary, key binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
SPINE = "path binary, words array<int>, " + ", ".join(f"{s} array<long>" for s in SUMS)
SCHEMA = f"kind string, {NODE}, at long, ends binary, {SPINE}"
LONGS = pa.list_(pa.int64())
ARROW = pa.schema([
    ("kind", pa.string()), ("pid", pa.int64()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("parent_key", pa.binary()), ("key", pa.binary()),
    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("at", pa.int64()), ("ends", pa.binary()),
    ("path", pa.binary()), ("words", pa.list_(pa.int32())), *[(s, LONGS) for s in SUMS]])


@dataclass
class Spine:
    """A path whose nodes may go on elsewhere, and per depth, the root included, what its node has gathered."""

    path: bytes
    words: np.ndarray
    sums: np.ndarray  # len(SUMS) x (depth + 1)


def _keys(path: bytes) -> list[bytes]:
    """A name for each prefix of a path."""
    out, chain = [], hashlib.sha256()
    for at in range(0, len(path) + 16, 16):
        out.append(chain.copy().digest()[:16])
        chain.update(path[at:at + 16])
    return out


def _batch(kind: str, n: int, **columns) -> pa.RecordBatch:
    arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in ARROW]
    arrays[0] = pa.array([kind] * n, pa.string())
    return pa.RecordBatch.from_arrays(arrays, schema=ARROW)


def _ids(low: np.ndarray) -> pa.Array:
    return pa.array(low, pa.int64(), mask=low == NO_ID)


def reduce_run(pid: int, at: int, spines: list[Spine], ids: list[int | None], paths: list[bytes], words: list[np.ndarray], final: bool = False) -> tuple[list[pa.RecordBatch], list[Spine]]:
    """Nodes that are complete, ends of those that are not, and the spines of the run.

    ``spines`` come before the conversations in path order or lie on their
    border; ``ids`` ascend within a path. With ``final`` every node is complete.
    """
    every = [s.path for s in spines] + paths
    n, n_spines = len(every), len(spines)
    length = np.array([len(p) // 16 for p in every], np.int64)
    width = int(length.max())
    filled = np.arange(width) < length[:, None]
    turn, word = np.zeros((n, width), np.int32), np.zeros((n, width), np.int64)
    if width:
        turn[filled] = np.unique(np.frombuffer(b"".join(every), "S16"), return_inverse=True)[1] + 1
        word[filled] = np.concatenate([s.words for s in spines] + words)
    order = np.lexsort([*turn.T[::-1], np.zeros(n, np.int8)]) if width == 0 else np.lexsort(turn.T[::-1])
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    turn, word, length_in = turn[order], word[order], length[order]
    starts = np.zeros((n, width + 1), bool)
    starts[0] = True
    if width:
        starts[1:, 1:] = np.logical_or.accumulate(turn[1:] != turn[:-1], axis=1)

    low_in = np.full(n, NO_ID)
    low_in[place[n_spines:]] = [NO_ID if i is None else i for i in ids]
    carried = np.zeros((len(SUMS), n_spines, width + 1), np.int64)
    carried[1] = NO_ID
    for i, s in enumerate(spines):
        carried[:, i, :s.sums.shape[1]] = s.sums
    at_spine = place[:n_spines]
    first, last = place[0], place[n - 1]
    edges = [] if final else [first, last]
    edge_rows = [] if final else [0, n - 1]
    edge_keys = [_keys(every[i]) for i in edge_rows]
    spine_keys = [_keys(s.path) for s in spines]
    texts = np.array(["" if i is None else str(i) for i in [None] * n_spines + list(ids)], object)[order]
    ender = np.zeros(n, bool)
    ender[place[n_spines:]] = True

    out: list[pa.RecordBatch] = []
    grown = [Spine(every[i], word[p][:length[i]].astype(np.int32), np.concatenate([np.zeros((1, length[i] + 1), np.int64), np.full((1, length[i] + 1), NO_ID), np.zeros((3, length[i] + 1), np.int64)])) for i, p in zip(edge_rows, edges)]
    below: dict | None = None  # complete nodes one level down
    for d in range(width, -1, -1):
        pos = np.flatnonzero(starts[:, d])
        group_of = lambda p: np.searchsorted(pos, p, "right") - 1  # noqa: E731, B023
        convs, low = (length_in >= d).astype(np.int64), np.where(length_in >= d, low_in, NO_ID)
        extra = np.zeros((3, len(pos)), np.int64)
        if n_spines:
            convs[at_spine], low[at_spine] = carried[0, :, d], carried[1, :, d]
            for k in range(3):
                np.add.at(extra[k], group_of(at_spine), carried[2 + k, :, d])
        n_convs, lowest = np.add.reduceat(convs, pos), np.minimum.reduceat(low, pos)
        if below is not None:
            parent = group_of(below["pos"])
            extra[0] += np.bincount(parent, minlength=len(pos)).astype(np.int64)
            np.add.at(extra[1], parent, below["leaves"])
            np.add.at(extra[2], parent, below["saved"])
        real = np.ones(len(pos), bool) if d == 0 else turn[pos, d - 1] > 0
        open_ = np.zeros(len(pos), bool)
        keys_of: dict[int, bytes] = {}
        for s in range(n_spines):
            if d <= length[s]:
                keys_of[int(group_of(at_spine[s]))] = spine_keys[s][d]
        for e, (p, row) in enumerate(zip(edges, edge_rows)):
            if d <= length[row]:
                g = int(group_of(p))
                if not open_[g]:
                    open_[g] = True
                    grown[e].sums[:, d] = n_convs[g], lowest[g], *extra[:, g]
                keys_of[g] = edge_keys[e][d]
        if below is not None:
            parents = np.where(open_[parent], NO_ID, lowest[parent])
            names = [keys_of[int(g)] if open_[g] else None for g in parent] if open_[parent].any() else [None] * len(parent)
            out.append(_batch("node", len(parent), **below["row"], parent_conv_id=_ids(parents), parent_key=names))
        # ends: rows as long as the node is deep come first in it
        ends = np.flatnonzero((length_in == d) & ender)
        chunks = np.split(texts[ends], np.flatnonzero(np.diff(group_of(ends))) + 1) if len(ends) else []
        ended = {int(g): ",".join(x for x in c if x).encode() for g, c in zip(np.unique(group_of(ends)), chunks)}
        later = {g: t for g, t in ended.items() if t and g in keys_of}
        if later:
            out.append(_batch("ends", len(later), pid=[pid] * len(later), key=[keys_of[g] for g in later], at=[at] * len(later), ends=list(later.values())))
        done = np.flatnonzero(real & ~open_)
        if not len(done):
            below = None
            continue
        leaves = extra[1, done] + (extra[0, done] == 0)
        saved = extra[2, done] + ((n_convs[done] - 1) * word[pos[done], d - 1] if d else 0)
        sha = [None if int(g) in keys_of else hashlib.sha256(ended[int(g)]).hexdigest() if int(g) in ended else EMPTY for g in done]
        row = dict(pid=np.full(len(done), pid), conv_id=_ids(lowest[done]), depth=np.full(len(done), d), key=[keys_of.get(int(g)) for g in done], n_convs=n_convs[done],
                   n_children=extra[0, done], n_leaves=leaves, saved_tokens=saved, ends_sha256=sha)
        below = {"pos": pos[done], "leaves": leaves, "saved": saved, "row": row}
        if d == 0:
            out.append(_batch("node", 1, **row))
    return out, grown


def _spine_rows(pid: int, spines: list[Spine]) -> pa.RecordBatch:
    return _batch("spine", len(spines), pid=[pid] * len(spines), at=list(range(len(spines))), path=[s.path for s in spines], words=[s.words for s in spines],
                  **{k: [s.sums[i] for s in spines] for i, k in enumerate(SUMS)})


def _spines(rows: pa.Table) -> list[Spine]:
    rows = rows.sort_by([("pid", "ascending"), ("at", "ascending")]).select(["path", "words", *SUMS]).to_pylist()
    return [Spine(r["path"], np.array(r["words"], np.int32), np.array([r[k] for k in SUMS], np.int64)) for r in rows]


def _merge(level: int, fan: int, final: bool):
    """Joins the spines of neighbouring summaries into one summary."""
    def merge(rows: pa.Table) -> pa.Table:
        pid = (level << 32) + rows.column("pid")[0].as_py() % (1 << 32) // fan
        out, grown = reduce_run(pid, 0, _spines(rows), [], [], [], final)
        return pa.Table.from_batches([*out, *([] if final else [_spine_rows(pid, grown)])], ARROW)

    return merge


def _shards(paths: DataFrame, cells: int) -> DataFrame:
    """Nodes, ends and spines of every range of paths."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, at, spines = TaskContext.get().partitionId(), 0, []
        ids, held, words, width = [], [], [], 0
        for batch in batches:
            for conv_id, path, counts in zip(batch.column("conv_id").to_pylist(), batch.column("path").to_pylist(), batch.column("words")):
                if held and max(width, len(path) // 16 + 1) * (len(held) + 3) > cells:
                    out, spines = reduce_run(pid, at, spines, ids, held, words)
                    yield from out
                    ids, held, words, width, at = [], [], [], max(len(s.path) // 16 + 1 for s in spines), at + 1
                ids.append(conv_id)
                held.append(path)
                words.append(counts.values.to_numpy(zero_copy_only=False))
                width = max(width, len(path) // 16 + 1)
        if held:
            out, spines = reduce_run(pid, at, spines, ids, held, words)
            yield from out
        if spines:
            yield _spine_rows(pid, spines)

    return paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(run, SCHEMA)


def _ends(chunks: DataFrame) -> DataFrame:
    """key and ends_sha256: the chunks of each key hashed in order, one at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            keys, told = [], []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("ends")):
                if key != now:
                    if now is not None:
                        keys.append(now)
                        told.append(digest.hexdigest())
                    now, digest = key, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(text.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(told, pa.string())], ["key", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], ["key", "ends_sha256"])

    return chunks.select("key", "pid", "at", "ends").repartition("key").sortWithinPartitions("key", "pid", "at").mapInArrow(run, "key binary, ends_sha256 string")


def turn_digest(role: Column, text: Column) -> Column:
    """32 hexadecimal digits of a SHA-256 over role and text, null as empty; turns are equal if these are."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    return F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)


def turn_lists(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id and turns (digest, words) of every conversation, in the order of turn, null first; equal turn numbers in the order of their digests."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.struct(
        F.col(turn_col).alias("turn"), turn_digest(F.col(role_col), F.col(text_col)).alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words")).alias("t"))
    return narrow.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def with_shared_heads(lists: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversation c gets the first h turns of conversation c - c % every in place of its own first h; h = crc32(decimal c) % most."""
    h = F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % most, F.lit(0)).cast("int")
    heads = lists.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, most - 1).alias("head"))
    both = lists.join(heads, F.col("conv_id") - F.col("conv_id") % every == F.col("head_id"), "left")
    head = F.coalesce(F.slice("head", F.lit(1), h), F.slice("turns", 1, 0))
    return both.select("conv_id", F.concat(head, F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def trie(lists: DataFrame, cells: int = CELLS, fan: int = FAN) -> DataFrame:
    """One row per distinct prefix of ``lists`` (conv_id, turns of digest and words), the root included.

    conv_id (smallest member), depth, parent_conv_id (the parent's conv_id),
    n_convs, n_children, n_leaves (childless nodes of its subtree),
    saved_tokens (over its subtree, members but one times words of the last
    turn), ends_sha256 (of the decimal ids of members that end here, ascending,
    comma-joined). A conversation without turns ends at the root; a null
    conv_id counts as a member, but is no smallest member and in no digest;
    repeated ids count each. No conversation, no row.

    A task holds one matrix of bounded size; equal conversations are spread by
    conv_id, and a digest over many ids is fed from chunks. Only one
    conversation's own digests must fit a task. ``cells`` bounds a run's matrix,
    ``fan`` is how many summaries meet in one step.
    """
    digests = F.transform("turns", lambda t: t["digest"])
    # one row per conversation: its path is as long as the conversation
    paths = cut_lineage(lists.select("conv_id", F.unhex(F.array_join(digests, "")).alias("path"), F.transform("turns", lambda t: t["words"].cast("int")).alias("words")))
    made = cut_lineage(_shards(paths, cells))
    levels, spines, level = [made], made.filter("kind = 'spine'"), 1
    left = (spines.agg(F.max("pid").alias("pid")).first()["pid"] or 0) + 1
    while left:
        final = left <= fan

        merged = cut_lineage(spines.groupBy(F.expr(f"pid % {1 << 32} div {fan}")).applyInArrow(_merge(level, fan, final), SCHEMA))
        levels.append(merged)
        spines, level, left = merged.filter("kind = 'spine'"), level + 1, 0 if final else -(-left // fan)
    every = levels[0]
    for more in levels[1:]:
        every = every.unionByName(more)
    nodes = every.filter("kind = 'node'").select(*[c.split()[0] for c in NODE.split(", ")])
    late = nodes.filter("key is not null")
    ends = _ends(every.filter("kind = 'ends'"))
    ended = cut_lineage(late.drop("ends_sha256").join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY))))
    known = ended.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("low"))
    rest = nodes.filter("key is null").unionByName(ended)
    own = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    # a parent known only after the merge: its number is looked up once per task, so a node of many children is no hot key
    waiting = rest.filter("parent_key is not null")
    asked = waiting.select("pid", "parent_key").distinct().join(known, "parent_key")
    told = waiting.join(asked, ["pid", "parent_key"]).withColumn("parent_conv_id", F.col("low"))
    return rest.filter("parent_key is null").select(*own).unionByName(told.select(*own))
