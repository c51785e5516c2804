"""Cost-balanced packing of tokenized documents into fixed-length sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from presage.llm.common import by_bytes, coded, ranges, strings, translated, words_of

SLICE_BYTES = 2 << 20
CACHED_WORDS = 300_000
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, `offset` long, sequence_tokens long, ids binary"


#: A-Z to a-z.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


_LOADED: dict[tuple[str, str], WordTokens] = {}


def word_tokens(path: str, apart: str) -> WordTokens:
    """One per worker process: tasks that follow each other share what it knows."""
    if (path, apart) not in _LOADED:
        _LOADED[path, apart] = WordTokens(path, apart)
    return _LOADED[path, apart]


class WordTokens:
    """Ids of texts by a lower-casing tokenizer that drops white space, looked up word by word.

    Only right for tokenizers whose pieces never span ASCII white space or the
    place between an ASCII letter or digit and one of ``.,;:!?``; texts are cut
    there, so that few distinct words remain. New words go through the
    tokenizer together, apart by a special token.
    """

    def __init__(self, path: str, apart: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.apart = Tokenizer.from_file(path), apart
        self.apart_id = self.tokenizer.token_to_id(apart)
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, and how many each has."""
        if any(self.apart in w for w in words):  # the sign itself is in the text
            got = [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
            return np.array([i for g in got for i in g], np.uint32), np.fromiter(map(len, got), np.int64, len(got))
        ids = np.array(self.tokenizer.encode_batch_fast([self.apart.join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(ids == self.apart_id) - np.arange(len(words) - 1)
        ids = ids[ids != self.apart_id]
        return ids, np.diff(np.concatenate([[0], ends, [len(ids)]]))

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for runs of a-z: these are one piece before the merges, so the model takes them as they are."""
        got = [[t.id for t in x] for x in map(self.tokenizer.model.tokenize, words)]
        return np.array([i for g in got for i in g], np.uint32), np.fromiter(map(len, got), np.int64, len(got))

    def __call__(self, texts: pa.StringArray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by ``end``; and how many each text has, with it."""
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # special tokens are told by their case
            texts = translated(texts, FOLD)
        split, counts = words_of(pc.replace_substring_regex(texts, r"([A-Za-z0-9])([.,;:!?])", r"\1 \2"))
        codes, distinct = coded(split)
        distinct = distinct.to_pylist()
        if len(self.place) > CACHED_WORDS:
            self.forget()
        new = [w for w in distinct if w not in self.place]
        plain = [w for w in new if w.isascii() and w.isalpha() and w.islower()]
        for words, ids_of in ((plain, self.merge), (sorted(set(new).difference(plain)), self.encode)):
            if words:
                ids, sizes = ids_of(words)
                self.place.update(zip(words, range(len(self.sizes), len(self.sizes) + len(words))))
                self.sizes, self.flat = np.append(self.sizes, sizes), np.append(self.flat, ids)
        known = np.append(np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct)), len(self.sizes))
        sizes, flat = np.append(self.sizes, 1), np.append(self.flat, np.uint32(end))
        # the end id is a last word of each text: its code stands after the text's own codes
        full = np.full(len(codes) + len(counts), len(distinct), np.int64)
        full[np.arange(len(codes)) + np.repeat(np.arange(len(counts)), counts)] = codes
        full = known[full]
        lengths = sizes[full]
        before = np.concatenate([[0], np.cumsum(lengths)])
        last = np.cumsum(counts) + np.arange(1, len(counts) + 1)
        return flat[ranges((np.cumsum(sizes) - sizes)[full], lengths)], np.diff(before[np.concatenate([[0], last])])


def capacities(tokens: int, context: int) -> list[int]:
    """Full sequences, and for the rest sequences whose lengths are powers of two, so nothing is padded."""
    rest = tokens % context
    return [context] * (tokens // context) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def assign(lengths: list[int], tokens: int, context: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """Descending documents, each to the cheapest sequence that still holds it.

    A piece of n tokens costs ``linear`` n + ``quadratic`` n^2. What fits nowhere
    whole fills the cheapest sequence with room and goes on with its rest. Gives
    (document, start, length, sequence, offset) and the sequences' sizes.
    """
    sizes = capacities(tokens, context)
    room, cost = np.array(sizes, np.int64), np.zeros(len(sizes))
    out = []
    todo = [(n, -i, 0) for i, n in enumerate(lengths)]
    pieces = [(min(context, n - s), i, s) for n, i, _ in todo for s in range(0, n, context)]
    for n, i, s in sorted(pieces, key=lambda x: (-x[0], -x[1], x[2])):
        while n:
            fits = room >= n
            at = int(np.where(fits if fits.any() else room > 0, cost, np.inf).argmin())
            take = min(n, int(room[at]))
            out.append((-i, s, take, at, sizes[at] - int(room[at])))
            room[at] -= take
            cost[at] += linear * take + quadratic * take * take
            n, s = n - take, s + take
    return out, sizes


def pack(docs: DataFrame, tokenizer: str, context: int = 4096, end: int = 2, block: int = 256, linear: float = 1.0, quadratic: float = 1 / 4096,
         apart: str = "<|startoftext|>", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, sequence_tokens, ids (little-endian 32-bit).

    ``tokenizer`` is a file of the tokenizers library that every worker can
    read, ``apart`` one of its special tokens. Ids come without special tokens
    added, then ``end``. Each task packs its
    documents in blocks of ``block`` full sequences (bounded memory, no
    shuffle); a document that a block's border meets is cut there, and only a
    task's last block has shorter sequences, of power-of-two lengths. No token
    is dropped or doubled and nothing is padded.

    Null or empty text: the end id alone. Null or repeated doc_ids: every row is
    a document of its own. A text of any length is cut into pieces of at most
    ``context``. Equal lengths keep input order. An empty table gives no rows.
    """
    from pyspark.sql import functions as F

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, base, made = word_tokens(tokenizer, apart), TaskContext.get().partitionId() << 32, 0
        held, total, goal = [], 0, block * context  # (doc_id, tokens of the document, tokens before, ids)

        def flush(parts, tokens_in):
            nonlocal made
            got, sizes = assign([len(p[3]) for p in parts], tokens_in, context, linear, quadratic)
            rows = [(parts[d][0], parts[d][2] + s, n, parts[d][1], base + made + q, o, sizes[q], parts[d][3][s:s + n].tobytes()) for d, s, n, q, o in got]
            made += len(sizes)
            kinds = [pa.int64()] * 7 + [pa.binary()]
            names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "ids"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        for batch in by_bytes(batches, "text", SLICE_BYTES):
            ids, sizes = tokens(strings(batch.column("text")), end)
            ids = ids.astype("<u4")
            at = 0
            for doc, n in zip(batch.column("doc_id").to_pylist(), sizes.tolist()):
                done = 0
                while done < n:
                    take = min(n - done, goal - total)
                    held.append((doc, n, done, ids[at + done:at + done + take]))
                    total, done = total + take, done + take
                    if total == goal:
                        yield flush(held, total)
                        held, total = [], 0
                at += n
            held = [(d, n, b, x.copy()) for d, n, b, x in held]
        if held:
            yield flush(held, total)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
