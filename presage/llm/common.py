"""Shared pieces: Arrow batches cut by bytes, words, and a check of what may go to every task."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; a text of ASCII only may take the fast way."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def give_back() -> None:
    """Freed memory to the system, as far as the platform can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def by_bytes(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in runs of about ``limit`` bytes of ``column``, so a task's memory follows the longest text, not the batch.

    In the end what Arrow and the allocator hold in reserve goes back, since the worker stays for other stages' tasks.
    """
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        run = (np.cumsum(size) - size) // limit
        cuts = np.flatnonzero(np.diff(run)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            if b > a:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(a, b - a)]) for c in batch.columns], schema=batch.schema)
    give_back()


def strings(column: pa.Array) -> pa.Array:
    """The texts with null as empty."""
    return pc.fill_null(column.cast(pa.string()), "")


def translated(texts: pa.StringArray, table: bytes) -> pa.StringArray:
    """Every byte replaced by its entry of ``table``; bytes of 0x80 and more must map to themselves."""
    _, offsets, data = texts.buffers()
    if data is None:
        return texts
    return pa.StringArray.from_buffers(len(texts), offsets, pa.py_buffer(data.to_pybytes().translate(table)), None, 0, texts.offset)


def words_of(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """Words between white space (0x20, 0x09-0x0D) of all texts in a row, and how many each text has."""
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.greater(pc.binary_length(words), 0)
    if pc.all(full).as_py() is False:
        ends = np.cumsum(counts)
        real = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        counts = real[ends] - real[ends - counts]
        words = words.filter(full)
    return words, counts


def coded(words: pa.StringArray) -> tuple[np.ndarray, list[str]]:
    """A code per word, and the distinct words in the order of their codes."""
    found = words.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each range, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
