"""Fill-in-the-middle over seekable compressed frames.

A text is kept as independent zstandard frames, each with the counts of units,
code points and bytes before it. A cut is found in the counts, so only the
frame it falls into is decompressed; whole frames go into the output as they
are, and digests stream one frame at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from presage.llm.common import by_bytes, strings

FRAME_BYTES, BATCH_BYTES = 128 << 10, 8 << 20
MARKS = {"P": b"<P>", "S": b"<S>", "M": b"<M>"}
ORDERS = {"psm": "PSM", "spm": "SPM"}
FRAME = "array<struct<units:long,chars:long,bytes:long,data:binary>>"
FRAME_TYPE = pa.list_(pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("bytes", pa.int64()), ("data", pa.binary())]))


class Writer:
    """Appends text to frames; what ``put`` gets is gathered up to ``size`` bytes a frame, cut between code points."""

    def __init__(self, size: int = FRAME_BYTES) -> None:
        self.size, self.compress = size, zstandard.ZstdCompressor(level=1).compress
        self.start()

    def start(self) -> None:
        self.frames: list[tuple[int, int, int, bytes]] = []
        self.units = self.chars = self.bytes = 0
        self.held: list[bytes] = []
        self.waiting = 0

    def put(self, text: bytes) -> None:
        self.held.append(text)
        self.waiting += len(text)
        if self.waiting > self.size:
            whole, at = b"".join(self.held), 0
            while len(whole) - at > self.size:
                to = at + self.size
                while whole[to] & 0xC0 == 0x80:
                    to -= 1
                self._add(whole[at:to])
                at = to
            self.held, self.waiting = [whole[at:]], len(whole) - at

    def flush(self) -> None:
        if self.waiting:
            self._add(b"".join(self.held))
        self.held, self.waiting = [], 0

    def frame(self, units: int, chars: int, size: int, data: bytes) -> None:
        """A whole frame as it is, with its own counts."""
        self.flush()
        self.frames.append((self.units, self.chars, self.bytes, data))
        self.units, self.chars, self.bytes = self.units + units, self.chars + chars, self.bytes + size

    def _add(self, text: bytes) -> None:
        self.frames.append((self.units, self.chars, self.bytes, self.compress(text)))
        self.units += text.count(b"\n")
        self.chars += len(text.decode())
        self.bytes += len(text)

    def done(self) -> list[tuple[int, int, int, bytes]]:
        """The frames; the last one, without data, holds the totals."""
        self.flush()
        out = [*self.frames, (self.units, self.chars, self.bytes, None)]
        self.start()
        return out


class Reader:
    """Random access to a text in frames."""

    def __init__(self, frames: list[tuple[int, int, int, bytes]], decompress) -> None:
        self.units, self.chars, self.bytes = (np.array([f[i] for f in frames], np.int64) for i in range(3))
        self.data, self.decompress = [f[3] for f in frames[:-1]], decompress

    @property
    def size(self) -> int:
        return int(self.bytes[-1])

    def stream(self, start: int, stop: int) -> Iterator[bytes]:
        """Bytes start to stop, a frame at a time."""
        for i in range(max(0, int(np.searchsorted(self.bytes, start, "right")) - 1), len(self.data)):
            a, b = int(self.bytes[i]), int(self.bytes[i + 1])
            if a >= stop:
                return
            text = self.decompress(self.data[i])
            yield text[max(0, start - a):stop - a] if start > a or stop < b else text

    def find(self, mark: bytes, start: int) -> int:
        """Where ``mark`` first begins at or after ``start``; -1 if nowhere."""
        tail, at = b"", start
        for text in self.stream(start, self.size):
            found = (tail + text).find(mark)
            if found >= 0:
                return at - len(tail) + found
            at += len(text)
            tail = (tail + text)[-(len(mark) - 1):]
        return -1

    def lines(self) -> int:
        """How many lines: line breaks, and a last line without one."""
        n = int(self.units[-1])
        return n if not self.data or self.decompress(self.data[-1]).endswith(b"\n") else n + 1

    def after(self, unit: int) -> tuple[int, int]:
        """Bytes and code points before the end of the unit-th line."""
        if unit > self.units[-1]:
            return self.size, int(self.chars[-1])
        if unit == 0:
            return 0, 0
        i = int(np.searchsorted(self.units, unit, "left")) - 1
        text = self.decompress(self.data[i])
        end = int(np.flatnonzero(np.frombuffer(text, np.uint8) == 10)[unit - int(self.units[i]) - 1]) + 1
        return int(self.bytes[i]) + end, int(self.chars[i]) + len(text[:end].decode())

    def copy(self, start: int, stop: int, to: Writer) -> None:
        """Bytes start to stop; frames inside go over without being opened."""
        for i in range(max(0, int(np.searchsorted(self.bytes, start, "right")) - 1), len(self.data)):
            a, b = int(self.bytes[i]), int(self.bytes[i + 1])
            if a >= stop:
                return
            if start <= a and b <= stop and b - a >= FRAME_BYTES // 2:
                to.frame(int(self.units[i + 1] - self.units[i]), int(self.chars[i + 1] - self.chars[i]), b - a, self.data[i])
            else:
                to.put(self.decompress(self.data[i])[max(0, start - a):stop - a])


def _frames(column: pa.Array) -> Iterator[list[tuple[int, int, int, bytes]]]:
    for row in column:
        kinds = row.values.flatten()
        yield list(zip(*(k.to_pylist() for k in kinds)))


def _as_frames(rows: list[list[tuple[int, int, int, bytes]]]) -> pa.Array:
    flat = [f for r in rows for f in r]
    inner = pa.StructArray.from_arrays([pa.array([f[i] for f in flat], t.type) for i, t in enumerate(FRAME_TYPE.value_type)], fields=list(FRAME_TYPE.value_type))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), inner)


def seekable(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and frames of every row; null text counts as empty. The last frame has no data but the totals."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer()
        for b in by_bytes(batches, "text", BATCH_BYTES):
            rows = []
            for text in strings(b.column("text")):
                writer.put(text.as_buffer().to_pybytes())
                rows.append(writer.done())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), _as_frames(rows)], ["doc_id", "frames"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id long, frames {FRAME}")


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers below 2^32 from the id alone; a null id counts as the text ``null``."""
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]


def rearranged(doc_id: int | None, text: Reader, to: Writer, seed: int, rate: int, spm: int) -> tuple[int, str, int | None, int | None]:
    """Puts the transformed text and gives units, form, and the code points of prefix and middle."""
    n, (h1, h2, h3, h4) = text.lines(), draws(doc_id, seed)
    if n == 0 or h3 % 100 >= rate or any(text.find(m, 0) >= 0 for m in MARKS.values()):
        text.copy(0, text.size, to)
        return n, "plain", None, None
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    (cut, cut_chars), (end, end_chars) = text.after(a), text.after(b)
    parts = {"P": (0, cut), "M": (cut, end), "S": (end, text.size)}
    form = "spm" if h4 % 100 < spm else "psm"
    for part in ORDERS[form]:
        to.put(MARKS[part])
        text.copy(*parts[part], to)
    return n, form, cut_chars, end_chars - cut_chars


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n (lines), form, prefix_chars, middle_chars, output (frames).

    The id's digest draws two cuts between lines, whether the text is changed
    (``rate`` per cent) and whether its suffix comes first (``spm`` per cent).
    Forms: ``psm`` <P>prefix<S>suffix<M>middle, ``spm``
    <S>suffix<P>prefix<M>middle, ``plain`` the text as it is: an empty or null
    text, one that holds a mark, or one not drawn; its char counts are null.
    Every row counts for itself, repeated ids and null ids too; a text of any
    length is held as its frames. An empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, decompress = Writer(), zstandard.ZstdDecompressor().decompress
        for b in batches:
            told, rows, size = [], [], 0
            ids, at = b.column("doc_id").to_pylist(), 0
            for doc_id, frames in zip(ids, _frames(b.column("frames"))):
                told.append(rearranged(doc_id, Reader(frames, decompress), writer, seed, rate, spm))
                rows.append(writer.done())
                size += sum(len(f[3] or b"") for f in rows[-1])
                if size > BATCH_BYTES or at + len(rows) == len(ids):
                    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at:at + len(rows)], pa.int64()), *[pa.array(c, t) for c, t in zip(zip(*told), kinds)], _as_frames(rows)],
                                                     ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
                    told, rows, size, at = [], [], 0, at + len(rows)

    return seekable(docs, id_col, text_col).mapInArrow(run, f"doc_id long, n long, form string, prefix_chars long, middle_chars long, output {FRAME}")


def restored(output: Reader, form: str) -> Iterator[bytes]:
    """The text behind an output, frame by frame: the marks are found, then prefix, middle and suffix are sought out."""
    if form == "plain":
        yield from output.stream(0, output.size)
        return
    starts, at = [], 0
    for part in ORDERS[form]:
        found = output.find(MARKS[part], at)
        if found < 0 or not starts and found:
            raise ValueError("the output lacks a mark of its form")
        starts.append(found)
        at = found + len(MARKS[part])
    parts = {part: (start + len(MARKS[part]), stop) for part, start, stop in zip(ORDERS[form], starts, [*starts[1:], output.size])}
    for part in "PMS":
        yield from output.stream(*parts[part])


def digests(outputs: DataFrame) -> DataFrame:
    """The rows of ``transform`` with output_sha256 and restored_sha256 in place of the output."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompress = zstandard.ZstdDecompressor().decompress
        for b in batches:
            found = [[], []]
            for form, frames in zip(b.column("form").to_pylist(), _frames(b.column("output"))):
                output = Reader(frames, decompress)
                for parts, out in zip((output.stream(0, output.size), restored(output, form)), found):
                    digest = hashlib.sha256()
                    for part in parts:
                        digest.update(part)
                    out.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *map(pa.array, found)], [*b.schema.names[:-1], "output_sha256", "restored_sha256"])

    own = outputs.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    return own.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def texts(outputs: DataFrame) -> DataFrame:
    """The rows of ``transform`` with the output as one string."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompress = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for i, frames in enumerate(_frames(b.column("output"))):
                output = Reader(frames, decompress)
                yield pa.RecordBatch.from_arrays([*[c.slice(i, 1) for c in b.columns[:-1]], pa.array([b"".join(output.stream(0, output.size)).decode()])], b.schema.names)

    own = outputs.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    return own.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")
