"""Language identification by string kernels, Nystroem landmarks and kernel ridge regression.

Blended-spectrum presence kernel: the number of letter n-grams (n = 1..3) two
texts share, over the root of the product of how many each has. Landmarks
stand for the training texts; one ridge regression per language on the
Nystroem features. As a text's kernel values are its 0/1 n-gram row times the
landmark matrix, landmark map and weights fold into one matrix, and a batch is
scored by one product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from presage.llm.common import by_bytes

CLASSES, GRAMS = 64, 3
SPACE = sum(CLASSES ** n for n in range(1, GRAMS + 1))
SCORED_AT_ONCE = 64
UNKNOWN = "und"


def letter_classes(text: str) -> np.ndarray:
    """a-z are 1-26, other letters share 27-63 by code point, all else is 0; runs of 0 are one."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    kind = np.where((code >= 97) & (code <= 122), code - 96, 0).astype(np.int64)
    high = np.flatnonzero(code > 127)
    if len(high):
        distinct, at = np.unique(code[high], return_inverse=True)
        alpha = np.array([chr(c).isalpha() for c in distinct])
        kind[high] = np.where(alpha, 27 + distinct % 37, 0)[at]
    keep = np.ones(len(kind), bool)
    keep[1:] = (kind[1:] > 0) | (kind[:-1] > 0)
    return kind[keep]


def present(text: str | None) -> np.ndarray:
    """Sorted numbers of the n-grams that occur in the text; empty if it has no letter."""
    kind = letter_classes(text or "")
    if not kind.any():
        return np.zeros(0, np.int64)
    kind = np.concatenate([[0], kind, [0]])
    seen = np.zeros(SPACE, bool)
    gram, base = np.zeros(len(kind), np.int64), 0
    for n in range(1, GRAMS + 1):
        gram = (gram[:len(kind) - n + 1] * CLASSES + kind[n - 1:])
        seen[base + gram] = True
        base += CLASSES ** n
    seen[0] = False
    return np.flatnonzero(seen)


def presence(texts: list[np.ndarray], column: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """0/1 rows over the known n-grams, and how many n-grams each text has at all."""
    rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    cols = column[np.concatenate(texts)] if len(rows) else np.zeros(0, np.int64)
    out = np.zeros((len(texts), width), np.float32)
    out[rows[cols >= 0], cols[cols >= 0]] = 1
    return out, np.array([max(1, len(t)) for t in texts], np.float32)


class Model:
    """n-gram number to row (-1: unknown), the folded matrix (n-grams x languages), and the languages."""

    def __init__(self, texts: list[np.ndarray], labels: list[str], landmarks: int, ridge: float) -> None:
        keep = [(g, y) for g, y in zip(texts, labels) if len(g)]
        self.languages = sorted({y for _, y in keep})
        self.column = np.full(SPACE, -1, np.int64)
        if not keep:
            self.weights = np.zeros((0, 0), np.float32)
            return
        # landmarks in turn from each language, in sample order
        turn = {}
        rank = [(turn.setdefault(y, []).append(0) or len(turn[y]), i) for i, (_, y) in enumerate(keep)]
        marks = [keep[i][0] for _, i in sorted(rank)[:landmarks]]
        known = np.unique(np.concatenate(marks))
        self.column[known] = np.arange(len(known))
        mark, norm = presence(marks, self.column, len(known))
        mark = mark.astype(np.float64) / np.sqrt(norm)[:, None]
        values, vectors = np.linalg.eigh(mark @ mark.T)
        good = values > values.max() * 1e-6
        root = vectors[:, good] / np.sqrt(values[good])
        fold = mark.T @ root
        side, right = np.zeros((fold.shape[1],) * 2), np.zeros((fold.shape[1], len(self.languages)))
        for at in range(0, len(keep), SCORED_AT_ONCE):
            part = keep[at:at + SCORED_AT_ONCE]
            rows, norm = presence([g for g, _ in part], self.column, len(known))
            phi = (rows / np.sqrt(norm)[:, None]) @ fold
            target = np.array([[1.0 if y == name else 0.0 for name in self.languages] for _, y in part])
            side, right = side + phi.T @ phi, right + phi.T @ target
        self.weights = (fold @ np.linalg.solve(side + ridge * np.eye(len(side)), right)).astype(np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        grams = [present(t) for t in texts]
        able = [i for i, g in enumerate(grams) if len(g)]
        for at in range(0, len(able), SCORED_AT_ONCE):
            part = able[at:at + SCORED_AT_ONCE]
            rows, norm = presence([grams[i] for i in part], self.column, len(self.weights))
            y = (rows @ self.weights) / np.sqrt(norm)[:, None]
            for i, best, top in zip(part, y.argmax(1), y.max(1)):
                names[i], scores[i] = self.languages[best], min(1.0, max(0.0, float(top)))
        return names, scores


def packed(grams: np.ndarray) -> bytes:
    """The n-gram numbers as 32-bit integers or, if that is shorter, as one bit for each possible one."""
    if len(grams) * 32 < SPACE:
        return b"n" + grams.astype("<i4").tobytes()
    seen = np.zeros(SPACE, bool)
    seen[grams] = True
    return b"b" + np.packbits(seen).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    rest = data[1:]
    return np.frombuffer(rest, "<i4").astype(np.int64) if data[:1] == b"n" else np.flatnonzero(np.unpackbits(np.frombuffer(rest, np.uint8), count=SPACE))


def train(labelled: DataFrame, sample: int = 2000, landmarks: int = 200, ridge: float = 1e-2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on at most ``sample`` rows, as many of each language or all it has, chosen by a hash of the id.

    Every language has at least one row, if they are more than ``sample`` too.
    Executors take the n-grams from whole texts; of a text only its n-gram
    numbers (34 KB at most) reach the driver, and the model. Rows with null
    text or language are no use.
    """
    rows = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()
    if not counts:
        return Model([], [], landmarks, ridge)
    share = max(1, sample // len(counts))
    # some more than the share are drawn, the luckiest of them stay
    rate = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, (1.2 * share + 20) / r["n"]))])
    luck = (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    drawn = rows.withColumn("luck", luck).filter(F.col("luck") <= rate[F.col("lang")]).filter("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text", 2 << 20):
            grams = [packed(present(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("luck"), b.column("id"), b.column("lang"), pa.array(grams, pa.binary())], ["luck", "id", "lang", "grams"])

    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("lang").orderBy("luck", "id", "grams"))  # over the drawn rows, a few thousand at any size
    made = drawn.select("luck", "id", "lang", "text").mapInArrow(run, "luck double, id string, lang string, grams binary")
    got = made.withColumn("nth", nth).filter(F.col("nth") <= share).orderBy("nth", "lang").select("lang", "grams").collect()
    return Model([unpacked(r["grams"]) for r in got], [r["lang"] for r in got], landmarks, ridge)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) of every row from its whole text.

    Null text or text without a letter: ``und`` with score 0, as every text if
    nothing was learned. Ties go to the language first in the alphabet.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # n-grams x languages, bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text", 2 << 20):
            names, scores = shared.value.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents that get a language, whole rows with their own columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, text_col, 2 << 20):
            names, _ = shared.value.predict(b.column(at).cast(pa.string()).to_pylist())
            yield b.filter(pa.array([n != UNKNOWN for n in names]))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id as text leaves no rest by 5; a null id is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))
