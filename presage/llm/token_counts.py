"""Token counts of a unigram vocabulary without tokens: Aho-Corasick matches and a count-only Viterbi."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

CACHED_WORDS = 300_000
UNKNOWN_PENALTY = 10.0
SPACE = "▁"


class Counter:
    """Best score and number of pieces of texts.

    The rules of common unigram tokenizers: spaces become a mark in front of
    the next word and words are segmented alone; a character without a piece
    of its own costs the lowest score less 10 and falls back to its UTF-8
    bytes; of equal scores the path whose last piece starts first wins, as
    only a higher score replaces what is held.
    """

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        import ahocorasick

        self.tree = ahocorasick.Automaton()
        for piece, score in pieces:
            self.tree.add_word(piece, (len(piece), score))
        self.tree.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.lines = not any("\n" in p for p, _ in pieces)
        self.matching = bool(pieces)
        self.known: dict[str, tuple[float, int]] = {}

    def word(self, word: str) -> tuple[float, int]:
        """Forward over ends; the automaton lists an end's matches from the longest, so from the first start."""
        n = len(word)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        matches = self.tree.iter(word) if self.matching else iter(())
        held = next(matches, None)
        for end in range(1, n + 1):
            best, pieces, single = None, 0, False
            while held is not None and held[0] == end - 1:
                size, gain = held[1]
                got = score[end - size] + gain
                if best is None or got > best:
                    best, pieces = got, count[end - size] + 1
                single = single or size == 1
                held = next(matches, None)
            if not single and (best is None or score[end - 1] + self.unknown > best):
                best, pieces = score[end - 1] + self.unknown, count[end - 1] + len(word[end - 1].encode())
            score[end], count[end] = best, pieces
        return score[n], count[n]

    def __call__(self, text: str) -> tuple[float, int]:
        words = text.replace(SPACE, " ").split(" ")
        if text[:1] in (" ", SPACE, ""):
            words = words[1:]
        known, score, count = self.known, 0.0, 0
        for w in words:
            got = known.get(w)
            if got is None:
                got = self.lined(SPACE + w)
                if len(known) < CACHED_WORDS:
                    known[w] = got
            score += got[0]
            count += got[1]
        return score, count

    def lined(self, word: str) -> tuple[float, int]:
        """A word cut at line ends where no piece holds one: they are unknown characters of one byte each."""
        parts = word.split("\n") if self.lines else [word]
        got = [self.word(p) for p in parts]
        return sum(s for s, _ in got) + self.unknown * (len(parts) - 1), sum(c for _, c in got) + len(parts) - 1


def unigram_pieces(path: str) -> list[tuple[str, float]]:
    """Ordinary pieces and scores of a vocabulary file of the sentencepiece library."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


_COUNTERS: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, score of every row; ``vocabulary`` is a file every worker can read.

    Null or empty text has no tokens and score 0. Texts are taken whole, as
    they are (no Unicode normalisation); strings of special tokens are ordinary
    text. Repeated rows and null ids are rows of their own.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _COUNTERS.setdefault(vocabulary, None) or _COUNTERS.update({vocabulary: Counter(unigram_pieces(vocabulary))}) or _COUNTERS[vocabulary]
        for b in batches:
            got = [counter(t.as_py() or "") for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([c for _, c in got], pa.int64()), pa.array([s for s, _ in got], pa.float64())], ["doc_id", "n_tokens", "score"])
            if len(counter.known) >= CACHED_WORDS:
                counter.known.clear()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, score double")
