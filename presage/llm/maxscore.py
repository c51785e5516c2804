"""Exact top-k by inner product with MaxScore over an inverted index.

A term is a dimension with a sign; its postings are the vectors with a value of
that sign there. A query's value of the same sign makes a term that adds to the
score, bounded by its largest posting; the opposite sign only takes away. The
terms whose bounds together stay below the k-th best score are non-essential:
a vector in none of the other terms' postings cannot enter. Vectors met in
essential postings are probed for the rest while their bound is competitive.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from presage.session import cut_lineage

#: Components an index shard holds, and vectors in its first and its other blocks.
SHARD_CELLS, FIRST_BLOCK, BLOCK = 1 << 19, 512, 4096
PROBES = 8
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


class Shard:
    """Inverted index of some vectors: ids (row numbers), names (vec_id, null last among ties), values (n x dimensions)."""

    def __init__(self, rows: np.ndarray, names: np.ndarray, unnamed: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(rows)
        self.rows, self.names, self.unnamed, self.values = rows[order], names[order], unnamed[order], values[order]
        n = len(rows)
        self.blocks = np.array([0, *range(min(FIRST_BLOCK, n), n, BLOCK), n])
        self.largest = np.abs(self.values.astype(float)).max(0) if n else np.zeros(values.shape[1])
        self.exact = self.values.astype(np.float64)
        self.postings = {}
        for i in range(values.shape[1]):
            for sign in (1, -1):
                own = np.flatnonzero(np.sign(self.values[:, i]) == sign)
                if len(own):
                    impact = np.abs(self.exact[own, i])
                    self.postings[i, sign] = own, impact, np.searchsorted(own, self.blocks), impact.max()

    def search(self, query: np.ndarray, row: int, k: int) -> list[tuple[int, int | None]]:
        """The k best (score, vec_id) but for the query's own row, best first, ties to the smaller vec_id."""
        dims = np.flatnonzero(query[:self.values.shape[1]])
        q = query[dims]
        if float((np.abs(q.astype(float)) * self.largest[dims]).sum()) < EXACT:
            q, values, number = q.astype(np.float64), self.exact, float
        else:
            q, values, number = q.astype(object), self.values.astype(object), int
        sign, size = np.sign(query[dims]).astype(np.int64), np.abs(q)
        terms = [self.postings.get((int(i), int(s))) for i, s in zip(dims, sign)]
        bound = np.array([0 if t is None else z * number(t[3]) for z, t in zip(size, terms)], q.dtype)
        rank = sorted(range(len(dims)), key=lambda t: bound[t])
        most = np.cumsum(bound[rank]) if len(dims) else bound
        own = int(np.searchsorted(self.rows, row))
        own = own if own < len(self.rows) and self.rows[own] == row else -1
        best_score, best_at = np.zeros(0, q.dtype), np.zeros(0, np.int64)
        for b, (start, stop) in enumerate(zip(self.blocks[:-1], self.blocks[1:])):
            bar = best_score[-1] if len(best_score) == k else None
            every = bar is None or bar <= 0  # then a vector in no posting may still enter
            spare = 0 if every else next((t for t in range(len(rank)) if most[t] >= bar), len(rank))
            if not every and spare == len(rank):
                break
            got = np.zeros(stop - start, q.dtype)
            for t in rank[spare:]:
                if terms[t] is not None:
                    docs, impact, cuts, _ = terms[t]
                    x = slice(cuts[b], cuts[b + 1])
                    got[docs[x] - start] += size[t] * (impact[x] if number is float else np.abs(values[docs[x], dims[t]]))
            met = np.arange(stop - start) if every else np.flatnonzero(got > 0)
            met = met[met + start != own]
            rest = most[spare - 1] if spare else 0
            competes = lambda met: met if bar is None else met[got[met] + rest >= bar]
            met = competes(met)
            # essential terms' opposite signs only take away
            used = np.array(rank[spare:], np.int64)
            for part in np.split(used, range(PROBES, len(used), PROBES)):
                if len(part) and len(met):
                    got[met] += np.minimum(values[np.ix_(met + start, dims[part])] * sign[part], 0) @ size[part]
                    met = competes(met)
            # the others, largest bound first
            for end in range(spare, 0, -PROBES):
                if not len(met):
                    break
                part = np.array(rank[max(0, end - PROBES):end], np.int64)
                got[met] += values[np.ix_(met + start, dims[part])] @ q[part]
                rest = most[end - PROBES - 1] if end > PROBES else 0
                met = competes(met)
            if len(met):
                score, at = np.concatenate([best_score, got[met]]), np.concatenate([best_at, met + start])
                top = np.lexsort((self.names[at], self.unnamed[at], -score if number is float else _places(-score)))[:k]
                best_score, best_at = score[top], at[top]
        return [(int(s), None if self.unnamed[a] else int(self.names[a])) for s, a in zip(best_score, best_at)]


def _long(x: int) -> int:
    return max(-LONG - 1, min(LONG, x))


def _places(x: np.ndarray) -> np.ndarray:
    """Order of Python integers as small numbers."""
    return np.unique(x, return_inverse=True)[1]


def _matrix(rows: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for r, x in zip(out, rows):
        r[:len(x)] = x
    return out


def _vectors(column: pa.Array) -> list[np.ndarray]:
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(offsets, offsets[1:])]


def quantised(vector: Column, factor: float = 256.0) -> Column:
    """floor(factor * x) of every component as long; null if the vector or a component is null, or one is not finite."""
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(x.isNotNull() & ~bad, F.transform(x, lambda v: F.floor(v * factor)))


def indexed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """row (a number of its own), vec_id and values of every usable vector, as a written table."""
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col)).alias("values")).filter("values is not null")
    return cut_lineage(own.select(F.monotonically_increasing_id().alias("row"), "vec_id", "values"))


def top_k(index: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_row, query_id, rank, vec_id, score: the k best rows of ``index`` for each row of ``queries`` (both as of ``indexed``).

    The score is the integer inner product; a shorter vector counts as filled
    with zeros. Sums are ranked as they are (up to 126 bits) and given as long,
    at its limits where they go beyond. A query never meets its own row, though
    other rows with its vec_id. Ties go to the smaller vec_id, null last. Fewer
    than k rows: all of them.

    The index is cut into shards of a bounded number of components, whatever
    their ids. Each shard's task holds its postings and lets the queries stream
    by, so a query is sent once to each shard and no pair of rows is ever
    listed; the shards' lists are merged per query.
    """
    cells = index.agg(F.sum(F.size("values") + F.lit(1)).alias("cells")).first()["cells"] or 1
    shards = math.ceil(cells / SHARD_CELLS)
    held = index.select((F.col("row") % shards).cast("int").alias("shard"), F.lit(0).alias("kind"), "row", "vec_id", "values")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "row", "vec_id", "values")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, names, unnamed, values, shard = [], [], [], [], None
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            split = int(np.searchsorted(kinds, 1))
            docs, asks = batch.slice(0, split), batch.slice(split)
            if docs.num_rows:
                names_in = docs.column("vec_id")
                rows.append(docs.column("row").to_numpy())
                names.append(names_in.fill_null(0).to_numpy())
                unnamed.append(names_in.is_null().to_numpy(zero_copy_only=False))
                values += [v.copy() for v in _vectors(docs.column("values"))]
            if asks.num_rows and rows:
                if shard is None:
                    shard, values = Shard(np.concatenate(rows), np.concatenate(names), np.concatenate(unnamed), _matrix(values)), []
                out = []
                for row, name, query in zip(asks.column("row").to_pylist(), asks.column("vec_id").to_pylist(), _vectors(asks.column("values"))):
                    out += [(row, name, _long(score), _long(score >> 63), score & LONG, vec_id) for score, vec_id in shard.search(query, row, k)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["query_row", "query_id", "score", "high", "low", "vec_id"])

    dealt = held.unionByName(asked).repartitionById(shards, F.col("shard")).sortWithinPartitions("kind")
    found = dealt.mapInArrow(run, "query_row long, query_id long, score long, high long, low long, vec_id long")
    from pyspark.sql import Window

    best = Window.partitionBy("query_row").orderBy(F.desc("high"), F.desc("low"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_row", "query_id", "rank", "vec_id", "score")
