"""SimHash near-duplicates by the generalised pigeonhole principle.

Bits that move together form a part. If the radii of the parts satisfy
sum(radius + 1) = distance + 1 (radius -1: part unused), two fingerprints
within the distance agree within some part's radius. A dynamic program gives
each fingerprint the radii with the fewest expected candidates, so a part with
a crowded value is left out and another is searched wider.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from presage.llm.components import components
from presage.session import cut_lineage

BITS = 64
CROWDED = 4 * (BITS + 1)


def fingerprint_bytes(text: bytes, shingle: int) -> bytes:
    from xxhash import xxh64_digest

    words = text.lower().split()
    if not words:
        return bytes(8)
    if len(words) < shingle:
        hashed = [xxh64_digest(b" ".join(words), 42)]
    else:
        hashed = [xxh64_digest(b" ".join(x), 42) for x in zip(*(words[i:] for i in range(shingle)))]
    bits = np.frombuffer(b"".join(hashed), np.uint8).reshape(-1, 8)
    count = np.zeros(BITS, np.int64)
    for i in range(0, len(bits), 255):
        count += np.unpackbits(bits[i:i + 255], axis=1).sum(0, dtype=np.uint8)
    return np.packbits(count * 2 > len(bits)).tobytes()


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key (hash of the text, null as empty) and fingerprint of every row.

    A-Z lower-cased, words between white space, ``shingle`` words joined by one
    space, repeats included; fewer words: the whole sequence; none: zero.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = b"".join(fingerprint_bytes(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(np.frombuffer(got, ">i8").astype(np.int64))], ["doc_id", "text_key", "fingerprint"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, text_key long, fingerprint long")


def bit_moments(prints: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how many have both bit i and bit j: 64 x 64 sums, added up on executors."""
    def run(batches):
        n, both = 0, np.zeros((BITS, BITS))
        for b in batches:
            x = np.unpackbits(b.column(0).to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            n, both = n + len(x), both + x.T @ x
        i, j = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *i], pa.int32()), pa.array([-1, *j], pa.int32()), pa.array([n, *both[i, j].astype(np.int64)], pa.int64())], ["i", "j", "n"])

    total, both = 0, np.zeros((BITS, BITS))
    for r in prints.select("fingerprint").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        if r["i"] < 0:
            total = r["n"]
        else:
            both[r["i"], r["j"]] = r["n"]
    return total, both


def group_bits(total: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits (0: highest) in ``parts`` groups of near-equal size, correlated bits together."""
    p = np.diag(both) / max(total, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs((both / max(total, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    left, out = list(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        part = [max(left, key=lambda b: (tie[b, left].sum(), -b))]
        while len(part) < size:
            part.append(max((b for b in left if b not in part), key=lambda b: (tie[b, part].mean(), -b)))
        out.append(sorted(part))
        left = [b for b in left if b not in part]
    return out


def differing(chance: np.ndarray, most: int) -> np.ndarray:
    """Probability that exactly 0..most of independent bits differ."""
    dist = np.zeros(most + 1)
    dist[0] = 1
    for c in chance:
        dist[1:] = dist[1:] * (1 - c) + dist[:-1] * c
        dist[0] *= 1 - c
    return dist


def allocate(counts: np.ndarray, expected: np.ndarray, probes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Radii of least cost per row and that cost.

    ``counts`` (rows x parts): fingerprints with the row's very value in the part.
    ``expected`` (parts x distance + 1): candidates a wider radius adds.
    ``probes`` alike: values to look up. The program runs over parts and over
    what is left of distance + 1.
    """
    rows, parts = counts.shape
    best = np.full((rows, distance + 2), np.inf)
    best[:, 0] = 0
    chosen = np.zeros((parts, rows, distance + 2), np.int8)
    for i in range(parts):
        now = np.full_like(best, np.inf)
        for spent in range(distance + 2):
            for r in range(-1, spent):
                cost = best[:, spent - r - 1] + (0 if r < 0 else counts[:, i] - 1 + expected[i, r] + probes[i, r])
                better = cost < now[:, spent]
                now[better, spent] = cost[better]
                chosen[i, better, spent] = r
        best = now
    radii, left = np.zeros((rows, parts), np.int8), np.full(rows, distance + 1)
    for i in range(parts - 1, -1, -1):
        radii[:, i] = chosen[i, np.arange(rows), left]
        left = left - radii[:, i] - 1
    return radii, best[:, distance + 1]


def links(prints: DataFrame, distance: int = 2, parts: int = 3) -> DataFrame:
    """Edges (a, b) over distinct fingerprints that join exactly those within ``distance``, up to reachability.

    Every pair within the distance is an edge, but for pairs of crowded
    fingerprints (more than ``CROWDED`` expected candidates): these meet at the
    values halfway between them (all within distance 2), each group of which
    becomes a star. So a fingerprint costs a bounded number of rows however
    dense its surroundings are. Needs ``distance`` 2 or less for that.
    """
    if not 0 < distance <= 2:
        raise ValueError("distance must be 1 or 2")
    total, both = bit_moments(prints)
    groups = group_bits(total, both, parts)
    signed = lambda bits: int(np.array(sum(1 << (BITS - 1 - b) for b in bits), np.uint64).astype(np.int64))
    masks = [signed(g) for g in groups]
    p = np.diag(both) / max(total, 1)
    expected = np.array([np.cumsum([0, *differing(2 * p[g] * (1 - p[g]), distance)[1:]]) * total for g in groups])
    flips = [(i, r, signed(c)) for i, g in enumerate(groups) for r in range(distance + 1) for c in combinations(g, r)]
    probes = np.array([np.cumsum([sum(1 for x in flips if x[:2] == (i, r)) for r in range(distance + 1)]) for i in range(parts)], float)

    value = lambda col: F.explode(F.array(*[F.struct(F.lit(i).alias("part"), col.bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(masks)])).alias("x")
    postings = cut_lineage(prints.select("fingerprint", value(F.col("fingerprint"))).select("fingerprint", "x.*"))
    sizes = postings.groupBy("part", "value").agg(F.count("*").alias("n"))
    seen = postings.join(sizes, ["part", "value"]).groupBy("fingerprint").agg(*[F.max(F.when(F.col("part") == i, F.col("n"))).alias(f"n{i}") for i in range(parts)])

    def run(batches):
        for b in batches:
            radii, cost = allocate(np.stack([b.column(f"n{i}").to_numpy().astype(float) for i in range(parts)], 1), expected, probes, distance)
            yield pa.RecordBatch.from_arrays([b.column("fingerprint"), pa.array(list(radii.astype(np.int32)), pa.list_(pa.int32())), pa.array(cost)], ["fingerprint", "radii", "cost"])

    plan = cut_lineage(seen.mapInArrow(run, "fingerprint long, radii array<int>, cost double"))
    table = F.broadcast(prints.sparkSession.createDataFrame(flips, "part int, need int, flip long"))  # a few hundred rows at any size
    mask = lambda part: F.element_at(F.array(*[F.lit(m) for m in masks]), part + 1)
    probe = plan.filter(F.col("cost") <= CROWDED).select("fingerprint", F.posexplode("radii").alias("part", "radius")).join(table, "part").filter(
        F.col("need") <= F.col("radius")).select("part", F.col("fingerprint").bitwiseAND(mask(F.col("part"))).bitwiseXOR(F.col("flip")).alias("value"), F.col("fingerprint").alias("a"))
    found = probe.alias("q").join(
        postings.withColumnRenamed("fingerprint", "b").alias("p"),
        (F.col("q.part") == F.col("p.part")) & (F.col("q.value") == F.col("p.value")) & (F.col("a") != F.col("b")) & (apart(F.col("a"), F.col("b")) <= distance)).select("a", "b")
    crowd = plan.filter(F.col("cost") > CROWDED).select("fingerprint")
    if not crowd.isEmpty():
        halfway = crowd.select(F.col("fingerprint").alias("a"), F.explode(F.array(*[F.col("fingerprint").bitwiseXOR(F.lit(signed([b]) if b >= 0 else 0)) for b in range(-1, BITS)])).alias("mid"))
        if distance == 1:
            halfway = crowd.select(F.col("fingerprint").alias("a"), F.explode(F.array(*[F.struct(F.lit(b).alias("bit"), F.col("fingerprint").bitwiseAND(F.lit(~signed([b]))).alias("rest")) for b in range(BITS)])).alias("mid"))
        halfway = cut_lineage(halfway)
        found = found.unionByName(halfway.join(halfway.groupBy("mid").agg(F.min("a").alias("b")), "mid").filter("a != b").select("a", "b"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def near_duplicates(docs: DataFrame, distance: int = 2, parts: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, fingerprint, component_id (smallest doc_id reachable), root (smallest fingerprint reachable) of every row.

    Rows whose fingerprints differ in ``distance`` bits or fewer are linked.
    Null text counts as empty; texts without words share the fingerprint zero.
    A null doc_id counts as larger than any other; a component of null ids has
    a null id. Repeated rows give repeated results. An empty table: no rows.
    """
    rows = cut_lineage(fingerprints(docs, shingle, id_col, text_col))
    firsts = cut_lineage(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(firsts.select("fingerprint"), distance, parts))
    labelled = firsts.join(roots, firsts["fingerprint"] == roots["node"], "left").select("fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root"))
    labelled = cut_lineage(labelled)
    named = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    told = cut_lineage(labelled.join(cut_lineage(named), "root").select("fingerprint", "component_id", "root"))
    return rows.join(told.hint("merge"), "fingerprint").select("doc_id", "text_key", "fingerprint", "component_id", "root")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: Callable[..., DataFrame] = near_duplicates, **how) -> DataFrame:
    """The documents that stay, whole rows: of each component of ``near`` the one with the smallest doc_id.

    Of several rows with that doc_id the one with the smallest text hash stays;
    a component of null ids keeps one row.
    """
    from pyspark.sql import Window

    own = docs.columns
    found = near(docs, id_col=id_col, text_col=text_col, **how).groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("lone")).agg(
        F.min(F.when(F.col("doc_id").eqNullSafe(F.col("component_id")), F.struct("text_key"))).alias("first"))
    stay = found.select(F.col("component_id").alias("__stay_id"), F.col("first.text_key").alias("__stay_key"))
    marked = docs.select(*[F.col(f"`{c}`") for c in own], F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("__text_key"))
    joined = marked.join(stay.hint("merge"), F.col(id_col).cast("long").eqNullSafe(F.col("__stay_id")) & (F.col("__text_key") == F.col("__stay_key")))
    nth = F.row_number().over(Window.partitionBy(F.col(id_col), "__text_key").orderBy(F.lit(0)))
    return joined.withColumn("__nth", nth).filter("__nth = 1").select(*[F.col(f"`{c}`") for c in own])
