"""Near copies by exact Jaccard similarity of word shingles.

SimHash components and MinHash bands only propose pairs; what they propose is
decided on the whole shingle sets. Fingerprints within two bits take in the
copies that differ least. Two texts of similarity s share none of the 32 bands
of five with chance (1 - s^5)^32, 3e-6 at 0.8 and less above.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from presage.llm.common import LOWER, UPPER, by_bytes, coded, strings, translated, words_of
from presage.llm import simhash
from presage.llm.components import components
from presage.session import cut_lineage

BANDS, ROWS = 32, 5
TEXT_BYTES = 2 << 20
LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
_RANDOM = np.random.default_rng(42)
PLACE = _RANDOM.integers(1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FACTOR = _RANDOM.integers(1 << 31, size=BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
FLIP = _RANDOM.integers(1 << 32, size=BANDS * ROWS, dtype=np.uint32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Of each text the distinct hashes of its shingles in order.

    A-Z lower-cased, words between white space, ``size`` words to a shingle;
    fewer words: the whole sequence; none: no shingle.
    """
    from xxhash import xxh64_intdigest

    words, counts = words_of(translated(strings(texts), LOWERED))
    codes, known = coded(words)
    hashed = np.array([xxh64_intdigest(w.as_py(), 42) for w in known], np.uint64)[codes] if len(codes) else np.zeros(0, np.uint64)
    ends = np.cumsum(counts)
    for a, b in zip(ends - counts, ends):
        k = min(size, b - a)
        own = hashed[a:b]
        runs = sum((own[i:len(own) - k + 1 + i] * PLACE[i] for i in range(k)), np.full(1 if k else 0, k, np.uint64))
        yield np.unique(_mixed(runs))


def bands(shingles: np.ndarray) -> np.ndarray:
    """One key per band: its number and the least values of its five hash orders."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    step = max(1, (1 << 20) // len(FACTOR))
    least = np.min([((low[i:i + step] ^ FLIP[:, None]) * FACTOR[:, None]).min(1) for i in range(0, len(low), step)], axis=0)
    keys = (least.reshape(BANDS, ROWS).astype(np.uint64) * PLACE[:ROWS]).sum(1, dtype=np.uint64)
    return _mixed(keys + np.arange(BANDS, dtype=np.uint64) * PLACE[ROWS])


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """set_key (hash of the shingle set), n (its size) and bands of every row (doc_id, text_key, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for b in by_bytes(batches, "text", TEXT_BYTES):
            sets = list(shingle_sets(b.column("text"), size))
            keys = np.array([xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).astype(np.int64)
            found = [bands(s).astype(np.int64) if len(s) else [] for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(keys), pa.array([len(s) for s in sets], pa.int32()), pa.array(found, pa.list_(pa.int64()))],
                                             ["doc_id", "text_key", "set_key", "n", "bands"])

    return docs.mapInArrow(run, "doc_id long, text_key long, set_key long, n int, bands array<long>")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """set_key and shingles of every row (set_key, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text", TEXT_BYTES):
            sets = [s.astype(np.int64) for s in shingle_sets(b.column("text"), size)]
            yield pa.RecordBatch.from_arrays([b.column("set_key"), pa.array(sets, pa.list_(pa.int64()))], ["set_key", "shingles"])

    return docs.mapInArrow(run, "set_key long, shingles array<long>")


def sets_of(ids: DataFrame, docs: DataFrame, firsts: DataFrame, size: int) -> DataFrame:
    """set_key and shingles of the asked set keys (id), made from one text of each."""
    asked = firsts.join(ids.distinct(), firsts["set_key"] == ids["id"], "left_semi").select("set_key", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("first_key"))
    asked = docs.join(asked.hint("merge"), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("first_key")))
    return cut_lineage(full_sets(asked.select("set_key", "text"), size).dropDuplicates(["set_key"]))


def alike(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) of set keys whose shingle sets reach the threshold."""
    both = pairs.join(sets.select(F.col("set_key").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("set_key").alias("b"), F.col("shingles").alias("sb")), "b")
    both = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("common"))
    return cut_lineage(both.filter(F.col("common") >= threshold * (F.col("na") + F.col("nb") - F.col("common")) - 1e-9).select("a", "b"))


def rare_posts(sets: DataFrame, threshold: float) -> DataFrame:
    """(bucket, id, n, after) for the rarest shingles of each set, so many that two sets within the threshold share one; ``after``: shingles from this one on."""
    tokens = sets.select("set_key", F.explode("shingles").alias("bucket"))
    counted = cut_lineage(tokens.groupBy("bucket").agg(F.count("*").alias("df")).filter("df > 1"))
    # shingles of one set only come first and meet nobody; they use up places all the same
    met = tokens.join(counted, "bucket").groupBy("set_key").agg(F.array_sort(F.collect_list(F.struct("df", "bucket"))).alias("o"))
    n = F.size("shingles")
    place = n - F.ceil(n * threshold - 1e-9) + 1 - (n - F.size("o"))
    posts = sets.join(met, "set_key").select(F.col("set_key").alias("id"), n.alias("n"), F.size("o").alias("shared"), F.posexplode(F.slice("o", F.lit(1), F.greatest(place, F.lit(0)).cast("int"))).alias("at", "t"))
    return posts.select(F.col("t.bucket").alias("bucket"), "id", "n", (F.col("shared") - F.col("at")).alias("after"))


def outside_largest(posts: DataFrame) -> DataFrame:
    """Rows of buckets with several roots, with the root most members have as ``main``."""
    parts = posts.groupBy("bucket", "root").agg(F.count("*").alias("c"))
    largest = parts.groupBy("bucket").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("k")).filter("k > 1").drop("k")
    return cut_lineage(posts.join(largest, "bucket"))


def print_posts(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """bucket, set_key, n: each set under the SimHash components (op2's operator, whole) of all its texts.

    Fingerprints within its distance are in one component, so no link is left
    out; which sets of a component are alike is decided as in a band's bucket.
    """
    found = simhash.near_duplicates(docs).select("text_key", "root").distinct()
    sets = prints.select("text_key", "set_key", "n").distinct()
    return sets.join(found.hint("merge"), "text_key").select(F.xxhash64(F.lit("simhash"), F.col("root")).alias("bucket"), "set_key", "n").distinct()


def links(docs: DataFrame, prints: DataFrame, firsts: DataFrame, threshold: float, size: int) -> DataFrame:
    """Edges (a, b) over set keys that join exactly the proposed pairs within the threshold, up to reachability.

    A bucket is a band's or a SimHash component's. Every member of it is held against three members of it, least
    in three orders. Only members of buckets left with several components are
    looked at again: those that share one of their rarest shingles and lie in
    different components meet, so unlike texts around one common passage do not.
    """
    distinct = prints.groupBy("set_key").agg(F.first("n").alias("n"), F.first("bands").alias("bands"))
    posts = distinct.select(F.explode("bands").alias("bucket"), "set_key", "n").unionByName(cut_lineage(print_posts(docs, prints))).withColumnRenamed("set_key", "id")
    orders = [F.struct(F.xxhash64("id", F.lit(k)).alias("at"), "id", "n") for k in range(3)]
    heads = posts.groupBy("bucket").agg(F.count("*").alias("members"), *[F.min(o).alias(f"h{k}") for k, o in enumerate(orders)]).filter("members > 1")
    heads = cut_lineage(heads.select("bucket", F.array_distinct(F.array(*[F.struct(F.col(f"h{k}.id").alias("id"), F.col(f"h{k}.n").alias("n")) for k in range(3)])).alias("heads")))
    shared = cut_lineage(posts.join(heads, "bucket").select("bucket", "id", "n", "heads"))
    fits = lambda m, n: F.least(m, n) >= threshold * F.greatest(m, n) - 1e-9
    star = shared.select("id", "n", F.explode("heads").alias("h")).filter((F.col("id") != F.col("h.id")) & fits(F.col("n"), F.col("h.n")))
    star = cut_lineage(star.select(F.least("id", "h.id").alias("a"), F.greatest("id", "h.id").alias("b")).distinct())
    first = alike(star, sets_of(star.select(F.explode(F.array("a", "b")).alias("id")), docs, firsts, size), threshold)

    roots = components(first).withColumnRenamed("node", "id")
    rooted = lambda posts: cut_lineage(posts.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")))
    sets = sets_of(outside_largest(rooted(shared.drop("heads"))).select("id"), docs, firsts, size)
    mixed = outside_largest(rooted(rare_posts(sets, threshold)))
    rest = mixed.filter("root != main").select("bucket", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("root").alias("rx"), F.col("after").alias("ax"))
    # at the first shingle two sets share in this order, no more can be shared than either has from there on
    enough = F.least("after", "ax") * (1 + threshold) >= threshold * (F.col("n") + F.col("nx")) - 1e-9
    cross = mixed.join(rest, "bucket").filter((F.col("root") != F.col("rx")) & fits(F.col("n"), F.col("nx")) & enough).select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b"))
    return first.unionByName(alike(cut_lineage(cross.distinct()), sets, threshold))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, fingerprint (key of its component), component_id (smallest doc_id reachable) of every row.

    Rows whose shingle sets have a Jaccard similarity of ``threshold`` or more
    are linked; texts without words are alike. A null doc_id counts as larger
    than any other.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    prints = cut_lineage(sketches(keyed, shingle))
    # the least of structs takes a null doc_id for the smallest, so the order says first whether it is null
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first")
    firsts = cut_lineage(prints.groupBy("set_key").agg(least))
    roots = components(links(keyed, prints, firsts, threshold, shingle))
    labelled = cut_lineage(firsts.join(roots, firsts["set_key"] == roots["node"], "left").select("set_key", F.col("first.doc_id").alias("first_id"), F.coalesce("root", "set_key").alias("root")))
    named = cut_lineage(labelled.groupBy("root").agg(F.min("first_id").alias("component_id")))
    told = cut_lineage(labelled.join(named, "root").select("set_key", "root", "component_id"))
    return prints.join(told.hint("merge"), "set_key").select("doc_id", "text_key", F.col("root").alias("fingerprint"), "component_id")
