"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. A new batch is
reduced to one row per digest, meets the index in a sort-merge anti join that
shuffles only the batch, and what is new is appended bucket by bucket.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from presage.llm.common import ascii_lower
from presage.session import checkpoint_dir, cut_lineage


class DigestIndex:
    """Digests seen so far: the document that stands for each, and the batch that brought it.

    ``path`` is a folder on storage that all executors share; opening it again
    goes on with what is there, in as many buckets as it was made with (kept in
    ``path``.buckets). One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        self.spark = spark
        self.buckets = self._kept_buckets(f"{path}.buckets", buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.name = "digest_index_" + hashlib.md5(path.encode()).hexdigest()[:16]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'")

    def _kept_buckets(self, path: str, wanted: int) -> int:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
        if not target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            self.spark.range(1).select(F.lit(wanted).alias("buckets")).write.mode("overwrite").parquet(path)
        return self.spark.read.schema("buckets int").parquet(path).first()["buckets"]

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, digests: DataFrame, batch: str | None = None) -> DataFrame:
        """Rows of ``digests`` (one per digest) that the index lacks, or has from this very batch alone."""
        known = self.rows().filter(~F.col("batch").eqNullSafe(F.lit(batch)))
        return digests.join(known.hint("merge"), "digest", "left_anti")

    def append(self, digests: DataFrame, batch: str | None = None) -> None:
        """Adds what the index lacks whole, so a second append of a batch adds nothing."""
        digests.select("digest", "keep_id", F.lit(batch).cast("string").alias("batch")).repartition(self.buckets, "digest").write.insertInto(self.name)


def digest(text):
    """SHA-256 of the text with A-Z lower-cased; null counts as empty."""
    return F.sha2(ascii_lower(text), 256)


def open_fresh(spark: SparkSession) -> DigestIndex:
    """An empty index in the shared folder."""
    return DigestIndex(spark, f"{checkpoint_dir(spark)}/digests-{uuid.uuid4().hex}")


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return cut_lineage(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(digest(F.col(text_col))).alias("digest")))


def deduplicate(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """Settle a batch against the index and add what is new to it.

    One row per input row: doc_id, keep_id, group_size, kept, text_sha256.
    Of equal texts that the index has not seen, the largest doc_id stays; if
    the index has the text, its document stays and the whole batch's copies
    go. ``group_size`` counts the batch's rows. Null text equals empty text. A
    null doc_id is the smallest: it stays only when alone with its text, and
    keep_id is null then. Rows that repeat both text and doc_id all carry
    ``kept``; ``survivors`` leaves one of them. An empty batch gives no rows.

    A job can die between the append and the storing of its result. Run again
    under the same ``batch`` name, the batch's own digests count as new, so
    the result is the same. Without a name each call is a batch of its own.

    A hot text is counted map-side and its rows stay narrow (id and digest);
    the join back is between two shuffled sides, which Spark splits if skewed.
    """
    batch = batch or uuid.uuid4().hex
    rows = _narrow(docs, id_col, text_col)
    groups = cut_lineage(rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    fresh = cut_lineage(index.unseen(groups, batch))
    earlier = index.rows().filter(F.col("batch") != batch).groupBy("digest").agg(F.max("keep_id").alias("kept_id"))
    known = groups.join(earlier.hint("merge"), "digest").select("digest", F.col("kept_id").alias("keep_id"), "group_size", F.lit(False).alias("new"))
    state = cut_lineage(known.unionByName(fresh.select("digest", "keep_id", "group_size", F.lit(True).alias("new"))))
    index.append(fresh.join(index.rows().hint("merge"), "digest", "left_anti"), batch)
    return rows.join(state.hint("merge"), "digest").select(
        "doc_id", "keep_id", "group_size", (F.col("new") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate_largest(docs: DataFrame, index: DigestIndex, batches: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``deduplicate`` for a table that comes in ``batches`` parts, of which the largest doc_id stays whatever part it is in.

    Each part meets what the earlier ones left in the index and appends its
    digests that are new or have a larger doc_id. In the end the index, read
    again, says which row stays. ``group_size`` counts all parts. The index
    must hold nothing but these documents.
    """
    rows = _narrow(docs, id_col, text_col)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(batches))
    for b in range(batches):
        groups = rows.filter(part == b).groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
        seen = index.rows().select("digest", F.col("keep_id").alias("seen_id"), F.lit(True).alias("seen")).hint("merge")
        better = groups.join(seen, (groups["digest"] == seen["digest"]) & (F.col("keep_id").isNull() | F.coalesce(F.col("seen_id") >= F.col("keep_id"), F.lit(False))), "left_anti")
        index.append(cut_lineage(better), str(b))
    sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
    stays = index.rows().groupBy("digest").agg(F.max("keep_id").alias("keep_id"))
    state = cut_lineage(sizes.join(stays.hint("merge"), "digest"))
    return rows.join(state.hint("merge"), "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def survivors(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, whole rows with their own columns, one per text.

    Same rules as ``deduplicate``; of rows that repeat text and doc_id, any one stays.
    """
    own = docs.columns
    told = deduplicate(docs, index, id_col, text_col).filter("kept").select(
        F.col("keep_id").alias("__keep_id"), F.col("text_sha256").alias("__digest")).distinct()
    marked = docs.select(*[F.col(f"`{c}`") for c in own], digest(F.col(text_col)).alias("__own_digest"))
    found = marked.join(told.hint("merge"), (F.col("__own_digest") == F.col("__digest")) & F.col(id_col).cast("long").eqNullSafe(F.col("__keep_id")))
    from pyspark.sql import Window

    one = Window.partitionBy("__own_digest", F.col(id_col)).orderBy(F.lit(0))
    return found.withColumn("__nth", F.row_number().over(one)).filter("__nth = 1").select(*[F.col(f"`{c}`") for c in own])
