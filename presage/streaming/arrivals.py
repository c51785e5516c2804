"""Near-duplicate articles as they arrive, against a persisted table of bands."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from presage.operators import similarity as SM
from presage.session import cut_lineage


class BandTable:
    """Kept fingerprints under each of their band keys, bucketed and sorted by band key.

    A micro-batch joins it without moving it. Rows carry the batch that brought
    them; a batch sees earlier ones only, so a batch that runs again finds what
    it found before and adds only what of it is missing. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32) -> None:
        self.spark, self.buckets = spark, buckets
        self.name = "bands_" + hashlib.md5(path.encode()).hexdigest()[:16]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (bucket BIGINT, seq BIGINT, id BIGINT, epoch BIGINT) USING parquet "
            f"CLUSTERED BY (bucket) SORTED BY (bucket) INTO {buckets} BUCKETS LOCATION '{path}'")

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)  # a stream writes from a session of its own, whose file list is another
        return self.spark.table(self.name)

    def before(self, epoch: int) -> DataFrame:
        return self.rows().filter(F.col("epoch") < epoch).select("bucket", "seq", "id")

    def extend(self, posts: DataFrame, epoch: int) -> None:
        there = self.rows().filter(F.col("epoch") == epoch).select("bucket", "seq")
        fresh = posts.select("bucket", "seq", "id", F.lit(epoch).cast("long").alias("epoch"))
        if not there.isEmpty():  # the batch runs again
            fresh = cut_lineage(fresh.join(there.hint("merge"), ["bucket", "seq"], "left_anti"))
        fresh.repartition(self.buckets, "bucket").write.insertInto(self.name)


def keep_first(bands: BandTable, out: str, text: str, distance: int = 8) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer: id, fp, canonical of every arriving row (id, text), a folder per batch under ``out``.

    ``id`` is the order of arrival. A text belongs to the first kept text within
    ``distance`` bits; if there is none, also among earlier rows of its batch,
    it is kept. Kept texts of earlier batches come first, so only rows without a
    match there are held against each other. Null texts and those of fewer than
    three words share the fingerprint zero.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        fp = cut_lineage(SM.simhash(batch, text))
        items = cut_lineage(SM.fingerprint_items(fp))
        # tables as long as the batch are merged: a broadcast would hold them in the driver
        stored = cut_lineage(SM.first_match(SM.sequenced_postings(items, distance).hint("merge"), bands.before(epoch), distance))
        rest = cut_lineage(items.join(stored.select("seq").hint("merge"), "seq", "left_anti"))
        matched = SM.first_among(rest, distance)
        told = items.join(stored.unionByName(matched).hint("merge"), "seq", "left").select(F.col("id").alias("fp"), F.coalesce("canonical", "seq").alias("canonical"))
        fp.join(told.hint("merge"), "fp").select("id", "fp", "canonical").write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        kept = rest.join(matched.filter("canonical <> seq").select("seq").hint("merge"), "seq", "left_anti")
        bands.extend(SM.sequenced_postings(kept, distance), epoch)

    return write
