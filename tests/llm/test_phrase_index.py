"""What the index holds in memory at once."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from presage.llm import phrase_index


def test_shards_are_held_one_by_one(spark, monkeypatch):
    """Shards are megabytes: a row group and an Arrow batch hold few, however many a partition has."""
    monkeypatch.setattr(phrase_index, "SHARD_BYTES", 1 << 16)
    monkeypatch.setattr(phrase_index, "LARGE_ROWS", phrase_index.LARGE_ROWS | {"parquet.block.size": str(1 << 18)})
    docs = spark.range(40).coalesce(1).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(1, 5000), i -> concat('w', xxhash64(id, i))), ' ')").alias("text"))
    index = phrase_index.build_index(docs)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    shards = index.count()
    assert shards >= 40 and [r.n for r in index.mapInArrow(sizes, "n long").collect()] == [1] * shards
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.inputFiles()]
    assert sum(m.num_row_groups for m in files) >= shards / 4
    items = spark.createDataFrame([("a", None)], "item_id string, text string").unionByName(docs.filter("doc_id = 7").selectExpr("'b' AS item_id", "substring_index(text, ' ', 30) AS text"))
    found = phrase_index.search(index, items)
    assert found.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found.count() == 40 and [(r.doc_id, r["items"]) for r in found.filter(F.size("spans") > 0).collect()] == [(7, ["b"])]
