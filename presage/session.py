"""Session helpers: lineage cuts on shared storage, tables, rounding."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; one of our own only for local runs."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="presage-"))
    return shared


_LOCAL: dict[str, str] = {}


def cut_lineage(df: DataFrame, reader: SparkSession | None = None, **how: str) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and read on from there.

    Survives lost executors, computes the input once, and gives later steps
    real file sizes, column pruning and pushed filters. ``reader``: the session
    that reads on, if another; ``how``: options of the writer.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/presage-{uuid.uuid4().hex}"
    df.write.options(**how).parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return (reader or spark).read.schema(df.schema).parquet(path)


#: Writer's options for rows of megabytes: the size of a row group is asked after each row, not after a hundred.
LARGE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1"}


def row_by_row(spark: SparkSession) -> SparkSession:
    """A session like ``spark`` that reads rows of megabytes one by one and hands them to Python so; thousands would meet in memory else."""
    own = spark.newSession()
    for key in ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch"):
        own.conf.set(key, "1")
    return own


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; zoneless timestamps are read as UTC instants."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def rounded(col):
    """Round to ten places, beyond the decimals of any input, with negative zero folded into zero."""
    return F.round(col, 10) + F.lit(0.0)
