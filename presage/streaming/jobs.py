"""Structured Streaming forms of the ledger, board and telemetry jobs."""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from presage.functions import scalars as S
from presage.operators.scoring import before_outcome
from presage.session import checkpoint_dir, table


def once_per_key(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """First row of a key within the watermark; later repeats are dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def reject_late(stream: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Rows about a closed question that are dated after its outcome never enter."""
    return stream.join(outcomes, "market_id").filter(before_outcome(F.col("article_date"), F.col("outcome_date")))


def running_board(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Additive board: counts and mean Brier per source, updated with every batch."""
    p = S.prob(F.col("stance"))
    return scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("claims"), F.avg(S.brier(p, F.col("outcome"))).alias("brier"),
                                     F.avg(S.directional_hit(F.col("stance"), F.col("outcome")).cast("double")).alias("accuracy"))


def windowed_counts(stream: DataFrame, time: str, key: str, delay: str, size: str = "48 hours", slide: str = "1 hour") -> DataFrame:
    """Counts per key over sliding windows, final once the watermark has passed."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, size, slide), key).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")


def append_once_sink(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer of an unbounded-key ledger: unseen keys only.

    A batch is written to its own folder, overwritten on replay, and compared
    with the folders of other batches only, so a retried batch repeats itself.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
            old = spark.read.schema(T.StructType([*batch.schema.fields, T.StructField("epoch", T.LongType())])).parquet(path).filter(F.col("epoch") != epoch)
            fresh = fresh.join(old.select(key), key, "left_anti").select(*batch.columns)
        fresh.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def latest_state(stream: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """Last state of every key so far, one row of state per key (``complete`` mode)."""
    last = F.max_by(F.struct(*values), F.col(order)).alias("_last")
    return stream.groupBy(*keys).agg(last).select(*keys, "_last.*")


def without_retracted(stream: DataFrame, key: str, order: str, action: str, retracts: str) -> DataFrame:
    """Ledger with retraction: a key counts while its last entry is no retraction."""
    return latest_state(stream, [key], order, [order, action]).filter(F.col(action) != retracts)


def in_evidence_window(stream: DataFrame, questions: DataFrame, key: str, day: str, lookback_days: int) -> DataFrame:
    """Evidence dated from ``lookback_days`` before a question was made until its deadline; undated rows and open ends pass."""
    d = F.col(day)
    late, early = d > F.col("claim_deadline"), d < F.date_sub("claim_created", lookback_days)
    return stream.join(questions.select(key, "claim_created", "claim_deadline"), key).filter(~F.coalesce(late, F.lit(False)) & ~F.coalesce(early, F.lit(False)))


def tumbling_counts(stream: DataFrame, time: str, key: str, delay: str, size: str = "48 hours") -> DataFrame:
    """Counts per key over fixed windows; anchored windows, which start at their first claim, are a batch report."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, size), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def cell_states(runs: DataFrame, keys: list[str], order: str, status: str, max_attempts: int = 3) -> DataFrame:
    """Last status of each cell, its failures so far, and whether they have parked it."""
    failed = F.count_if(F.col(status) == "failed")
    board = runs.groupBy(*keys).agg(F.max_by(status, order).alias("status"), failed.alias("failed"))
    return board.withColumn("parked", (F.col("status") == "failed") & (F.col("failed") >= max_attempts))


#: Of the markets of a shard: their ids and last asked seconds (NaN: never), whether a position is open, and the millisecond after which they are idle.
MARKET_STATE = "ids binary, asked binary, opened binary, until binary"
MARKET_OUT = "market_id long, seq long, ask boolean, trade string"
MARKET_IDLE_DAYS = 90


def market_decisions(snapshots: DataFrame, stale_hours: float = 20.0, threshold: float = 0.10, delay: str = "1 day", shards: int = 2048) -> DataFrame:
    """Ask-again and one-open-position decisions with state per market.

    ``snapshots``: market_id, seq, ts, market_yes, model_yes, closed. State is
    two values per market, dropped ninety days after its last snapshot. Markets
    are dealt to ``shards``, so a micro-batch calls Python once a shard and not
    once a market, and writes the state of the shards it has rows of. The rows
    of a market in one micro-batch, which the trigger bounds, are decided in order.
    """
    def decide(rows: list[tuple], asked: float | None, opened: bool) -> tuple[list[bool], list[str | None], float | None, bool]:
        asks, trades = [], []
        for _, micros, market_yes, model_yes, closed in rows:
            now = micros / 1e6
            usable = not closed and pd.notna(market_yes)
            ask = usable and 0.02 <= market_yes <= 0.98 and (asked is None or now - asked >= stale_hours * 3600)
            if ask:
                asked = now
            trade = None
            if usable and not opened and pd.notna(model_yes) and 0.05 <= market_yes <= 0.95:
                edge = round(model_yes - market_yes, 4)
                trade = "YES" if edge >= threshold else "NO" if edge <= -threshold else None
                opened = trade is not None
            asks.append(ask)
            trades.append(trade)
        return asks, trades, asked, opened

    def known(state: GroupState) -> dict[int, tuple[float | None, bool, int]]:
        if not state.exists:
            return {}
        ids, asked, opened, until = (np.frombuffer(x, kind).tolist() for x, kind in zip(state.get, (np.int64, np.float64, np.bool_, np.int64)))
        return {i: (None if a != a else a, o, u) for i, a, o, u in zip(ids, asked, opened, until)}

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        markets, fresh, now = known(state), defaultdict(list), state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            for b in batches:
                ts = b["ts"].to_numpy().astype("datetime64[us]").astype("int64").tolist()
                for market, *row in zip(b["market_id"].tolist(), b["seq"].tolist(), ts, *[b[c].to_numpy().tolist() for c in ("market_yes", "model_yes", "closed")]):
                    fresh[market].append(tuple(row))
        out = [[], [], [], []]
        for market, rows in fresh.items():
            rows.sort()
            asks, trades, *after = decide(rows, *markets.get(market, (None, False))[:2])
            markets[market] = (*after, max(max(r[1] for r in rows) // 1000 + MARKET_IDLE_DAYS * 86_400_000, now + 1))
            for column, values in zip(out, ([None if key[1] else market] * len(rows), [r[0] for r in rows], asks, trades)):
                column += values
        markets = {m: x for m, x in markets.items() if x[2] >= now}
        if markets:
            asked, opened, until = zip(*markets.values())
            state.update((np.array([*markets], np.int64).tobytes(), np.array([np.nan if a is None else a for a in asked]).tobytes(), np.array(opened, np.bool_).tobytes(), np.array(until, np.int64).tobytes()))
            state.setTimeoutTimestamp(min(until))
        else:
            state.remove()
        if fresh:
            yield pd.DataFrame(dict(zip(("market_id", "seq", "ask", "trade"), out)))

    market = F.col("market_id")
    dealt = snapshots.withWatermark("ts", delay).withColumns({
        "shard": F.pmod(F.xxhash64(market), F.lit(shards)).cast("int"), "lone": market.isNull(), "market_id": F.coalesce(market.cast("long"), F.lit(0).cast("long"))})
    return dealt.groupBy("shard", "lone").applyInPandasWithState(step, MARKET_OUT, MARKET_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def table_stream(spark: SparkSession, sf_dir: str, name: str, order: str = "event_id", arrivals: int = 6) -> DataFrame:
    """A table as a stream of arrivals in the order of a column, one arrival per micro-batch.

    An arrival has as many files as its share of the table's splits, empty ones
    among them where rows are too few, and a micro-batch takes so many: a large
    table comes in as many micro-batches as a small one.
    """
    rows = table(spark, sf_dir, name)
    path = f"{checkpoint_dir(spark)}/presage-arrivals-{uuid.uuid4().hex}"
    ends = rows.agg(F.min(order), F.max(order)).first()
    low, width = (ends[0] or 0), max(1, ((ends[1] or 0) - (ends[0] or 0)) // arrivals + 1)
    files = max(1, -(-rows.rdd.getNumPartitions() // arrivals))
    for i in range(arrivals):
        part = rows.filter((F.col(order) >= low + i * width) & (F.col(order) < low + (i + 1) * width))
        part.repartition(files).write.mode("append").parquet(path)
        for _ in range(files * (i + 1) - len(spark.read.schema(rows.schema).parquet(path).inputFiles())):
            rows.limit(0).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is available and return its result as a table.

    ``append``: all batches; ``complete``: the last one.
    """
    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark)}/presage-stream-{uuid.uuid4().hex}"
    last = {"epoch": -1}

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")
        last["epoch"] = epoch

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    path = f"{base}/out" if mode == "append" else f"{base}/out/epoch={last['epoch']}"
    out = spark.read.parquet(path)
    return out.drop("epoch") if "epoch" in out.columns else out
