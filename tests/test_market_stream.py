"""State of market decisions over ordered arrivals."""

import datetime as dt

from presage.streaming import jobs as J


def test_markets_share_shards(spark, tmp_path):
    """Python and the state store see a few shards, not each market; null and idle markets are told as before."""
    start, day = dt.datetime(2024, 1, 1), dt.timedelta(days=1)
    snaps = [(m, start, 0.5, 0.9) for m in [*range(100), None]]  # first arrival: every market opens
    snaps += [(1, start + 60 * day, 0.5, 0.9), (None, start + 60 * day, 0.5, 0.9), (500, start + 150 * day, 0.5, 0.1)]
    snaps += [(0, start + 151 * day, 0.5, 0.9), (501, start + 151 * day, None, 0.9)]
    snaps += [(m, start + 152 * day, 0.5, 0.1) for m in (0, 1, 2, None, 500)]
    at = [0, 101, 104, 106, 111]
    spark.createDataFrame([(1000 * a + i, *x, False) for a, (b, e) in enumerate(zip(at, at[1:])) for i, x in enumerate(snaps[b:e])],
                          "seq long, market_id long, ts timestamp, market_yes double, model_yes double, closed boolean").write.parquet(f"{tmp_path}/snaps.parquet")
    stream = J.table_stream(spark, str(tmp_path), "snaps", "seq", 4)
    got = []
    q = J.market_decisions(stream, shards=4).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(
        lambda batch, epoch: got.extend(tuple(r) for r in batch.collect())).start()
    q.awaitTermination()
    want = [(m, i, True, "YES") for i, m in enumerate([*range(100), None])]
    want += [(1, 1000, True, None), (None, 1001, True, None), (500, 1002, True, "NO"), (0, 2000, True, None), (501, 2001, False, None)]
    want += [(0, 3000, True, None), (1, 3001, True, None), (2, 3002, True, "NO"), (None, 3003, True, None), (500, 3004, True, None)]
    assert sorted(got, key=lambda r: r[1]) == want
    assert all(0 < s.numRowsTotal <= 8 for p in q.recentProgress for s in p.stateOperators)
