"""Append-only ledgers: idempotent append, retraction, reports, positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from presage.functions import scalars as S
from presage.operators.skew import first_per, latest_per, with_rank, with_totals


def append_once(existing: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Existing rows plus the first incoming row of every unseen key."""
    fresh = first_per(incoming, [key], F.col(order), incoming.columns).join(existing.select(key), key, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def retract(rows: DataFrame, tombstones: DataFrame, key: str, seq: str) -> DataFrame:
    """Drop rows with a later tombstone; a row added after it survives."""
    last = tombstones.groupBy(key).agg(F.max(seq).alias("_gone"))
    return rows.join(last, key, "left").filter(F.col("_gone").isNull() | (F.col("_gone") < F.col(seq))).drop("_gone")


def upsert_tags(log: DataFrame, key: str, seq: str) -> DataFrame:
    """Latest tag list per key: trimmed, distinct, sorted; empty lists remove the key."""
    clean = F.array_sort(F.array_distinct(F.filter(F.transform("tags", lambda t: F.trim(t)), lambda t: t != "")))
    return log.groupBy(key).agg(F.max_by(clean, F.col(seq)).alias("tags")).filter(F.size("tags") > 0)


def asked(row_model: Column, row_reason: Column) -> Column:
    return row_model.isNotNull() | row_reason.isNotNull()


def market_report(snapshots: DataFrame, use: str = "latest") -> DataFrame:
    """One row per market: its last state and its first or last model number."""
    model = F.col("model_yes").isNotNull()
    order = F.col("seq")
    picked = (F.max_by if use == "latest" else F.min_by)(
        F.struct("model_yes", "market_yes", "ts", "end_ts"), F.when(model, order))
    return snapshots.groupBy("market_id").agg(
        F.count(F.lit(1)).alias("n_snapshots"), F.count_if(asked(F.col("model_yes"), F.col("model_reason"))).alias("calls"),
        F.max_by(F.struct("event_slug", "end_ts", "closed", "resolved_outcome", "resolution_raw", "market_yes", "ts", "partition_market"), order).alias("l"),
        picked.alias("f"),
    ).select(
        "market_id", "n_snapshots", "calls", "l.*", F.col("f.model_yes").alias("model_yes"), F.col("f.market_yes").alias("market_at_model"),
        F.col("f.ts").alias("model_ts"), F.col("f.end_ts").alias("model_end_ts"))


def exclusion(horizon_days: float = 5.0, lo: float = 0.10, hi: float = 0.90) -> Column:
    """Why a forecast is not scored: too close to the end, or price outside the band."""
    lead = F.unix_micros("model_end_ts") - F.unix_micros("model_ts")
    return F.when(F.coalesce(lead < horizon_days * 86400e6, F.lit(True)), "horizon").when(
        ~F.col("market_at_model").between(lo, hi), "band")


def score_markets(report: DataFrame, excluded: Column | None = None) -> DataFrame:
    yes = F.col("resolved_outcome") == "YES"
    scorable = F.col("resolved_outcome").isin("YES", "NO") & F.col("model_yes").isNotNull() & F.col("market_at_model").isNotNull()
    why = F.when(scorable, excluded) if excluded is not None else F.lit(None).cast("string")
    out = report.withColumn("excluded", why)
    ok = scorable & F.col("excluded").isNull()
    return out.withColumns({
        "brier_model": F.when(ok, S.brier(F.col("model_yes"), yes)), "brier_market": F.when(ok, S.brier(F.col("market_at_model"), yes)),
        "logloss_model": F.when(ok, S.log_loss(F.col("model_yes"), yes)), "logloss_market": F.when(ok, S.log_loss(F.col("market_at_model"), yes))})


def report_summary(scored: DataFrame, min_scored: int = 150, margin: float = 0.01) -> DataFrame:
    diff = F.avg(F.col("brier_model") - F.col("brier_market"))
    out = scored.agg(
        F.count(F.lit(1)).alias("n_markets"), F.count("model_yes").alias("n_with_model"),
        F.avg(F.col("model_yes").isNotNull().cast("double")).alias("coverage"),
        F.count_if(F.col("resolved_outcome").isin("YES", "NO")).alias("n_resolved"),
        F.count_if(F.col("resolution_raw").isin("MKT", "CANCEL")).alias("n_void"), F.count("brier_model").alias("n_scored"),
        F.count_if(F.col("excluded") == "horizon").alias("n_excluded_horizon"), F.count_if(F.col("excluded") == "band").alias("n_excluded_band"),
        F.avg("brier_model").alias("brier_model"), F.avg("brier_market").alias("brier_market"),
        F.avg("logloss_model").alias("logloss_model"), F.avg("logloss_market").alias("logloss_market"), diff.alias("brier_diff"),
        F.sum("calls").alias("calls"))
    enough = F.col("n_scored") >= min_scored
    return out.withColumn("verdict", F.when(~enough, "too early").when(F.col("brier_diff") <= margin, "pass").otherwise("not passing"))


def positions(trades: DataFrame, report: DataFrame) -> DataFrame:
    """Trades marked to the market's last state: won, lost, void or open."""
    state = report.select("market_id", "resolved_outcome", "resolution_raw", "market_yes")
    won = F.col("resolved_outcome") == F.col("side")
    resolved = F.col("resolved_outcome").isin("YES", "NO")
    void = ~F.coalesce(resolved, F.lit(False)) & F.coalesce(F.col("resolution_raw").isin("MKT", "CANCEL"), F.lit(False))
    price = F.when(resolved, won.cast("double")).when(~void, F.when(F.col("side") == "YES", F.col("market_yes")).otherwise(1 - F.col("market_yes")))
    return trades.join(state, "market_id", "left").withColumn(
        "status", F.when(resolved, F.when(won, "won").otherwise("lost")).when(void, "void").otherwise("open")
    ).withColumn("side_price", price).withColumn("value", F.col("shares") * F.col("side_price")).withColumn("pnl", F.col("value") - F.col("notional"))


def pnl_summary(pos: DataFrame) -> DataFrame:
    closed = F.col("status").isin("won", "lost")
    return pos.agg(
        F.count(F.lit(1)).alias("n_positions"), F.count_if(F.col("status") == "open").alias("n_open"), F.count_if(F.col("status") == "won").alias("n_won"),
        F.count_if(F.col("status") == "lost").alias("n_lost"), F.count_if(F.col("status") == "void").alias("n_void"),
        F.sum("notional").alias("notional"), F.coalesce(F.sum(F.when(F.col("status") == "open", F.col("pnl"))), F.lit(0.0)).alias("unrealised"),
        F.coalesce(F.sum(F.when(closed, F.col("pnl"))), F.lit(0.0)).alias("realised"))


def coherent(report: DataFrame, lo: float = 0.02, hi: float = 0.98) -> DataFrame:
    """Model numbers of one event's partition rescaled to sum to one.

    Rows are markets in their last state. No number results when fewer than two
    markets are priced, one is no partition market, a closed one is unresolved,
    none is open, an in-band market has no model number, or the total is zero.
    A resolved YES sets every in-band market to zero.
    """
    priced = report.filter(F.col("market_yes").isNotNull()).withColumn("_live", ~F.col("closed")).withColumn(
        "_band", F.col("_live") & F.col("market_yes").between(lo, hi))
    n = lambda cond: F.count_if(cond)
    tot = with_totals(priced, ["event_slug"], {
        "_n": F.count(F.lit(1)), "_foreign": n(~F.col("partition_market")), "_open_res": n(F.col("closed") & F.col("resolved_outcome").isNull()),
        "_nlive": n(F.col("_live")), "_yes": n(F.col("closed") & (F.col("resolved_outcome") == "YES")), "_nband": n(F.col("_band")),
        "_nomodel": n(F.col("_band") & F.col("model_yes").isNull()),
        "_total": F.sum(F.when(F.col("_band"), F.col("model_yes")).when(F.col("_live"), F.col("market_yes")).otherwise(0.0))}, F.col("market_id"))
    usable = (F.col("_n") >= 2) & (F.col("_foreign") == 0) & (F.col("_open_res") == 0) & (F.col("_nlive") > 0)
    scaled = (F.col("_nband") > 0) & (F.col("_nomodel") == 0) & (F.col("_total") > 0)
    value = F.when(usable & F.col("_band"), F.when(F.col("_yes") > 0, 0.0).when(scaled, F.round(F.col("model_yes") / F.col("_total"), 4)))
    return tot.select("market_id", "event_slug", "market_yes", "model_yes", value.alias("coherent_yes"),
                      F.when(value.isNotNull(), F.when(F.col("_yes") > 0, 1.0).otherwise(F.round("_total", 4))).alias("coherent_sum"),
                      F.round(value - F.col("market_yes"), 4).alias("coherent_edge"))


def wants_ask(report: DataFrame, now: str, stale_hours: int, lo: float = 0.02, hi: float = 0.98) -> Column:
    """Open, priced inside the band, and never asked or asked long ago."""
    age = F.unix_micros(F.to_timestamp(F.lit(now))) - F.unix_micros("asked_ts")
    return ~F.col("closed") & F.coalesce(F.col("market_yes").between(lo, hi), F.lit(False)) & F.coalesce(age >= stale_hours * 3600e6, F.lit(True))


def wants_single_ask(now: str, retry_hours: int = 72, min_days: int = 5, lo: float = 0.02, hi: float = 0.98) -> Column:
    """One forecast per market: never after a number, retried after a refusal."""
    at = F.unix_micros(F.to_timestamp(F.lit(now)))
    far = F.coalesce(F.unix_micros("end_ts") - at >= min_days * 86400e6, F.lit(True))
    retry = F.coalesce(at - F.unix_micros("asked_ts") >= retry_hours * 3600e6, F.lit(True))
    return (~F.col("closed") & F.coalesce(F.col("market_yes").between(lo, hi), F.lit(False)) & far & F.col("asked_model").isNull() & retry)


def last_asked(snapshots: DataFrame) -> DataFrame:
    called = asked(F.col("model_yes"), F.col("model_reason"))
    return snapshots.groupBy("market_id").agg(
        F.max_by(F.struct("closed", "market_yes", "end_ts"), "seq").alias("l"),
        F.max_by(F.struct(F.col("ts").alias("asked_ts"), F.col("model_yes").alias("asked_model")), F.when(called, F.col("seq"))).alias("a"),
    ).select("market_id", "l.*", "a.*")


def first_open_trade(candidates: DataFrame, open_ids: DataFrame) -> DataFrame:
    """At most one new trade per market that has none open."""
    return first_per(candidates, ["market_id"], F.col("seq"), candidates.columns).join(open_ids.select("market_id"), "market_id", "left_anti")


def per_run_cap(due: DataFrame, run: str, order: str, cap: int) -> DataFrame:
    """First ``cap`` due markets of each run."""
    return with_rank(due, [run], [F.floor(F.col(order) / 1_000_000)], [F.col(order)], "call_ix").filter(F.col("call_ix") <= cap)


def latest_rows(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    return latest_per(rows, keys, F.col(seq))
