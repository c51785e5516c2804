"""Counts and comparisons that check the data and the rules."""

from __future__ import annotations

from bisect import bisect_right
from math import inf

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from presage.operators.skew import fork


def gate_matrix(candidates: DataFrame, flags: list[Column], bad: Column) -> DataFrame:
    """Confusion counts of every non-empty combination of gates.

    Candidates collapse to their flag pattern first, so the cross join with the
    combinations runs over at most 2^gates rows per label.
    """
    mask = sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(flags)), F.lit(0))
    patterns = candidates.groupBy(mask.alias("_mask"), bad.alias("_bad")).agg(F.count(F.lit(1)).alias("_n"))
    combos = candidates.sparkSession.range(1, 1 << len(flags)).select(F.col("id").cast("int").alias("combo"))
    both = patterns.crossJoin(F.broadcast(combos)).withColumn("_stop", F.col("_mask").bitwiseAND(F.col("combo")) > 0)
    s = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("_n"))), F.lit(0))
    out = both.groupBy("combo").agg(s(F.col("_stop") & F.col("_bad")).alias("tp"), s(F.col("_stop") & ~F.col("_bad")).alias("fp"),
                                    s(~F.col("_stop") & F.col("_bad")).alias("fn"), s(~F.col("_stop") & ~F.col("_bad")).alias("tn"))
    return out.withColumns({"prec": F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), "recall": F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))})


def parse_log(lines: DataFrame, since: str | None = None) -> DataFrame:
    """Typed rows from ``event=name k=v …`` lines; lines without a time are dropped."""
    v = F.col("value")
    kv = F.str_to_map(F.regexp_replace(F.regexp_extract(v, "(event=.*)$", 1), "\\s+", " "), F.lit(" "), F.lit("="))
    out = lines.select(F.try_to_timestamp(F.regexp_extract(v, "^(\\d{4}-\\d\\d-\\d\\d \\d\\d:\\d\\d:\\d\\d)", 1), F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"), kv.alias("kv"))
    out = out.filter(F.col("ts").isNotNull() & F.col("kv")["event"].isNotNull())
    return out if since is None else out.filter(F.col("ts") >= F.to_timestamp(F.lit(since)))


def event_counts(log: DataFrame) -> DataFrame:
    return log.groupBy(F.col("kv")["event"].alias("event")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))


def flag_status(flags: DataFrame, counts: DataFrame) -> DataFrame:
    """OFF for a disabled flag, else PASS or SILENT by whether its event was seen."""
    return flags.join(counts, "event", "left").select("flag", "event", F.coalesce("n", F.lit(0)).alias("n"), F.when(~F.col("enabled"), "OFF").when(
        F.coalesce("n", F.lit(0)) > 0, "PASS").otherwise("SILENT").alias("status"))


BLOCK_ROWS = 20_000


def _take_turns(shadows: list[tuple], verdicts: list[tuple], seconds: float) -> list[tuple]:
    """(shadow id, verdict id, verdict time): each (time, id) of the shadows in order takes the nearest verdict left within the window."""
    queues: dict = {}
    for t, i in sorted(verdicts, reverse=True):
        queues.setdefault(t, []).append(i)  # the smallest id of a time is last, and goes first
    times = sorted(queues)
    # nearest time with verdicts left, at or below a place and at or above it: paths are halved as they are walked
    down, up, out = list(range(len(times) + 1)), list(range(len(times) + 1)), []

    def root(to: list[int], i: int) -> int:
        while to[i] != i:
            to[i] = to[to[i]]
            i = to[i]
        return i

    for t, i in sorted(shadows):
        at = bisect_right(times, t)
        low, high = root(down, at) - 1, root(up, at)
        far = [t - times[low] if low >= 0 else inf, times[high] - t if high < len(times) else inf]
        if min(far) > seconds:
            continue
        k = low if far[0] <= far[1] else high
        out.append((i, queues[times[k]].pop(), times[k]))
        if not queues[times[k]]:
            down[k + 1], up[k] = k, k + 1
    return out


def pair_nearest(shadows: DataFrame, verdicts: DataFrame, seconds: int = 120) -> DataFrame:
    """One-to-one pairs of a question's lines: each shadow line in order takes the
    nearest free verdict within the window; leftovers of both sides stay.

    A question's time is cut into blocks of about ``BLOCK_ROWS`` lines and of
    twenty windows at least. A block takes its turns alone but for the verdicts
    about its start, which the block before may have taken. So all blocks are
    settled at once as if none were taken, and those settled again whose
    verdicts so taken have changed, until none has; what a block hands on mostly
    stays the same. No two lines are paired up to be compared, however dense
    the log is. Equal distances go to the earlier verdict; a null question or
    time pairs with nothing.
    """
    s = fork(shadows.select("question", F.col("id").alias("shadow_id"), F.col("t").alias("ts")))
    v = fork(verdicts.select("question", F.col("id").alias("verdict_id"), F.col("t").alias("tv")))
    lines = s.select("question", F.col("ts").alias("t"), F.col("shadow_id").alias("id"), F.lit(True).alias("asks")).unionByName(
        v.select("question", F.col("tv").alias("t"), F.col("verdict_id").alias("id"), F.lit(False).alias("asks"))).filter("question is not null and t is not null")
    busiest = lines.groupBy("question").agg(F.count(F.lit(1)).alias("n"), (F.max("t") - F.min("t")).alias("d")).agg(F.min(BLOCK_ROWS * F.col("d") / F.col("n"))).first()[0]
    size = max(20 * seconds, int(busiest or 0))
    block = F.floor(F.col("t") / size)
    # a verdict within the window of a block's end is also within reach of the next block
    reach = F.array_distinct(F.array(F.floor((F.col("t") - seconds) / size), block, F.floor((F.col("t") + seconds) / size)))
    lines = fork(lines.withColumn("block", F.explode(F.when(F.col("asks"), F.array(block)).otherwise(reach))))
    asked = fork(lines.filter("asks").select("question", "block").distinct())

    def settle(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        free = rows[~rows.asks & rows.free]
        asks = rows[rows.asks]
        got = _take_turns(list(zip(asks.t.tolist(), asks.id.tolist())), list(zip(free.t.tolist(), free.id.tolist())), seconds)
        return pd.DataFrame([(*key, *x) for x in got], columns=["question", "block", "shadow_id", "verdict_id", "tv"])

    kinds = dict([*s.dtypes, *v.dtypes])
    schema = f"question {kinds['question']}, block long, shadow_id {kinds['shadow_id']}, verdict_id {kinds['verdict_id']}, tv {kinds['tv']}"
    taken = lambda pairs: pairs.filter(F.col("tv") >= (F.col("block") + 1) * size - seconds).select("question", (F.col("block") + 1).alias("block"), F.col("verdict_id").alias("id"))
    mark = lambda rows, name: rows.groupBy("question", "block").agg(F.count(F.lit(1)).alias(f"{name}n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias(name))
    pairs, due = s.sparkSession.createDataFrame([], schema), asked
    while True:
        gone = taken(pairs).withColumn("asks", F.lit(False)).withColumn("_gone", F.lit(True))
        work = lines.join(due, ["question", "block"], "left_semi").join(gone, ["question", "block", "id", "asks"], "left")
        work = work.select("question", "block", "t", "id", "asks", F.col("_gone").isNull().alias("free"))
        again = work.groupBy("question", "block").applyInPandas(settle, schema)
        now = fork(pairs.join(due, ["question", "block"], "left_anti").unionByName(again))
        marks = mark(taken(pairs), "was").join(mark(taken(now), "is"), ["question", "block"], "full")
        changed = marks.filter(~F.col("was").eqNullSafe(F.col("is")) | ~F.col("wasn").eqNullSafe(F.col("isn"))).select("question", "block")
        pairs, due = now, fork(changed.join(asked, ["question", "block"], "left_semi"))
        if due.isEmpty():
            break
    pairs = pairs.select("question", "shadow_id", "verdict_id")
    lone_s = s.join(pairs, ["question", "shadow_id"], "left_anti").select("question", "shadow_id", F.lit(None).cast(kinds["verdict_id"]).alias("verdict_id"))
    lone_v = v.join(pairs, ["question", "verdict_id"], "left_anti").select("question", F.lit(None).cast(kinds["shadow_id"]).alias("shadow_id"), "verdict_id")
    return pairs.unionByName(lone_s).unionByName(lone_v)


def facet_gate(runs: DataFrame, expected: DataFrame) -> DataFrame:
    """Facets met in any run per case and arm, with regressions and improvements."""
    hit = runs.join(expected, ["case_id", "facet"]).groupBy("case_id", "facet", "arm").agg(F.bool_or(F.col("value").eqNullSafe(F.col("want"))).alias("met"))
    wide = hit.groupBy("case_id", "facet").agg(F.max(F.when(F.col("arm") == "base", F.col("met"))).alias("base"), F.max(F.when(F.col("arm") == "patched", F.col("met"))).alias("patched"))
    return wide.withColumns({"regression": F.col("base") & ~F.col("patched"), "improvement": ~F.col("base") & F.col("patched")})


def stability(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Range, spread, sign-flip rate against the modal sign, and the sign counts."""
    s = F.signum(value)
    pos, neg, zero = F.count_if(s > 0), F.count_if(s < 0), F.count_if(s == 0)
    n = F.count(value)
    return runs.groupBy(*keys).agg(n.alias("runs"), (F.max(value) - F.min(value)).alias("range"), F.stddev_pop(value).alias("stdev"),
                                   F.when(n < 2, 0.0).otherwise(1 - F.greatest(pos, neg, zero) / n).alias("flip_rate"),
                                   F.concat(F.lit("+"), pos.cast("string"), F.lit("/-"), neg.cast("string"), F.lit("/0x"), zero.cast("string")).alias("signs"))


def unique_decisions(votes: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Decisions with the same vote set count once.

    The signature adds up hashes of the distinct items, so a set of any size
    merges map-side instead of being listed.
    """
    distinct = votes.select(*keys, item).distinct()
    sig = distinct.groupBy(*keys).agg(F.count(F.lit(1)).alias("votes"), F.sum(F.xxhash64(item).cast("decimal(38,0)")).alias("_a"), F.bit_xor(F.xxhash64(F.lit(17), F.col(item))).alias("_b"))
    return sig.groupBy(keys[0], "votes", "_a", "_b").agg(F.min(keys[1]).alias("first_decision"), F.count(F.lit(1)).alias("repeats")).drop("_a", "_b")


def failure_reason(counts: dict[str, Column]) -> Column:
    """Dominant reason of an empty forecast from its outcome histogram."""
    errors = counts["gate_error"] + counts["extract_error"]
    total = counts["total"]
    return (F.when((errors > 0) & (errors >= total / 2), "extraction_errors").when(counts["gate_rejected"] >= total / 2, "all_articles_off_topic")
            .when(counts["empty_text"] >= total / 2, "all_fetches_failed").otherwise("no_usable_predictions"))


def settlement_band(rate: Column, go: float = 0.05, stop: float = 0.15) -> Column:
    return F.when(rate <= go, "go").when(rate <= stop, "escalate").otherwise("no-go")


def replay_differences(stored: DataFrame, now: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """Per field the rows where a stored run and a new one differ, null-safe; rows of one run only count in ``only_one``."""
    pick = lambda d, p: d.select(key, F.lit(True).alias(p + "has"), *[F.col(f).alias(p + f) for f in fields])
    both = pick(stored, "a_").join(pick(now, "b_"), key, "full")
    paired = F.col("a_has").isNotNull() & F.col("b_has").isNotNull()
    s = both.agg(F.count_if(paired).alias("rows"), F.count_if(~paired).alias("only_one"),
                 *[F.count_if(paired & ~F.col("a_" + f).eqNullSafe(F.col("b_" + f))).alias(f) for f in fields])
    return s.unpivot(["rows", "only_one"], list(fields), "field", "differ")
