"""Learned forecasts: boosted trees by folds, isotonic calibration, edge refits."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import TaskContext, inheritable_thread_target
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from presage.session import cut_lineage

FEATURES = ("stance", "certainty", "specificity", "hedge_ratio", "conditionality", "magnitude", "source_authority", "sentiment", "days_before", "source_brier", "prediction_count")
#: Where the claims do not state a feature.
UNSTATED = {"specificity": 0.5, "hedge_ratio": 0.5, "conditionality": 0.0, "magnitude": 0.5, "source_authority": 0.5, "sentiment": 0.5}


def boosted_by_fold(rows: DataFrame, event: str, folds: int, iterations: int = 100, depth: int = 4, step: float = 0.05) -> DataFrame:
    """Out-of-fold mean probability per event; whole events share a fold.

    A fit is hundreds of short jobs one after the other, so the folds are fitted
    side by side, as many at a time as there are folds.
    """
    rows = cut_lineage(rows.withColumn("_fold", F.pmod(F.xxhash64(event), F.lit(folds))))
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows.withColumn("label", F.col("outcome").cast("double")))

    def fit(f: int):
        return GBTClassifier(maxIter=iterations, maxDepth=depth, stepSize=step, seed=42).fit(ready.filter(F.col("_fold") != f))

    with ThreadPool(folds) as pool:
        models = pool.map(inheritable_thread_target(rows.sparkSession)(fit), range(folds))
    out = None
    for f, model in enumerate(models):
        part = model.transform(ready.filter(F.col("_fold") == f)).groupBy(event).agg(
            F.avg(vector_to_array("probability")[1]).alias("p"), F.max("outcome").alias("outcome"))
        out = part if out is None else out.union(part)
    return out


FAN = 32


def _pooled(hits: np.ndarray, n: np.ndarray) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Pool adjacent violators of blocks in order: for each its pooled block, and the pooled blocks (number, hits, rows)."""
    stack: list[list[int]] = []  # first block, hits, rows
    for i, (h, k) in enumerate(zip(hits.tolist(), n.tolist())):
        stack.append([i, h, k])
        while len(stack) > 1 and stack[-2][1] * stack[-1][2] >= stack[-1][1] * stack[-2][2]:
            _, h2, k2 = stack.pop()
            stack[-1][1] += h2
            stack[-1][2] += k2
    ends = [b[0] for b in stack[1:]] + [len(hits)]
    return [j for j, (b, e) in enumerate(zip(stack, ends)) for _ in range(e - b[0])], [(j, b[1], b[2]) for j, b in enumerate(stack)]


def isotonic(pairs: DataFrame, p: str, outcome: str) -> DataFrame:
    """Calibrated value per row: the least-squares rising fit of the 0/1 outcomes over ``p``.

    Equal inputs are merged first. Each range of inputs pools its violators,
    then neighbouring ranges' blocks are pooled in groups until one is left. A
    task sees pooled blocks alone: their means are distinct fractions that rise,
    so n rows leave no more than about n^(2/3) of them. A null ``p`` or outcome
    takes no part and gets null.
    """
    pairs = cut_lineage(pairs)
    merged = pairs.filter(F.col(p).isNotNull() & F.col(outcome).isNotNull()).groupBy(F.col(p).cast("double").alias("_p")).agg(
        F.sum(F.col(outcome).cast("long")).alias("hits"), F.count(F.lit(1)).alias("n"))

    def ranges(frames):
        pid = TaskContext.get().partitionId()
        got = [f for f in frames if len(f)]
        if got:
            rows = pd.concat(got)  # one range of distinct inputs
            place, blocks = _pooled(rows["hits"].to_numpy(), rows["n"].to_numpy())
            made = pd.DataFrame(blocks, columns=["to", "h", "k"])
            yield pd.DataFrame({"part": 0, "block": 0, "p": rows["_p"].to_numpy(), "to_part": pid, "to": place, "h": made["h"].to_numpy()[place], "k": made["k"].to_numpy()[place]})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["part", "block"])
        place, blocks = _pooled(rows["h"].to_numpy(), rows["k"].to_numpy())
        made = pd.DataFrame(blocks, columns=["to", "h", "k"])
        return pd.DataFrame({"part": rows["part"].to_numpy(), "block": rows["block"].to_numpy(), "to_part": rows["part"].to_numpy() // FAN, "to": place,
                             "h": made["h"].to_numpy()[place], "k": made["k"].to_numpy()[place]})

    level = cut_lineage(merged.repartitionByRange("_p").sortWithinPartitions("_p").mapInPandas(ranges, "part long, block long, p double, to_part long, to long, h long, k long"))
    told = level.select("p", "to_part", "to", "h", "k")
    parts = (level.agg(F.max("to_part").alias("m")).first()["m"] or 0) + 1
    while parts > 1:
        blocks = level.groupBy(F.col("to_part").alias("part"), F.col("to").alias("block")).agg(F.first("h").alias("h"), F.first("k").alias("k"))
        level = cut_lineage(blocks.groupBy(F.floor(F.col("part") / FAN).alias("g")).applyInPandas(merge, "part long, block long, to_part long, to long, h long, k long"))
        up = level.select(F.col("part").alias("_part"), F.col("block").alias("_block"), F.col("to_part").alias("_to_part"), F.col("to").alias("_to"), F.col("h").alias("_h"), F.col("k").alias("_k"))
        told = told.join(up, (F.col("to_part") == F.col("_part")) & (F.col("to") == F.col("_block"))).select(
            "p", F.col("_to_part").alias("to_part"), F.col("_to").alias("to"), F.col("_h").alias("h"), F.col("_k").alias("k"))
        parts = -(-parts // FAN)
    fitted = told.select(F.col("p").alias("_p"), (F.col("h") / F.col("k")).alias("calibrated"))
    return pairs.join(fitted, F.col(p).cast("double") == F.col("_p"), "left").withColumn("calibrated", F.when(F.col(outcome).isNotNull(), F.col("calibrated"))).drop("_p")


def _predict(P: np.ndarray, w: np.ndarray, b: float) -> np.ndarray:
    k = P.shape[1]
    on = ((np.arange(1 << k)[:, None] >> np.arange(k)) & 1).astype(float)
    state = np.prod(P[:, None, :] * on + (1 - P[:, None, :]) * (1 - on), axis=2)
    return state @ (1 / (1 + np.exp(-(b + on @ w))))


def _fit(P: np.ndarray, y: np.ndarray, w0: np.ndarray, free_w: bool, ridge: float, rounds: int = 400, rate: float = 0.3) -> tuple[np.ndarray, float]:
    k = P.shape[1]
    on = ((np.arange(1 << k)[:, None] >> np.arange(k)) & 1).astype(float)
    state = np.prod(P[:, None, :] * on + (1 - P[:, None, :]) * (1 - on), axis=2)
    w, m = w0.copy(), np.clip(y.mean(), 1e-3, 1 - 1e-3)
    b = float(np.log(m / (1 - m)))
    for _ in range(rounds):
        s = 1 / (1 + np.exp(-(b + on @ w)))
        q = np.clip(state @ s, 1e-4, 1 - 1e-4)
        dq = (q - y) / (q * (1 - q)) / len(y)
        ds = (state.T @ dq) * s * (1 - s)
        b -= rate * ds.sum()
        if free_w:
            w -= rate * (on.T @ ds + 2 * ridge * (w - w0) / k)
    return w, b


def refit_edges(rows: DataFrame, scales: list[float], ridge: float = 2.0) -> DataFrame:
    """Out-of-sample error per child for given, globally scaled and refitted weights.

    ``rows``: target, date, test, y, p[], w[]; one child has at most one row per
    calendar day, so a child is one bounded group. Scales are tried side by side
    and the one with the least training loss over all children is kept.
    """
    schema = "target string, scale double, n int, train_loss double, sq_scaled double, sq_node double, sq_frozen double, mse_node double, mse_zero double, n_diff int"

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        target, scale = key
        pdf = pdf.sort_values("date")
        P, y, test = np.array(pdf.p.tolist()), pdf.y.to_numpy(), pdf.test.to_numpy()
        w0 = np.array(pdf.w.iloc[0])
        P0, y0, P1, y1 = P[~test], y[~test], P[test], y[test]
        if len(y0) < 20 or len(y1) < 5:
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        _, b = _fit(P0, y0, scale * w0, False, ridge)
        q = np.clip(_predict(P0, scale * w0, b), 1e-4, 1 - 1e-4)
        loss = float(-np.mean(y0 * np.log(q) + (1 - y0) * np.log(1 - q)))
        wn, bn = _fit(P0, y0, w0, True, ridge)
        node, scaled = _predict(P1, wn, bn), _predict(P1, scale * w0, b)
        return pd.DataFrame([(target, scale, len(y1), loss, float(((scaled - y1) ** 2).sum()), float(((node - y1) ** 2).sum()),
                              float(((y0[-1] - y1) ** 2).sum()), float(((np.diff(node) - np.diff(y1)) ** 2).sum()), float((np.diff(y1) ** 2).sum()), len(y1) - 1)],
                            columns=[c.split()[0] for c in schema.split(", ")])

    tried = rows.withColumn("scale", F.explode(F.array(*[F.lit(float(s)) for s in scales]))).groupBy("target", "scale").applyInPandas(one, schema)
    tried = cut_lineage(tried)
    total = tried.groupBy("scale").agg(F.sum("train_loss").alias("_l")).agg(F.min_by("scale", "_l").alias("best_scale"))
    sums = tried.crossJoin(F.broadcast(total))
    pick = lambda cond, x: F.sum(F.when(cond, F.col(x)))
    given, best = F.col("scale") == 1.0, F.col("scale") == F.col("best_scale")
    return sums.agg(
        F.max("best_scale").alias("best_scale"), (pick(given, "sq_scaled") / pick(given, "n")).alias("brier_given"), (pick(best, "sq_scaled") / pick(best, "n")).alias("brier_scaled"),
        (pick(given, "sq_node") / pick(given, "n")).alias("brier_node"), (pick(given, "sq_frozen") / pick(given, "n")).alias("brier_persistence"),
        (pick(given, "mse_node") / pick(given, "n_diff")).alias("diff_node"), (pick(given, "mse_zero") / pick(given, "n_diff")).alias("diff_zero"))
