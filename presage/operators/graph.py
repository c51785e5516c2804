"""Small conditional-probability graphs under many what-if scenarios."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window, functions as F

from presage.functions import scalars as S
from presage.functions.scalars import let
from presage.session import cut_lineage

MAX_PARENTS = 16
FLOOR, CEIL, EPS = 0.001, 0.999, 1e-9
SECONDARY = 0.5


def safe_logit(p: Column) -> Column:
    return S.logit(S.clamp(p, FLOOR, CEIL))


def edge_weights(edges: DataFrame) -> DataFrame:
    w = safe_logit(F.col("p_yes")) - safe_logit(F.col("p_no"))
    return edges.withColumn("w", F.when(F.col("type") == "secondary", w * SECONDARY).otherwise(w))


def findings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Structural faults: duplicate ids, ranges, unknown ends, too many parents."""
    dup = nodes.groupBy("id").count().filter("count > 1").select(F.lit("duplicate_id").alias("fault"), "id")
    prior = nodes.filter(~F.coalesce(F.col("prior").between(0, 1), F.lit(False))).select(F.lit("prior_range").alias("fault"), "id")
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).join(nodes.select("id"), "id", "left_anti").select(F.lit("unknown_node").alias("fault"), "id")
    ranged = edges.filter(~F.coalesce(F.col("p_yes").between(0, 1) & F.col("p_no").between(0, 1), F.lit(False))).select(F.lit("edge_range").alias("fault"), F.col("target").alias("id"))
    wide = edges.groupBy("target").count().filter(F.col("count") > MAX_PARENTS).select(F.lit("fan_in").alias("fault"), F.col("target").alias("id"))
    return dup.union(prior).union(ends).union(ranged).union(wide).distinct()


def layers(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, int]:
    """Longest-path depth per node; raises on a cycle. Loops once per layer."""
    todo = nodes.select("id")
    placed = None
    for depth in count():
        waiting = edges.join(todo.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("target").alias("id")).distinct()
        ready = cut_lineage(todo.join(waiting, "id", "left_anti").withColumn("layer", F.lit(depth)))
        if ready.limit(1).count() == 0:
            raise ValueError("graph has a cycle")
        placed = ready if placed is None else placed.union(ready)
        todo = cut_lineage(todo.join(ready.select("id"), "id", "left_anti"))
        if todo.limit(1).count() == 0:
            return placed, depth


def _states(parents: Column) -> Column:
    """(probability, weight sum) of every on/off state of at most 16 parents."""
    start = F.array(F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("z")))
    start = F.when(F.size(parents) > MAX_PARENTS, F.raise_error(F.lit(f"a node has more than {MAX_PARENTS} parents"))).otherwise(start)

    def add(acc: Column, q: Column) -> Column:
        off = F.transform(acc, lambda s: F.struct((s["p"] * (1.0 - q["p"])).alias("p"), s["z"].alias("z")))
        on = F.transform(acc, lambda s: F.struct((s["p"] * q["p"]).alias("p"), (s["z"] + q["w"]).alias("z")))
        return F.concat(off, on)

    return F.filter(F.aggregate(parents, start, add), lambda s: s["p"] > EPS)


def _marginal(states: Column, b: Column) -> Column:
    return F.aggregate(states, F.lit(0.0), lambda acc, s: acc + s["p"] / (1.0 + F.exp(-(b + s["z"]))))


def intercepts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Intercept per child so that its priors reproduce its own prior (bisection)."""
    prior = nodes.select(F.col("id").alias("source"), F.col("prior").alias("p"))
    per = edge_weights(edges).join(prior, "source").groupBy("target").agg(F.array_sort(F.collect_list(F.struct("source", "w", "p"))).alias("ps"))
    per = per.join(nodes.select(F.col("id").alias("target"), S.clamp(F.col("prior"), FLOOR, CEIL).alias("goal")), "target")

    def solve(states: Column) -> Column:
        def halve(st: Column, _: Column) -> Column:
            return let((st["lo"] + st["hi"]) / 2.0, lambda mid: F.when(
                _marginal(states, mid) < F.col("goal"), F.struct(mid.alias("lo"), st["hi"].alias("hi"))).otherwise(F.struct(st["lo"].alias("lo"), mid.alias("hi"))))

        return F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(F.lit(-40.0).alias("lo"), F.lit(40.0).alias("hi")), halve, lambda st: (st["lo"] + st["hi"]) / 2.0)

    return per.select("target", let(_states(F.col("ps")), solve).alias("b"))


def _normalise(values: DataFrame, groups: DataFrame) -> DataFrame:
    """Scale the unlocked members of exclusive groups into what the locked leave."""
    mem = groups.select("group_id", "allow_other", F.explode("members").alias("id"))
    rows = values.join(mem, "id", "left")
    w = Window.partitionBy("scenario", "group_id")  # at most one graph's nodes
    locked, free = F.sum(F.when(F.col("locked"), F.col("p")).otherwise(0.0)).over(w), F.sum(F.when(~F.col("locked"), F.col("p")).otherwise(0.0)).over(w)
    budget = F.greatest(F.lit(0.0), 1.0 - locked)
    scale = F.when((free > EPS) & (~F.col("allow_other") | (free > budget)), budget / free).otherwise(1.0)
    return rows.withColumn("p", F.when(F.col("group_id").isNotNull() & ~F.col("locked"), F.col("p") * scale).otherwise(F.col("p"))).select(*values.columns)


def propagate(nodes: DataFrame, edges: DataFrame, observed: DataFrame, groups: DataFrame | None = None, reconcile: bool = False) -> DataFrame:
    """Node probabilities per scenario given ``observed`` (scenario, id, p).

    One join per layer over (scenario, node) rows; a child's at most 16 parents
    meet in one array and all their states are enumerated in the expression.
    ``reconcile`` uses the law of total probability instead of the states.
    """
    placed, depth = layers(nodes, edges)
    placed = cut_lineage(placed)
    b = cut_lineage(intercepts(nodes, edges))
    weighted = edge_weights(edges)
    seen = observed.select("scenario", "id", S.clamp(F.col("p"), 0.0, 1.0).alias("obs"))
    base = observed.select("scenario").distinct().crossJoin(nodes.select("id", "prior"))
    values = base.join(seen, ["scenario", "id"], "left").select(
        "scenario", "id", F.coalesce("obs", "prior").alias("p"), F.col("obs").isNotNull().alias("locked"))
    values = cut_lineage(values)
    for d in range(1, depth + 1):
        kids = weighted.join(placed.filter(F.col("layer") == d).select(F.col("id").alias("target")), "target", "left_semi")
        meet = values.select("scenario", F.col("id").alias("source"), "p").join(kids, "source")
        if reconcile:
            k = F.when(F.col("type") == "secondary", SECONDARY).otherwise(1.0)
            new = meet.groupBy("scenario", "target").agg((F.sum(k * (F.col("p_yes") * F.col("p") + F.col("p_no") * (1 - F.col("p")))) / F.sum(k)).alias("_new"))
        else:
            ps = F.array_sort(F.collect_list(F.struct("source", "w", "p")))
            new = meet.groupBy("scenario", "target").agg(ps.alias("ps")).join(b, "target").select(
                "scenario", "target", let(_states(F.col("ps")), lambda s: _marginal(s, F.col("b"))).alias("_new"))
        values = values.join(new.withColumnRenamed("target", "id"), ["scenario", "id"], "left").select(
            "scenario", "id", F.when(F.col("locked") & F.lit(not reconcile), F.col("p")).otherwise(F.coalesce("_new", "p")).alias("p"), "locked")
        if groups is not None:
            last = groups.join(placed, F.array_contains("members", F.col("id"))).groupBy("group_id").agg(F.max("layer").alias("_l"))
            due = groups.join(last.filter(F.col("_l") == d).select("group_id"), "group_id", "left_semi")
            values = _normalise(values, due)
        values = cut_lineage(values)
    return values


def what_if(values: DataFrame, nodes: DataFrame) -> DataFrame:
    p = F.round("p", 4)
    return values.join(nodes.select("id", "prior"), "id").select(
        "scenario", "id", F.round("prior", 4).alias("prior"), p.alias("p"), F.round(p - F.col("prior"), 4).alias("delta"), "locked")


def reachable(edges: DataFrame, root: str) -> DataFrame:
    """Nodes from which ``root`` can be reached along edges, the root included."""
    seen = cut_lineage(edges.sparkSession.createDataFrame([(root,)], "id string"))
    front = seen
    while True:
        front = cut_lineage(edges.join(front.withColumnRenamed("id", "target"), "target", "left_semi").select(F.col("source").alias("id")).distinct().join(seen, "id", "left_anti"))
        if front.limit(1).count() == 0:
            return seen
        seen = cut_lineage(seen.union(front))


def prune_edges(edges: DataFrame, keep: int) -> DataFrame:
    """Strongest children per parent by sensitivity times uncertainty."""
    score = F.round(F.abs(F.col("p_yes") - F.col("p_no")) * F.col("p") * (1 - F.col("p")), 5)
    ranked = edges.withColumn("score", F.coalesce(score, F.lit(0.0))).withColumn(
        "_r", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("score"), "source")))
    return ranked.withColumn("kept", (F.col("score") > 0) & (F.col("_r") <= keep)).drop("_r")


def edge_estimates(aligned: DataFrame, hi: float = 0.6, lo: float = 0.4, min_bin: int = 8, min_rows: int = 20) -> DataFrame:
    """Regression and high/low-bin estimates of an edge from two aligned series."""
    x, y = F.col("x"), F.col("y")
    up, down = F.when(x > hi, y), F.when(x < lo, y)
    g = aligned.groupBy("source", "target").agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("_s"), F.regr_intercept(y, x).alias("_i"), F.regr_r2(y, x).alias("_r2"),
        F.count(up).alias("n_hi"), F.count(down).alias("n_lo"), F.avg(up).alias("_yh"), F.avg(down).alias("_yl"), F.stddev_pop(up).alias("_sh"), F.stddev_pop(down).alias("_sl"))
    ok = F.col("n") >= min_rows
    r3 = lambda cond, v: F.when(ok & cond, F.round(v, 3))
    h, l = F.col("n_hi") >= min_bin, F.col("n_lo") >= min_bin
    return g.select("source", "target", "n", r3(F.lit(True), S.clamp(F.col("_i") + F.col("_s"), 0.01, 0.99)).alias("py_reg"), r3(F.lit(True), S.clamp(F.col("_i"), 0.01, 0.99)).alias("pn_reg"),
                    F.when(ok, F.round("_r2", 4)).otherwise(0.0).alias("r2"), F.when(ok, F.col("n_hi")).otherwise(0).alias("n_hi"), F.when(ok, F.col("n_lo")).otherwise(0).alias("n_lo"),
                    r3(h, F.col("_yh")).alias("py_bin"), r3(l, F.col("_yl")).alias("pn_bin"), r3(h, F.col("_sh")).alias("std_hi"), r3(l, F.col("_sl")).alias("std_lo"))


def blend(prior: Column, binned: Column, n: Column, std: Column, reg: Column, r2: Column) -> tuple[Column, Column, Column]:
    """Prior blended with the bin, else the regression; and its 90 % interval."""
    use_reg = binned.isNull() & reg.isNotNull() & (r2 > 0)
    wt = F.when(binned.isNotNull(), n / 10.0).when(use_reg, r2 * 3.0).otherwise(0.0)
    est = F.coalesce(binned, F.when(use_reg, reg), prior)
    raw = (prior + wt * est) / (1.0 + wt)
    half = F.when(binned.isNotNull(), 1.645 * std / F.sqrt(n) * 1.5).otherwise(0.15)
    p = S.clamp(raw, 0.01, 0.99)
    mid = F.when(binned.isNotNull(), raw).otherwise(p)
    return F.round(p, 3), F.round(S.clamp(mid - half, 0.01, 0.99), 3), F.round(S.clamp(mid + half, 0.01, 0.99), 3)
