"""Group-wise steps that stay parallel when one group holds much of the data.

Spark's own windows put a whole group into one task. So totals are partial
aggregates joined back on a salted key, ranks work on small value buckets, and
exact quantiles narrow down to the one bucket that holds them, at any size.
Steps that read their input twice first write it to the checkpoint folder, so
a chain of them grows linearly.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from presage.session import cut_lineage

HOT_SHARE = 1000      # a key is hot from 1/1000 of all rows on: at most 1000 hot keys
HOT_MIN_ROWS = 200_000  # rows of a hot key per salt


def join_back(rows: DataFrame, totals: DataFrame, keys: Sequence[str], n: str, row_id: Column) -> DataFrame:
    """Left join per-group ``totals`` onto ``rows``; hot groups are salted.

    ``totals`` has one row per key and carries the group's row count in ``n``.
    Hot keys are those with at least 1/HOT_SHARE of all rows, so their list is
    never longer than HOT_SHARE and can be broadcast whatever the input size.
    """
    keys = list(keys)
    all_rows = totals.agg(F.sum(n)).scalar()
    hot = (
        totals.select(*keys, F.col(n).alias("_hot_n"))
        .filter((F.col("_hot_n") >= HOT_MIN_ROWS) & (F.col("_hot_n") * HOT_SHARE >= all_rows))
        .select(*keys, F.ceil(F.col("_hot_n") / HOT_MIN_ROWS).cast("int").alias("_salts"))
    )
    marked = _null_safe_left(rows, F.broadcast(hot), keys)
    marked = marked.withColumn(
        "_salt", F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(row_id), F.col("_salts")).cast("int"))
    ).drop("_salts")
    spread = _null_safe_left(totals, F.broadcast(hot), keys)
    spread = spread.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    ).drop("_salts")
    return _null_safe_left(marked, spread, [*keys, "_salt"]).drop("_salt")


def _null_safe_left(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"_r_{k}")
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, cond, "left").drop(*[f"_r_{k}" for k in keys])


def fork(rows: DataFrame) -> DataFrame:
    """Prepare rows that are read more than once."""
    return cut_lineage(rows)


def attach(rows: DataFrame, per_group: DataFrame, keys: Sequence[str], n: str, row_id: Column) -> DataFrame:
    """Left join one row per group (with its row count ``n``) onto forked rows."""
    return join_back(rows, per_group, keys, n, row_id).drop(n)


def by_size(rows: DataFrame, keys: Sequence[str], step: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
    """``step(rows, whole)`` on the groups of ``keys``, those one task may hold apart from the others.

    Groups of at most HOT_MIN_ROWS rows are dealt out whole in one shuffle, so
    windows and aggregates on ``keys`` and more need no other; ``step`` is told
    by ``whole``. The larger ones, if there are any, go through it spread over tasks.
    """
    keys = list(keys)
    large = cut_lineage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > HOT_MIN_ROWS).drop("_n"))
    if large.isEmpty():
        return step(rows.repartition(*keys), True)
    rows = cut_lineage(rows)
    of_large = large.select(*[F.col(k).alias(f"_r_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    small = step(rows.join(of_large, same, "left_anti").repartition(*keys), True)
    return small.unionByName(step(rows.join(of_large, same, "left_semi"), False))


def with_totals(rows: DataFrame, keys: Sequence[str], aggs: dict[str, Column], row_id: Column, whole: bool = False) -> DataFrame:
    """Attach aggregates of a row's group to the row (a window without ordering); ``whole``: one task may hold a group."""
    keys = list(keys)
    if whole:
        return rows.withColumns({name: agg.over(Window.partitionBy(*keys)) for name, agg in aggs.items()})
    rows = cut_lineage(rows)
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n_group"), *[agg.alias(name) for name, agg in aggs.items()])
    return join_back(rows, totals, keys, "_n_group", row_id).drop("_n_group")


def with_rank(
    rows: DataFrame,
    keys: Sequence[str],
    bucket: Sequence[Column],
    order: Sequence[Column],
    name: str = "rank",
    whole: bool = False,
) -> DataFrame:
    """1-based rank inside a group of any size, or (``whole``) of one that a task may hold.

    ``bucket`` are columns whose ascending order agrees with ``order`` and which
    cut a group into small pieces (a day, an ordinal block). Rank is the number
    of rows in earlier buckets plus the position inside the own bucket.
    """
    keys = list(keys)
    if whole:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    rows = cut_lineage(rows)
    bnames = [f"_b{i}" for i in range(len(bucket))]
    rows = rows.withColumns(dict(zip(bnames, bucket)))
    cells = rows.groupBy(*keys, *bnames).agg(F.count(F.lit(1)).alias("_cell"))
    before = Window.partitionBy(*keys).orderBy(*bnames).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_cell").over(before), F.lit(0))).drop("_cell")
    local = Window.partitionBy(*keys, *bnames).orderBy(*order)
    ranked = rows.withColumn("_local", F.row_number().over(local))
    return (
        _null_safe_left(ranked, cells, [*keys, *bnames])
        .withColumn(name, (F.col("_before") + F.col("_local")).cast("long"))
        .drop("_before", "_local", *bnames)
    )


def latest_per(rows: DataFrame, keys: Sequence[str], order: Column, columns: Sequence[str] | None = None) -> DataFrame:
    """Whole row with the greatest ``order`` per key, merged map-side first."""
    return _pick(rows, keys, order, columns, F.max_by)


def first_per(rows: DataFrame, keys: Sequence[str], order: Column, columns: Sequence[str] | None = None) -> DataFrame:
    """Whole row with the smallest ``order`` per key, merged map-side first."""
    return _pick(rows, keys, order, columns, F.min_by)


def _pick(rows, keys, order, columns, fn):
    cols = [c for c in (columns or rows.columns) if c not in keys]
    picked = rows.groupBy(*keys).agg(fn(F.struct(*cols), order).alias("_pick"))
    return picked.select(*keys, *[F.col(f"_pick.{c}").alias(c) for c in cols])


#: Cells a group is cut into at a time, and distinct values of one cell that are looked at one by one.
SPLITS, CELL_VALUES = 256, 100_000


def values_reaching(dist: DataFrame, keys: Sequence[str], wanted: DataFrame, tol: float = 0.0) -> DataFrame:
    """First value of each group whose running measure reaches ``_t``: keys, ``_id``, ``_v``.

    ``dist``: keys, ``_v`` (distinct in a group), ``_m`` (count or weight);
    ``wanted``: keys, ``_id``, ``_t``. A group with many values is cut at
    equally deep splitters (``percentile_approx``, merged map-side), so a far
    value does not empty the cells; only the cell in which the measure is
    reached is kept and cut again until it is small.
    """
    scope = list(keys)
    dist, wanted = cut_lineage(dist), cut_lineage(wanted.withColumnRenamed("_t", "_left"))
    while (dist.groupBy(*scope).count().agg(F.max("count").alias("n")).first()["n"] or 0) > CELL_VALUES:
        cell = f"_cell{len(scope)}"
        ends = dist.groupBy(*scope).agg(F.percentile_approx("_v", [i / SPLITS for i in range(1, SPLITS)], 40 * SPLITS).alias("_ends"), F.count(F.lit(1)).alias("_n_group"))
        # the cell is how many splitters lie below: sixteen steps of sixteen first, then the rest
        step = 16
        coarse = F.size(F.filter(F.transform(F.sequence(F.lit(step), F.lit(SPLITS - 1), F.lit(step)), lambda i: F.element_at("_ends", i)), lambda x: x < F.col("_v")))
        within = join_back(dist, ends, scope, "_n_group", F.col("_v")).drop("_n_group").withColumn("_coarse", coarse)
        fine = F.size(F.filter(F.slice("_ends", F.col("_coarse") * step + 1, F.lit(step)), lambda x: x < F.col("_v")))
        dist = cut_lineage(within.withColumn(cell, F.col("_coarse") * step + fine).drop("_ends", "_coarse"))
        cells = dist.groupBy(*scope, cell).agg(F.sum("_m").alias("_cm"))
        upto = Window.partitionBy(*scope).orderBy(cell).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # SPLITS rows at most
        cells = cells.withColumn("_end", F.sum("_cm").over(upto)).withColumn("_start", F.col("_end") - F.col("_cm")).drop("_cm")
        found = wanted.join(cells, scope).filter(F.col("_end") + tol >= F.col("_left")).groupBy(*scope, "_id", "_left").agg(F.min_by(F.struct(cell, "_start"), cell).alias("_x"))
        wanted = cut_lineage(found.select(*scope, "_id", (F.col("_left") - F.col("_x._start")).alias("_left"), F.col(f"_x.{cell}").alias(cell)))
        scope.append(cell)
        dist = cut_lineage(dist.join(wanted.select(*scope).distinct(), scope, "left_semi"))
    run = Window.partitionBy(*scope).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = dist.withColumn("_cum", F.sum("_m").over(run))
    reached = wanted.join(inside, scope).filter(F.col("_cum") + tol >= F.col("_left"))
    return reached.groupBy(*scope, "_id").agg(F.min("_v").alias("_v")).select(*keys, "_id", "_v")


def exact_quantiles(rows: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Exact linear-interpolation quantiles per key without gathering a group.

    Values are merged to (value, count) first, then the wanted order statistics
    are narrowed down. Output: keys, ``prob``, ``q``, ``n``.
    """
    keys = list(keys)
    rows = rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    dist = cut_lineage(rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_m")))
    sizes = dist.groupBy(*keys).agg(F.sum("_m").alias("n"))
    asked = sizes.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs]))).withColumn("_pos", F.col("prob") * (F.col("n") - 1))
    asked = cut_lineage(asked.select(*keys, "prob", "n", (F.col("_pos") - F.floor("_pos")).alias("_frac"), F.explode(F.array(F.floor("_pos"), F.least(F.floor("_pos") + 1, F.col("n") - 1))).alias("_id")))
    found = values_reaching(dist, keys, asked.select(*keys, "_id", (F.col("_id") + 1).alias("_t")).distinct())
    return asked.join(found, [*keys, "_id"]).groupBy(*keys, "prob").agg(
        (F.min("_v") + (F.max("_v") - F.min("_v")) * F.max("_frac")).alias("q"), F.max("n").alias("n"))


def weighted_medians(rows: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """First value whose cumulative weight reaches half of the group's total.

    Zero total weight falls back to the plain middle value(s) of the group.
    """
    keys = list(keys)
    rows = rows.filter(F.col(value).isNotNull()).select(
        *keys, F.col(value).cast("double").alias("_v"), F.col(weight).cast("double").alias("_w"))
    dist = cut_lineage(rows.groupBy(*keys, "_v").agg(F.sum("_w").alias("_m")))
    totals = cut_lineage(dist.groupBy(*keys).agg(F.sum("_m").alias("_tw")))
    plain = exact_quantiles(rows.join(totals.filter("_tw = 0").select(*keys), keys, "left_semi"), keys, "_v", [0.5]).select(*keys, F.col("q").alias("median"))
    half = totals.filter("_tw > 0").select(*keys, F.lit(0).alias("_id"), (F.col("_tw") / 2).alias("_t"))
    return values_reaching(dist, keys, half, 1e-12).select(*keys, F.col("_v").alias("median")).unionByName(plain)
