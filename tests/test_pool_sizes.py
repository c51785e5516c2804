"""Pools that one task may hold are dealt out once; larger ones give the same results."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from presage.operators import pooling as PL, skew
from presage.plans import studies
from presage.plans.pooling import FULL, _out, evidence

SF = "/root/testdata/sf0.001"


def uneven(spark, sf=SF):
    """Pools of 1 to 40 rows."""
    return evidence(spark, sf).filter("row_ix % 40 <= pool_id * 7 % 40")


def sweep(spark):
    return studies.strata_threshold_sweep(spark, SF)


def full(spark):
    return _out(PL.aggregate_pool(uneven(spark), ["pool_id"], FULL))


def outliers(spark):
    return studies.outlier_scan(spark, SF)


def alike(a, b):
    assert len(a) == len(b) > 0
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert u == v or (isinstance(u, float) and u == pytest.approx(v, abs=1e-9)), (x, y)


@pytest.mark.parametrize("query", [full, sweep, outliers])
def test_results_do_not_depend_on_what_is_large(spark, monkeypatch, query):
    monkeypatch.setattr(studies, "evidence", uneven)
    result = lambda: sorted(map(tuple, query(spark).collect()), key=lambda r: tuple(str(x) for x in r[:2]))
    whole = result()
    sizes = uneven(spark).groupBy("pool_id").count()
    assert not sizes.filter(F.col("count") > 15).isEmpty() and not sizes.filter(F.col("count") <= 15).isEmpty()
    monkeypatch.setattr(skew, "HOT_MIN_ROWS", 15)
    alike(whole, result())


@pytest.mark.parametrize("name", ["pooled_forecasts_full", "capped_source_weights", "strata_threshold_sweep", "outlier_scan"])
def test_rows_of_small_pools_are_not_written(spark, monkeypatch, name):
    written = []
    cut = skew.cut_lineage

    def watched(df):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(skew, "cut_lineage", watched)
    entry.queries()[name](spark, SF)
    assert written == [0]
