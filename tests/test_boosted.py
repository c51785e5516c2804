"""What the registered backtest hands to the boosted trees."""

from presage.operators import models
from presage.plans.graphs import boosted_backtest


def test_whole_job(spark, monkeypatch):
    import inspect

    seen, plain = {}, inspect.signature(models.boosted_by_fold)

    def spy(*args, **how):
        bound = plain.bind(*args, **how)
        bound.apply_defaults()
        seen.update(bound.arguments)
        return seen["rows"].selectExpr("market_id", "outcome", "0.5D AS p")

    monkeypatch.setattr(models, "boosted_by_fold", spy)
    boosted_backtest(spark, "/root/testdata/sf0.001")
    assert seen["folds"] >= 10 and seen["iterations"] == 100 and seen["step"] == 0.05 and seen["event"] == "market_id"
    assert len(models.FEATURES) == 11 and set(models.FEATURES) <= set(seen["rows"].columns)
    assert seen["rows"].na.drop(subset=list(models.FEATURES)).count() == seen["rows"].count() > 0
    assert seen["rows"].agg({"prediction_count": "sum"}).first()[0] > 0


def test_folds_are_fitted_side_by_side(spark, monkeypatch):
    """Each fit waits until every fold's fit has begun, so one after the other would never end."""
    from threading import Barrier

    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    begun = Barrier(3, timeout=60)

    class Share:
        def __init__(self, **how):
            pass

        def fit(self, rows):
            begun.wait()
            share = rows.agg(F.avg("label")).first()[0]
            self.transform = lambda other: other.withColumn("probability", array_to_vector(F.array(F.lit(1 - share), F.lit(share))))
            return self

    monkeypatch.setattr(models, "GBTClassifier", Share)
    rows = spark.range(30).selectExpr("id AS event", "id % 2 = 0 AS outcome", *[f"0.5D AS {c}" for c in models.FEATURES]).localCheckpoint()
    got = models.boosted_by_fold(rows, "event", folds=3).collect()
    fold = {r.event: r.f for r in rows.selectExpr("event", "pmod(xxhash64(event), 3) AS f").collect()}
    for r in got:
        others = [e % 2 == 0 for e, f in fold.items() if f != fold[r.event]]
        assert abs(r.p - sum(others) / len(others)) < 1e-9 and r.outcome == (r.event % 2 == 0)
    assert len(got) == 30
