import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import scalars as S
from tidepanel.operators import metrics, panel, scoring
from tidepanel.sources import delimited
from tidepanel.sources.workspace import scratch


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(0)
    p = rng.random(6000)
    z = np.log(p / (1 - p))
    rows = [(int(k % 36), float(1 / (1 + np.exp(-(b + 0.8)))), int(rng.random() < a), int(k % 3 + 1), float(b), None if k % 7 == 0 else float(rng.random())) for k, (a, b) in enumerate(zip(p, z, strict=True))]
    return spark.createDataFrame(rows, "month_idx int, raw double, y int, dq_bucket int, a double, b double").withColumn("label", F.col("y")).cache()


def test_calibrators_mend_a_shift(scores):
    before = metrics.calibration_error(scores, score="raw").first().ece
    for name in ("intercept", "platt", "isotonic"):
        after = metrics.calibration_error(scoring.calibrator(name)(scores)(scores)).first().ece
        assert after < 0.02 < before, name
    chosen, table = scoring.transfer_check(scores, "month_idx")
    assert chosen != "identity" and table.count() == 4
    with pytest.raises(ValueError):
        scoring.calibrator("magic")


def test_woe_logistic_and_comparison(scores):
    check, train = scores.where("month_idx >= 30"), scores.where("month_idx < 30")
    woe = scoring.woe_logistic(train, ["a", "b"])
    pooled = scoring.boosted(train, ["a", "b"], trees=10, depth=3, check=check)
    own = scoring.segmented(train, ["a", "b"], "dq_bucket", [1, 2, 3], trees=3, depth=2)
    models = {"woe": woe, "pooled": lambda df: scoring.scored(pooled, df, ["a", "b"], "raw"), "own": lambda df: scoring.scored_by_segment(own, df, ["a", "b"], "dq_bucket", "raw")}
    bare = lambda df: df.drop("raw")
    got = {r.model: r for r in scoring.compared(models, bare(check), bare(check)).collect()}
    assert got.keys() == models.keys() and all(r.auc > 0.75 for r in got.values())
    assert got["woe"].auc == metrics.auc(woe(bare(check)), [], "raw").first().auc
    with pytest.raises(ValueError):
        scoring.scored_by_segment(own, bare(check).withColumn("dq_bucket", F.lit(9)), ["a", "b"], "dq_bucket")


def test_frozen_model_is_refused_for_other_settings(spark, scores):
    model = scoring.boosted(scores, ["a"], trees=2, depth=2)
    path = scratch(spark, "frozen")
    scoring.freeze(model, scoring.manifest(["a"], {"trees": 2}, {"method": "platt"}), path, spark)
    again, made = scoring.thaw(path, spark, ["a"], {"trees": 2})
    assert made["chosen"] == {"method": "platt"} and scoring.scored(again, scores.drop("raw"), ["a"]).count() == 6000
    with pytest.raises(ValueError):
        scoring.thaw(path, spark, ["a"], {"trees": 3})


def test_sinks(spark):
    df = spark.createDataFrame([(k, 2000 + k % 3, k / 7) for k in range(50)], "k int, year int, x double")
    path = scratch(spark, "parts")
    delimited.write_partitioned(df, path, "year", ["k"])
    assert spark.read.parquet(path).where("year = 2001").count() == df.where("year = 2001").count()
    log = scratch(spark, "log")
    delimited.append_log(spark, log, {"run": 1})
    assert {(r.run, r.auc) for r in delimited.append_log(spark, log, {"run": 2, "auc": 0.5}).collect()} == {(1, None), (2, 0.5)}


def test_joins_and_grids(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    assert panel.join_one_to_one(a, a.withColumnRenamed("a", "b"), ["k"]).count() == 2
    with pytest.raises(ValueError):
        panel.join_one_to_one(a, a.union(a), ["k"])
    assert S.capacity_grid(0.1, 0.3, 0.1, [0.25]) == [0.1, 0.2, 0.25, 0.3, 1.0]
    got = panel.contained(a.withColumn("g", F.lit(1)), a.where("k = 1"), ["k"], ["g"]).first()
    assert (got.n, got.n_missing) == (2, 1)
