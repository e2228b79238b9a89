from datetime import date

import pytest
from pyspark.sql import functions as F

from tidepanel.functions import scalars as S
from tidepanel.operators import drift, metrics, panel, ranking
from tidepanel.plans.frames import Check, Feature, LeakageError, audit, require
from tidepanel.sources import delimited as D


def test_status_mapping(spark):
    codes = ["00", "01", "02", "03", "04", "12", "99", "100", "RA", "XX", None, "Q1"]
    s = F.col("s")
    got = spark.createDataFrame([(c,) for c in codes], "s string").select(S.status_months(s), S.status_bucket(s), S.status_owned(s)).collect()
    assert [tuple(r) for r in got] == [(0, 0, False), (1, 1, False), (2, 2, False), (3, 3, False), (4, 4, False), (12, 4, False), (99, 4, False), (100, 4, False), (None, 4, True)] + [(None, None, None)] * 3


def test_text_is_cleaned_cast_and_counted(spark, tmp_path):
    path = tmp_path / "sample_orig_2003.txt"
    path.write_text('L1|720|"q"\nL2|650\nL3| 9999 |x|extra\nL4|abc|y\n')
    fields = [D.Field(1, "id", "string"), D.Field(2, "score", "int"), D.Field(3, "c", "string")]
    raw = D.read_text(spark, str(path), fields)
    assert sum(r[D.CORRUPT] is not None for r in raw.collect()) == 2
    clean = D.clean(raw, fields, {"score": ["9999"]})
    p = D.profile(clean, fields).first()
    assert (p.n_rows, p.n_corrupt, p.failed_score) == (4, 2, 1)
    rows = {r.id: r for r in D.cast(clean, fields).withColumn("v", D.file_vintage()).collect()}
    assert rows["L1"].score == 720 and rows["L1"].c == '"q"' and rows["L3"].score is None and rows["L1"].v == 2003
    with pytest.raises(ValueError):
        S.typed(F.col("x"), "money")
    assert D.field_kind("Numeric", "12,2") == "double" and D.field_kind("Numeric", "4") == "int" and D.field_kind("Alpha", "2") == "string"


def history(spark, buckets, codes=(), skip=(), last=None):
    rows = [("L", k, None if b == "R" else b, b == "R", dict(codes).get(k)) for k, b in enumerate(buckets) if k not in skip]
    rows += [("Z", last if last is not None else 40, 0, False, None)]
    return spark.createDataFrame(rows, "loan_sequence_number string, month_idx int, dq_bucket int, is_reo boolean, zero_balance_code string").withColumn("dq_bucket", F.when(F.col("is_reo"), 4).otherwise(F.col("dq_bucket")))


@pytest.mark.parametrize(
    "buckets,t,codes,skip,last,want",
    [
        ([0, 1, 1, 2, 2], 1, (), (), None, (1, "deeper_bucket")),
        ([0, 1, 0, 0, 0], 1, (), (), None, (0, "no_roll_full_window")),
        ([0, 1, 1, 1, 1, 2], 1, (), (), None, (0, "no_roll_full_window")),
        ([3, 3, "R"], 0, (), (), None, (1, "deeper_bucket")),
        ([1, 1, 1], 0, ((2, "03"),), (), None, (1, "roll_zero_balance")),
        ([1, 0], 0, ((1, "01"),), (), None, (0, "cure_zero_balance")),
        ([1, 0], 0, ((1, "16"),), (), None, (None, "excluded_zero_balance")),
        ([1, 2, 0], 0, ((2, "16"),), (), None, (1, "deeper_bucket")),
        ([1, 1, 2, 3, 3, 3], 3, (), (), 5, (None, "end_of_data")),
        ([1, 1], 0, (), (), None, (None, "incomplete_window")),
        ([1, 1, 1, 1, 2], 0, (), (1,), None, (None, "incomplete_window")),
        ([1, 1, 2, 2], 0, (), (1,), None, (1, "deeper_bucket")),
    ],
)
def test_labels(spark, buckets, t, codes, skip, last, want):
    r = panel.labelled(history(spark, buckets, codes, skip, last)).where(f"loan_sequence_number = 'L' AND month_idx = {t}").first()
    assert (r.label, r.label_reason) == want


def test_trajectories_and_gap(spark):
    b = [0, 0, 1, 2, 0, 0, 1, 1, 0, 0, 0, 1, 2, 1, 2, 3]
    rows = [("L", k, x, 100000.0 - 500 * k) for k, x in enumerate(b)]
    schema = "loan_sequence_number string, month_idx int, dq_bucket int, current_upb double"
    r = panel.trajectories(spark.createDataFrame(rows, schema)).where("month_idx = 13").first()
    assert (r.months_delinquent_last_3, r.max_bucket_last_3, r.mean_bucket_last_3, r.bucket_lag_1, r.bucket_lag_2, r.bucket_lag_3) == (2, 2, 1.0, 2, 1, 0)
    assert (r.delinquency_velocity_3m, r.months_since_last_current, r.months_since_first_delinquency, r.times_entered_delinquency_before_t) == (1, 3, 11, 3)
    assert (r.n_cure_events_last_6, r.n_roll_events_last_6, r.longest_delinquent_run_before_t, r.current_run_length, r.max_bucket_before_t) == (1, 2, 2, 3, 2)
    assert abs(r.upb_change_pct_3 - (93500 / 95000 - 1) * 100) < 1e-9
    r = panel.trajectories(spark.createDataFrame([x for x in rows if x[1] != 12], schema)).where("month_idx = 13").first()
    assert (r.bucket_lag_1, r.bucket_lag_2, r.months_observed_last_12, r.months_delinquent_last_3, r.current_run_length) == (None, 1, 11, 1, 1)


def test_one_exchange_for_all_trajectories(spark):
    df = spark.range(10).select(F.concat(F.lit("L"), F.col("id") % 2).alias("loan_sequence_number"), F.col("id").cast("int").alias("month_idx"), F.lit(1).alias("dq_bucket"), F.lit(1.0).alias("current_upb")).repartition(3)
    plan = panel.trajectories(df)._jdf.queryExecution().sparkPlan().toString()
    assert "Python" not in plan
    assert panel.trajectories(df)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_capture_by_hand(spark):
    rows = [("a", 1, 1, 100, 1), ("b", 1, 1, 200, 0), ("c", 1, 1, 300, 1), ("d", 1, 1, 400, 0), ("e", 1, 1, 500, 1), ("f", 2, 1, 1000, 0), ("g", 2, 1, 10, 1)]
    df = spark.createDataFrame(rows, "loan_sequence_number string, month_idx int, dq_bucket int, exposure long, label int").withColumn("p", F.lit(0.5))
    sim = ranking.simulate(df, [0.4, 0.5, 1.0], {"by_balance": "CAST(exposure AS DOUBLE)"})
    got = {(r.capacity, r.policy): r.capture for r in ranking.curve(sim).collect()}
    assert got[0.4, "by_balance"] == round(500 / 910, 6) and got[0.4, "oracle"] == round(800 / 910, 6) and got[0.5, "oracle"] == round(810 / 910, 6)
    assert got[1.0, "by_balance"] == got[1.0, "oracle"] == 1.0
    with pytest.raises(LeakageError):
        ranking.ranked(df)


def test_contacts_are_safe_floors(spark):
    got = spark.createDataFrame([(10, 0.3), (411, 0.05), (7, 1.0)], "n long, c double").select(S.contacts(F.col("c"), F.col("n")).alias("k")).collect()
    assert [r.k for r in got] == [3, 20, 7]
    with pytest.raises(Exception, match="capacity"):
        spark.createDataFrame([(10, 1.5)], "n long, c double").select(S.contacts(F.col("c"), F.col("n"))).collect()


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(0, 0.05), (1, 0.15), (1, 0.95), (1, 0.85)], "y int, p double")
    rel = {r.bin: r for r in metrics.reliability(df).collect()}
    assert len(rel) == 10 and [rel[k].n for k in (0, 1, 5, 8, 9)] == [1, 1, 0, 1, 1] and rel[5].mean_pred is None
    assert metrics.calibration_error(spark.createDataFrame([(0, 0.2), (1, 0.9)], "y int, p double")).first().ece == 0.15
    two = spark.createDataFrame([(1, 0, 0.1), (1, 1, 0.9), (2, 0, 0.2), (2, 0, 0.3)], "b int, y int, p double")
    assert {r.b: r.auc for r in metrics.auc(two, ["b"]).collect()} == {1: 1.0, 2: None}


def test_monthly_means_do_not_depend_on_the_order_of_rows(spark):
    """Means that are halves at the last place: a sum of doubles falls on either side of them, by the order of its rows."""
    p = [0.450001, 0.483721, 0.512077, 0.539031, 0.46723, 0.501123, 0.49907, 0.338711]
    assert sum(round(x * 10**6) for x in p) % 8 == 4  # the eighth of it ends on a half
    for rows in (3 * p, 3 * p[::-1], sorted(3 * p), sorted(3 * p)[::-1]):
        df = spark.createDataFrame([(1, x, 0, 0.25) for x in rows], "month_idx int, p double, y int, p_raw double").coalesce(1)
        r = drift.monthly(df, "month_idx").first()
        assert (r.mean_pred, r.gap, r.gap_raw, r.roll_rate, r.ece) == (0.473871, 0.473871, 0.25, 0.0, 0.473871)
    odd = spark.createDataFrame([(float("nan"),), (1e30,)], "p double")
    assert str(odd.select(metrics.exact_mean("p")).first()[0]) == "nan" and odd.where("p < 1e31").select(metrics.exact_mean("p")).first()[0] == 1e30


def test_departures(spark):
    v = [0.5, 2.0, 0.5, -5.0, -5.0, 2.0, 2.0, 2.0]
    s = spark.createDataFrame(list(zip("abcdefgh", v)), "period string, x double")
    bands = spark.createDataFrame([(0.0, 1.0)], "low double, high double")
    first = lambda **k: drift.first_departure(s, bands, "period", "x", **k).first()[0]
    assert (first(), first(bad="low"), first(run=1)) == ("f", "d", "b")
    empty = s.withColumn("x", F.lit(None).cast("double"))
    assert drift.first_departure(empty, bands, "period", "x").first()[0] is None


def test_guards():
    with pytest.raises(LeakageError):
        audit([Feature("f", "max(x)", 1, 3)])
    with pytest.raises(LeakageError):
        audit([Feature("f", "max(x)", -3, -1, ("Zero_Balance_Code",))])
    audit(panel.trajectory_features())
    with pytest.raises(AssertionError):
        require([Check("a", False, "no")])
    require([Check("a", False, "no")], {"a": "known and agreed with the owners"})
    assert date(2015, 1, 1).year * 12 == 24180
