"""Who to contact first: priorities, ranks with seeded ties, value captured at each capacity, checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..plans.frames import LeakageError

KEY, PERIOD = "loan_sequence_number", "month_idx"
OUTCOMES = ("label", "rolls_deeper", "at_risk", "outcome", "label_reason")
PLACES = 6

#: What each policy ranks by, largest first; random has ties only.
POLICIES = {
    "random": "CAST(0 AS DOUBLE)",
    "by_dpd": "CAST(dq_bucket AS DOUBLE)",
    "by_balance": "CAST(exposure AS DOUBLE)",
    "by_prob": "p",
    "by_expected_value": "p * exposure",
    "by_expected_value_raw": "p_raw * exposure",
}
UNINFORMED = ("random", "oracle")


def ranked(df: DataFrame, policies: Mapping[str, str] = POLICIES, seeds: Sequence[int] = (0,), key: str = KEY, period: str = PERIOD) -> DataFrame:
    """(period, key, policy, seed, rank). Frames that still hold an outcome are refused: a policy must not see one.

    Each row is repeated per policy and seed inside its task; one shuffle by (period, policy, seed) ranks them all.
    """
    if seen := {c.lower() for c in df.columns} & set(OUTCOMES):
        raise LeakageError(f"outcome columns before ranking: {sorted(seen)}")
    options = F.array(*(F.struct(F.lit(n).alias("policy"), F.expr(e).alias("priority")) for n, e in policies.items()))
    long = df.select(period, key, F.explode(options).alias("o")).select(period, key, "o.policy", F.when(F.col("o.priority").isNull(), F.raise_error(F.lit("a priority is null")).cast("double")).otherwise(F.col("o.priority")).alias("priority"))
    long = long.select("*", F.explode(F.array(*map(F.lit, seeds))).alias("seed"))
    w = Window.partitionBy(period, "policy", "seed").orderBy(F.desc("priority"), S.shuffled(F.col("seed").cast("string"), F.col(key), F.col(period)), key)
    return long.select(period, key, "policy", "seed", F.row_number().over(w).alias("rank"))


def simulate(df: DataFrame, capacities: Sequence[float], policies: Mapping[str, str] = POLICIES, seeds: Sequence[int] = (0,), y: str = "label") -> DataFrame:
    """(period, policy, seed, capacity, n, contacts, captured, at_risk); policy `oracle` ranks by what was at risk.

    Money is in whole units, so sums are exact. Captured value is read off running sums at rank = contacts, so the
    number of capacities doesn't multiply the ranked rows.
    """
    money = df.select(PERIOD, KEY, F.when(F.col(y) == 1, F.col("exposure")).otherwise(0).cast("long").alias("money"))
    r = ranked(df.drop(*OUTCOMES), policies, seeds).join(money, [PERIOD, KEY])
    best = Window.partitionBy(PERIOD).orderBy(F.desc("money"), KEY)
    hindsight = money.select(PERIOD, KEY, F.lit("oracle").alias("policy"), "money", F.row_number().over(best).alias("rank"))
    r = r.unionByName(hindsight.select("*", F.explode(F.array(*map(F.lit, seeds))).alias("seed")))
    run = Window.partitionBy(PERIOD, "policy", "seed").orderBy("rank")
    cum = r.withColumn("captured", F.sum("money").over(run.rowsBetween(Window.unboundedPreceding, 0))).select(PERIOD, "policy", "seed", F.col("rank").cast("long").alias("contacts"), "captured")
    size = money.groupBy(PERIOD).agg(F.count("*").alias("n"), F.sum("money").alias("at_risk"))
    grid = size.select("*", F.explode(F.array(*map(F.lit, capacities))).alias("capacity"))
    grid = grid.select("*", S.contacts(F.col("capacity"), F.col("n")).alias("contacts"), F.explode(F.array(*map(F.lit, [*policies, "oracle"]))).alias("policy"))
    grid = grid.select("*", F.explode(F.array(*map(F.lit, seeds))).alias("seed"))
    return grid.join(cum, [PERIOD, "policy", "seed", "contacts"], "left").withColumn("captured", F.coalesce("captured", F.lit(0).cast("long")))


def curve(sim: DataFrame) -> DataFrame:
    """Pooled capture per (capacity, policy): sums over months, then the ratio; seeds are averaged."""
    s = sim.groupBy("capacity", "policy", "seed").agg(F.sum("captured").alias("c"), F.sum("at_risk").alias("r"))
    return s.groupBy("capacity", "policy").agg(F.round(F.try_divide(F.sum("c"), F.sum("r")), PLACES).alias("capture"))


def monthly_capture(sim: DataFrame, capacity: float) -> DataFrame:
    at = sim.where(S.same_number(F.col("capacity"), F.lit(capacity)))
    s = at.groupBy(PERIOD, "policy").agg(F.sum("captured").alias("c"), F.sum("at_risk").alias("r"))
    return s.select(PERIOD, "policy", F.round(F.try_divide(F.col("c"), F.col("r")), PLACES).alias("capture"))


def stability(months: DataFrame, floors: Sequence[str] = ("by_dpd", "by_balance")) -> DataFrame:
    """Mean, spread and range of each policy's months, and in how many it is above each floor."""
    at = {f: F.max(F.when(F.col("policy") == f, F.col("capture"))).alias(f"floor_{f}") for f in floors}
    j = months.join(months.groupBy(PERIOD).agg(*at.values()), PERIOD)
    above = [F.count_if(F.col("capture") > F.col(f"floor_{f}")).alias(f"above_{f}") for f in floors]
    return j.groupBy("policy").agg(F.count("capture").alias("months"), F.round(F.avg("capture"), 8).alias("mean"), F.round(F.stddev_samp("capture"), 8).alias("sd"), F.min("capture").alias("low"), F.max("capture").alias("high"), *above)


def gap_closed(points: DataFrame, floor: str = "random") -> DataFrame:
    """(policy - floor) / (oracle - floor) at each capacity."""
    wide = points.groupBy("capacity").agg(F.max(F.when(F.col("policy") == floor, F.col("capture"))).alias("f"), F.max(F.when(F.col("policy") == "oracle", F.col("capture"))).alias("o"))
    return points.join(wide, "capacity").select("capacity", "policy", F.round(F.try_divide(F.col("capture") - F.col("f"), F.col("o") - F.col("f")), 4).alias("gap_closed"))


def largest_share(df: DataFrame, capacity: float, value: Column | None = None) -> DataFrame:
    """Share of exposure held by the largest accounts of each month, and the outcome rates of those and of the rest."""
    w = Window.partitionBy(PERIOD)
    r = df.withColumns({"r": F.row_number().over(w.orderBy(F.desc("exposure"), KEY)), "n": F.count("*").over(w)})
    top = F.col("r") <= S.contacts(F.lit(capacity), F.col("n"))
    s = r.agg(F.sum(F.when(top, F.col("exposure"))).alias("a"), F.sum("exposure").alias("b"), F.avg(F.when(top, F.col("label"))).alias("x"), F.avg(F.when(~top, F.col("label"))).alias("y"))
    return s.select(F.round(F.try_divide(F.col("a"), F.col("b")), PLACES).alias("balance_share"), F.round("x", PLACES).alias("rate_largest"), F.round("y", PLACES).alias("rate_rest"))


def validity(points: DataFrame) -> DataFrame:
    """Structural checks of a curve as rows (check, passed): complete at full capacity, never over the oracle, never
    falling, random near its capacity."""
    w = Window.partitionBy("policy").orderBy("capacity")
    p = points.withColumn("before", F.lag("capture").over(w))
    p = p.join(points.where("policy = 'oracle'").select("capacity", F.col("capture").alias("best")), "capacity")
    one = p.agg(
        F.bool_and((F.col("capacity") < 1) | (F.abs(F.col("capture") - 1) < 1e-6)).alias("all_at_full_capacity"),
        F.bool_and(F.col("capture") <= F.col("best") + 1e-6).alias("never_over_oracle"),
        F.bool_and(F.col("before").isNull() | (F.col("capture") >= F.col("before") - 1e-6)).alias("never_falling"),
        F.bool_and((F.col("policy") != "random") | (F.abs(F.col("capture") - F.col("capacity")) < 0.25)).alias("random_near_capacity"),
    )
    return one.unpivot([], one.columns, "check", "passed")


def structure_checks(points: DataFrame, share: DataFrame, capacity: float, tolerance: float) -> DataFrame:
    """Six families of checks as rows (check, passed): random follows the capacity; nothing is above the oracle; informed
    policies are below it short of full capacity, and not below random; curves never fall and end complete; ranking by
    balance captures what the largest balances hold (`share`, one row) at `capacity`."""
    ends = points.groupBy("capacity").agg(*(F.max(F.when(F.col("policy") == c, F.col("capture"))).alias(n) for c, n in (("oracle", "best"), ("random", "least"))))
    p = points.withColumn("before", F.lag("capture").over(Window.partitionBy("policy").orderBy("capacity"))).join(ends, "capacity").join(F.broadcast(share))
    c, informed, full = F.col("capture"), ~F.col("policy").isin(*UNINFORMED), F.col("capacity") >= 1
    one = p.agg(
        F.bool_and((F.col("policy") != "random") | (F.abs(c - F.col("capacity")) <= tolerance)).alias("random_near_capacity"),
        F.bool_and(c <= F.col("best") + 1e-6).alias("never_over_oracle"),
        F.bool_and(~informed | full | (c < F.col("best"))).alias("informed_below_oracle"),
        F.bool_and(~informed | (c >= F.col("least") - tolerance)).alias("informed_over_random"),
        F.bool_and((F.col("before").isNull() | (c >= F.col("before") - 1e-6)) & (~full | (F.abs(c - 1) < 1e-6))).alias("complete_and_never_falling"),
        F.bool_and((F.col("policy") != "by_balance") | ~S.same_number(F.col("capacity"), F.lit(capacity)) | (F.abs(c - F.col("balance_share")) <= tolerance)).alias("balance_tracks_share"),
    )
    return one.unpivot([], one.columns, "check", "passed")
