"""Panel checks, labels, splits, trajectories and macro series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..plans.frames import START, Feature, applied, window

KEY, MONTH = "loan_sequence_number", "month_idx"
ROLL, CURE, EXCLUDE = ("02", "03", "09", "15"), ("01",), ("16", "96")
SPLITS = {"train": (1995 * 12, 1998 * 12 + 11), "validation": (1999 * 12, 1999 * 12 + 11), "test": (2000 * 12, 2000 * 12 + 11), "drift_study": (2001 * 12, 2001 * 12 + 11)}


def mapped(df: DataFrame, unknown: str = "XX") -> DataFrame:
    """Rows whose status is known or null, with dq_months, dq_bucket and is_reo."""
    s = F.col("delinquency_status")
    kept = df.where(s.isNull() | (s != unknown))
    return kept.withColumns({"dq_months": S.status_months(s), "dq_bucket": S.status_bucket(s), "is_reo": S.status_owned(s)})


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def gap_summary(df: DataFrame) -> DataFrame:
    each = df.groupBy(KEY).agg(F.count("*").alias("n"), (F.max(MONTH) - F.min(MONTH) + 1).alias("span"))
    return each.agg(F.count("*").alias("n_loans"), F.count_if(F.col("span") != F.col("n")).alias("n_with_gaps"))


def shares(df: DataFrame, *by: str) -> DataFrame:
    """Counts and shares of each combination. The grand total is one row, joined back."""
    n = df.groupBy(*by).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("total")))).select(*by, "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def in_population(buckets: Sequence[int] = (1, 2, 3)) -> Column:
    return F.col("dq_bucket").isin(*buckets) & ~F.coalesce("is_reo", F.lit(False)) & F.col("zero_balance_code").isNull()


def with_outcomes(df: DataFrame, horizon: int = 3) -> DataFrame:
    """Look-ahead columns, inside one struct that features can't read by name."""
    w = window(KEY, MONTH, 1, horizon)
    code = F.col("zero_balance_code")
    any_of = lambda codes: F.max(F.when(code.isin(*codes), 1).otherwise(0)).over(w)
    ahead = F.struct(F.max("dq_bucket").over(w).alias("bucket"), F.count("*").over(w).alias("months"), any_of(ROLL).alias("roll"), any_of(CURE).alias("cure"), any_of(EXCLUDE).alias("exclude"))
    return df.withColumn("outcome", ahead)


def labelled(df: DataFrame, horizon: int = 3) -> DataFrame:
    """The population with label_reason and label. Loans never in it are left out before the window."""
    ever = df.where(in_population()).select(KEY).distinct()
    last = df.agg((F.max(MONTH) - horizon).alias("last_month"))
    rows = with_outcomes(df.join(ever, KEY, "left_semi"), horizon).where(in_population()).join(F.broadcast(last))
    o = lambda c: F.col(f"outcome.{c}")
    reason = (
        F.when(F.col(MONTH) > F.col("last_month"), "end_of_data")
        .when(F.coalesce(o("bucket"), F.lit(-1)) > F.col("dq_bucket"), "deeper_bucket")
        .when(o("roll") == 1, "roll_zero_balance")
        .when(o("exclude") == 1, "excluded_zero_balance")
        .when(o("cure") == 1, "cure_zero_balance")
        .when(o("months") == horizon, "no_roll_full_window")
        .otherwise("incomplete_window")
    )
    label = F.when(F.col("label_reason").isin("deeper_bucket", "roll_zero_balance"), 1).when(F.col("label_reason").isin("cure_zero_balance", "no_roll_full_window"), 0)
    return rows.withColumn("label_reason", reason).withColumn("label", label).drop("last_month")


def with_splits(df: DataFrame, splits: Mapping[str, tuple[int, int]] = SPLITS) -> DataFrame:
    """split and first_split of labelled rows inside a split: the split of the loan's first such row."""
    order = {name: k for k, name in enumerate(splits)}
    rows = df.where(F.col("label").isNotNull()).withColumn("split", S.first_range(F.col(MONTH), splits)).where("split IS NOT NULL")
    first = F.min(S.lookup(F.col("split"), order)).over(Window.partitionBy(KEY))
    return rows.withColumn("first_split", F.element_at(F.array(*map(F.lit, order)), first + 1))


def disjoint(df: DataFrame, splits: Mapping[str, tuple[int, int]] = SPLITS) -> DataFrame:
    return with_splits(df, splits).where("split = first_split").drop("first_split")


def overlaps(df: DataFrame, splits: Sequence[str]) -> DataFrame:
    """Loans in each pair of splits, in one pass."""
    held = df.groupBy(KEY).agg(F.collect_set("split").alias("held"))
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for k, a in enumerate(splits) for b in splits[k + 1 :]))
    each = held.select("held", F.explode(pairs).alias("p"))
    both = F.array_contains("held", F.col("p.a")) & F.array_contains("held", F.col("p.b"))
    return each.groupBy(F.col("p.a").alias("split_a"), F.col("p.b").alias("split_b")).agg(F.count_if(both).alias("n_loans"))


def with_events(df: DataFrame) -> DataFrame:
    """Events against the calendar month before; a gap or the first row has none, and runs restart after it."""
    w = Window.partitionBy(KEY).orderBy(MONTH)
    b = F.col("dq_bucket")
    prev = F.when(F.lag(MONTH).over(w) == F.col(MONTH) - 1, F.lag("dq_bucket").over(w))
    df = df.withColumn("prev_bucket", prev)
    entry = F.when((F.coalesce("prev_bucket", F.lit(0)) == 0) & (b > 0), 1).otherwise(0)
    cure = ((F.col("prev_bucket") > 0) & (b == 0)).cast("int")
    df = df.withColumns({"entry_event": entry, "cure_event": cure, "roll_event": (b > F.col("prev_bucket")).cast("int")})
    start = F.max(F.when(F.col("entry_event") == 1, F.col(MONTH))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("run_len", F.when(b > 0, F.col(MONTH) - start + 1))


def trajectory_features(value: str = "current_upb") -> list[Feature]:
    out = []
    for n in (3, 6, 12):
        out += [
            Feature(f"months_delinquent_last_{n}", "sum(CASE WHEN dq_bucket > 0 THEN 1 ELSE 0 END)", -n, -1, ("dq_bucket",)),
            Feature(f"max_bucket_last_{n}", "max(dq_bucket)", -n, -1, ("dq_bucket",)),
            Feature(f"mean_bucket_last_{n}", "avg(dq_bucket)", -n, -1, ("dq_bucket",)),
        ]
    out.append(Feature("months_observed_last_12", "count(1)", -12, -1))
    for n in (6, 12):
        out += [Feature(f"n_{e}_events_last_{n}", f"sum({e}_event)", -n, -1, ("dq_bucket",)) for e in ("cure", "roll")]
    out += [Feature(f"bucket_lag_{k}", "max(dq_bucket)", -k, -k, ("dq_bucket",)) for k in (1, 2, 3)]
    out += [
        Feature("months_since_last_current", "max(CASE WHEN dq_bucket = 0 THEN month_idx END)", START, -1, ("dq_bucket",), "month_idx - {x}"),
        Feature("months_since_first_delinquency", "min(CASE WHEN dq_bucket > 0 THEN month_idx END)", START, -1, ("dq_bucket",), "month_idx - {x}"),
        Feature("longest_delinquent_run_before_t", "max(run_len)", START, -1, ("dq_bucket",)),
        Feature("times_entered_delinquency_before_t", "sum(entry_event)", START, -1, ("dq_bucket",)),
        Feature("max_bucket_before_t", "max(dq_bucket)", START, -1, ("dq_bucket",)),
        Feature("delinquency_velocity_3m", "max(dq_bucket)", -3, -3, ("dq_bucket",), "dq_bucket - {x}"),
        Feature("current_run_length", "max(run_len)", 0, 0, ("dq_bucket",)),
    ]
    out += [Feature(f"upb_change_pct_{n}", f"max({value})", -n, -n, (value,), f"CASE WHEN {{x}} > 0 THEN ({value} / {{x}} - 1) * 100 END") for n in (3, 6, 12)]
    return out


def flag_features(flags: Mapping[str, str]) -> list[Feature]:
    """name -> SQL flag (0, 1 or null): whether it was ever set before the month."""
    return [Feature(name, f"max({expr})", START, -1, (name,)) for name, expr in flags.items()]


def trajectories(df: DataFrame, value: str = "current_upb", extra: Sequence[Feature] = ()) -> DataFrame:
    return applied(with_events(df), [*trajectory_features(value), *extra], KEY, MONTH)


def current_state(df: DataFrame) -> DataFrame:
    return df.withColumns({"upb_to_orig_upb": S.ratio(F.col("current_upb"), F.col("orig_upb")), "rate_change_since_orig": F.col("current_interest_rate") - F.col("orig_interest_rate")})


def monthly(series: DataFrame, by: Sequence[str] = (), extend: int = 2, value: str = "value") -> DataFrame:
    """(by, month_idx, value): monthly means on a calendar that ends `extend` months late, carried forward as far."""
    mean = series.groupBy(*by, MONTH).agg(F.avg(value).alias("mean"))
    ends = mean.groupBy(*by).agg(F.min(MONTH).alias("m0"), F.max(MONTH).alias("m1"))
    spine = ends.select(*by, F.explode(F.sequence("m0", F.col("m1") + extend)).alias(MONTH))
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(MONTH).rowsBetween(-extend, 0)
    return spine.join(mean, [*by, MONTH], "left").select(*by, MONTH, F.last("mean", ignorenulls=True).over(w).alias(value))


def published(series: DataFrame, lag: int, changes: Sequence[int], percent: bool, by: Sequence[str] = (), value: str = "value", name: str = "level") -> DataFrame:
    """The level known in a month (its value `lag` months before) and its changes over n months."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(MONTH)
    out = series.select(*by, MONTH, F.col(value).alias(name), *(F.max(value).over(w.rangeBetween(-n, -n)).alias(f"b{n}") for n in changes))
    change = lambda n: S.percent_change(F.col(name), F.col(f"b{n}")) if percent else F.col(name) - F.col(f"b{n}")
    return out.select(*by, (F.col(MONTH) + lag).alias(MONTH), name, *(change(n).alias(f"{name}_chg_{n}m") for n in changes))


def trace(df: DataFrame, n: int, seed: int = 0, before: int = 3, after: int = 3) -> DataFrame:
    """All months around n rows picked by seeded order: what a reader checks labels against."""
    picked = df.orderBy(S.shuffled(seed, F.col(KEY), F.col(MONTH))).limit(n).select(KEY, F.col(MONTH).alias("t"))
    return df.join(F.broadcast(picked), KEY).where(F.col(MONTH).between(F.col("t") - before, F.col("t") + after))


def join_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join that fails on a key that either side has twice."""
    for side, df in (("left", left), ("right", right)):
        if duplicates(df, *keys).head(1):
            raise ValueError(f"{side} side has a key twice")
    return left.join(right, list(keys))


def ever_delinquent(df: DataFrame) -> DataFrame:
    """Loans that were ever behind, with their worst bucket."""
    return df.groupBy(KEY).agg(F.max("dq_bucket").alias("max_bucket")).where("max_bucket > 0")


def by_count(df: DataFrame, *by: str) -> DataFrame:
    """Counts of the levels, the most frequent first; place is their order."""
    n = df.groupBy(*by).agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), *by))).orderBy("place")


def contained(df: DataFrame, whole: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Per group of `df`, its rows and those whose key `whole` doesn't have."""
    marked = df.join(whole.select(*keys).distinct().withColumn("_there", F.lit(True)), list(keys), "left")
    return marked.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("_there").isNull()).alias("n_missing"))
