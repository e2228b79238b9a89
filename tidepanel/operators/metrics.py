"""Evaluation as grouped aggregates over a long table (groups, score p, outcome y): any number of groups in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PLACES = 6


def _by(by: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in by] or [F.lit(0)]


def _decimal(c: str | Column) -> Column:
    return F.col(c).try_cast("decimal(38,18)") if isinstance(c, str) else c.try_cast("decimal(38,18)")


def _exactly(agg, c: str | Column, less: str | Column | None = None) -> Column:
    """F.avg or F.sum of `c` (less that of `less`) over decimals of 18 places, so that it doesn't depend on the order of
    rows; over doubles, if such a decimal doesn't hold a value."""
    terms = [x for x in (c, less) if x is not None]
    held = [F.count(_decimal(x)) == F.count(x) for x in terms]
    made = [[agg(x).cast("double") for x in some] for some in ([_decimal(x) for x in terms], terms)]
    whole, plain = (m[0] if less is None else m[0] - m[1] for m in made)
    return F.when(held[0] if less is None else held[0] & held[1], whole).otherwise(plain)


def exact_mean(c: str | Column, less: str | Column | None = None) -> Column:
    """The mean of `c` (less that of `less`) to PLACES, halves away from zero: neither the order of rows nor a sum's error
    decides a half, since what is left of that is rounded away before."""
    return F.round(F.round(_exactly(F.avg, c, less), 2 * PLACES), PLACES)


def auc(df: DataFrame, by: Sequence[str], score: str = "p", y: str = "y") -> DataFrame:
    """n, positives and ROC AUC per group with ties counted half; null where a group has one class.

    Rows are first counted per distinct score, so windows run over distinct scores, not rows.
    """
    at = df.groupBy(*by, score).agg(F.count("*").alias("c"), F.sum(F.col(y).cast("long")).alias("c1"))
    w = Window.partitionBy(*_by(by)).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("below", F.coalesce(F.sum(F.col("c") - F.col("c1")).over(w), F.lit(0)))
    # twice the wins, so that sums stay whole
    out = at.groupBy(*by).agg(F.sum("c").alias("n"), F.sum("c1").alias("n_pos"), F.sum(F.col("c1") * (2 * F.col("below") + F.col("c") - F.col("c1"))).alias("wins2"))
    pairs = F.col("n_pos") * (F.col("n") - F.col("n_pos"))
    return out.select(*by, "n", "n_pos", F.round(F.try_divide(F.col("wins2"), 2 * pairs), PLACES).alias("auc"))


def average_precision(df: DataFrame, by: Sequence[str], score: str = "p", y: str = "y") -> DataFrame:
    """Sum of recall steps times precision over distinct thresholds; null without positives."""
    at = df.groupBy(*by, score).agg(F.count("*").alias("c"), F.sum(F.col(y).cast("long")).alias("c1"))
    w = Window.partitionBy(*_by(by)).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumns({"n": F.sum("c").over(w), "tp": F.sum("c1").over(w)})
    out = at.groupBy(*by).agg(F.sum(F.col("c1") * F.col("tp") / F.col("n")).alias("s"), F.sum("c1").alias("n_pos"))
    return out.select(*by, F.round(F.try_divide(F.col("s"), F.col("n_pos")), PLACES).alias("average_precision"))


def brier(df: DataFrame, by: Sequence[str], score: str = "p", y: str = "y") -> DataFrame:
    return df.groupBy(*by).agg(F.round(F.avg(F.pow(F.col(score) - F.col(y), 2)), PLACES).alias("brier"))


def bin_of(p: Column, bins: int = 10) -> Column:
    """Equal-width bin, edges computed as k * (1 / bins); [low, high), the last one closed."""
    edges = F.array(*(F.lit(k * (1.0 / bins)) for k in range(1, bins)))
    return F.size(F.filter(edges, lambda e: e <= p))


def reliability(df: DataFrame, by: Sequence[str] = (), bins: int = 10, score: str = "p", y: str = "y") -> DataFrame:
    """n, mean prediction and outcome rate of every bin, empty ones too."""
    found = df.groupBy(*by, bin_of(F.col(score), bins).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(score), PLACES).alias("mean_pred"), F.round(F.avg(F.col(y)), PLACES).alias("actual"))
    spine = (df.select(*by).distinct() if by else df.sparkSession.range(1).select()).select(*by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return spine.join(found, [*by, "bin"], "left").select(*by, "bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_pred", "actual")


def calibration_error(df: DataFrame, by: Sequence[str] = (), bins: int = 10, score: str = "p", y: str = "y") -> DataFrame:
    b = df.groupBy(*by, bin_of(F.col(score), bins).alias("bin")).agg(F.count("*").alias("n"), F.abs(_exactly(F.sum, score, y)).alias("gap"))
    return b.groupBy(*by).agg(F.round(F.round(F.sum("gap") / F.sum("n"), 2 * PLACES), PLACES).alias("ece"))


def deciles(df: DataFrame, by: Sequence[str] = (), score: str = "p", y: str = "y", key: Sequence[str] = ("loan_sequence_number", "month_idx"), bins: int = 10) -> DataFrame:
    """Ranks in descending score, cut at ceil(rank / n * bins); 1 is the riskiest."""
    w = Window.partitionBy(*_by(by))
    ranked = df.withColumns({"r": F.row_number().over(w.orderBy(F.desc(score), *key)), "m": F.count("*").over(w)})
    d = F.floor((F.col("r") * bins + F.col("m") - 1) / F.col("m")).cast("int")
    return ranked.groupBy(*by, d.alias("decile")).agg(F.count("*").alias("n"), F.round(F.avg(score), PLACES).alias("mean_pred"), F.round(F.avg(F.col(y)), PLACES).alias("actual"))


def target_rates(train: DataFrame, by: Sequence[str], y: str = "label", smooth: int = 100) -> DataFrame:
    """(by, rate): outcome rates shrunk to the overall one; nulls are a level of their own."""
    prior = train.agg(F.sum(F.col(y).cast("long")).alias("s0"), F.count(y).alias("n0"))
    at = train.groupBy(*by).agg(F.sum(F.col(y).cast("long")).alias("s"), F.count(y).alias("n"))
    return at.join(F.broadcast(prior)).select(*by, F.round((F.col("s") + smooth * F.col("s0") / F.col("n0")) / (F.col("n") + smooth), PLACES).alias("rate"))


def encoded(df: DataFrame, rates: DataFrame, by: Sequence[str], prior: DataFrame, name: str = "p") -> DataFrame:
    """`df` with the rate of its level; a level that training hasn't seen takes the overall rate (one row, `prior`)."""
    r = rates.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("rate").alias("_rate"))
    match = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    cond = match[0]
    for m in match[1:]:
        cond = cond & m
    return df.join(r, cond, "left").join(F.broadcast(prior.select(F.col("rate").alias("_prior")))).withColumn(name, F.coalesce("_rate", "_prior")).drop("_rate", "_prior", *(f"_{c}" for c in by))


def null_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, null_rate) from one aggregation."""
    one = df.agg(F.count("*").alias("n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    long = one.unpivot("n", list(columns), "feature", "n_null")
    return long.select("feature", F.round(F.col("n_null") / F.col("n"), PLACES).alias("null_rate"))


def feature_audit(train: DataFrame, test: DataFrame, whole: DataFrame, features: Sequence[str], y: str = "label", bins: int = 10, smooth: int = 100) -> DataFrame:
    """(feature, null_rate, auc, auc_rank) of each feature alone: outcome rates of its training quantile bins (nulls are a
    bin), shrunk to the overall rate, as the score of the test rows. All features share one pass over a long table."""
    from . import drift

    cuts = drift.edges(train, features, bins)
    place = F.when(F.col("x").isNull(), drift.NULL_BIN).otherwise(F.size(F.filter("edges", lambda e: e <= F.col("x"))))
    binned = lambda df: drift.long_form(df, [y], features).join(F.broadcast(cuts), "feature").select("feature", y, place.alias("bin"))  # noqa: E731  a row of edges a feature
    seen = binned(train).groupBy("feature", "bin").agg(F.sum(F.col(y).cast("long")).alias("s"), F.count("*").alias("n"))
    prior = seen.groupBy("feature").agg((F.sum("s") / F.sum("n")).alias("prior"))
    rates = seen.join(prior, "feature").select("feature", "bin", F.round((F.col("s") + smooth * F.col("prior")) / (F.col("n") + smooth), PLACES).alias("rate"))
    scored = binned(test).join(F.broadcast(rates), ["feature", "bin"], "left").join(F.broadcast(prior), "feature")
    found = auc(scored.withColumn("p", F.coalesce("rate", F.round("prior", PLACES))), ["feature"], "p", y).select("feature", "auc")
    out = null_rates(whole, list(features)).join(found, "feature")
    return out.withColumn("auc_rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("auc"), "feature")))


def per_group(df: DataFrame, by: Sequence[str], score: str = "p", y: str = "y") -> DataFrame:
    """n, base rate, AUC and average precision of each group; AUC is null where a group has one class."""
    base = df.groupBy(*by).agg(F.round(F.avg(F.col(y)), PLACES).alias("base_rate"))
    return auc(df, by, score, y).join(average_precision(df, by, score, y), list(by)).join(base, list(by)).select(*by, "n", "base_rate", "auc", "average_precision")
