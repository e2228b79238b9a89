"""Population stability and departures. Features are unpivoted once, so all features and months share one shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from . import metrics

FLOOR = 1e-4
PLACES = 6
NULL_BIN = -1


def long_form(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    return df.select(*keys, *(F.col(f).cast("double").alias(f) for f in features)).unpivot(list(keys), list(features), "feature", "x").withColumn("x", F.when(~F.isnan("x"), F.col("x")))


def edges(reference: DataFrame, features: Sequence[str], bins: int = 10) -> DataFrame:
    """(feature, edges): distinct interior quantiles, linearly interpolated. One row per feature."""
    at = F.array(*(F.lit(k / bins) for k in range(1, bins)))
    return long_form(reference, [], features).groupBy("feature").agg(F.array_sort(F.array_distinct(F.coalesce(F.percentile("x", at), F.array().cast("array<double>")))).alias("edges"))


def binned(df: DataFrame, cuts: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(keys, feature, bin, n): bins are [low, high), nulls have bin -1."""
    j = long_form(df, keys, features).join(F.broadcast(cuts), "feature")
    place = F.when(F.col("x").isNull(), NULL_BIN).otherwise(F.size(F.filter("edges", lambda e: e <= F.col("x"))))
    return j.groupBy(*keys, "feature", place.alias("bin")).agg(F.count("*").alias("n"))


def level_bins(df: DataFrame, reference: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts by level; levels that the reference doesn't have are `other`, nulls `null`."""
    known = reference.where(F.col(column).isNotNull()).select(F.col(column).alias("_known")).distinct()
    j = df.join(known, F.col(column) == F.col("_known"), "left")
    return j.groupBy(*by, F.when(F.col(column).isNull(), "null").otherwise(F.coalesce("_known", F.lit("other"))).alias("bin")).agg(F.count("*").alias("n"))


def stability_index(expected: DataFrame, actual: DataFrame, cuts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, feature, psi) over all bins of the edges and the null bin, shares floored at 1e-4."""
    catalogue = cuts.select("feature", F.explode(F.sequence(F.lit(NULL_BIN), F.size("edges"))).alias("bin"))
    e = catalogue.join(expected, ["feature", "bin"], "left").withColumn("e", F.coalesce(F.col("n") / F.sum("n").over(Window.partitionBy("feature")), F.lit(0.0))).select("feature", "bin", "e")
    total = actual.groupBy(*keys, "feature").agg(F.sum("n").alias("t"))
    a = total.join(F.broadcast(e), "feature").join(actual, [*keys, "feature", "bin"], "left")
    floor = lambda c: F.greatest(c, F.lit(FLOOR))
    x, y = floor(F.coalesce(F.col("n"), F.lit(0)) / F.col("t")), floor(F.col("e"))
    return a.groupBy(*keys, "feature").agg(F.round(F.sum((x - y) * F.ln(x / y)), PLACES).alias("psi"))


def psi_by_period(reference: DataFrame, df: DataFrame, period: str, features: Sequence[str], bins: int = 10) -> DataFrame:
    cuts = edges(reference, features, bins)
    return stability_index(binned(reference, cuts, [], features), binned(df, cuts, [period], features), cuts, [period])


def split_half(reference: DataFrame, key: Sequence[str], features: Sequence[str], seed: int = 0, bins: int = 10) -> DataFrame:
    """PSI of one half of the reference against the other; halves by hash, not by a random generator."""
    half = (F.conv(F.substring(S.shuffled(seed, *map(F.col, key)), 1, 1), 16, 10).cast("int") % 2).alias("half")
    rows = reference.select("*", half)
    cuts = edges(reference, features, bins)
    one = binned(rows.where("half = 0"), cuts, [], features)
    two = binned(rows.where("half = 1").withColumn("one", F.lit(1)), cuts, ["one"], features)
    return stability_index(one, two, cuts, ["one"]).select("feature", "psi")


def monthly(df: DataFrame, period: str, score: str = "p", y: str = "y", raw: str = "p_raw") -> DataFrame:
    """n, roll rate, mean prediction, gaps of the score and of the raw one, calibration error and AUC (null for one
    class) of each month."""
    base = df.groupBy(period).agg(F.count("*").alias("n"), metrics.exact_mean(y).alias("roll_rate"), metrics.exact_mean(score).alias("mean_pred"), metrics.exact_mean(score, y).alias("gap"), metrics.exact_mean(raw, y).alias("gap_raw"))
    return base.join(metrics.calibration_error(df, [period], score=score, y=y), period).join(metrics.auc(df, [period], score, y).select(period, "auc"), period)


def band(series: DataFrame, value: str, k: float = 2.0, by: Sequence[str] = ()) -> DataFrame:
    s = series.groupBy(*by).agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("sd"))
    return s.select(*by, F.round(F.col("m") - k * F.col("sd"), PLACES).alias("low"), F.round(F.col("m") + k * F.col("sd"), PLACES).alias("high"))


def first_departure(series: DataFrame, bands: DataFrame, period: str, value: str, run: int = 2, bad: str = "high", by: Sequence[str] = ()) -> DataFrame:
    """(by, first): start of the first `run` periods in a row beyond the band on the bad side; nulls never depart."""
    s = series.join(F.broadcast(bands), list(by)) if by else series.join(F.broadcast(bands))
    out = {"high": F.col(value) > F.col("high"), "low": F.col(value) < F.col("low")}[bad]
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(period).rowsBetween(0, run - 1)
    s = s.withColumns({"hits": F.sum(F.coalesce(out, F.lit(False)).cast("int")).over(w)})
    return s.groupBy(*by).agg(F.min(F.when(F.col("hits") == run, F.col(period))).alias("first_departure"))


def movers(psi: DataFrame, period: str, start: int, top: int = 5) -> DataFrame:
    """Features by the excess of their mean PSI from `start` on over the mean before, with the month of the peak."""
    s = psi.groupBy("feature").agg(F.avg(F.when(F.col(period) < start, F.col("psi"))).alias("before"), F.avg(F.when(F.col(period) >= start, F.col("psi"))).alias("after"), F.max("psi").alias("peak"), F.max_by(period, F.struct("psi", F.negative(F.col(period)))).alias("peak_period"))
    return s.select("feature", F.round(F.col("after") - F.col("before"), PLACES).alias("excess"), "peak", "peak_period").orderBy(F.desc_nulls_last("excess"), "feature").limit(top)


def monthly_summary(psi: DataFrame, period: str, warn: float = 0.1, alarm: float = 0.25) -> DataFrame:
    return psi.groupBy(period).agg(F.round(F.percentile("psi", 0.5), PLACES + 1).alias("median_psi"), F.count_if(F.col("psi") > warn).alias("n_warn"), F.count_if(F.col("psi") > alarm).alias("n_alarm"))
