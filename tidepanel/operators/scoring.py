"""Calibration with a forward check, and Spark ML scorers: pooled and segmented trees, WOE logistic, frozen manifests."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from . import metrics

Calibrator = Callable[[DataFrame], DataFrame]


def _clip(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def identity(fit: DataFrame, score: str = "raw", y: str = "y") -> Calibrator:
    return lambda df: df.withColumn("p", _clip(F.col(score)))


def isotonic(fit: DataFrame, score: str = "raw", y: str = "y") -> Calibrator:
    model = IsotonicRegression(featuresCol=score, labelCol=y, predictionCol="p_iso").fit(fit.select(F.col(score), F.col(y).cast("double").alias(y)))
    return lambda df: model.transform(df).withColumn("p", _clip(F.col("p_iso"))).drop("p_iso")


def platt(fit: DataFrame, score: str = "raw", y: str = "y") -> Calibrator:
    rows = VectorAssembler(inputCols=["z"], outputCol="v").transform(fit.select(S.log_odds(F.col(score)).alias("z"), F.col(y).cast("double").alias("t")))
    m = LogisticRegression(featuresCol="v", labelCol="t", regParam=0.0, standardization=False).fit(rows)
    a, b = float(m.coefficients[0]), float(m.intercept)
    return lambda df: df.withColumn("p", S.sigmoid(F.lit(a) * S.log_odds(F.col(score)) + F.lit(b)))


def intercept(fit: DataFrame, score: str = "raw", y: str = "y", bound: float = 5.0) -> Calibrator:
    """A shift of the log-odds by which predictions sum to outcomes, by bisection; each step is one aggregate."""
    low, high = -bound, bound
    rows = fit.select(S.log_odds(F.col(score)).alias("z"), F.col(y).alias("t"))
    grid = 9
    for _ in range(8):
        at = [low + (high - low) * k / (grid - 1) for k in range(grid)]
        got = rows.agg(*(F.sum(S.sigmoid(F.col("z") + F.lit(s)) - F.col("t")).alias(f"g{k}") for k, s in enumerate(at))).first()
        if got[0] is None:
            break
        below = [k for k in range(grid) if got[k] < 0]
        k = min(max(below, default=0), grid - 2)
        low, high = at[k], at[k + 1]
    shift = (low + high) / 2
    return lambda df: df.withColumn("p", S.sigmoid(S.log_odds(F.col(score)) + F.lit(shift)))


METHODS = {"identity": identity, "isotonic": isotonic, "platt": platt, "intercept": intercept}


def calibrator(name: str) -> Callable[..., Calibrator]:
    if name not in METHODS:
        raise ValueError(f"no calibration called {name!r}; there are {sorted(METHODS)}")
    return METHODS[name]


def transfer_check(df: DataFrame, period: str, hold: int = 12, score: str = "raw", y: str = "y") -> tuple[str, DataFrame]:
    """Fits each method up to `hold` months before the end and scores what follows. The choice: the smallest ECE of
    those better than raw in Brier and ECE, else identity. Also returns the table (method, brier, ece)."""
    last = df.agg(F.max(period)).first()[0]
    if last is None:
        raise ValueError("no rows")
    fit, later = df.where(F.col(period) <= last - hold), df.where(F.col(period) > last - hold)
    long = None
    for name, make in METHODS.items():
        part = make(fit, score, y)(later).select(F.lit(name).alias("method"), "p", F.col(y).alias("y"))
        long = part if long is None else long.unionByName(part)
    table = metrics.brier(long, ["method"]).join(metrics.calibration_error(long, ["method"]), "method")
    rows = {r.method: r for r in table.collect()}
    raw = rows["identity"]
    better = [r for k, r in rows.items() if k != "identity" and r.brier < raw.brier and r.ece < raw.ece]
    return min(better, key=lambda r: (r.ece, r.method)).method if better else "identity", table


def boosted(train: DataFrame, features: Sequence[str], y: str = "label", trees: int = 20, depth: int = 4, seed: int = 7, check: DataFrame | None = None) -> PipelineModel:
    """Boosted trees over median-imputed features and is-null indicators (Spark's trees take no missing values). With
    rows to check on, boosting stops once their loss no longer falls; medians are those of the training rows alone."""
    fill, put, gbt = _stages(features, y, trees, depth, seed)
    rows = prepared(train, features)
    filled = fill.fit(rows)
    if check is not None:
        both = rows.withColumn("checks", F.lit(False)).unionByName(prepared(check, features).withColumn("checks", F.lit(True)), allowMissingColumns=True)
        rows, gbt = both, gbt.setValidationIndicatorCol("checks")
    return PipelineModel([filled, put, gbt.fit(put.transform(filled.transform(rows)))])


def prepared(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({f"x_{f}": F.col(f).cast("double") for f in features} | {f"x_{f}_null": F.col(f).isNull().cast("double") for f in features})


def _stages(features, y, trees, depth, seed):
    filled = [f"x_{f}" for f in features]
    return (
        Imputer(inputCols=filled, outputCols=[f"{c}_f" for c in filled], strategy="median"),
        VectorAssembler(inputCols=[f"{c}_f" for c in filled] + [f"{c}_null" for c in filled], outputCol="v"),
        GBTClassifier(featuresCol="v", labelCol=y, maxIter=trees, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed),
    )


def scored(model: PipelineModel, df: DataFrame, features: Sequence[str], name: str = "raw") -> DataFrame:
    out = model.transform(prepared(df, features))
    return out.withColumn(name, vector_to_array("probability")[1]).select(*df.columns, name)


def segmented(train: DataFrame, features: Sequence[str], segment: str, values: Sequence, **options) -> Mapping[object, PipelineModel]:
    return {v: boosted(train.where(F.col(segment) == v), features, **options) for v in values}


def scored_by_segment(models: Mapping, df: DataFrame, features: Sequence[str], segment: str, name: str = "raw") -> DataFrame:
    """Each row by its segment's model; a row whose segment has none is an error."""
    if df.where(~F.coalesce(F.col(segment).isin(*models), F.lit(False))).head(1):
        raise ValueError("rows without a segment model")
    out = None
    for v, m in models.items():
        part = scored(m, df.where(F.col(segment) == v), features, name)
        out = part if out is None else out.unionByName(part)
    return out


def woe_table(train: DataFrame, feature: str, y: str = "label", bins: int = 20) -> DataFrame:
    """(bin, woe) over quantile bins and a null bin, half a row added to each count."""
    cuts = train.agg(F.array_distinct(F.percentile(F.col(feature).cast("double"), F.array(*(F.lit(k / bins) for k in range(1, bins))))).alias("edges"))
    at = train.join(F.broadcast(cuts)).select(F.when(F.col(feature).isNull(), -1).otherwise(F.size(F.filter("edges", lambda e: e <= F.col(feature)))).alias("bin"), F.col(y).alias("y"), "edges")
    n = at.groupBy("bin").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0"), F.first("edges").alias("edges"))
    total = Window.partitionBy()
    return n.select(F.lit(feature).alias("feature"), "bin", "edges", F.ln(((F.col("n1") + 0.5) / F.sum("n1").over(total)) / ((F.col("n0") + 0.5) / F.sum("n0").over(total))).alias("woe"))


def woe_logistic(train: DataFrame, features: Sequence[str], y: str = "label", bins: int = 20, c: float = 1.0) -> Callable[[DataFrame], DataFrame]:
    """A ridge logistic model on the weights of evidence of each feature's bins; gives `raw`. A bin that training has
    not seen weighs nothing. Only edges and weights (bins + 1 a feature) come to the driver."""
    weights = {}
    for f in features:
        found = woe_table(train, f, y, bins).collect()
        weights[f] = (list(found[0].edges or []) if found else [], {r.bin: float(r.woe) for r in found})

    def weighed(df: DataFrame) -> DataFrame:
        columns = {}
        for f, (edges, woe) in weights.items():
            place = F.when(F.col(f).isNull(), -1).otherwise(F.size(F.filter(F.array(*map(F.lit, edges)).cast("array<double>"), lambda e: e <= F.col(f))))
            columns[f"woe_{f}"] = F.coalesce(S.lookup(place, woe), F.lit(0.0)) if woe else F.lit(0.0)
        return VectorAssembler(inputCols=list(columns), outputCol="woe_v").transform(df.withColumns(columns)).drop(*columns)

    rows = weighed(train).select("woe_v", F.col(y).cast("double").alias("woe_y"))
    n = max(1, rows.count())
    model = LogisticRegression(featuresCol="woe_v", labelCol="woe_y", regParam=1 / (c * n), standardization=False).fit(rows)
    return lambda df: model.transform(weighed(df)).withColumn("raw", vector_to_array("probability")[1]).select(*df.columns, "raw")


def compared(models: Mapping[str, Callable[[DataFrame], DataFrame]], fit: DataFrame, test: DataFrame, method: str = "platt", y: str = "y") -> DataFrame:
    """(model, auc, average_precision, brier and ece raw and calibrated) of scorers that add `raw`; calibrated on `fit`."""
    long = None
    for name, score in models.items():
        raw = score(test)
        part = calibrator(method)(score(fit), "raw", y)(raw).select(F.lit(name).alias("model"), F.col(y).alias("y"), "raw", "p")
        long = part if long is None else long.unionByName(part)
    out = metrics.auc(long, ["model"], "raw").join(metrics.average_precision(long, ["model"], "raw"), "model")
    for at in ("raw", "p"):
        kind = "raw" if at == "raw" else "calibrated"
        pair = metrics.brier(long, ["model"], at).join(metrics.calibration_error(long, ["model"], score=at), "model")
        out = out.join(pair.withColumnsRenamed({"brier": f"brier_{kind}", "ece": f"ece_{kind}"}), "model")
    return out


def importance(model: PipelineModel, features: Sequence[str], spark: SparkSession) -> DataFrame:
    v = model.stages[-1].featureImportances.toArray().tolist()
    k = len(features)
    rows = [(f, float(v[i] + v[i + k])) for i, f in enumerate(features)]
    whole = math.fsum(r[1] for r in rows) or 1.0
    return spark.createDataFrame([(f, g, g / whole) for f, g in rows], "feature string, gain double, gain_share double")


def manifest(features: Sequence[str], settings: Mapping, chosen: Mapping) -> dict:
    stamp = hashlib.sha256(json.dumps({"features": list(features), "settings": dict(settings)}, sort_keys=True).encode()).hexdigest()
    return {"stamp": stamp, "features": list(features), "settings": dict(settings), "chosen": dict(chosen)}


def freeze(model: PipelineModel, made: dict, path: str, spark: SparkSession) -> None:
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(made, sort_keys=True),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def thaw(path: str, spark: SparkSession, features: Sequence[str], settings: Mapping) -> tuple[PipelineModel, dict]:
    """The frozen model, refused if it was made from other features or settings."""
    made = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if made["stamp"] != manifest(features, settings, {})["stamp"]:
        raise ValueError("the frozen model was made from other features or settings")
    return PipelineModel.load(f"{path}/model"), made
