"""Delimited history under a fixed layout, and the sinks of the pipeline."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.scalars import cast_failures, cleaned, typed

CORRUPT = "_corrupt_record"


@dataclass(frozen=True)
class Field:
    position: int
    name: str
    kind: str


def field_kind(type_name: str, length: str, date: bool = False) -> str:
    """Kind from a layout's type and length: months, text, scaled or long numbers, short whole numbers."""
    if date:
        return "yyyymm"
    if not type_name.lower().startswith("num"):
        return "string"
    whole, _, scale = str(length).replace(".", ",").partition(",")
    return "double" if scale or int(whole) > 4 else "int"


def layout(rows: Sequence[Mapping], names: Mapping[str, str], categorical: Sequence[str] = ()) -> list[Field]:
    """Fields of layout rows (position, title, type, length); titles are matched with white space collapsed.

    Fails on gaps in positions, titles without a name and names without a title.
    """
    squeeze = lambda s: re.sub(r"\s+", " ", str(s)).strip()
    rows = sorted(rows, key=lambda r: int(r["position"]))
    if [int(r["position"]) for r in rows] != list(range(1, len(rows) + 1)):
        raise ValueError("positions must run from 1 without gaps")
    known = {squeeze(k): v for k, v in names.items()}
    titles = [squeeze(r["title"]) for r in rows]
    if missing := set(titles) - set(known):
        raise ValueError(f"no name for {sorted(missing)}")
    if unused := set(known) - set(titles):
        raise ValueError(f"not in the layout: {sorted(unused)}")
    out = []
    for r, t in zip(rows, titles, strict=True):
        kind = "string" if known[t] in categorical else field_kind(r["type"], r["length"], "yyyymm" in str(r.get("format", "")).lower())
        out.append(Field(int(r["position"]), known[t], kind))
    return out


def text_schema(fields: Sequence[Field]) -> StructType:
    return StructType([StructField(f.name, StringType()) for f in fields] + [StructField(CORRUPT, StringType())])


def resolve(spark: SparkSession, template: str, vintages: Sequence[int]) -> list[str]:
    """One path per vintage; any that is missing is an error naming all missing ones. Works on any file system."""
    paths, jvm = [template.format(vintage=v) for v in vintages], spark._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    missing = [p for p in paths if not (lambda q: q.getFileSystem(conf).exists(q))(jvm.org.apache.hadoop.fs.Path(p))]
    if missing:
        raise FileNotFoundError(f"missing: {missing}")
    return paths


def read_text(spark: SparkSession, paths: Sequence[str] | str, fields: Sequence[Field], sep: str = "|") -> DataFrame:
    """Headerless rows as text, with the raw text of rows of the wrong width and the file they came from."""
    src = spark.read.schema(text_schema(fields)).option("sep", sep).option("quote", "").option("mode", "PERMISSIVE")
    src = src.option("columnPruning", "false")  # else rows of the wrong width are only seen if all columns are asked for
    return src.option("columnNameOfCorruptRecord", CORRUPT).csv(paths).withColumn("source_file", F.col("_metadata.file_path"))


def file_vintage(pattern: str = r"sample_orig_(\d{4})"):
    return F.regexp_extract(F.col("source_file"), pattern, 1).try_cast("int")


def clean(df: DataFrame, fields: Sequence[Field], sentinels: Mapping[str, Sequence[str]]) -> DataFrame:
    named = {f.name for f in fields}
    return df.select(*(cleaned(c, sentinels.get(c, ())).alias(c) if c in named else F.col(c) for c in df.columns))


def cast(df: DataFrame, fields: Sequence[Field]) -> DataFrame:
    kinds = {f.name: f.kind for f in fields}
    return df.select(*(typed(F.col(c), kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns))


def profile(df: DataFrame, fields: Sequence[Field], **extras) -> DataFrame:
    """One row: rows, corrupt rows, failed casts of each field, and the caller's aggregates (null as 0)."""
    aggs = [F.count("*").alias("n_rows")]
    if CORRUPT in df.columns:
        aggs.append(F.count(CORRUPT).alias("n_corrupt"))
    aggs += [cast_failures(F.col(f.name), f.kind).alias(f"failed_{f.name}") for f in fields if f.kind != "string"]
    return df.agg(*aggs, *(F.coalesce(e, F.lit(0)).alias(n) for n, e in extras.items()))


def retain(df: DataFrame, static: DataFrame, key: str, own: Sequence[str], added: Sequence[str], small: int | None = None) -> DataFrame:
    """Panel columns and, left-joined by `key`, static ones. Rows without a match stay, with nulls. The static side is
    only hinted to be broadcast if the caller states its row count and that is small."""
    if clash := set(own) & set(added) - {key}:
        raise ValueError(f"in both tables: {sorted(clash)}")
    right = static.select(key, *(c for c in added if c != key))
    return df.select(*own).join(F.broadcast(right) if small is not None and small <= 1_000_000 else right, key, "left")


def write_partitioned(df: DataFrame, path: str, by: str, order: Sequence[str], files: int | None = None) -> None:
    """Parquet by `by`, sorted inside files. Rows are rebalanced, so a large value is split over several files."""
    df = df.hint("rebalance", by) if files is None else df.repartition(files, by)
    df.sortWithinPartitions(by, *order).write.mode("overwrite").partitionBy(by).parquet(path)


def write_table(df: DataFrame, path: str, places: int = 5) -> None:
    """A small result table as one CSV file with fixed decimals."""
    shown = [F.format_string(f"%.{places}f", F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*shown).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_log(spark: SparkSession, path: str, row: Mapping) -> DataFrame:
    """Adds one row to a log whose columns may grow; returns the whole log."""
    new = spark.read.json(spark.sparkContext.parallelize([json.dumps(dict(row), sort_keys=True)], 1))
    new.write.mode("append").json(path)
    return spark.read.json(path)


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """An observation CSV: date and the first value column; a dot is missing."""
    src = spark.read.option("header", True).option("nullValue", ".").csv(path)
    return src.select(F.try_to_date(src.columns[0]).alias("period"), F.col(src.columns[1]).try_cast("double").alias("value"))
