"""The queries of this subpackage, each over its whole table, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import forest, licences, lines, neural, packing, pieces, quality, simhash, substring, wrappers
from .common import table


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encoded(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), n=3)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.sha2(F.to_json("ids"), 256).alias("ids_sha256"), "scores", "restored", F.sha2(F.to_json("others"), 256).alias("others_sha256"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"), distance=2, width=3)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed public tokenizer files have `name`."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, end_id=0)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.judged(docs, table(spark, sf_dir, "labels"))
    counts = [F.col(f"q_{c}").alias(c) for c in quality.COUNTS]
    return out.select("doc_id", *counts, F.col("q_base_failed").alias("base_failed"), F.col("q_kept").alias("kept"), F.col("q_rule").alias("rule"))


def op5_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(table(spark, sf_dir, "pages"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licences.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"), out_col="found")
    best = F.array_max(F.transform("found", lambda m: m["dice"]))
    names = F.filter("found", lambda m: m["dice"] == F.col("best"))
    out = out.withColumn("best", best).withColumn("licence", F.array_min(F.transform(names, lambda m: m["licence"])))
    return out.select("doc_id", F.size("found").cast("long").alias("n_matches"), "licence", F.round("best", 6).alias("dice"))


def op7_neural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neural.scored(table(spark, sf_dir, "documents"))


def op8_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.neighbours(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), bands=lines.BANDS)
    return out.select("doc_id", F.coalesce(F.size("ld_dropped"), F.lit(0)).alias("n_dropped"), F.sha2(F.coalesce("ld_text", F.lit("")), 256).alias("kept_sha256"))


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring.deduplicated(docs, window=50)
    return out.select("doc_id", F.col("sd_n_words").alias("n_words"), F.col("sd_n_removed").alias("n_removed"), F.col("sd_sha256").alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f) and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op6_licences": licences.sql()}
