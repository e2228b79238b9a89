"""Every operator and stage with columns that clash, nulls, empty and very long texts, repeated rows and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidepanel.llm import forest, licences, lines, neural, packing, pieces, quality, simhash, substring, wrappers
from tidepanel.llm.entry import tokenizer_path

CLASH = ["q_kept", "q_rule", "Q_n_words", "ld_dropped", "LD_text", "sd_kept", "sd_parts", "rid", "held", "row", "block", "key", "component", "n_pieces", "licences", "piece"]


def documents(spark):
    docs = [(1, "same words here"), (1, "same words here"), (2, None), (None, "no id " * 30), (3, ""), (4, " \n\t\n "), (5, "x" * 30_000), (6, "many words and lines\n" * 3_000), (7, " ".join(f"w{k}" for k in range(120)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return df.select("doc_id", *(F.lit(k).alias(c) for k, c in enumerate(CLASH)), "text")


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "pieces": lambda d, s: pieces.encoded(d.drop("ids", "scores"), tokenizer_path("piece_bpe_32k.model")),
    "simhash": lambda d, s: simhash.near_groups(d),
    "quality": lambda d, s: quality.judged(d, labels(s)),
    "licences": lambda d, s: licences.scanned(d.drop("licences")),
    "neural": lambda d, s: neural.scored(d),
    "lines": lambda d, s: lines.deduplicated(d, bands=lines.BANDS),
    "substring": lambda d, s: substring.deduplicated(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators(spark, name):
    docs = documents(spark)
    assert OPERATORS[name](docs, spark).count() == docs.count()
    assert OPERATORS[name](docs.limit(0), spark).count() == 0


def test_packing_wrappers_and_forest(spark):
    docs = documents(spark)
    out = packing.packed(docs, tokenizer_path())
    assert out.where("piece = 0").count() == docs.count() and out.agg(F.max("length")).first()[0] <= 2048
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://h.org/").alias("url"), F.concat(F.lit("<p>"), "text").alias("html"), *CLASH)
    assert wrappers.main_text(pages).count() == docs.count()
    vectors = docs.select(F.col("doc_id").alias("vec_id"), F.array(F.length("text").cast("float"), F.lit(1.0)).alias("embedding"), *CLASH)
    assert forest.neighbours(vectors, every=1, k=2).groupBy("query_id").count().count() == vectors.where("vec_id IS NOT NULL AND embedding[0] IS NOT NULL").select("vec_id").distinct().count()


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_the_columns(spark, tmp_path, name, stage):
    docs = documents(spark)
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    out = stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and out.count() <= docs.count()
    kept = {c: r for c, r in zip(out.columns, out.first() or [], strict=False)}
    assert not kept or all(kept[c] == k for k, c in enumerate(CLASH))
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
