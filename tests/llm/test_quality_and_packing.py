import os
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import packing, quality
from tidepanel.llm.entry import tokenizer_path
from tidepanel.llm.wordbpe import WordBPE

from . import brute
from .test_near_and_substring import frame, some_docs


def test_statistics():
    texts = [t for _, t in some_docs(40)] + ["a a a a a", "x\nx\n \n \nx\r", "é#*$ é#*$ é#*$ <|>", "A\x1cB c\x0bd", None]
    for t in texts:
        assert quality.statistics(t)[:5] == brute.quality(t)


def test_rules_are_learned_and_equal_in_spark(spark):
    rng = np.random.default_rng(0)
    n = 900
    counts = pd.DataFrame({c: rng.integers(1, 200, n) for c in quality.COUNTS})
    counts["word_chars"] = counts.n_words * 5
    x = quality.feature_frame(counts)
    bad = (x.symbol_share > 0.2) & (x.words < 120)
    rules = quality.fit(x, bad.to_numpy(), precision=0.9)
    assert rules.rules
    held = np.zeros(n, dtype=bool)
    for r in rules.rules:
        held |= quality._cover(list(r), x)
    assert (held == bad).mean() > 0.9
    got = spark.createDataFrame(counts).select(rules.keeps().alias("kept")).toPandas().kept.to_numpy()
    assert (got == ~held).all()
    assert quality.fit(x, np.zeros(n, dtype=bool)).rules == ()
    assert quality.fit(x.head(0), np.zeros(0, dtype=bool)).rules == ()


def test_judged(spark):
    docs = some_docs() + [(5000 + i, "bad### words*** " * 40 + str(i)) for i in range(60)]
    labels = [(i, 1, 0) for i, _ in docs[:60]] + [(5000 + i, 0, 0) for i in range(60)] + [(None, 0, 0), (3, None, 0)]
    out = quality.judged(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    names = [f"q_{c}" for c in quality.COUNTS[:5]]
    assert Counter((r.doc_id, *(r[c] for c in names)) for r in out) == Counter((i, *brute.quality(t)) for i, t in docs)
    for r in out:
        assert r.q_base_failed == (r.q_n_words < 50 or 100 * r.q_n_repeat_words > 50 * r.q_n_words)
        assert not (r.q_base_failed and r.q_kept)
    assert quality.judged(frame(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    clash = frame(spark, docs).withColumnRenamed("row", "Q_n_words").withColumn("q_kept", F.lit("own"))
    found = quality.judged(clash, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert [c.lower() for c in found.columns].count("q_n_words") == 1 and found.where("q_kept").count() > 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_rules_come_from_rows_that_the_base_rule_passes(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality.judged(docs, labels).join(labels, "doc_id").where("NOT q_base_failed").toPandas()
    assert quality.learn(docs, labels).rules
    assert (out.q_kept == (out.quality == 1)).mean() > 0.98 and (out.quality == 0).sum() >= 20


def test_an_imprecise_rule_does_not_end_the_search():
    rng = np.random.default_rng(1)
    x = pd.DataFrame({f: rng.random(1200) for f in quality.FEATURES})
    bad = (x.words > 0.5) & (rng.random(1200) < 0.6) | (x.digit_share > 0.9)  # the first part is never precise
    rules = quality.fit(x, bad.to_numpy())
    assert any(t.feature == "digit_share" for r in rules.rules for t in r)


def test_best_fit_and_bounds():
    rng = np.random.default_rng(2)
    for _ in range(60):
        lengths = rng.integers(1, 101, rng.integers(1, 60))
        bins, offsets, fill = packing.best_fit(lengths, 100)
        assert packing.least_bins(np.bincount(lengths, minlength=101), 100) <= len(fill)
        for k in range(len(fill)):
            own = sorted(zip(offsets[bins == k], lengths[bins == k]))
            at = 0
            for o, n in own:
                assert o == at
                at += n
            assert at == fill[k] <= 100
    assert packing.least_bins(np.bincount([51] * 7, minlength=101), 100) == 7
    assert packing.least_bins(np.bincount([34] * 9, minlength=101), 100) == 5
    assert packing.least_bins(np.zeros(101), 100) == 0


def test_ids_equal_the_library():
    from tokenizers import Tokenizer

    path = tokenizer_path()
    library, own = Tokenizer.from_file(path), WordBPE(path, most_known=50)
    import pyarrow as pa

    texts = [t for _, t in some_docs(30)] + ["á b ́c\tÀ É ẞ İ Σας ΣΑΣ x y", "don't I'LL <|endoftext|>a a<|endoftext|> 12ab ½ 中文 ﬁ", "\x1c a\x85b it'sve ''s l'd", "éx   ŉ ǅ ſ", "x" * 300 + " y"]
    got = [i[a:b].tolist() for i, at in own.ids(pa.array(texts, pa.string()), docs=7) for a, b in zip(at[:-1], at[1:])]
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("capacity,size", [(64, 40), (2048, 50_000)])
def test_packed(spark, capacity, size):
    from tokenizers import Tokenizer

    docs = some_docs()
    out = packing.packed(frame(spark, docs), tokenizer_path(), capacity=capacity, pieces=size).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == brute.pieces(docs, Tokenizer.from_file(tokenizer_path()), capacity)
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= capacity
    total = sum(r.length for r in out)
    assert len(by) <= 1.1 * total / capacity + 2
    assert packing.packed(frame(spark, []), tokenizer_path()).count() == 0
