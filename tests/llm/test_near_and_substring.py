import random

import numpy as np
import pytest

from tidepanel.llm import fmindex, simhash, substring

from . import brute

DOCS = "doc_id long, text string, doc_ID2 long, row string"


def rows(out, *names):
    from collections import Counter

    return Counter(tuple(r[n] for n in names) for r in out.collect())


def some_docs(n=120, seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        kind = rng.randrange(6)
        if out and kind == 0:
            text = rng.choice(out)[1]
        elif out and kind == 1:
            w = (rng.choice(out)[1] or "x").split(" ")
            w[rng.randrange(len(w))] = rng.choice(vocab)
            text = " ".join(w)
        else:
            text = " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 260)))
        out.append((i * 7 % n, text))
    out += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (None, out[0][1]), (n + 3, out[1][1]), (n + 3, out[1][1]), (n + 4, "A b"), (n + 5, "a B")]
    out += [(n + 6, out[2][1]), (n + 6, "zz " + (out[2][1] or ""))]
    return out


def frame(spark, docs):
    return spark.createDataFrame([(i, t, i, "x") for i, t in docs], DOCS)


def test_fingerprints_match_the_plain_version():
    for _, t in some_docs(40):
        assert simhash.fingerprint(t) == brute.fingerprint(t)
    assert simhash.fingerprint("ÀB c" * 3) == brute.fingerprint("ÀB c" * 3)


def test_gray_index_finds_every_pair():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    near = [b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (k, 30)).astype(np.uint64), axis=0) for b in base[:20] for k in (1, 2, 3)]
    x = np.unique(np.concatenate([base, *near]))
    key, rank, fp = simhash.dealt(x)
    order = np.lexsort((rank, key))
    a, b = simhash.star_links(key[order], fp[order].astype(np.uint64), 2)
    ids = x.tolist()
    at = {v: i for i, v in enumerate(ids)}
    want = brute.classes(ids, np.argwhere(np.bitwise_count(x[:, None] ^ x[None, :]) <= 2))
    assert brute.classes(ids, [(at[int(p)], at[int(q)]) for p, q in zip(a, b)]) == want


def test_near_groups(spark):
    docs = some_docs()
    assert rows(simhash.near_groups(frame(spark, docs)), "doc_id", "fingerprint", "component_id") == brute.simhash(docs)
    assert simhash.near_groups(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        simhash.near_groups(frame(spark, docs), distance=3)


def test_matching_statistics():
    rng = random.Random(1)
    for _ in range(25):
        top = rng.choice([2, 5, 40])
        ps = [[rng.randrange(1, top + 1) for _ in range(rng.randrange(1, 30))] for _ in range(rng.randrange(1, 20))]
        own = np.array([rng.randrange(8) for _ in ps], dtype=np.int32)
        words = np.concatenate([np.array([*p, 0]) for p in ps])
        ends = np.cumsum([len(p) + 1 for p in ps])
        starts = np.r_[0, ends[:-1]]
        got = fmindex.FMIndex(words, starts, own).earlier(words, starts, ends - 1, own)
        for k, p in enumerate(ps):
            for i in range(len(p)):
                found = (n for n in range(len(p) - i, 0, -1) if any(own[o] < own[k] and any(q[j : j + n] == p[i : i + n] for j in range(len(q))) for o, q in enumerate(ps)))
                assert got[starts[k] + i] == next(found, 0)


@pytest.mark.parametrize("hot", [substring.HOT_SEGMENTS, 1])
@pytest.mark.parametrize("window", [50, 12])
def test_substring(spark, hot, window):
    docs = some_docs()
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(70))
    docs += [(1000 + i, " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(60))) + " " + passage + f" q{i}") for i in range(30)]
    docs += [(2000, " ".join(["same"] * 300)), (2001, " ".join(["same"] * 120))]
    out = substring.deduplicated(frame(spark, docs), window=window, hot=hot, shard_words=500)
    assert out.columns[:4] == ["doc_id", "text", "doc_ID2", "row"]
    assert rows(out, "doc_id", "sd_n_words", "sd_n_removed", "sd_sha256") == brute.substring(docs, window)


def test_substring_of_nothing(spark):
    assert substring.deduplicated(frame(spark, [])).count() == 0
