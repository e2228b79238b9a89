import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from tidepanel.llm import licences, lines

from . import brute
from .test_near_and_substring import frame, some_docs


def dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b))


def plain_matches(text):
    if text is None:
        return Counter()
    cut = text.split("\n")
    units = [(text, 0)] + ([(t, k + 1) for k, t in enumerate(cut)] if len(cut) > 1 else [])
    parts = re.split(r"\n[ \t\r]*\n", text)
    units += [(t, -k - 1) for k, t in enumerate(parts) if len(parts) > 1 and "\n" in t]
    out = Counter()
    for t, k in units:
        g = licences.bigrams(licences.normalised(t))
        for name, template in licences.TEMPLATES.items():
            if g and (d := dice(g, licences.bigrams(licences.normalised(template)))) >= licences.THRESHOLD:
                out[name, round(d, 9), k] += 1
    return out


def test_licences(spark):
    t = licences.TEMPLATES
    texts = [v for v in t.values()] + [v.replace("  ", "\n") for v in t.values()] + [f"Some words.\n{t['MIT']}\nmore\n\n{t['MIT-text']}\nend"]
    texts += [None, "", "\n\n", "x", "x y", t["MPL-2.0-notice"].replace("Source", "source-code"), f"intro\n\n{t['BSD-text']}:\n1. keep\n\nend", "LICENSED UNDER THE APACHE LICENSE; VERSION 2.0", "long " * 30_000]
    docs = list(enumerate(texts)) + [(1, texts[1])]
    out = licences.scanned(frame(spark, docs)).collect()
    assert len(out) == len(docs) and out[0].asDict().keys() == {"doc_id", "text", "doc_ID2", "row", "licences"}
    for r in out:
        assert Counter((m.licence, round(m.dice, 9), m.unit) for m in r.licences) == plain_matches(r.text)
    assert licences.scanned(frame(spark, [])).count() == 0
    assert licences.scanned(frame(spark, docs), templates={"none": "x"}).collect()[0].licences == []


def test_scan_plans_no_python_and_no_shuffle(spark):
    plan = licences.scanned(frame(spark, [(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def edits(a, b):
    """The edit distance, a row of the table at a time."""
    x, y = (np.array(list(map(ord, t))) for t in (a, b))
    steps = np.arange(len(y) + 1)
    row = steps.copy()
    for i, c in enumerate(x, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (y != c))
        row = np.minimum.accumulate(np.r_[i, new] - steps) + steps
    return int(row[-1])


def test_edits():
    assert all(edits(a, b) == levenshtein(a, b) for a in ("", "kitten", "abcabc", "flaw") for b in ("x", "sitting", "bcabca", "lawn"))


def plain_lines(docs, gate=3):
    """(id, text) -> the text without the lines that repeat an earlier one. Links are lines of an edit similarity of 0.8
    or more; with a gate, only those whose SimHashes are as near."""
    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    occ = []
    for i, t in docs:
        mark = signed(xxhash.xxh64((t or "").encode(), seed=42).intdigest())
        for pos, line in enumerate((t or "").split("\n") if t is not None else []):
            norm = re.sub(r"[^\w]+|_+", " ", line.lower()).strip()
            if norm:
                occ.append((((-1, 0) if i is None else (0, i)), mark, pos, norm))
    norms = sorted({o[3] for o in occ})
    fps = []
    for n in norms:
        h = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in n.split(" ")]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if len(h) >= lines.LEAST_WORDS else None)
    linked = [
        (a, b)
        for a in range(len(norms))
        for b in range(a)
        if fps[a] is not None and fps[b] is not None and (gate is None or (fps[a] ^ fps[b]).bit_count() <= gate)
        and abs(len(norms[a]) - len(norms[b])) <= (most := int(0.2 * max(len(norms[a]), len(norms[b])) + 1e-9)) and edits(norms[a], norms[b]) <= most
    ]
    group = dict(zip(norms, brute.classes(list(range(len(norms))), linked)))
    first = {}
    for o in occ:
        first[group[o[3]]] = min(o[:3], first.get(group[o[3]], o[:3]))
    drop = {o[:3] for o in occ if first[group[o[3]]] != o[:3]}
    out = Counter()
    for i, t in docs:
        if t is None:
            out[i, None] += 1
            continue
        mark = signed(xxhash.xxh64(t.encode(), seed=42).intdigest())
        key = (-1, 0) if i is None else (0, i)
        out[i, "\n".join(x for p, x in enumerate(t.split("\n")) if (key, mark, p) not in drop)] += 1
    return out, linked


def test_line_dedup(spark):
    rng = np.random.default_rng(4)
    vocab = [f"word{i}" for i in range(500)]
    base = [" ".join(rng.choice(vocab, n)) for n in (3, 8, 20, 60, 90, 120, 120)]
    docs = []
    for i in range(90):
        own = []
        for _ in range(rng.integers(0, 5)):
            w = base[rng.integers(len(base))].split(" ")
            for _ in range(rng.integers(0, 3)):
                w[rng.integers(len(w))] = str(rng.choice(vocab))
            own.append("  ".join(w).title() + "." * rng.integers(0, 2))
        own += ["", "--", "Same line here", " ".join(rng.choice(vocab, 12))][: rng.integers(0, 5)]
        docs.append((int(i * 37 % 90), "\n".join(own)))
    docs += [(500, None), (501, ""), (None, "Same line here\nnew one"), (502, docs[0][1]), (502, docs[0][1]), (503, "x\nx\nx"), (504, "été À la\nETE\nété   à LA!")]
    want, linked = plain_lines(docs)
    assert linked
    out = lines.deduplicated(frame(spark, docs))
    got = Counter((r.doc_id, r.ld_text) for r in out.collect())
    assert got == want
    assert lines.deduplicated(frame(spark, [])).count() == 0


def test_near_lines_far_apart_in_words_are_found(spark):
    """Against edit similarity alone, without a gate: changed letters in lines of any length."""
    rng = np.random.default_rng(11)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    norms = set()
    for n in [*range(3, 9)] * 4 + [12, 20, 40, 70] * 4:
        base = " ".join("".join(rng.choice(letters, rng.integers(4, 9))) for _ in range(n))
        norms.add(base)
        for _ in range(2):
            t = list(base)
            for _ in range(max(1, len(t) // 25)):
                t[rng.choice([k for k, c in enumerate(t) if c != " "])] = str(rng.choice(letters))
            norms.add("".join(t))
    norms = sorted(norms)
    linked = [(a, b) for a in range(len(norms)) for b in range(a) if abs(len(norms[a]) - len(norms[b])) <= 0.2 * max(len(norms[a]), len(norms[b])) and levenshtein(norms[a], norms[b]) <= int(0.2 * max(len(norms[a]), len(norms[b])) + 1e-9)]
    group = dict(zip(norms, brute.classes(list(range(len(norms))), linked)))
    docs = list(enumerate(norms))
    kept = {r.doc_id for r in lines.deduplicated(frame(spark, docs), bands=lines.BANDS).collect() if r.ld_text}
    first = {min(i for i, t in docs if group[t] == g) for g in set(group.values())}
    missed = kept - first
    assert len(linked) > 80 and first <= kept
    assert len(missed) <= 0.03 * len(linked)
    assert len({r.doc_id for r in lines.deduplicated(frame(spark, docs)).collect() if r.ld_text} - first) > 10 + len(missed)  # by SimHashes alone


@pytest.mark.parametrize("hot", [None, 4])
def test_lines_around_one_passage(spark, hot):
    rng = np.random.default_rng(5)
    vocab = [f"{a}{b}{k}" for k in range(30) for a in "bcdfgh" for b in "aeiou"]
    passage = " ".join(rng.choice(vocab, 30))
    docs = []
    for k in range(40):
        own = " ".join(rng.choice(vocab, 40))
        docs += [(k, f"{own} {passage}"), (100 + k, f"{own[:-1]}x {passage}")]
    out = lines.deduplicated(frame(spark, docs), bands=lines.BANDS, hot=hot)
    assert {r.doc_id for r in out.collect() if r.ld_text} == set(range(40))


def test_tables_of_round_two_hold_what_can_link(spark, monkeypatch):
    """Lines that share a phrase meet in a block or two, of which three have to agree: they don't reach the second round's
    table. The cut lines with their texts are gone by the time that lines are compared."""
    rng = np.random.default_rng(8)
    vocab = [f"{a}{b}{k}" for k in range(30) for a in "bcdfgh" for b in "aeiou"]
    phrase = " ".join(rng.choice(vocab, 4))
    docs = []
    for k in range(80):
        own = " ".join(rng.choice(vocab, 30))
        docs += [(k, f"{own} {phrase}"), (100 + k, f"{own[:-1]}x {phrase}")] if k % 8 == 0 else [(k, f"{own} {phrase}")]
    made, gone = [], []
    write, remove = lines.written, lines.removed

    def written(df, folder=None):
        out = write(df, folder)
        made.append((set(df.columns), folder, len(gone), out.count()))
        return out

    monkeypatch.setattr(lines, "written", written)
    monkeypatch.setattr(lines, "removed", lambda s, folder: (gone.append(folder), remove(s, folder)))
    out = lines.deduplicated(frame(spark, docs), bands=lines.BANDS)
    assert {r.doc_id for r in out.collect() if r.ld_text} == set(range(80))
    met = sum(n for c, _, _, n in made if c == {"block", "key", "b"})
    left = [n for c, _, _, n in made if "main" in c]
    assert met > 100 and left and left[0] < 0.2 * met
    (cut,) = {folder for c, folder, _, _ in made if {"id", "norm"} <= c}
    assert gone[0] == cut and all(done for c, _, done, _ in made if "least" in c)


def test_common_short_words_bring_no_lines_together(spark, monkeypatch):
    rng = np.random.default_rng(3)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    docs = []
    for k in range(100):
        own = " ".join("".join(rng.choice(letters, 8)) for _ in range(5))
        docs += [(k, f"{own} of to a and"), (100 + k, f"{own[:-1]}0 of to a and")] if k % 10 == 0 else [(k, f"{own} of to a and")]
    asked, verified = [], lines._verified
    monkeypatch.setattr(lines, "_verified", lambda pairs, *a: (asked.append(pairs.count()), verified(pairs, *a))[1])
    out = lines.deduplicated(frame(spark, docs), bands=lines.BANDS)
    assert {r.doc_id for r in out.collect() if r.ld_text} == set(range(100))
    assert sum(asked) < 100


def test_pairs_of_round_two_are_met_twice_at_most(spark):
    lanes = [[1, 2, 3, 4, 5, 6, 7, 8], [9, 2, 3, -1, 5, 6, 0, 8]]
    rows = [tuple(sum((x & 0xFFFF) << 16 * n for n, x in enumerate(own[k : k + 4])) - (1 << 64 if own[k + 3] & 0x8000 else 0) for own in lanes for k in (0, 4))]
    df = spark.createDataFrame(rows, "p0_a long, p1_a long, p0_b long, p1_b long")
    got = df.select(lines._agreeing("_a", "_b", 8), *(lines._agreeing("_a", "_b", 8, lines.F.lit(k)) for k in range(9))).first()
    assert list(got) == [5, 0, 0, 1, 2, 2, 3, 4, 4, 5]


def test_runs_leave_out_empty_parts(spark):
    """Lines of the same parts, four letters being a part of three and one of one, and lines too short for a run."""
    texts = ["ab cde fg h ij", "a b", "abcd efgh ijkl", "of to"]
    once = spark.createDataFrame([(k, len(t), t, len(t.split())) for k, t in enumerate(texts)], "key long, size int, norm string, n int").where("n >= 3")
    got = {r.key: r for r in lines.fingerprints(once, 4).collect()}
    assert set(got) == {0, 2} and all(len(r.least) == 4 for r in got.values())
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    part = lambda t: signed(xxhash.xxh64(t.encode(), seed=42).intdigest())
    one = spark.createDataFrame([tuple(part(t) for t in ("ab", "cde", "fg", "h", "ij"))], "a long, b long, c long, d long, e long").select(lines.F.xxhash64("a", "b", "c", "d", "e")).first()[0]
    assert got[0].fp == one  # the only run


def test_what_many_lines_share_alone_brings_no_two_together(spark, monkeypatch):
    """A crowd of unlike lines around one passage, with near copies among them, and lines that are near by the passage."""
    rng = np.random.default_rng(6)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    say = lambda n: " ".join("".join(rng.choice(letters, 6)) for _ in range(n))
    passage, docs = say(40), []
    for k in range(150):
        own = say(40)
        docs += [(k, f"{own} {passage}"), (1000 + k, f"{own[:-1]}0 {passage}")] if k % 5 == 0 else [(k, f"{own} {passage}")]
    docs += [(500 + k, f"{passage} {say(6)}") for k in range(8)]
    asked, verified = [], lines._verified
    monkeypatch.setattr(lines, "_verified", lambda pairs, *a: (asked.append(pairs.count()), verified(pairs, *a))[1])
    out = lines.deduplicated(frame(spark, docs), bands=lines.BANDS)
    assert {r.doc_id for r in out.collect() if r.ld_text} == {*range(150), 500}
    assert asked[1] < 1500  # of 11,000 pairs
