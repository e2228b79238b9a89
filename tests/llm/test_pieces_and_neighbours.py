import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidepanel.llm import forest, neural, pieces, wrappers
from tidepanel.llm.entry import tokenizer_path

from . import brute
from .test_near_and_substring import frame, some_docs


def every_segmentation(m, word):
    if not word:
        return [(0.0, ())]
    out = []
    for a, s, ids in m.lattice(word)[0][len(word)]:
        out += [(s + t, own + ids) for t, own in every_segmentation(m, word[:a])]
    return out


def test_n_best_are_the_best():
    m = pieces.Pieces(tokenizer_path("piece_bpe_32k.model"), n=4)
    for word in ("▁then", "▁ététhe", "▁▁ab", "ﬁ中x", "▁inging", "aaaaaaa"):
        want = sorted((s for s, _ in every_segmentation(m, word)), reverse=True)
        got = m.best(word)
        assert [round(s, 6) for s, _ in got] == [round(s, 6) for s in want[:4]]
        assert len({i for _, i in got}) == len(got)
    text = "the ing on"
    lists = [every_segmentation(m, w) for w in m.words(text)]
    sums = sorted((a[0] + b[0] + c[0] for a in lists[0] for b in lists[1] for c in lists[2]), reverse=True)
    assert [round(s, 6) for s in m.encode(text)[1]] == [round(s, 6) for s in sums[:4]]
    for text in ("the ing on", "a", "thing then the", "then then", ""):
        whole = [(0.0, ())]
        for w in m.words(text):
            whole = [(s + t, a + b) for s, a in whole for t, b in every_segmentation(m, w)]
        plain = {ids: s for s, ids in whole}
        ids, scores, others = m.encode(text)
        found = [tuple(ids), *map(tuple, others)]
        assert len(set(found)) == len(found) == len(scores) == min(4, len(plain))
        assert [round(plain[x], 6) for x in found] == [round(s, 6) for s in scores] == [round(s, 6) for s in sorted(plain.values(), reverse=True)[:4]]
        assert all(m.decode(list(x)) == text for x in found)


def test_pieces_round_trip(spark):
    docs = some_docs(20) + [(900, "a  b\n\tc Ünïé ﬁ 中文 \x01 "), (901, " x"), (902, "y" * 30_000), (903, "\n\n"), (904, "  ")]
    out = pieces.encoded(frame(spark, docs), tokenizer_path("piece_bpe_32k.model")).collect()
    assert len(out) == len(docs) and all(r.restored for r in out)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    texts = {i: t or "" for i, t in docs}
    assert all(sp.decode(list(r.ids)) == texts[r.doc_id] for r in out if r.doc_id is not None and r.doc_id < 20)
    assert pieces.encoded(frame(spark, []), tokenizer_path("piece_bpe_32k.model")).count() == 0


def plain_neighbours(rows, every, k):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok[i] = min(v, ok.get(i, v))
    out = {}
    for q in ok:
        if q % every == 0:
            s = sorted((-float(np.dot(np.float64(ok[q]), np.float64(v))), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))
            out[q] = [(i, -x) for x, i in s[:k]]
    return out


def test_forest(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16))
    x = (centres[rng.integers(0, 12, 1500)] + 0.4 * rng.standard_normal((1500, 16))).astype(np.float32)
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(None, rows[0][1]), (5000, None), (5001, [0.0] * 16), (5020, [float("nan")] * 16), (5040, [None] * 16), (5060, [1.0] * 3), (20, rows[20][1]), (5080, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = plain_neighbours(rows, 20, 10)
    got: dict = {}
    for r in sorted(forest.neighbours(df, every=20, k=10, shard_rows=400).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    hit = 0
    for q, w in want.items():
        assert all(abs(s - float(np.dot(np.float64(rows[q][1]), np.float64(rows[i][1])))) < 1e-9 for i, s in got.get(q, []))
        assert got.get(q, []) == sorted(got.get(q, []), key=lambda p: (-p[1], p[0])) and len(got.get(q, [])) == len(w)
        hit += len({i for i, _ in w} & {i for i, _ in got.get(q, [])})
    assert hit >= 0.9 * sum(map(len, want.values()))
    assert forest.neighbours(df.where("vec_id < 0")).count() == 0


def lm_base(docs):
    toks = {k: [brute.lower(w) for w in brute.words(t)] + [""] for k, (_, t) in enumerate(docs)}
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs]
    c = Counter(w for k, ws in toks.items() if not held[k] for w in ws)
    n, v = sum(c.values()), len(c)
    return Counter((docs[k][0], held[k], len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for k, ws in toks.items())


def test_language_model(spark):
    docs = some_docs(60) + [(3000 + i, " ".join(["red green blue"] * 40)) for i in range(40)]
    for head, outputs in ((50_000, 2_000), (30, 5)):
        out = neural.scored(frame(spark, docs), head=head, outputs=outputs).collect()
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == lm_base(docs)
        assert all(r.score < 0 for r in out)
    # what follows is predictable, so the network beats the counts on texts that it hasn't learned from
    held = [r for r in out if r.held_out and r.doc_id >= 3000]
    assert held and all(r.n_tokens == 121 for r in held)
    out = neural.scored(frame(spark, docs)).collect()
    held = [r for r in out if r.held_out and r.doc_id >= 3000]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert neural.scored(frame(spark, [])).count() == 0


def test_network_gives_probabilities():
    v = neural.Vocabulary(["a", "b", "", "c"], np.array([5.0, 4, 3, 1]))
    net = neural.Network(v)
    net.fit(np.tile([0, 1, 2], 200))
    h = np.random.default_rng(0).standard_normal((3, neural.STATE)).astype(np.float32)
    total = sum(np.exp(net.log_probs(h, np.full(3, w))) for w in range(5))
    assert np.allclose(total, 1, atol=1e-5)
    texts = [np.array([0, 1, 2]), np.array([3, 2]), np.tile([0, 1], 100), np.array([2])]
    got = net.score(np.concatenate(texts), np.array([len(t) for t in texts]), most_states=7)
    assert np.allclose(got, [plain_score(net, t) for t in texts], atol=1e-3)


def plain_score(net, text):
    """Step by step, with whole tables, in double precision."""
    p, v, d = {k: x.astype(np.float64) for k, x in net.p.items()}, net.v, net.d
    sig = lambda x: 1 / (1 + np.exp(-x))
    h, before, total = np.zeros(d), net.end, 0.0
    for y in text:
        a = p["x"][before] + p["b"]
        z, r = sig(a[:d] + h @ p["u"][:, :d]), sig(a[d : 2 * d] + h @ p["u"][:, d : 2 * d])
        h = (1 - z) * h + z * np.tanh(a[2 * d :] + (r * h) @ p["u"][:, 2 * d :])
        e = np.exp(h @ p["c"] + p["cb"])
        c = v.class_of[y]
        total += math.log10(e[c] / e.sum())
        if c < v.classes:
            e = np.exp(h @ p["w"][v.members[c]].T + p["wb"][v.members[c]])
            total += math.log10(e[v.place[y]] / e.sum())
        before = y
    return total


def test_gradients_are_those_of_the_likelihood():
    v = neural.Vocabulary([*"abcdefg", ""], np.array([9.0, 8, 7, 5, 3, 2, 1, 4]))
    net = neural.Network(v, state=3)
    net.p = {k: x.astype(np.float64) for k, x in net.p.items()}
    rng = np.random.default_rng(0)
    text = rng.integers(0, 9, (7, 4))
    text[3, 1] = text[2, 0] = net.end
    x, y, h = text[:-1], text[1:], rng.standard_normal((4, 3))

    def loss():
        state, total = h, 0.0
        for t in range(len(x)):
            state = net.step(x[t], state * (x[t] != net.end)[:, None])
            total -= net.log_probs(state, y[t]).sum()
        return total

    g, _ = net.gradients(x, y, h)
    for k, values in net.p.items():
        for at in rng.integers(0, values.size, 12):
            old = values.flat[at]
            values.flat[at] = old + 1e-5
            up = loss()
            values.flat[at] = old - 1e-5
            down = loss()
            values.flat[at] = old
            assert abs((up - down) / 2e-5 - g[k].flat[at]) < 1e-5 * max(1, abs(g[k].flat[at])), k


def test_scores_stay_with_their_documents(spark):
    docs = [(i, f"word{i % 7} " * (i + 1)) for i in range(200)] + [(900, "long " * 50_000), (901, None), (902, " \n "), (3, "again")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("held", F.lit(1)).withColumn("rid", F.lit("x"))
    for dealt in (df.repartition(7), df.repartition(3, "text"), df.coalesce(1)):
        got = neural.scored(dealt).collect()
        assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((i, len((t or "").split()) + 1) for i, t in docs)


def test_workers_of_the_network_get_small_batches(spark, monkeypatch):
    """Two workers beside a heap of 1,800 MB have to stay under 3,000 MB: what they hold follows the batch."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.repeat(F.lit(" some words here"), 125)).alias("text")).coalesce(1)

    def sized(work, name):
        def inner(batches):
            def seen():
                for b in batches:
                    assert b.nbytes < 14 << 20, f"{name}: {b.nbytes}"
                    yield b
            yield from work(seen())
        return inner

    for name in ("_trained", "_scored"):
        monkeypatch.setattr(neural, name, lambda *a, f=getattr(neural, name), n=name: sized(f(*a), n))
    monkeypatch.setattr(neural, "_counted", sized(neural._counted, "_counted"))
    out = neural.scored(docs, sample=10)
    assert out.count() == 20_000 and out.where("n_tokens <> 377").count() == 0


def page(title, paragraphs, extra="", ad="buy now"):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body><nav><ul><li><a href="/">Home {title}</a></li><li>x</li></ul></nav><div class="ad">{ad}</div><article><h1>{title}</h1>{body}{extra}</article><footer>&copy; me</footer></body></html>'


def test_wrappers(spark):
    rows = [(i, f"http://h{i % 3}.org/{i}", page(f"T{i}", [f"One &amp; {i}\n  two", "<b>bold</b> text<br><p>next"], '<div class="comments"><p>me too</p></div>')) for i in range(30)]
    want = {i: f"T{i}\nOne & {i} two\nbold text\nnext" for i in range(30)}
    rows += [(100 + i, f"https://plain.net/{i}", f"<html><body><div id='menu'><a href=x>menu {i}</a></div><div class=top>Same</div><div class=text><p>Words of page {i} that run on and on.</p><p>More {i}.</p></div><div class=sidebar>side {i}</div></body></html>") for i in range(8)]
    want |= {100 + i: f"Words of page {i} that run on and on.\nMore {i}." for i in range(8)}
    rows += [(200, None, page("N", ["x"])), (201, "http://h0.org/x", None), (202, "http://h0.org/y", ""), (203, "nonsense", "just text"), (204, "http://h1.org/q", "<article>cut <p>off &am"), (3, rows[3][1], rows[3][2])]
    want |= {200: "N\nx", 201: "", 202: "", 203: "just text", 204: "cut\noff &am"}
    out = wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.page_id, r.text, r.n_chars) == (r.page_id, want[r.page_id], len(want[r.page_id]))
    assert wrappers.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_alignment_infers_repeats_optionals_and_slots():
    w = wrappers.infer(["<ul><li>a</li><li>b</li></ul><p>x</p>", "<ul><li>c</li></ul>"])
    ul, p = w[wrappers.CHILDREN]
    assert ul[wrappers.CHILDREN][0][wrappers.REPEATED] and ul[wrappers.CHILDREN][0][wrappers.TEXT] == 0
    assert p[wrappers.OPTIONAL] and p[wrappers.TEXT] == "x"


def test_network_learns_from_every_training_document(spark):
    docs = [(i, "red green blue black " * 30) for i in range(300)]
    out = neural.scored(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), sample=0).collect()
    assert len(out) == len(docs)
    gain = [(r.score - r.base_score) / r.n_tokens for r in out if r.held_out]
    assert gain and min(gain) > 0.1  # no document is in the sample, so only the pass over all can teach the order


def test_every_page_of_a_host_shapes_its_wrapper(spark):
    """A layout of one page in sixty, whose text is beside the path of the others."""
    def page(i):
        if i % 60 == 59:
            return f"<div id=x><p>Short {i}.</p></div><div id=y><p>{'Other layout text. ' * 100} {i}</p></div>"
        return f"<div id=x><p>Words of page {i} that vary {i * 7}.</p></div>"

    rows = [(i, "https://one.example/", page(i)) for i in range(240)]
    out = {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert len(out) == 240
    assert all("Other layout text." in out[i] and f"Short {i}." in out[i] for i in range(59, 240, 60))
    assert all(f"Words of page {i} " in out[i] for i in range(240) if i % 60 != 59)


def covered(node, w):
    """Whether the wrapper has every element of the page, at its place in the nesting."""
    for p in node.parts:
        if isinstance(p, wrappers.Node):
            known = next((c for c in w[wrappers.CHILDREN] if c[:2] == [p.tag, p.marks]), None)
            if known is None or not covered(p, known):
                return False
    return True


def test_the_wrapper_decides():
    """What is the same on a host's pages goes, marked article or not; another wrapper gives another text."""
    def one(i, mark):
        own = "".join(f"<p>Words {i} {k} of this page and no other.</p>" for k in range(i % 3 + 1))
        return f"<html><body><div class=top><p>Same top</p></div><{mark}><h1>Title {i}</h1><div class=x><p>Buy our magazine</p></div>{own}<dl><dt>a{i}</dt><dd>b{i}</dd><dt>c{i}</dt><dd>d{i}</dd></dl></{mark}></body></html>"

    for mark in ("article", "div"):
        pages = [one(i, mark) for i in range(7)]
        w = wrappers.infer(pages)
        assert all(covered(wrappers.parsed(p), w) for p in pages)
        for i, p in enumerate(pages):
            own = [f"Words {i} {k} of this page and no other." for k in range(i % 3 + 1)]
            assert wrappers.extract(p, w) == "\n".join([f"Title {i}", *own, f"a{i}", f"b{i}", f"c{i}", f"d{i}"])
            assert "Buy our magazine" in wrappers.extract(p, wrappers.infer(["<article>x</article>"]))
    alike = ["<article><p>All pages say this.</p></article>"] * 9
    assert wrappers.extract(alike[0], wrappers.infer(alike)) == "All pages say this."


def test_groups_of_more_elements_repeat():
    w = wrappers.infer(["<dl>" + "<dt>a</dt><dd>b</dd>" * 5 + "</dl>", "<dl><dt>x</dt><dd>y</dd></dl>"])
    dl = w[wrappers.CHILDREN][0]
    assert [(c[wrappers.TAG], c[wrappers.REPEATED]) for c in dl[wrappers.CHILDREN]] == [("dt", True), ("dd", True)]


def test_deep_and_wide_pages():
    deep = "<div>" * 5000 + "in the depths" + "</div>" * 5000
    wide = "".join(f"<p>p{k}</p><ul><li>l{k}</li></ul>" for k in range(3000))
    w = wrappers.infer([deep, wide, deep])
    assert wrappers.extract(deep) == "in the depths"
    assert wrappers.extract(wide, w).count("\n") == 5999
