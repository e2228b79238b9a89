"""LM scoring: a gated recurrent network with a class-factored softmax, on top of counts over the whole corpus.

Words fall in classes: frequent words in classes of about equal mass, each a softmax of its own over the state; all
other words in one last class, whose words take their share of the corpus counts, (c + 0.5) / (N' + 0.5 (V' + 1)), one
unseen word included. So every text has a proper probability. Counts come from all training documents by one shuffle;
the network begins on a small sample of them; then every partition trains it on all its own training documents, by
truncated backpropagation, and the networks are averaged by their tokens. Scoring runs many documents in
lock-step and carries each state over windows until its document ends.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import batch, map_batches, written

#: Documents the network begins on (smallest XXH64 of the id), and tokens of them at most. All are trained on later.
SAMPLE_DOCS, SAMPLE_TOKENS = 600, 150_000
#: Words whose counts go to every worker, words with an output of their own, classes of those.
HEAD, OUTPUTS, CLASSES = 150_000, 2_000, 40
STATE, WINDOW, STREAMS, EPOCHS = 24, 32, 32, 3
#: Streams of the pass over all documents (fewer where a batch has under 64 windows of each), and steps of a whole that averaged parameters are counted in.
MOST_STREAMS, STEPS = 256, 1 << 20
#: Distinct words that a task counts before it hands them on, and states that wait for their outputs.
MOST_HELD, MOST_STATES = 200_000, 16_384
#: Bytes of the Arrow batches that are counted or scored, and trained on: beside a batch a worker holds some ten times that.
SCORE_BYTES, TRAIN_BYTES = 6 << 20, 12 << 20
END = ""


@dataclass
class Vocabulary:
    words: list[str]  # OUTPUTS most frequent
    counts: np.ndarray

    def __post_init__(self):
        mass = np.cumsum(np.sqrt(self.counts)) / max(1e-9, np.sqrt(self.counts).sum())
        # no class without words, so that no probability is lost
        found = np.unique(np.minimum((mass * CLASSES - 1e-9).astype(int), CLASSES - 1), return_inverse=True)[1].astype(np.int64)
        self.classes = int(found.max(initial=-1)) + 1
        self.class_of = np.r_[found, self.classes]
        self.members = [np.flatnonzero(found == c) for c in range(self.classes)]
        self.place = np.zeros(len(self.class_of), dtype=np.int64)
        for m in self.members:
            self.place[m] = np.arange(len(m))


def _sig(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _log_softmax(z):
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _softmax(z):
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


class Network:
    """GRU over word inputs; the last input and class stand for all words without an output."""

    def __init__(self, v: Vocabulary, state: int = STATE, seed: int = 5):
        rng = np.random.default_rng(seed)
        n = len(v.words) + 1
        r = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        self.v, self.d = v, state
        freq = np.array([v.counts[m].sum() for m in v.members] + [max(1.0, v.counts.sum())], dtype=np.float64)
        self.p = {"x": r(n, 3 * state), "u": r(state, 3 * state), "b": np.zeros(3 * state, np.float32), "c": r(state, v.classes + 1), "cb": np.log(freq / freq.sum() + 1e-6).astype(np.float32)}
        self.p |= {"w": r(n, state), "wb": np.r_[np.log(v.counts + 0.5), 0].astype(np.float32)}

    def step(self, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The states after inputs x."""
        d, p = self.d, self.p
        a = p["x"][x] + p["b"]
        zr = _sig(a[:, : 2 * d] + h @ p["u"][:, : 2 * d])
        c = np.tanh(a[:, 2 * d :] + (zr[:, d:] * h) @ p["u"][:, 2 * d :])
        return h + zr[:, :d] * (c - h)

    def log_probs(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log of the class and, inside classes of frequent words, the word."""
        p, cls = self.p, self.v.class_of[y]
        out = _log_softmax(h @ p["c"] + p["cb"])[np.arange(len(y)), cls].astype(np.float64)
        order, cut = self._by_class(cls)
        for c, m in enumerate(self.v.members):
            own = order[cut[c] : cut[c + 1]]
            if len(own) and len(m) > 1:
                out[own] += _log_softmax(h[own] @ p["w"][m].T + p["wb"][m])[np.arange(len(own)), self.v.place[y[own]]]
        return out

    def _by_class(self, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in order of their classes, and where each class begins."""
        order = np.argsort(cls.astype(np.int16), kind="stable")
        return order, np.searchsorted(cls[order], np.arange(self.v.classes + 1))

    def _grad_out(self, h, y, g):
        """Sets gradients of the outputs; returns the gradient of the state."""
        p, cls, n = self.p, self.v.class_of[y], len(y)
        e = _softmax(h @ p["c"] + p["cb"])
        e[np.arange(n), cls] -= 1
        g["c"] = h.T @ e
        g["cb"] = e.sum(axis=0)
        dh = e @ p["c"].T
        order, cut = self._by_class(cls)
        for c, m in enumerate(self.v.members):
            own = order[cut[c] : cut[c + 1]]
            if not len(own):
                continue
            hs, w = h[own], p["w"][m]
            q = _softmax(hs @ w.T + p["wb"][m])
            q[np.arange(len(own)), self.v.place[y[own]]] -= 1
            g["w"][m] = q.T @ hs
            g["wb"][m] = q.sum(axis=0)
            dh[own] += q @ w
        return dh

    def gradients(self, x: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the negative log-likelihood of y after inputs x (both steps by streams) from states h, by
        backpropagation through these steps; and the last states. A stream whose input is the end begins anew."""
        d, p, (steps, streams) = self.d, self.p, x.shape
        to_zr, to_c = p["u"][:, : 2 * d], p["u"][:, 2 * d :]
        into, live = p["x"][x] + p["b"], (x != self.end)[..., None]
        h0s, rhs, cs, hs = (np.empty((steps, streams, d), h.dtype) for _ in range(4))
        zrs = np.empty((steps, streams, 2 * d), h.dtype)
        for t in range(steps):
            h0 = np.multiply(h, live[t], out=h0s[t])
            zr = zrs[t] = _sig(into[t, :, : 2 * d] + h0 @ to_zr)
            rh = np.multiply(zr[:, d:], h0, out=rhs[t])
            c = np.tanh(into[t, :, 2 * d :] + rh @ to_c, out=cs[t])
            h = hs[t] = h0 + zr[:, :d] * (c - h0)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        out = self._grad_out(hs.reshape(-1, d), y.ravel(), g).reshape(hs.shape)
        da, dh = np.empty((steps, streams, 3 * d), h.dtype), np.zeros_like(h)
        for t in range(steps - 1, -1, -1):
            h0, c, z, r = h0s[t], cs[t], zrs[t, :, :d], zrs[t, :, d:]
            dh += out[t]
            dc = np.multiply(dh * z, 1 - c * c, out=da[t, :, 2 * d :])
            drh = dc @ to_c.T
            da[t, :, :d] = dh * (c - h0) * z * (1 - z)
            da[t, :, d : 2 * d] = drh * h0 * r * (1 - r)
            dh = (dh * (1 - z) + drh * r + da[t, :, : 2 * d] @ to_zr.T) * live[t]
        flat = da.reshape(-1, 3 * d)
        g["b"] = flat.sum(axis=0)
        g["u"][:, : 2 * d] = h0s.reshape(-1, d).T @ flat[:, : 2 * d]
        g["u"][:, 2 * d :] = rhs.reshape(-1, d).T @ flat[:, 2 * d :]
        order = np.argsort(x.ravel().astype(np.int32), kind="stable")
        first = x.ravel()[order]
        starts = np.r_[0, np.flatnonzero(first[1:] != first[:-1]) + 1]
        g["x"][first[starts]] = np.add.reduceat(flat[order], starts, axis=0)
        return g, h

    def fit(self, ids: np.ndarray, epochs: int = EPOCHS, window: int = WINDOW, streams: int = STREAMS, rate: float = 4e-3) -> None:
        """Truncated backpropagation over windows of parallel streams, Adam."""
        n = len(ids) // streams
        if n < 1:
            return
        text = np.ascontiguousarray(ids[: n * streams].reshape(streams, n).T)
        m = {k: np.zeros_like(x) for k, x in self.p.items()}
        s = {k: np.zeros_like(x) for k, x in self.p.items()}
        turn, p = 0, self.p
        for _ in range(epochs):
            h = np.zeros((streams, self.d), np.float32)
            before = np.full((1, streams), self.end)
            for a in range(0, n, window):
                y = text[a : a + window]
                g, h = self.gradients(np.concatenate([before, y[:-1]]), y, h)
                before = y[-1:]
                turn += 1
                for k in p:
                    gk = np.clip(g[k] / y.size, -1, 1)
                    m[k] += 0.1 * (gk - m[k])
                    s[k] += 0.01 * (gk * gk - s[k])
                    p[k] -= rate * (m[k] / (1 - 0.9**turn)) / (np.sqrt(s[k] / (1 - 0.99**turn)) + 1e-6)

    @property
    def end(self) -> int:
        return self.v.words.index(END) if END in self.v.words else len(self.v.words)

    def score(self, flat: np.ndarray, size: np.ndarray, most_states: int = MOST_STATES) -> np.ndarray:
        """Log10 of class and word parts, summed over each whole text: texts of these sizes one after another in
        `flat`, each with the end as its last id. All run in lock-step, longest first; states go to the outputs once
        `most_states` of them are held, and are carried on until their text ends."""
        order = np.argsort(-size, kind="stable")
        start, size = (np.cumsum(size) - size)[order], size[order]
        steps = int(size[0]) if len(size) else 0
        on = np.searchsorted(-size, -np.arange(steps), side="left")  # texts longer than each step
        out = np.zeros(len(size))
        h, before = np.zeros((len(size), self.d), np.float32), np.full(len(size), self.end)
        states, targets, held, since = [], [], 0, 0
        for t in range(steps):
            n = on[t]
            h = self.step(before[:n], h[:n])
            before = flat[start[:n] + t]
            states.append(h)
            targets.append(before)
            held += n
            if held >= most_states or t == steps - 1:
                got = self.log_probs(np.concatenate(states), np.concatenate(targets))
                out[: on[since]] += np.bincount(np.concatenate([np.arange(k) for k in on[since : t + 1]]), weights=got, minlength=on[since])
                states, targets, held, since = [], [], 0, t + 1
        back = np.empty(len(out))
        back[order] = out
        return back / np.log(10)


def held_out(c: Column) -> Column:
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def coded(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(words, codes, counts): the distinct words, each word of the texts as a code, words in each text. A-Z lower-cased."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    found = lists.flatten().dictionary_encode()
    words, codes = found.dictionary.to_pylist(), found.indices.to_numpy()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    if "" in words:  # what split gives at the ends of texts
        real = codes != words.index("")
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[real], minlength=len(counts))
        codes = codes[real]
    return words, codes, counts


def with_ends(ids: np.ndarray, counts: np.ndarray, end: int) -> np.ndarray:
    """The ids of texts one after another, with the end after each text."""
    return np.insert(ids, np.cumsum(counts), end)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, c) of the texts; a token may come more than once."""
    schema = pa.schema([("token", pa.string()), ("c", pa.int64())])
    held: Counter = Counter()
    for b in batches:
        words, codes, counts = coded(b.column(0))
        held[END] += len(counts)
        found = np.bincount(codes, minlength=len(words)).tolist()
        for w, c in zip(words, found, strict=True):
            if c:
                held[w] += c
        if len(held) > MOST_HELD:
            yield batch(schema, list(held), list(held.values()))
            held = Counter()
    if held:
        yield batch(schema, list(held), list(held.values()))


def _trained(network: Network):
    """Over texts: the parameters after training on all of them, times the number of tokens, in STEPS."""
    schema = pa.schema([("at", pa.int64()), ("value", pa.int64()), ("n", pa.int64())])
    index, rest = {w: k for k, w in enumerate(network.v.words)}, len(network.v.words)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n, left = deepcopy(network), 0, np.zeros(0, dtype=np.int64)
        for b in batches:
            words, codes, counts = coded(b.column(0))
            known = np.array([index.get(w, rest) for w in words], dtype=np.int64)
            ids = np.r_[left, with_ends(known[codes], counts, network.end)]
            streams = max(1, min(MOST_STREAMS, len(ids) // (64 * WINDOW)))
            cut = len(ids) // streams * streams
            own.fit(ids[:cut], epochs=1, streams=streams)
            n, left = n + cut, ids[cut:]
        own.fit(left, epochs=1, streams=1)
        n += len(left)
        if n:
            flat = np.concatenate([x.ravel() for x in own.p.values()]).astype(np.float64)
            yield batch(schema, np.arange(len(flat)), np.rint(flat * STEPS).astype(np.int64) * n, np.full(len(flat), n))

    return work


def fit_all(network: Network, texts: DataFrame) -> None:
    """Trains `network` on every row of `texts` (one column): one pass in each partition, then the average."""
    got = map_batches(texts, texts.columns, "at long, value long, n long", _trained(network), TRAIN_BYTES)
    # whole numbers, so that the order of the sums is no matter; as many rows as parameters come to the driver
    rows = got.groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"), F.sum("n").alias("n")).collect()
    if rows:
        flat, at = np.zeros(len(rows), dtype=np.float32), 0
        for r in rows:
            flat[r["at"]] = int(r.value) / r.n / STEPS
        for k, x in network.p.items():
            network.p[k] = flat[at : at + x.size].reshape(x.shape).astype(x.dtype)
            at += x.size


def _scored(network: Network, head: dict[str, float], id_type: pa.DataType):
    schema = pa.schema(
        [("rid", pa.int64()), ("id", id_type), ("held", pa.bool_()), ("n_tokens", pa.int64()), ("n_head", pa.int64()), ("head_log", pa.float64()), ("log_p", pa.float64()), ("n_rest", pa.int64()), ("tail", pa.list_(pa.string())), ("rest_log", pa.float64())]
    )
    index, rest = {w: k for k, w in enumerate(network.v.words)}, len(network.v.words)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rid = (TaskContext.get().partitionId() << 33) if TaskContext.get() else 0
        for b in batches:
            words, codes, counts = coded(b.column(2))
            words, n = [*words, END], len(counts)
            codes = with_ends(codes, counts, len(words) - 1)
            size, row = counts + 1, np.repeat(np.arange(n), counts + 1)
            ids = np.array([index.get(w, rest) for w in words], dtype=np.int64)[codes]
            logs = np.array([head.get(w, np.nan) for w in words])[codes]
            known, other = ~np.isnan(logs), ids == rest
            logs[~known] = 0
            tail_codes = codes[~known]
            tail_bounds = np.r_[0, np.cumsum(np.bincount(row[~known], minlength=n))].astype(np.int32)
            tail = pa.ListArray.from_arrays(pa.array(tail_bounds), pa.array(words, pa.string()).take(pa.array(tail_codes)))
            summed = lambda where, x=None: np.bincount(row[where], weights=None if x is None else x[where], minlength=n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rid + np.arange(n)), b.column(0).cast(id_type), b.column(1), pa.array(size), pa.array(summed(known).astype(np.int64)), pa.array(summed(known, logs)),
                    pa.array(network.score(ids, size)), pa.array(summed(other).astype(np.int64)), tail, pa.array(summed(known & other, logs)),
                ],
                schema=schema,
            )
            rid += n

    return work


def _head(counts: DataFrame, most: int) -> list:
    """Tokens with the highest counts, `most` at most: whole classes of like counts, so one small sum says where to
    stop and no task sends more than what is kept."""
    mark = F.floor(F.log2("c") * 64)
    sizes = counts.groupBy(mark.alias("mark")).agg(F.count("*").alias("n")).orderBy(F.desc("mark")).collect()  # 64 * 63 rows at most
    least, held = None, 0
    for r in sizes:
        if held + r.n > most:
            break
        least, held = r.mark, held + r.n
    if least is None:  # more words of like counts than may be kept
        return counts.orderBy(F.desc("c"), "token").limit(most).collect()
    return sorted(counts.where(mark >= least).collect(), key=lambda r: (-r.c, r.token))


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, outputs: int = OUTPUTS, sample: int = SAMPLE_DOCS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Learns from rows that are not held out (crc32 of the id as text, mod 5, is 1); null ids are not held out. Null and
    empty texts are one end token. Repeated rows come back each. Without training rows all words are unseen. Other
    columns are left out, so their names can't clash.
    """
    src = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held"), F.col(text_col).alias("text"))
    train = src.where(~F.col("held"))
    counts = map_batches(train, ["text"], "token string, c long", _counted, SCORE_BYTES).groupBy("token").agg(F.sum("c").alias("c"))
    counts = written(counts)
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = _head(counts, head)
    own = top[: min(outputs, len(top))]
    v = Vocabulary([r.token for r in own], np.array([r.c for r in own], dtype=np.float64))
    network = Network(v)
    index = {w: k for k, w in enumerate(v.words)}
    picked = train.where("id IS NOT NULL").select("id", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(sample)
    texts = train.join(F.broadcast(picked), "id").orderBy("h", "id", "text").limit(sample).select("text")
    ids: list[int] = []
    for r in texts.toLocalIterator():
        words, codes, found = coded(pa.array([r.text], pa.string()))
        known = np.array([index.get(w, len(index)) for w in words], dtype=np.int64)
        ids += with_ends(known[codes], found, network.end).tolist()
        if len(ids) > SAMPLE_TOKENS:
            break
    network.fit(np.array(ids[:SAMPLE_TOKENS], dtype=np.int64))
    fit_all(network, train.select("text"))
    logs = {r.token: float(np.log10(r.c + 0.5)) for r in top}
    kind = src.schema["id"].dataType.simpleString()
    # what a row is, and its number, come out of the same task: no other pass has to deal the rows the same way
    columns = f"rid long, id {kind}, held boolean, n_tokens long, n_head long, head_log double, log_p double, n_rest long, tail array<string>, rest_log double"
    got = written(map_batches(src, ["id", "held", "text"], columns, _scored(network, logs, to_arrow_type(src.schema["id"].dataType)), SCORE_BYTES))
    tail = got.select("rid", F.explode("tail").alias("token")).groupBy("rid", "token").agg(F.count("*").alias("n"))
    tail = tail.join(counts, "token", "left").groupBy("rid").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("tail_log"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_tail")
    )
    out = got.drop("tail").join(tail, "rid", "left")
    in_own = sum(r.c for r in own)
    zero = F.lit(0.0)
    all_log = np.log10(total + 0.5 * (kinds + 1))
    rest_log = np.log10(total - in_own + 0.5 * (kinds - len(own) + 1))
    return out.select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("head_log") + F.coalesce("tail_log", zero) - F.col("n_tokens") * F.lit(float(all_log))).alias("base_score"),
        (F.col("log_p") + F.col("rest_log") + F.coalesce("tail_log", zero) - F.col("n_rest") * F.lit(float(rest_log))).alias("score"),
    )
