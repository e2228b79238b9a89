"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints: XXH64 (seed 42) of word shingles, a bit is set if it is set in over half of the shingles' hashes.

Search: equal fingerprints collapse first. Two fingerprints at most two bits apart agree on one of three segments, and
on one of three parts of what is left, so each fingerprint is dealt to nine (segment, part) keys of 35 or 36 bits, and
every linked pair meets under at least one key. Inside a key the fingerprints are sorted by Gray rank; a tree of
fan-out 8 over that order keeps, per node, the bits on which all its members agree (mask and pattern). What a parent
has factored out is not compared again in its children: a search carries the differences accumulated so far and drops
a node with all its members once they exceed the distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, connected_components, map_batches, written

SEED = 42
FAN = 8
#: Bits of the three segments, from the top.
SEGMENTS = (22, 21, 21)
#: Rows that a worker gathers before it searches them (whole keys only), and queries that descend the tree at a time.
GATHER, ABREAST = 200_000, 4_096


def fingerprint(text: str | None, width: int = 3) -> int:
    """The fingerprint of one text: A-Z lower-cased, words split at ASCII white space, `width`-word shingles with
    repeats; fewer words: the whole sequence; none, or null: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[: -width] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]
    h = np.array(hashes, dtype=np.uint64)
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65_536):
        votes += np.unpackbits(h[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(h)).tobytes(), "big")


def _fingerprints(width: int):
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py(), width) for x in b.column(1)], dtype=np.uint64).astype(np.int64)
            yield batch(schema, b.column(0), fps)

    return work


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Places of code words in the reflected Gray order."""
    r = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def dealt(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nine rows for each fingerprint: key, Gray rank of the word that starts with the key's bits, fingerprint."""
    keys, ranks, out = [], [], []
    x = fps.astype(np.uint64)
    u = np.uint64
    for i, size in enumerate(SEGMENTS):
        before = sum(SEGMENTS[:i])
        rest = 64 - size
        turned = (x << u(before)) | (x >> u(64 - before)) if before else x
        segment, left = turned >> u(rest), turned & u((1 << rest) - 1)
        part = rest // 3
        for j in range(3):
            long = rest - 2 * part if j == 2 else part
            shift = part * j
            spun = ((left << u(shift)) | (left >> u(rest - shift))) & u((1 << rest) - 1) if shift else left
            head = spun >> u(rest - long)
            keys.append((u(3 * i + j) << u(60)) | (segment << u(long)) | head)
            ranks.append(gray_rank((segment << u(rest)) | spun))
            out.append(x)
    return tuple(np.concatenate(a).astype(np.int64) for a in (keys, ranks, out))


class GrayIndex:
    """The tree over fingerprints in the order given; levels[0] are the fingerprints themselves."""

    def __init__(self, x: np.ndarray):
        self.levels = [(x, np.full(len(x), ~np.uint64(0)))]
        low = high = x
        while len(low) > 1:
            extra = -len(low) % FAN
            low = np.bitwise_and.reduce(np.pad(low, (0, extra), mode="edge").reshape(-1, FAN), axis=1)
            high = np.bitwise_or.reduce(np.pad(high, (0, extra), mode="edge").reshape(-1, FAN), axis=1)
            same = ~(low ^ high)
            self.levels.append((low & same, same))

    def pairs(self, at: np.ndarray, end: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j), i in `at`, i < j < end, whose fingerprints differ in at most `distance` bits."""
        x = self.levels[0][0]
        top = np.zeros(len(at), dtype=np.int64)
        while ((end - at) > FAN ** (top + 1)).any():
            top = np.where((end - at) > FAN ** (top + 1), top + 1, top)
        found = []
        query = node = differ = known = None
        for level in range(int(top.max(initial=0)), -1, -1):
            mine = np.flatnonzero(top == level)
            size = FAN**level
            first, last = (at[mine] + 1) // size, (end[mine] - 1) // size
            count = np.maximum(last - first + 1, 0)
            q = np.repeat(mine, count)
            n = np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
            d, k = np.zeros(len(q), dtype=np.int64), np.zeros(len(q), dtype=np.uint64)
            if query is not None and len(query):
                inner = (node[:, None] * FAN + np.arange(FAN)).ravel()
                q, n = np.concatenate([q, np.repeat(query, FAN)]), np.concatenate([n, inner])
                d, k = np.concatenate([d, np.repeat(differ, FAN)]), np.concatenate([k, np.repeat(known, FAN)])
            inside = (n * size < end[q]) & ((n + 1) * size > at[q] + 1)
            q, n, d, k = q[inside], n[inside], d[inside], k[inside]
            pattern, mask = self.levels[level]
            d = d + np.bitwise_count((x[at[q]] ^ pattern[n]) & mask[n] & ~k)
            near = d <= distance
            query, node, differ, known = q[near], n[near], d[near], mask[n[near]]
        if query is not None:
            found.append((at[query], node))
        return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (at[:0], at[:0])


def _settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest labels over the edges (a, b), on top of the labels so far."""
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return label
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]


def star_links(key: np.ndarray, x: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join, inside each run of equal keys, all fingerprints of a connected group to one of them."""
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
    size = np.diff(np.r_[cut, len(key)])
    several = np.repeat(size > 1, size)
    key, x = key[several], x[several]
    if not len(key):
        return x, x
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[cut, len(key)])
    end = np.repeat(cut + size, size)
    index, label = GrayIndex(x), np.arange(len(x))
    at = np.flatnonzero(end - np.arange(len(x)) > 1)
    for s in range(0, len(at), ABREAST):
        a, b = index.pairs(at[s : s + ABREAST], end[at[s : s + ABREAST]], distance)
        label = _settle(label, a, b)
    other = np.flatnonzero(label != np.arange(len(x)))
    return x[other], x[label[other]]


def _search(distance: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, x = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)

        def found(k, f):
            a, b = star_links(k, f, distance)
            return batch(schema, a.astype(np.int64), b.astype(np.int64))

        for b in batches:
            key = np.concatenate([key, b.column(0).to_numpy()])
            x = np.concatenate([x, b.column(1).to_numpy().astype(np.uint64)])
            if len(key) >= GATHER and key[0] != key[-1]:
                cut = int(np.flatnonzero(key != key[-1])[-1]) + 1
                yield found(key[:cut], x[:cut])
                key, x = key[cut:], x[cut:]
        yield found(key, x)

    return work


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.int64()), ("rank", pa.int64()), ("fp", pa.int64())])
    for b in batches:
        yield batch(schema, *dealt(b.column(0).to_numpy()))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2, width: int = 3) -> DataFrame:
    """(id, fingerprint, component_id) for every row of `docs`.

    component_id is the smallest id reachable over links of at most `distance` (0 to 2) differing bits. Null text has
    fingerprint zero and links like any other; a row with a null id keeps its fingerprint and takes the smallest
    non-null id of its group (null if none). Repeated rows each come back. Other columns are ignored. Empty in, empty out.
    """
    if not 0 <= distance <= 2:
        raise ValueError("the index finds distances from 0 to 2")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    marked = written(map_batches(src, ["id", "text"], "id long, fp long", _fingerprints(width)))
    nodes = marked.groupBy("fp").agg(F.min("id").alias("least"))
    keyed = nodes.select("fp").mapInArrow(_deal, "key long, rank long, fp long")
    keyed = keyed.repartition(F.col("key")).sortWithinPartitions("key", "rank")
    edges = written(keyed.select("key", "fp").mapInArrow(_search(distance), "a long, b long"))
    groups = connected_components(edges)
    named = nodes.join(groups, nodes.fp == groups.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    where = named.join(least, "root").select(F.col("fp").alias("node_fp"), "component_id")
    return marked.join(where, marked.fp == where.node_fp).select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
