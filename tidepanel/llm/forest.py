"""Approximate nearest neighbours: a hash-prefix forest per shard.

Rows are dealt by hash to shards of a bounded size (of smaller ones, if there would be fewer than cores). A shard hashes its vectors to a 32-bit string per tree (signs of
random projections) and keeps each tree as a sorted array. A query descends each tree to its longest prefix match,
then all trees ascend together, one bit at a time, until enough candidates are met; their inner products are exact.
How many are enough is measured in each shard: a bounded sample of its own rows is searched by brute force, and the
smallest budget with the wanted recall is taken, all rows if no smaller one will do.
Queries stream through every shard in blocks; the best of all shards are merged per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batch, map_batches, written

SHARD_ROWS, LEAST_ROWS, TREES, BITS = 60_000, 4_096, 12, 32
#: Recall to reach on the sample, rows of the sample, and budgets (shares of a shard's rows, over all trees) to choose from.
RECALL, SAMPLE = 0.97, 48
BUDGETS = (0.01, 0.03, 0.1, 0.3, 0.6, 1.0, 2.0, 4.0)


class Forest:
    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, trees: int = TREES, seed: int = 17):
        self.ids, self.x, self.k = ids, x, k
        self.planes = np.random.default_rng(seed).standard_normal((x.shape[1], trees * BITS))
        code = self._codes(x)
        self.order = [np.argsort(code[:, t], kind="stable") for t in range(trees)]
        self.code = [code[o, t] for t, o in enumerate(self.order)]
        self.budget = self._measured(seed)

    def _codes(self, x: np.ndarray) -> np.ndarray:
        out = []
        for a in range(0, len(x), 8192):
            bits = (x[a : a + 8192] @ self.planes > 0).reshape(-1, self.planes.shape[1] // BITS, BITS)
            out.append(np.packbits(bits, axis=2).view(">u4")[:, :, 0].astype(np.int64))
        return np.concatenate(out) if out else np.zeros((0, self.planes.shape[1] // BITS), dtype=np.int64)

    def ranges(self, q: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, tree) -> [from, to) at the deepest level where all trees together hold the budget."""
        code, n, trees = self._codes(q), len(q), len(self.order)
        low, high = np.zeros((n, trees), dtype=np.int64), np.full((n, trees), len(self.ids), dtype=np.int64)
        open_ = np.ones(n, dtype=bool)
        for depth in range(BITS, 0, -1):  # ascend from the longest prefix
            at = np.flatnonzero(open_)
            if not len(at):
                break
            mask = (1 << (BITS - depth)) - 1
            a = np.stack([np.searchsorted(self.code[t], code[at, t] & ~mask) for t in range(trees)], axis=1)
            b = np.stack([np.searchsorted(self.code[t], code[at, t] | mask, side="right") for t in range(trees)], axis=1)
            enough = (b - a).sum(axis=1) >= max(self.k + 1, budget * len(self.ids))
            low[at[enough]], high[at[enough]] = a[enough], b[enough]
            open_[at[enough]] = False
        return low, high

    def search(self, qids: np.ndarray, q: np.ndarray, budget: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places, scores) of the k best candidates of each query, ties to smaller ids."""
        low, high = self.ranges(q, budget)
        out = []
        for i in range(len(q)):
            met = np.zeros(len(self.ids), dtype=bool)
            for t, o in enumerate(self.order):
                met[o[low[i, t] : high[i, t]]] = True
            met[self.ids == qids[i]] = False
            at = np.flatnonzero(met)
            s = (self.x if len(at) > 0.5 * len(met) else self.x[at]) @ q[i]
            s = s[at] if len(s) != len(at) else s
            if len(at) > self.k:
                # a product of many rows may end in other last bits for equal rows, so all that is near the last place stays
                least = np.partition(s, len(s) - self.k)[len(s) - self.k]
                keep = s >= least - 1e-9 * (1 + abs(least))
                at = at[keep]
            s = (self.x[at] * q[i]).sum(axis=1)  # row by row, the same for equal rows in any shard
            best = np.lexsort((self.ids[at], -s))[: self.k]
            out.append((at[best], s[best]))
        return out

    def _measured(self, seed: int) -> float:
        n = len(self.ids)
        pick = np.sort(np.random.default_rng(seed + 1).permutation(n)[:SAMPLE])
        want = [set(at.tolist()) for at, _ in self.search(self.ids[pick], self.x[pick], float("inf"))]
        for budget in BUDGETS:
            got = self.search(self.ids[pick], self.x[pick], budget)
            hit = sum(len(w & set(at.tolist())) for w, (at, _) in zip(want, got, strict=True))
            if hit >= RECALL * max(1, sum(map(len, want))):
                return budget
        return float("inf")


def valid(v: Column) -> Column:
    """Vectors that take part: not null or empty, no null, NaN or infinite component, not all zero."""
    odd = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    return F.coalesce(v.isNotNull() & ~F.exists(v, odd) & F.exists(v, lambda e: e != 0), F.lit(False))


def _search(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, rows, forest = None, [], [], None
        for b in batches:
            part, kind, vid = (b.column(c).to_numpy() for c in range(3))
            cut = np.r_[0, np.flatnonzero((part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1, len(part)]
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if s == e:
                    continue
                x = np.array(b.column(3).slice(s, e - s).to_pylist(), dtype=np.float64)
                if part[s] != shard:
                    shard, ids, rows, forest = part[s], [], [], None
                if kind[s] == 0:
                    ids.append(vid[s:e])
                    rows.append(x)
                    continue
                if forest is None and ids:
                    forest = Forest(np.concatenate(ids), np.concatenate(rows), k)
                if forest is None:
                    continue
                for a in range(0, e - s, 1024):
                    q = vid[s + a : min(e, s + a + 1024)]
                    found = forest.search(q, x[a : a + 1024], forest.budget)
                    yield batch(schema, np.repeat(q, [len(f[0]) for f in found]), np.concatenate([forest.ids[f[0]] for f in found]), np.concatenate([f[1] for f in found]))

    return work


def neighbours(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found by inner product of each row whose id `every` divides.

    Null ids and invalid vectors (see `valid`) take no part. Rows that share an id count once, with the smallest
    vector. Only vectors of one dimension are compared. A query without any candidate has no rows.
    """
    rows = vectors.where(F.col(id_col).isNotNull() & valid(F.col(vector_col)))
    rows = written(rows.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(F.col(vector_col).cast("array<double>")).alias("v")))
    n = rows.count()
    shards = max(1, -(-n // shard_rows), min(vectors.sparkSession.sparkContext.defaultParallelism, n // LEAST_ROWS))
    rows = rows.withColumn("dim", F.size("v"))
    index = rows.select((F.pmod(F.xxhash64("id"), F.lit(shards)) + F.col("dim") * shards).alias("shard"), F.lit(0).alias("kind"), "id", "v")
    asked = rows.where(F.col("id") % every == 0).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"), "dim", "id", "v")
    asked = asked.select((F.col("s") + F.col("dim") * shards).cast("long").alias("shard"), F.lit(1).alias("kind"), "id", "v")
    both = index.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "kind", "id")
    found = map_batches(both, ["shard", "kind", "id", "v"], "query_id long, vec_id long, score double", _search(k))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return written(found).select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
