"""Best-fit packing of token pieces, with dual-feasible-function bounds that certify bin counts.

Every partition packs its own pieces by best-fit decreasing and compares its bin count with lower bounds from
dual-feasible functions. Partitions with a gap put the documents of their bins that are not full into an exchange;
certified ones only put in their emptiest bin, since bounds of single partitions are rounded up. What is exchanged is
dealt to fewer partitions and packed again, for as long as that saves bins and the whole is above its own bound.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, map_batches, written
from .wordbpe import WordBPE

CAPACITY = 2048
#: Pieces that one partition packs, and rounds of exchange at most.
PIECES, ROUNDS = 50_000, 6

_TOKENIZERS: dict[str, WordBPE] = {}


def tokenizer(path: str) -> WordBPE:
    """The worker's own copy of the tokenizer at `path`."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordBPE(path)
    return _TOKENIZERS[path]


def _pieces(path: str, capacity: int, end_id: int):
    schema = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.array([end_id], dtype="<u4")
        for b in batches:
            names, at = b.column(0).to_pylist(), 0
            for ids, bounds in tokenizer(path).ids(b.column(1)):
                rows = []
                for row, i, j in zip(names[at:], bounds[:-1].tolist(), bounds[1:].tolist(), strict=False):
                    own = np.r_[ids[i:j], last]
                    for k, s in enumerate(range(0, len(own), capacity)):
                        piece = own[s : s + capacity]
                        rows.append((row, k, s, len(piece), zlib.crc32(piece.astype("<u4"))))
                at += len(bounds) - 1
                yield batch(schema, *(zip(*rows, strict=True) if rows else [[]] * 5))

    return work


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each, offset of each, fill of each bin) by best-fit decreasing; room is found by one bit per residue."""
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    fill: list[int] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = rooms >> n
        if n and fits:
            room = n + (fits & -fits).bit_length() - 1
            k = free[room].pop()
            if not free[room]:
                rooms &= ~(1 << room)
        else:
            k, room = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = k, fill[k]
        fill[k] += n
        if room - n:
            free[room - n].append(k)
            rooms |= 1 << (room - n)
    return bins, offsets, np.array(fill, dtype=np.int64)


def least_bins(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """A lower bound of the bins for counts[n] pieces of length n, by two families of dual-feasible functions."""
    n = np.arange(capacity + 1, dtype=np.int64)
    counts = np.asarray(counts, dtype=np.int64)
    if not counts.any():
        return 0
    number, total = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(counts * n)]
    # pieces over capacity - e count whole, pieces under e not at all
    e = np.arange(capacity // 2 + 1)
    whole = number[capacity + 1] - number[capacity - e + 1]
    middle = total[capacity - e + 1] - total[e]
    best = int((whole - (-middle // capacity)).max())
    # x -> x if (k + 1) x is whole, else floor((k + 1) x) / k, in units of 1 / (k capacity)
    for k in range(1, 21):
        exact = (k + 1) * n % capacity == 0
        weight = np.where(exact, n * k, (k + 1) * n // capacity * capacity)
        best = max(best, -int(-(counts * weight).sum() // (k * capacity)))
    return best


_PACKED = "id long, piece int, start long, length long, crc long, seq long, offset long, fill long, gap boolean"


def _pack(capacity: int, turn: int):
    schema = pa.schema(
        [("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64())]
        + [("seq", pa.int64()), ("offset", pa.int64()), ("fill", pa.int64()), ("gap", pa.bool_())]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = list(batches)
        rows = pa.Table.from_batches(given).cast(pa.schema(list(schema)[:5])) if given else None
        if rows is None or not rows.num_rows:
            return
        rows = rows.sort_by([("length", "descending"), ("id", "ascending"), ("piece", "ascending"), ("crc", "ascending")])
        lengths = rows["length"].to_numpy()
        bins, offsets, fill = best_fit(lengths, capacity)
        bound = least_bins(np.bincount(lengths, minlength=capacity + 1), capacity)
        seq = bins + (turn << 56) + (TaskContext.get().partitionId() << 28)
        gap = np.full(len(bins), len(fill) > bound)
        # the emptiest bin of a certified partition goes into the exchange as well
        if not gap.any() and fill.min() < capacity:
            gap[bins == int(fill.argmin())] = True
        for b in rows.add_column(5, "seq", pa.array(seq)).add_column(6, "offset", pa.array(offsets)).add_column(7, "fill", pa.array(fill[bins])).add_column(8, "gap", pa.array(gap)).cast(schema).to_batches():
            yield b

    return work


def packed(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, pieces: int = PIECES) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty, so its one piece is the end id alone. Null ids and repeated rows are packed like others, each
    row for itself. Documents over `capacity` tokens are cut into pieces of `capacity`; no other is cut. No documents:
    no rows.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    all_pieces = written(map_batches(src, ["id", "text"], "id long, piece int, start long, length long, crc long", _pieces(path, capacity, end_id)))
    full = F.col("length") == capacity
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in all_pieces.groupBy("length").count().collect():  # at most `capacity` rows
        counts[n] = c
    bound, bins = least_bins(counts, capacity), int(counts[capacity])
    # a full piece is a bin of its own
    done = [all_pieces.where(full).select("*", F.monotonically_increasing_id().alias("seq"), F.lit(0).cast("long").alias("offset"))]
    rest, count = all_pieces.where(~full), int(counts[:capacity].sum())
    before = None
    for turn in range(1, ROUNDS + 1):
        if not count:
            break
        parts = max(1, -(-count // pieces))
        new = written(rest.select("id", "piece", "start", "length", "crc").repartition(parts).mapInArrow(_pack(capacity, turn), _PACKED))
        released = F.col("gap") & (F.col("fill") < capacity)
        made, over, over_rows = new.agg(
            F.count_if(F.col("offset") == 0), F.count_if(released & (F.col("offset") == 0)), F.count_if(released)
        ).first()
        if before is not None and made >= before[0]:  # the exchange saved nothing
            done.append(before[1])
            break
        if bins + made <= bound or parts == 1 or over < 2 or turn == ROUNDS:
            done.append(new)
            break
        done.append(new.where(~released))
        bins += made - over
        rest, count, before = new.where(released), over_rows, (over, new.where(released))
    out = None
    for d in done:
        d = d.select(F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), F.col("seq").alias("sequence_id"), "offset")
        out = d if out is None else out.unionByName(d)
    return out
