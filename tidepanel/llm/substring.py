"""Substring dedup: words that repeat a passage of an earlier document are found with FM-indexes and removed.

1. Each document is cut into segments: the longest runs of 50-word windows that share their minimizer (the smallest
   hash of any 8 consecutive words in the window). Equal windows have equal minimizers, so they meet in one shard.
2. Minimizers found in one document only are dropped, by a minimum and a maximum per minimizer.
3. Equal segments collapse to the first document that has them; its text is fetched once per distinct segment.
4. Shards: runs of whole minimizers, closed at a bounded number of words. Each builds an FM-index (wavelet matrix) over
   its segments and streams them through backward search; matching statistics against segments of earlier documents
   give the intervals of at least 50 words.
5. A minimizer with very many distinct segments (a passage inside thousands of different texts) would fill a shard
   alone. Its segments are first cut down to the windows whose 128-bit hash more than one document has, counted with
   pre-aggregation; what is left of them collapses again.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, map_batches, without, written
from .fmindex import FMIndex

WINDOW, GRAM = 50, 8
#: Words in a shard's index, and distinct segments of one minimizer beyond which its windows are counted first.
SHARD_WORDS, HOT_SEGMENTS = 300_000, 500
#: What Python holds at once of what it returns, in bytes of text or rows, and rows of a batch that are read at once.
BATCH_OUT, ROWS_OUT, ROWS_IN = 4 << 20, 50_000, 1000
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def segments(words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, first word, end) of the runs of windows with one minimizer; none for under `window` words."""
    n = len(words) - window + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    w = _mixed(np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words)) + _MIX[0])
    h = w[: len(w) - gram + 1].copy()
    for k in range(1, gram):
        h = h * _MIX[0] + w[k : len(w) - gram + 1 + k]
    h = _mixed(h)
    least, span = h, 1
    while span * 2 <= window - gram + 1:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    least = np.minimum(least[:n], least[window - gram + 1 - span :][:n])
    cut = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    return least[cut].astype(np.int64), cut, np.r_[cut[1:], n] + window - 1


def _spans(words: list[bytes]) -> tuple[bytes, np.ndarray]:
    line = b" ".join(words)
    return line, np.r_[0, np.cumsum([len(x) + 1 for x in words])]


def _halves(raw: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(raw)
    return (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)


def _cut(window: int):
    schema = pa.schema([("key", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("row", pa.int64()), ("mark", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [[] for _ in schema]
            for row, mark, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                words = text.as_py().encode("utf-8", "surrogatepass").split()
                key, start, end = segments(words, window)
                if not len(key):
                    continue
                line, at = _spans(words)
                both = [_halves(line[i:j]) for i, j in zip(at[start].tolist(), (at[end] - 1).tolist(), strict=True)]
                for col, x in zip(cols, (key, [x[0] for x in both], [x[1] for x in both], np.full(len(key), row), np.full(len(key), mark), start, end), strict=True):
                    col.append(np.asarray(x, dtype=np.int64))
            if cols[0]:
                yield batch(schema, *(np.concatenate(c).astype(f.type.to_pandas_dtype()) for c, f in zip(cols, schema, strict=True)))

    return work


def _texts(window: int):
    """The texts of the asked segments of a document."""
    schema = pa.schema([("key", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("text", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for row, text, asked in zip(*(b.column(k) for k in (0, 2, 3)), strict=True):
                row, (line, at) = row.as_py(), _spans(text.as_py().encode("utf-8", "surrogatepass").split())
                for s in asked.as_py():
                    raw = line[at[s["start"]] : at[s["end"]] - 1]
                    rows.append((s["key"], s["h1"], s["h2"], row, s["start"], raw.decode("utf-8", "surrogatepass")))
                    size += len(raw)
                    if size >= BATCH_OUT:
                        yield batch(schema, *zip(*rows, strict=True))
                        rows, size = [], 0
            yield batch(schema, *(zip(*rows, strict=True) if rows else [[]] * len(schema)))

    return work


def _windows(window: int):
    """The 128-bit hashes of all windows inside the asked segments of a document."""
    schema = pa.schema([("key", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("row", pa.int64()), ("mark", pa.int64()), ("start", pa.int32())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for row, mark, text, asked in zip(*b.columns, strict=True):
                row, mark, (line, at) = row.as_py(), mark.as_py(), _spans(text.as_py().encode("utf-8", "surrogatepass").split())
                for s in asked.as_py():
                    for i in range(s["start"], s["end"] - window + 1):
                        rows.append((s["key"], *_halves(line[at[i] : at[i + window] - 1]), row, mark, i))
                    if len(rows) >= ROWS_OUT:
                        yield batch(schema, *zip(*rows, strict=True))
                        rows = []
            yield batch(schema, *(zip(*rows, strict=True) if rows else [[]] * len(schema)))

    return work


def covered(lengths: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Unions of [i, i + window) over the places with a match of at least `window`."""
    at = np.flatnonzero(lengths >= window)
    if not len(at):
        return []
    cut = np.flatnonzero(np.r_[True, np.diff(at) > window])
    return list(zip(at[cut].tolist(), (at[np.r_[cut[1:], len(at)] - 1] + window).tolist(), strict=True))


def _rows(b: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch, of which few are Python objects at once."""
    for k in range(0, b.num_rows, ROWS_IN):
        yield from zip(*(c.to_pylist() for c in b.slice(k, ROWS_IN).columns), strict=True)


def _shard(window: int, most_words: int):
    schema = pa.schema([("key", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("parts", pa.list_(pa.int32()))])

    def search(rows: list[tuple]):
        ids: dict[bytes, int] = {}
        pieces = [[ids.setdefault(w, len(ids) + 1) for w in r[4].encode("utf-8", "surrogatepass").split()] for r in rows]
        words = np.concatenate([np.array([*p, 0], dtype=np.int64) for p in pieces])
        ends = np.cumsum([len(p) + 1 for p in pieces])
        starts = np.r_[0, ends[:-1]]
        owners = np.unique(np.array([r[3] for r in rows], dtype=np.int64), return_inverse=True)[1].astype(np.int32)
        lengths = FMIndex(words, starts, owners).earlier(words, starts, ends - 1, owners)
        parts = [[x for pair in covered(lengths[a:b], window) for x in pair] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        return batch(schema, *([r[k] for r in rows] for k in range(3)), parts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in batches:
            for r in _rows(b):
                if size >= most_words and r[0] != rows[-1][0]:
                    yield search(rows)
                    rows, size = [], 0
                rows.append(r)
                size += r[4].count(" ") + 2
        if rows:
            yield search(rows)

    return work


def repeats(docs: DataFrame, row_col: str, text_col: str, window: int = WINDOW, hot: int = HOT_SEGMENTS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(row, mark, parts): for each row with repeats, the word intervals [from, to, ...] that are also in a smaller row.

    `row_col` holds longs; mark is the XXH64 of the text, which tells rows with one id apart. Null rows and texts take
    no part.
    """
    src = docs.where(F.col(row_col).isNotNull() & F.col(text_col).isNotNull())
    src = src.select(F.col(row_col).cast("long").alias("row"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    cut = written(map_batches(src, ["row", "mark", "text"], "key long, h1 long, h2 long, row long, mark long, start int, end int", _cut(window)))
    shared = cut.groupBy("key").agg(F.min("row").alias("lo"), F.max("row").alias("hi")).where("lo < hi").select("key")
    found = written(cut.join(shared, "key", "left_semi"))
    distinct = found.groupBy("key", "h1", "h2").agg(F.min("row").alias("first"))
    crowded = written(distinct.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key"))
    if crowded.head(1):
        found = written(_trimmed(src, found, crowded, window))
        distinct = found.groupBy("key", "h1", "h2").agg(F.min("row").alias("first"))
    # a minimizer with one distinct segment has nothing to search: its windows are new in the first document
    several = distinct.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    # one place of each distinct segment in its first document
    place = found.join(distinct.join(several, "key", "left_semi"), ["key", "h1", "h2"]).where("row = first").groupBy("key", "h1", "h2", "row")
    place = place.agg(F.min(F.struct("mark", "start", "end")).alias("at")).select("key", "h1", "h2", "row", "at.*")
    asked = place.groupBy("row", "mark").agg(F.collect_list(F.struct("key", "h1", "h2", "start", "end")).alias("asked"))
    texts = map_batches(src.join(asked, ["row", "mark"]), ["row", "mark", "text", "asked"], "key long, h1 long, h2 long, row long, start int, text string", _texts(window))
    texts = texts.dropDuplicates(["key", "h1", "h2"]).repartition(F.col("key")).sortWithinPartitions("key", "row", "start")
    parts = written(texts.select("key", "h1", "h2", "row", "text").mapInArrow(_shard(window, shard_words), "key long, h1 long, h2 long, parts array<int>"))
    known = distinct.join(parts, ["key", "h1", "h2"], "left")
    hits = found.join(known, ["key", "h1", "h2"]).select(
        "row", "mark",
        F.when(F.col("row") > F.col("first"), F.array(F.col("start"), F.col("end"))).otherwise(F.transform("parts", lambda x: x + F.col("start"))).alias("part"),
    ).where(F.size("part") > 0)
    return hits.groupBy("row", "mark").agg(F.flatten(F.collect_list("part")).alias("parts"))


def _trimmed(src: DataFrame, found: DataFrame, crowded: DataFrame, window: int) -> DataFrame:
    """Segments of crowded minimizers cut down to runs of windows that more than one row has; the others as they are."""
    mine = found.join(crowded, "key", "left_semi")
    asked = mine.groupBy("row", "mark").agg(F.collect_list(F.struct("key", "h1", "h2", "start", "end")).alias("asked"))
    each = written(map_batches(src.join(asked, ["row", "mark"]), ["row", "mark", "text", "asked"], "key long, h1 long, h2 long, row long, mark long, start int", _windows(window)))
    shared = each.groupBy("key", "h1", "h2").agg(F.min("row").alias("lo"), F.max("row").alias("hi")).where("lo < hi").select("key", "h1", "h2")
    one = each.join(shared, ["key", "h1", "h2"], "left_semi").select("key", "h1", "h2", "row", "mark", "start", (F.col("start") + window).cast("int").alias("end"))
    return found.join(crowded, "key", "left_anti").unionByName(one)


def _kept(at: int, parts_at: int, prefix: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, removed, kept = [], [], []
            for text, parts in zip(b.column(at), b.column(parts_at), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                gone = np.zeros(len(words), dtype=bool)
                p = parts.as_py() or []
                for i, j in zip(p[::2], p[1::2], strict=True):
                    gone[i:j] = True
                counts.append(len(words))
                removed.append(int(gone.sum()))
                kept.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if gone.any() else b" ".join(words))
            sha = [hashlib.sha256(k).hexdigest() for k in kept]
            rest = [c for k, c in enumerate(b.columns) if k != parts_at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array([k.decode("utf-8", "surrogatepass") for k in kept], pa.string()), pa.array(sha, pa.string())]
                , names=[*(n for k, n in enumerate(b.schema.names) if k != parts_at), *(prefix + c for c in ("n_words", "n_removed", "kept", "sha256"))])

    return work


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, prefix: str = "sd_", **options) -> DataFrame:
    """`docs` with sd_n_words, sd_n_removed, sd_kept (the words left, joined by one space) and sd_sha256 of that.

    A word goes if a `window`-word window covers it whose words also start in a row with a smaller id. Windows are
    judged on the input. Rows that share an id don't remove each other's words. Null ids keep all words; null or empty
    texts have none. Every row comes back once, with its other columns; columns that have the new ones' names, or begin
    like them with row, mark or parts, are replaced.
    """
    docs = without(docs, [prefix + c for c in ("n_words", "n_removed", "kept", "sha256", "row", "mark", "parts")])
    parts = repeats(docs, id_col, text_col, window, **options)
    row, mark = f"{prefix}row", f"{prefix}mark"
    parts = parts.select(F.col("row").alias(row), F.col("mark").alias(mark), F.col("parts").alias(f"{prefix}parts"))
    mine = (docs[id_col].cast("long") == parts[row]) & (F.xxhash64(docs[text_col]) == parts[mark])
    whole = docs.join(parts, mine, "left").drop(row, mark)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{prefix}{c}` {kind}" for c, kind in (("n_words", "long"), ("n_removed", "long"), ("kept", "string"), ("sha256", "string"))]
    return map_batches(whole, [f"`{c}`" for c in whole.columns], ", ".join(fields), _kept(docs.columns.index(text_col), len(docs.columns), prefix))
