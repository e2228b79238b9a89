"""SentencePiece encoding and decoding with the n best segmentations.

The lattice of a text falls apart at each word start, since no piece runs over one. In each word, forward Viterbi gives
the best score to every position; these are exact heuristics for an A* search backward from the word's end, which
yields segmentations best first. A whole text's n best follow from the words' lists by a search over the words whose
choice costs least. Known words are looked up.
"""

from __future__ import annotations

import gc
import heapq
import re
from bisect import insort
from collections.abc import Iterator
from itertools import accumulate, chain
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, map_batches

SPACE = "▁"
MOST_KNOWN = 800_000
_WORD = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


class Pieces:
    """A SentencePiece model file: pieces with additive scores, byte pieces for characters it lacks, a space prefix."""

    def __init__(self, path: str, n: int = 3):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte = {}
        self.score: dict[str, tuple[float, int]] = {}
        for i, p in enumerate(self.text):
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.score[p] = (float(sp.get_score(i)), i)
        self.raw = {i: bytes([b]) for b, i in self.byte.items()}
        self.unknown = sp.unk_id()
        self.single = frozenset(p for p in self.score if len(p) == 1)
        #: finds the pieces of a word by their ends
        self.automaton = ahocorasick.Automaton()
        for p, (s, i) in self.score.items():
            self.automaton.add_word(p, (len(p), s, (i,)))
        self.automaton.make_automaton()
        # a character of no piece: below all pieces but those that the model marks as never to be merged into
        self.lost = min((s for s, _ in self.score.values() if s > -1e8), default=0.0) - 10.0
        self.n = n
        self.known: dict[str, tuple[tuple[int, ...], float, float]] = {}
        bad = [p for p in self.score if SPACE in p.lstrip(SPACE) or ("\n" in p and len(p) > 1)]
        if bad:
            raise ValueError(f"pieces run over word starts: {bad[:5]}")

    def lattice(self, word: str) -> tuple[list[list[tuple[int, float, tuple[int, ...]]]], list[float]]:
        """For each end, the edges (start, score, ids) that reach it; and the best score up to each end."""
        edges, ahead = self._costed(word)
        return [[e[1:] for e in x] for x in edges], ahead

    def _costed(self, word: str) -> tuple[list[list[tuple[float, int, float, tuple[int, ...]]]], list[float]]:
        """For each end, the edges (cost, start, score, ids) that reach it and, by forward Viterbi, the best score up to
        it; an edge's cost is the negative best score up to its end through it."""
        size = len(word)
        edges: list[list] = [[] for _ in range(size + 1)]
        ahead = [0.0] + [float("-inf")] * size
        found = self.automaton.iter(word)
        if not self.single.issuperset(word):
            # characters without a piece: an edge of their own, in the order of the ends
            lost = []
            for k, c in enumerate(word):
                if c not in self.single:
                    ids = tuple(self.byte.get(x, self.unknown) for x in c.encode("utf-8", "surrogatepass"))
                    lost.append((k, (1, self.lost, ids if self.byte else (self.unknown,))))
            found = sorted([*found, *lost], key=itemgetter(0))
        for last, (length, s, own) in found:
            end = last + 1
            start = end - length
            so_far = ahead[start] + s
            edges[end].append((-so_far, start, s, own))
            if so_far > ahead[end]:
                ahead[end] = so_far
        return edges, ahead

    def best(self, word: str, n: int | None = None) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations, best first."""
        n, size = n or self.n, len(word)
        edges, ahead = self._costed(word)
        # heuristics are exact: each open path ends in a segmentation of its own of just that score. So the cheapest one
        # goes straight on to the start by its cheapest edges (ties: the smallest position), and of the edges it leaves
        # aside no more stay open than there are segmentations still asked for
        open_, out, turn = [(-ahead[size], size, 0, 0.0, None)], [], 0
        while open_:
            _, at, _, done, path = open_.pop(0)
            room = n - len(out) - 1
            while at:
                here = edges[at]
                if len(here) > 1:
                    here.sort()
                    for through, a, t, other in here[1 : room + 1]:
                        cost = through - done
                        if len(open_) >= room:
                            if cost > open_[-1][0]:
                                break
                            del open_[room:]
                        turn += 1
                        insort(open_, (cost, a, -turn, t + done, (other, path)))
                _, at, s, own = here[0]
                done += s
                path = (own, path)
            ids: list[int] = []
            while path is not None:
                ids += path[0]
                path = path[1]
            out.append((done, tuple(ids)))
            if not room:
                break
            del open_[room:]
        return out

    def words(self, text: str) -> list[str]:
        return _WORD.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def first(self, word: str) -> tuple[tuple[int, ...], float, float]:
        """Ids and score of the best segmentation, and what the second costs more (infinite if there is none): the same
        search, cut off when its first path ends. The cheapest open path's cost is then that of the second."""
        edges, _ = self._costed(word)
        at, done, gap, path = len(word), 0.0, float("inf"), []
        while at:
            here = edges[at]
            if len(here) > 1:
                here.sort()
                if (more := here[1][0] - here[0][0]) < gap:
                    gap = more
            _, at, s, own = here[0]
            done += s
            path.append(own)
        path.reverse()
        return tuple(chain.from_iterable(path)), done, gap

    def _of(self, word: str) -> tuple[tuple[int, ...], float, float]:
        got = self.first(word)
        if len(self.known) < MOST_KNOWN:
            self.known[word] = got
        return got

    def encode(self, text: str | None) -> tuple[list[int], list[float], list[list[int]]]:
        """Ids of the best segmentation, the scores of the n best, and the ids of the others of these, best first. Null
        and empty texts have one, empty, score 0."""
        get, of = self.known.get, self._of
        words = self.words(text or "")
        lists = [get(w) or of(w) for w in words]
        ids = list(chain.from_iterable([x[0] for x in lists]))
        best = sum([x[1] for x in lists])
        # a text's n best change at most n - 1 words, and only those whose change costs least
        gaps = [x[2] for x in lists]
        options: list[tuple[float, tuple]] = [(0.0, ())]
        for _ in range(min(self.n - 1, len(gaps))):
            least = min(gaps)
            if least == float("inf"):
                break
            k = gaps.index(least)
            gaps[k] = float("inf")
            (first, _), *rest = self.best(words[k])
            more = [(c + first - s, (*changed, (k, own))) for c, changed in options for s, own in rest]
            options = heapq.nsmallest(self.n, [*options, *more], key=itemgetter(0))
        starts = [0, *accumulate(len(x[0]) for x in lists)] if len(options) > 1 else []
        others = []
        for _, changed in options[1:]:
            own, at = [], 0
            for k, new in sorted(changed):
                own += ids[at : starts[k]]
                own += new
                at = starts[k + 1]
            others.append(own + ids[at:])
        return ids, [best - c for c, _ in options], others

    def decode(self, ids: list[int]) -> str:
        """The text: byte pieces joined and decoded, spaces back in place, the first one dropped."""
        raw, get, text = [], self.raw.get, self.text
        for i in ids:
            b = get(i)
            raw.append(b if b is not None else text[i].encode())
        out = b"".join(raw).decode("utf-8", "replace").replace(SPACE, " ")
        return out[1:] if out.startswith(" ") else out


_MODELS: dict[tuple[str, int], Pieces] = {}


def model(path: str, n: int) -> Pieces:
    if (path, n) not in _MODELS:
        _MODELS[path, n] = Pieces(path, n)
    return _MODELS[path, n]


def encoded(docs: DataFrame, path: str, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, scores, restored, others) of every row: best segmentation, scores of the n best, whether decoding gives
    the text back (U+2581 in a text comes back as a space), and the others of the n best segmentations, whole. Null texts
    are empty. Every row comes back once."""
    schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32())), ("scores", pa.list_(pa.float64())), ("restored", pa.bool_()), ("others", pa.list_(pa.list_(pa.int32())))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path, n)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, rows = b.slice(at, 256), []
                # nothing here makes cycles, and the known words are many to walk over again and again
                gc.disable()
                try:
                    for row, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                        ids, scores, others = m.encode(t)
                        rows.append((row, np.array(ids, dtype=np.int32), scores, m.decode(ids) == (t or ""), [np.array(o, dtype=np.int32) for o in others]))
                finally:
                    gc.enable()
                yield batch(schema, *(zip(*rows, strict=True) if rows else [[]] * 5))

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_batches(src, ["id", "text"], "id long, ids array<int>, scores array<double>, restored boolean, others array<array<int>>", work).withColumnRenamed("id", id_col)
