"""Quality rules: a learned decision list over text statistics, emitted as one ordered Spark conditional.

Sequential covering: each round grows a conjunction of thresholds by FOIL gain on two thirds of the labelled rows,
prunes it on the other third, keeps it if it is precise there, and takes the rows it covers out. The rules name what
is rejected; whatever no rule covers is kept.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, map_batches, without

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_digits")
SYMBOLS, SPACES, MARKS = b"#*$%&|<>", b" \t\n\x0b\x0c\r", b"!?"

#: What the rules may test: name -> (numerator, denominator or None).
FEATURES = {
    "words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbol_share": ("n_symbols", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "mark_share": ("n_marks", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
}

#: Bound of the labelled rows that the list is fitted on (those with the smallest XXH64 of their id).
MOST_LABELLED = 20_000


def statistics(text: str | None) -> tuple[int, ...]:
    """COUNTS of one whole text; a null text has none of anything."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return (0,) * len(COUNTS)
    by = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    count = lambda chars: int(by[list(chars)].sum())
    word_chars = len(raw) - int(by[0x80:0xC0].sum()) - count(SPACES)
    lines = Counter(x for x in raw.split(b"\n") if x.strip())
    n_lines = lines.total()
    return (
        len(words), word_chars, count(SYMBOLS), n_lines - len(lines), repeated_words(words),
        n_lines, int(by[65:91].sum()), count(MARKS), int(by[48:58].sum()),
    )


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside windows of `width` words that are found twice or more in the text, first ones included."""
    if len(words) <= width:
        return 0
    ids: dict[bytes, int] = {}
    w = np.array([ids.setdefault(x, len(ids)) for x in words], dtype=np.int64)
    if len(ids) == len(w):
        return 0
    key = w[: len(w) - width + 1]
    for k in range(1, width):
        if k > 1 and len(ids) > 2_000_000:  # a product of three would not fit 63 bits
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(ids) + w[k : len(w) - width + 1 + k]
    _, place, found = np.unique(key, return_inverse=True, return_counts=True)
    again = found[place] > 1
    covered = np.zeros(len(w), dtype=bool)
    for k in range(width):
        covered[k : len(w) - width + 1 + k] |= again
    return int(covered.sum())


def with_statistics(docs: DataFrame, text_col: str = "text", prefix: str = "q_") -> DataFrame:
    """`docs` with the columns `prefix` + COUNTS after its own; rows and their order are unchanged. Columns of `docs`
    that have these names are replaced."""
    docs = without(docs, [prefix + c for c in COUNTS])
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([statistics(x.as_py()) for x in b.column(at)], dtype=np.int64).reshape(-1, len(COUNTS))
            names = [*b.schema.names, *(prefix + c for c in COUNTS)]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c) for c in found.T)], names=names)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{prefix}{c}` long" for c in COUNTS]
    return map_batches(docs, [f"`{c}`" for c in docs.columns], ", ".join(fields), work)


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: pd.DataFrame) -> np.ndarray:
        v = x[self.feature].to_numpy()
        return v > self.threshold if self.above else v <= self.threshold

    def column(self, prefix: str) -> Column:
        top, bottom = FEATURES[self.feature]
        v = F.col(prefix + top).cast("double")
        if bottom:
            v = F.coalesce(F.try_divide(v, F.col(prefix + bottom).cast("double")), F.lit(0.0))
        return v > F.lit(self.threshold) if self.above else v <= F.lit(self.threshold)


@dataclass(frozen=True)
class DecisionList:
    """Ordered conjunctions, each rejecting what it covers; the default keeps."""

    rules: tuple[tuple[Test, ...], ...]

    def rule_number(self, prefix: str = "") -> Column:
        """1, 2, ... for the first rule that covers the row, else 0."""
        out = None
        for n, rule in enumerate(self.rules, 1):
            holds = rule[0].column(prefix)
            for t in rule[1:]:
                holds = holds & t.column(prefix)
            out = F.when(holds, n) if out is None else out.when(holds, n)
        return F.lit(0) if out is None else out.otherwise(0)

    def keeps(self, prefix: str = "") -> Column:
        return self.rule_number(prefix) == 0


def feature_frame(counts: pd.DataFrame, prefix: str = "") -> pd.DataFrame:
    out = {}
    for name, (top, bottom) in FEATURES.items():
        v = counts[prefix + top].to_numpy(dtype=float)
        d = counts[prefix + bottom].to_numpy(dtype=float) if bottom else np.ones(len(v))
        out[name] = np.divide(v, d, out=np.zeros(len(v)), where=d > 0)
    return pd.DataFrame(out)


def _gain(bad: np.ndarray, covered: np.ndarray, now: np.ndarray) -> float:
    p0, n0 = int((bad & now).sum()), int(now.sum())
    p1, n1 = int((bad & covered).sum()), int(covered.sum())
    return p1 * (math.log2(p1 / n1) - math.log2(p0 / n0)) if p1 and p0 else 0.0


def _grow(x: pd.DataFrame, bad: np.ndarray, most_tests: int, cuts: int) -> list[Test]:
    rule: list[Test] = []
    now = np.ones(len(x), dtype=bool)
    while len(rule) < most_tests and (now & ~bad).any():
        best, gain = None, 1e-9
        for f in x.columns:
            v = np.unique(x[f].to_numpy()[now])
            if len(v) < 2:
                continue
            mids = (v[:-1] + v[1:]) / 2
            # thresholds spread over the rows to reject and over all rows
            own = np.unique(np.quantile(x[f].to_numpy()[now & bad], np.linspace(0, 1, cuts)))
            picks = mids[np.unique(np.clip(np.searchsorted(mids, own), 0, len(mids) - 1))]
            picks = np.unique(np.r_[picks, mids[np.unique(np.clip(np.searchsorted(mids, own) - 1, 0, len(mids) - 1))], mids[np.linspace(0, len(mids) - 1, cuts).astype(int)]])
            for t in picks.tolist():
                for above in (True, False):
                    test = Test(f, above, t)
                    if (g := _gain(bad, now & test.holds(x), now)) > gain:
                        best, gain = test, g
        if best is None:
            break
        rule.append(best)
        now &= best.holds(x)
    return rule


def _cover(rule: list[Test], x: pd.DataFrame) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for t in rule:
        out &= t.holds(x)
    return out


def fit(x: pd.DataFrame, bad: np.ndarray, precision: float = 0.97, support: int = 5, most_rules: int = 12, most_tests: int = 4, cuts: int = 24) -> DecisionList:
    """Sequential covering of the rows marked `bad`.

    A rule stays if at least `support` bad rows of the pruning third are covered with at least `precision`. The rows
    of a rule that does not stay are only no longer looked for, so that the search goes on with the others. Row order
    decides the split (every third row prunes). No rows, or one class only: no rule, so everything is kept.
    """
    bad = np.asarray(bad, dtype=bool)
    prune = np.arange(len(x)) % 3 == 2
    gx, gb, px, pb = x[~prune].reset_index(drop=True), bad[~prune], x[prune].reset_index(drop=True), bad[prune]
    rules: list[tuple[Test, ...]] = []
    wanted = gb.copy()  # bad rows that no tried rule covers
    for _ in range(4 * most_rules):
        if len(rules) == most_rules or wanted.sum() < support or not pb.any():
            break
        use = wanted | ~gb
        rule = _grow(gx[use].reset_index(drop=True), gb[use], most_tests, cuts)
        if not rule:
            break
        worth = lambda r: (c := _cover(r, px), ((pb & c).sum() - (~pb & c).sum()) / max(1, c.sum()))[1]
        while len(rule) > 1:
            shorter = max((rule[:k] + rule[k + 1 :] for k in range(len(rule))), key=worth)
            if worth(shorter) < worth(rule):
                break
            rule = shorter
        covered, hit = _cover(rule, gx), _cover(rule, px)
        if not (covered & wanted).any():
            break
        if (pb & hit).sum() < support or (pb & hit).sum() < precision * hit.sum():
            wanted &= ~covered
            continue
        rules.append(tuple(rule))
        gx, gb, wanted = gx[~covered].reset_index(drop=True), gb[~covered], wanted[~covered]
        px, pb = px[~hit].reset_index(drop=True), pb[~hit]
    return DecisionList(tuple(rules))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_LABELLED, **options) -> DecisionList:
    """The list for `docs` from `labels` (id, quality; 0 is to reject).

    Fits on at most `most` labelled ids, those with the smallest XXH64, which is also the bound of what is broadcast
    and sent to the driver (nine counts each). Rows that the base rule rejects take no part, since the list never judges
    them. Null ids and null labels take no part; of repeated labels the lowest counts, of repeated documents each row.
    """
    picked = (
        labels.where(f"{id_col} IS NOT NULL AND quality IS NOT NULL")
        .groupBy(F.col(id_col).alias("q_id")).agg(F.min("quality").alias("q_label"))
        .orderBy(F.xxhash64("q_id"), "q_id").limit(most)
    )
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    mine = src.join(F.broadcast(picked), src.id == picked.q_id).select("id", "q_label", "text")
    rows = with_statistics(mine).where(~base_failed("q_")).drop("text").orderBy(F.xxhash64("id"), "id", *(f"q_{c}" for c in COUNTS)).limit(most).toPandas()
    return fit(feature_frame(rows, "q_"), (rows["q_label"] == 0).to_numpy(), **options)


def base_failed(prefix: str = "") -> Column:
    """Under 50 words, or over half of the words inside repeated three-word windows."""
    n, again = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < 50) | (F.lit(100) * again > F.lit(50) * n)


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: str = "q_") -> DataFrame:
    """`docs` with its statistics, `prefix` + base_failed, rule and kept. One pass over the texts, no shuffle.

    Every row comes back once, repeated rows too. Null and empty texts have zero counts and so fail the base rule.
    Columns of `docs` that have the names of new ones are replaced.
    """
    rules = learn(docs, labels, id_col, text_col)
    out = without(with_statistics(docs, text_col, prefix), [f"{prefix}{c}" for c in ("base_failed", "rule", "kept")])
    return out.withColumns({f"{prefix}base_failed": base_failed(prefix), f"{prefix}rule": rules.rule_number(prefix)}).withColumn(
        f"{prefix}kept", ~F.col(f"{prefix}base_failed") & (F.col(f"{prefix}rule") == 0)
    )
