"""Word-at-a-time BPE ids, equal to those of a `tokenizers` file with word ends: many new words are merged at once.

The library encodes about 60,000 new words a second and core. Words of Latin letters, digits and ASCII marks are
instead lower-cased and split by the same pattern here, and merged together in numpy, a merge per word and step in
the order of the ranks. All other words go to the library, as does everything if the file is of another make.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What the file must say for the fast way: fixed values of the public tokenizer's format.
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
SUFFIX = "</w>"

#: Letters that are in composed form and lower-case one to one (no dotted I, no letters with apostrophes).
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-įĲ-ň]+")
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ň]+|[0-9]|[^a-zß-öø-ň0-9]+")
_LONGEST = 48
_NONE = np.int32(1 << 30)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it is printable Latin-1, else the next from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class _PairTable:
    """Pairs of ids to (rank, merged id), in two hash tables, the second for what collides in the first."""

    def __init__(self, a: np.ndarray, b: np.ndarray, merged: np.ndarray, vocabulary: int):
        self.vocabulary = np.uint64(vocabulary)
        keys = a.astype(np.uint64) * self.vocabulary + b.astype(np.uint64)
        self.rank = np.r_[np.arange(len(keys), dtype=np.int32), _NONE]
        self.merged = np.r_[merged.astype(np.int32), np.int32(0)]
        self.keys = np.r_[keys, np.uint64(0xFFFFFFFFFFFFFFFF)]
        left, self.tables = np.arange(len(keys)), []
        rng = np.random.default_rng(1)
        while len(left):
            odd = np.uint64(int(rng.integers(1 << 62)) * 2 + 1)
            slot = (keys[left] * odd) >> np.uint64(44)
            first = np.unique(slot, return_index=True)[1]
            place = np.full(1 << 20, len(keys), dtype=np.int32)
            place[slot[first]] = left[first]
            self.tables.append((odd, place))
            left = np.delete(left, first)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a.astype(np.uint64) * self.vocabulary + b.astype(np.uint64)
        at = np.full(len(key), len(self.keys) - 1, dtype=np.int32)
        for odd, place in self.tables:
            p = place[(key * odd) >> np.uint64(44)]
            at = np.where(self.keys[p] == key, p, at)
        return self.rank[at], self.merged[at]


class WordBPE:
    def __init__(self, path: str, most_known: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.most_known = most_known
        made = json.loads(Path(path).read_text())
        model, vocab = made["model"], made["model"]["vocab"]
        steps = [x.get("type") for x in (made.get("normalizer") or {}).get("normalizers", [])]
        split = next((x["pattern"].get("Regex") for x in (made.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split"), None)
        self.fast = steps == ["NFC", "Replace", "Lowercase"] and split == PATTERN and model.get("end_of_word_suffix") == SUFFIX and not any(model.get(k) for k in ("dropout", "ignore_merges", "byte_fallback"))
        self.special = [x["content"] for x in made["added_tokens"]]
        if not self.fast:
            return
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int32)
        self.last = np.array([vocab[c + SUFFIX] for c in letters], dtype=np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        a, b = (np.array([vocab[p[k]] for p in pairs]) for k in (0, 1))
        self.pairs = _PairTable(a, b, np.array([vocab[x + y] for x, y in pairs]), len(vocab))

    def merged(self, parts: list[bytes]) -> list[bytes]:
        """Ids of split parts."""
        out: list[bytes] = [b""] * len(parts)
        sizes = np.array([len(p) for p in parts])
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            raw = np.frombuffer(b"".join([parts[k] for k in own.tolist()]), dtype=np.uint8).reshape(-1, size)
            ids = self.inner[raw]
            ids[:, -1] = self.last[raw[:, -1]]
            self._merge(ids, own, out)
        return out

    def _merge(self, ids: np.ndarray, own: np.ndarray, out: list[bytes]) -> None:
        size = ids.shape[1]
        rank = np.full((len(ids), size), _NONE, dtype=np.int32)  # the last column stays without a pair
        into = np.zeros((len(ids), size), dtype=np.int32)
        for k in range(size - 1):
            rank[:, k], into[:, k] = self.pairs.find(ids[:, k], ids[:, k + 1])
        while True:
            at = rank.argmin(axis=1)
            row = np.arange(len(ids))
            done = rank[row, at] == _NONE
            if done.any():
                for k, words in zip(own[done].tolist(), ids[done][:, :size].astype("<u4"), strict=True):
                    out[k] = words.tobytes()
                ids, rank, into, own, at = ids[~done], rank[~done], into[~done], own[~done], at[~done]
                row = np.arange(len(ids))
            if not len(ids):
                return
            ids[row, at] = into[row, at]
            # close the gap: columns after the merged place move left by one
            later = np.arange(size - 1) > at[:, None]
            for m in (ids, rank, into):
                m[:, :-1] = np.where(later, m[:, 1:], m[:, :-1])
            rank[:, size - 1] = _NONE
            size -= 1
            ids, rank, into = (np.ascontiguousarray(m[:, :size]) for m in (ids, rank, into))
            rank[:, size - 1] = _NONE
            has = np.flatnonzero(at < size - 1)
            rank[has, at[has]], into[has, at[has]] = self.pairs.find(ids[has, at[has]], ids[has, at[has] + 1])
            has = np.flatnonzero(at > 0)
            rank[has, at[has] - 1], into[has, at[has] - 1] = self.pairs.find(ids[has, at[has] - 1], ids[has, at[has]])

    def new_words(self, words: list[str]) -> list[bytes]:
        out = [b""] * len(words)
        slow, split, parts = [], [], {}
        plain, findall = _PLAIN.fullmatch, _SPLIT.findall
        for k, w in enumerate(words):
            if self.fast and plain(w) and not ("<" in w and any(s in w for s in self.special)):
                own = findall(w.lower())
                if len(w) <= _LONGEST // 2:
                    split.append((k, [parts.setdefault(p, len(parts)) for p in own]))
                    continue
            slow.append(k)
        if parts:
            ids = self.merged([p.encode() for p in parts])
            for k, own in split:
                out[k] = ids[own[0]] if len(own) == 1 else b"".join([ids[p] for p in own])
        for at in range(0, len(slow), 4096):
            part = slow[at : at + 4096]
            for k, e in zip(part, self.library.encode_batch_fast([words[k] for k in part], add_special_tokens=False), strict=True):
                out[k] = np.array(e.ids, dtype="<u4").tobytes()
        return out

    def ids(self, texts: pa.Array, docs: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For every `docs` texts, their ids one after another, and where each text's begin (and the last ends).

        Nothing joins across white space, so each distinct word of the batch is looked up or encoded once. Null: no ids.
        """
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = lists.flatten().dictionary_encode()
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        bounds = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]
        found = list(map(self.known.get, words))
        new = [k for k, x in enumerate(found) if x is None]
        made = self.new_words([words[k] for k in new])
        for k, x in zip(new, made, strict=True):
            found[k] = x
        self.known.update((words[k], x) for k, x in zip(new[: max(0, self.most_known - len(self.known))], made, strict=False))
        flat = np.frombuffer(b"".join(found), dtype="<u4")
        size = np.fromiter(map(len, found), dtype=np.int32, count=len(found)) // 4
        start = np.cumsum(size, dtype=np.int32) - size
        for at in range(0, len(texts), docs):
            own = bounds[at : at + docs + 1]
            code = codes[own[0] : own[-1]]
            n = size[code]
            ends = np.cumsum(n, dtype=np.int32)
            total = int(ends[-1]) if len(ends) else 0
            yield flat[np.arange(total, dtype=np.int32) + np.repeat(start[code] - (ends - n), n)], np.r_[0, ends][own - own[0]]
