"""Plain versions that the operators are held against."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def fingerprint(text):
    w = words(lower(text))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids, linked):
    """id -> smallest id reachable over the pairs (i, j) of places."""
    up = list(range(len(ids)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in linked:
        up[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        r = find(i)
        least[r] = x if least.get(r) is None else least[r] if x is None else min(x, least[r])
    return [least[find(i)] for i in range(len(ids))]


def simhash(rows, distance=2):
    fps = [fingerprint(t) for _, t in rows]
    x = np.array(fps, dtype=np.uint64)
    pairs = np.argwhere(np.bitwise_count(x[:, None] ^ x[None, :]) <= distance) if len(x) else []
    return Counter((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, classes([i for i, _ in rows], pairs)))


def quality(text):
    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def substring(rows, window=50):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            if i is not None:
                g = tuple(w[k : k + window])
                first[g] = min(i, first.get(g, i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def pieces(rows, tokenizer, capacity=2048):
    out = []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k, s in enumerate(range(0, len(ids), capacity)):
            own = ids[s : s + capacity]
            out.append((i, k, s, len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes())))
    return Counter(out)
