"""Main text of web pages by wrappers: union-free patterns inferred from pages of the same host.

A page is read as a stream of tags and texts and nested leniently. Two pages' streams are aligned element by element;
what only one has becomes optional, runs of like elements become one repeated group, and texts that differ become
slots; a sequence of elements that comes again, such as (dt dd), is a repeated group as well. All pages of a host are
aligned into its wrapper, first those of a partition one after another, then what the partitions have.

The wrapper says what to keep: the node below which most of the varying, unlinked text is, and in it the slots. What
is the same on all pages that have it, and on FIXED pages at least, is the host's own matter and goes. Tags, classes and
roles only help: what they mark as other matter doesn't count as text, and the way down ends at a marked article. Every
page of the host is walked along the wrapper; an element that the wrapper hasn't seen is judged by its own marks, so no
page is dropped.
"""

from __future__ import annotations

import html as _html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, map_batches, written

#: Salts of the join by host, and hosts whose wrappers a partition holds at once.
SALTS, OPEN = 32, 256
#: Pages that a block must be the same on to be the host's, elements that a repeated group has at most, and the depth
#: below which elements become neighbours (their text stays).
FIXED, GROUP, DEPTH = 4, 4, 150

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template|textarea|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S | re.I)
_MARK = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
_OTHER = frozenset("nav footer aside form head title button select dialog menu".split())
_CLOSES_P = _BLOCK - {"body", "html"}
#: Words in classes, ids and roles that mark matter outside an article.
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies disclaimer disqus footer masthead menu nav navbar navigation newsletter "
    "notice notification pager pagination popup promo promotion related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "marks", "parts")

    def __init__(self, tag: str, marks: str = ""):
        self.tag, self.marks, self.parts = tag, marks, []


def parsed(page: str) -> Node:
    """The page as nested elements; parts are elements and texts. Unclosed elements end with their parents."""
    root = Node("")
    stack = [root]
    for m in _TOKEN.finditer(page):
        tag = m[3]
        if tag is None:
            if not m[0].startswith("<") or m[0] == "<":
                stack[-1].parts.append(m[0])
            continue
        tag = tag.lower()
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in _CLOSES_P:  # an open paragraph ends, with what is open inside it
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in _BLOCK:
                    break
        if tag in ("li", "tr", "td", "th", "dd", "dt", "option") and stack[-1].tag == tag:
            stack.pop()
        words = sorted({w for a in _MARK.finditer(m[4] or "") for w in re.findall(r"[a-z]+", (a[2] or a[3] or a[4] or "").lower())}) if m[4] else []
        node = Node(tag, " ".join(words))
        stack[-1].parts.append(node)
        if tag not in _VOID and not (m[4] or "").endswith("/") and len(stack) < DEPTH:
            stack.append(node)
    return root


# --- wrappers: [tag, marks, optional, repeated, text (None: none, str: constant, 0: slot), size, linked, children, pages] ---

TAG, MARKS, OPTIONAL, REPEATED, TEXT, SIZE, LINKED, CHILDREN, PAGES = range(9)


def pattern(node: Node, linked: bool = False) -> list:
    """A page's own wrapper: neighbours that come again are folded into one repeated group."""
    text = _SPACE.sub(" ", "".join(p for p in node.parts if isinstance(p, str))).strip()
    linked = linked or node.tag == "a"
    children = folded([pattern(child, linked) for child in node.parts if isinstance(child, Node)])
    return [node.tag, node.marks, False, False, text or None, len(text), len(text) if linked else 0, children, 1]


def folded(parts: list[list]) -> list[list]:
    """Each run of like sequences of up to GROUP elements as one, marked as repeated. A run's pages count once."""
    out: list[list] = []
    for p in parts:
        out.append(p)
        for k in range(1, GROUP + 1):
            if len(out) >= 2 * k and all(out[-k + i][:2] == out[-2 * k + i][:2] for i in range(k)):
                for i in range(k):
                    a, b = out[-2 * k + i], out[-k + i]
                    both = aligned(a, b)
                    both[REPEATED], both[PAGES] = True, max(a[PAGES], b[PAGES])
                    out[-2 * k + i] = both
                del out[-k:]
                break
    return out


def aligned(a: list, b: list) -> list:
    """The least wrapper of both: unequal texts become a slot, children without a match optional."""
    text = a[TEXT] if a[TEXT] == b[TEXT] else 0
    x, y, n = a[CHILDREN], b[CHILDREN], 0
    out = []
    while n < min(len(x), len(y)) and x[n][:2] == y[n][:2]:  # most pages of a host begin alike
        out.append(aligned(x[n], y[n]))
        n += 1
    x, y = x[n:], y[n:]
    # longest common subsequence by tag and marks
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i][:2] == y[j][:2] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i][:2] == y[j][:2]:
            out.append(aligned(x[i], y[j]))
            i, j = i + 1, j + 1
            continue
        from_x = j == len(y) or (i < len(x) and best[i + 1][j] >= best[i][j + 1])
        one = [*(x[i] if from_x else y[j])]
        i, j = (i + 1, j) if from_x else (i, j + 1)
        one[OPTIONAL] = True
        out.append(one)
    if i and j or len(out) > n:
        out = folded(out)  # stays free of unions and of ambiguous neighbours
    return [a[TAG], a[MARKS], a[OPTIONAL] or b[OPTIONAL], a[REPEATED] or b[REPEATED], text, a[SIZE] + b[SIZE], a[LINKED] + b[LINKED], out, a[PAGES] + b[PAGES]]


def infer(pages: list[str]) -> list:
    """The wrapper of some pages of one host, aligned one after another."""
    out = None
    for page in pages:
        p = pattern(parsed(page))
        out = p if out is None else aligned(out, p)
    return out if out is not None else pattern(Node(""))


def _is_other(tag: str, marks: str, inside: bool) -> bool:
    """Whether an element's own marks put it outside an article. Headers inside one hold its title."""
    return tag in _OTHER or (tag == "header" and not inside) or bool(marks and _WORDS.intersection(marks.split()))


def _is_main(tag: str, marks: str) -> bool:
    return tag in ("article", "main") or "articlebody" in marks.split()


def _mass(w: list) -> tuple[int, int]:
    """Varying text and linked text of a wrapper node, without what its marks put aside."""
    if _is_other(w[TAG], w[MARKS], True):
        return 0, 0
    own = [(0, 0) if isinstance(w[TEXT], str) or w[TEXT] is None else (w[SIZE], w[LINKED]), *(_mass(c) for c in w[CHILDREN])]
    return sum(o[0] for o in own), sum(o[1] for o in own)


def chosen(w: list) -> list[int]:
    """The path to what is kept: down to the node with most of the varying unlinked text, or to a marked article on the way."""
    path, node = [], w
    total = _mass(w)[0]
    while not (path and _is_main(node[TAG], node[MARKS])):
        masses = [_mass(c) for c in node[CHILDREN]]
        k = max(range(len(masses)), key=lambda i: (masses[i][0] - 2 * masses[i][1], _is_main(*node[CHILDREN][i][:2])), default=None)
        if k is None or masses[k][0] < 0.7 * total or masses[k][0] == 0 or node[CHILDREN][k][REPEATED]:
            break
        path.append(k)
        node = node[CHILDREN][k]
    return path


def _same(w: list) -> bool:
    """Whether all text below is the same on each page that has it."""
    return w[TEXT] != 0 and all(_same(c) for c in w[CHILDREN])


def fixed(w: list) -> bool:
    """Whether a block is the host's own matter: the same text on FIXED pages at least."""
    return w[TAG] in _BLOCK and w[PAGES] >= FIXED and _same(w)


def extract(page: str | None, wrapper: list | None = None) -> str:
    """The main text of a page: blocks, white space folded, one to a line."""
    if not page:
        return ""
    root = parsed(page)
    wrapper = wrapper if wrapper is not None else infer([page])
    path = chosen(wrapper)
    node = wrapper
    for k in path:
        node = node[CHILDREN][k]
    varies = _mass(node)[0] > 0  # else the host's pages are all alike, and nothing tells its own matter from theirs
    blocks, line = [], []

    def flush():
        text = _SPACE.sub(" ", _html.unescape("".join(line))).strip()
        line.clear()
        if text:
            blocks.append(text)

    def walk(node: Node, w: list | None, inside: bool, rest: list[int]):
        """rest: what is left of the path; [-1] off it."""
        at = 0
        for p in node.parts:
            if isinstance(p, str):
                if inside:
                    line.append(p)
                continue
            # the wrapper's next element of this kind; repeated groups match again
            known = None
            if w is not None:
                for k in [*range(at, len(w[CHILDREN])), *range(at)]:
                    if w[CHILDREN][k][:2] == [p.tag, p.marks]:
                        known, at = k, k
                        break
            below = rest if inside else (rest[1:] if rest and known == rest[0] else [-1])
            block = p.tag in _BLOCK
            if _is_other(p.tag, p.marks, inside) or (inside and varies and known is not None and fixed(w[CHILDREN][known])):
                if block:
                    flush()
                continue
            if block:
                flush()
            elif p.tag == "br":
                line.append(" ")
            walk(p, w[CHILDREN][known] if known is not None else None, inside or below == [], below)
            if block:
                flush()

    walk(root, wrapper, not path, path)
    if path and not blocks:  # the page doesn't follow the wrapper down the path
        main = _marked(root)
        walk(main or root, None, True, [])
    flush()
    return "\n".join(blocks)


def _marked(node: Node) -> Node | None:
    """The first marked article of a page."""
    for p in node.parts:
        if isinstance(p, Node) and not _is_other(p.tag, p.marks, False) and (found := p if _is_main(p.tag, p.marks) else _marked(p)):
            return found
    return None


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wrappers of the hosts in (host, page) rows; a host has one for each time that OPEN hosts were held."""
    schema = pa.schema([("host", pa.string()), ("wrapper", pa.string())])
    held: dict[str, list] = {}
    for b in batches:
        for host, page in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            w = pattern(parsed(page.as_py()))
            held[host] = aligned(held[host], w) if host in held else w
            if len(held) > OPEN:
                yield batch(schema, list(held), [json.dumps(x) for x in held.values()])
                held = {}
    if held:
        yield batch(schema, list(held), [json.dumps(x) for x in held.values()])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wrapper of each host from the sorted ones of its runs."""
    schema = pa.schema([("host", pa.string()), ("wrapper", pa.string())])
    for b in batches:
        out = []
        for parts in b.column(1):
            found = [json.loads(p.as_py()) for p in parts.values]
            whole = found[0]
            for w in found[1:]:
                whole = aligned(whole, w)
            out.append(json.dumps(whole))
        yield batch(schema, b.column(0), out)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    known: dict[str, list] = {}
    for b in batches:
        texts = []
        for page, w in zip(b.column(2), b.column(3).to_pylist(), strict=True):
            if w is not None and w not in known:
                if len(known) > 256:
                    known.clear()
                known[w] = json.loads(w)
            texts.append(extract(page.as_py(), known.get(w)))
        yield batch(schema, b.column(0), b.column(1), texts, [len(t) for t in texts])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page. Null and empty pages have empty text; pages without a host share one
    wrapper; repeated rows come back each. A host's pages are spread over salts, so a large host isn't one task's."""
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    src = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    parts = map_batches(src.where("html IS NOT NULL AND html <> ''"), ["host", "html"], "host string, wrapper string", _learn)
    parts = written(parts).groupBy("host").agg(F.array_sort(F.collect_list("wrapper")).alias("wrappers"))
    wrappers = written(map_batches(parts, ["host", "wrappers"], "host string, wrapper string", _merged))
    salted = wrappers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mine = src.withColumn("salt", F.pmod(F.xxhash64("id", "html"), F.lit(SALTS)).cast("int"))
    out = map_batches(mine.join(salted, ["host", "salt"], "left"), ["id", "url", "html", "wrapper"], "id long, url string, text string, n_chars long", _apply)
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
