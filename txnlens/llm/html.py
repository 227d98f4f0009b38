"""Main-text extraction with union-free regular expressions inferred per host.

A page becomes a stream of structural tokens (block tags with their class
names, and ``#`` for a text). Repeated neighbours are folded into ``( ... )+``.
The distinct folded streams of a host are aligned one after another: equal
tokens match, a mismatch between two matches becomes an optional group
``( ... )?``, a repeat on either side stays a repeat. The result is the host's
wrapper, a regular expression without unions, whose ``#`` are its text slots.
Alignment works on distinct streams only: pages are collapsed to (host,
stream) first, aligned in parts of about ``FAN`` streams, and the parts' wrappers
aligned again in the same way until one is left, so a host with a third of all
pages is neither one task nor one long list. Ids and names with digits are not
structure: they differ from page to page.

Main text is decided for each page by its own elements: the slots under its
main region (the ``article`` or ``main`` element); on a page without one, under
the element it has that holds the most repeated text slots of the host's
wrapper. Slots under an element that is by name, role or class a menu, header,
footer, sidebar, notice, advert, form or comment list are left out, and so are
slots outside the main region, headings and paragraphs whose text is the same on
every page that has them, if at least ``LEAST_PAGES`` of these differ in other
texts (copies of one page count once). An element around the main region, ``html``,
``body`` and a form around the whole page are never boilerplate. Below the main region
a header, a heading and a paragraph stay whatever their names; other elements go by
their tag, by a whole boilerplate class name, or by one like ``related-posts``.
Scripts, styles, templates, titles, ``noscript`` text and elements marked hidden have no
text.

Defined results
    null or empty html: empty text. Unclosed, crossed and cut-off tags are
    accepted. A null url, or one without a host, is the host ``""``. Repeated
    rows each get their result. A host's wrapper uses all its pages. Empty
    table: no rows. Only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.llm.common import small_batches, stored
from txnlens.llm.urls import host_of
from txnlens.plans.small import join_small

LEAST_PAGES = 5
#: streams or wrappers that one task aligns
FAN = 64
MAX_BROADCAST_HOSTS = 50_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|svg|iframe|select|button)\b.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)/?>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"""\b(class|id|role|hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_DIGIT = re.compile(r"\d")
#: tags that do not end a block of text
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small"
    " span strike strong sub sup time tt u var wbr".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: an open element of these is closed by a block tag (p) or by its own kind
SELF_CLOSING = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "blockquote", "pre"}
MAIN = ("article", "main")
BOILERPLATE_TAGS = set("nav header footer aside form menu dialog head input fieldset object".split())
BOILERPLATE_NAMES = set(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent"
    " contentinfo cookie cookies disclaimer footer gdpr header hidden menu menubar nav navbar navigation newsletter"
    " notice popup promo promotion related reply replies search share sharing sidebar signup skip social sponsor"
    " sponsored subscribe toolbar widget".split()
)
#: words of ids that tell the parts of a page's layout; other ids name single elements
LAYOUT_NAMES = set("article body bottom center column container content entry left main page post primary right story text top wrapper".split())
#: last words of names of boxes
CONTAINER_NAMES = set("area bar block box buttons container content form group icons inner item items links list panel posts section slot thread wrap wrapper".split())
#: names that the head of an article has as well
HEADER_NAMES = {"header", "banner"}
#: names that elements around a whole article have as well
AROUND_MAIN = set("header menu nav notice search share social widget".split())


class Leaf:
    """A block of text: its path of elements, and its words."""

    __slots__ = ("path", "words")

    def __init__(self, path: tuple[str, ...], words: list[str]):
        self.path, self.words = path, words


def _names(attrs: str) -> list[str]:
    """Class and role names without parts that have digits; of ids the layout and boilerplate words; ``hidden``.

    Ids and numbers name one page's element (``post-123``), so they are no structure.
    """
    names = []
    for m in _ATTR.finditer(attrs):
        kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if kind == "hidden" or (kind == "style" and re.search(r"display\s*:\s*none", value)):
            names.append("hidden")
        elif kind != "style":
            for n in value.split():
                parts = [part for part in re.split(r"[-_]+", re.sub(r"[^\w-]", "_", n)) if part and not _DIGIT.search(part)]
                if kind == "id":
                    parts = [part for part in parts if part in LAYOUT_NAMES or part in BOILERPLATE_NAMES]
                if parts:
                    names.append("-".join(parts))
    return names


def leaves(page: str | None) -> Iterator[Leaf]:
    """The blocks of text of a page in order, with paths like ``body/article/p``."""
    stack: list[str] = []
    tags: list[str] = []
    words: list[str] = []

    def flush() -> Iterator[Leaf]:
        text = " ".join(entities.unescape("".join(words)).split())
        words.clear()
        if text:
            yield Leaf(tuple(stack), [text])

    for m in _TOKEN.finditer(page or ""):
        if m["text"] is not None:
            words.append(m["text"])
            continue
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if tag in INLINE:
            if tag == "br":
                words.append(" ")
            continue
        yield from flush()
        if m["end"]:
            if tag in tags:
                at = len(tags) - 1 - tags[::-1].index(tag)
                del tags[at:], stack[at:]
            continue
        while tags and tags[-1] in SELF_CLOSING and (tags[-1] == "p" or tags[-1] == tag):
            tags.pop()
            stack.pop()
        if tag not in VOID:
            names = sorted(set(_names(m["attrs"])))
            tags.append(tag)
            stack.append(".".join([tag, *names]) if names else tag)
    yield from flush()


# ------------------------------------------------------------------ wrappers
def stream(found: list[Leaf]) -> list[str]:
    """Structural tokens of a page: ``name`` opens, ``/name`` closes, ``#`` is a text."""
    out: list[str] = []
    here: tuple[str, ...] = ()
    for leaf in found:
        same = 0
        while same < min(len(here), len(leaf.path)) and here[same] == leaf.path[same]:
            same += 1
        if same == len(leaf.path) and same and here == leaf.path and out and out[-1] == "#":
            same -= 1  # a neighbour of the same kind is an element of its own
        out += [f"/{n}" for n in reversed(here[same:])] + list(leaf.path[same:]) + ["#"]
        here = leaf.path
    return out + [f"/{n}" for n in reversed(here)]


Node = tuple  # ("t", token) | ("+", nodes) | ("?", nodes)


def fold(tokens: list[str]) -> list[Node]:
    """Whole elements as nodes, equal neighbours folded into one repeat."""
    nodes: list[Node] = []
    stack: list[list[Node]] = [nodes]
    for t in tokens:
        if t.startswith("/"):
            children = stack.pop()
            name = children[0][1]
            stack[-1].append(("e", name, tuple(_fold_runs(children[1:]))))
        elif t == "#":
            stack[-1].append(("t", "#"))
        else:
            stack.append([("t", t)])
    while len(stack) > 1:  # cut-off pages
        children = stack.pop()
        stack[-1].append(("e", children[0][1], tuple(_fold_runs(children[1:]))))
    return _fold_runs(nodes)


def _strip(node: Node) -> Node:
    return node[1] if node[0] == "+" else node


def _fold_runs(nodes: list[Node]) -> list[Node]:
    out: list[Node] = []
    for n in nodes:
        if out and _strip(out[-1]) == _strip(n):
            out[-1] = ("+", _strip(n))
        else:
            out.append(n)
    return out


def _kernel(node: Node) -> tuple:
    """What two nodes must share to match: the element's name, or being text."""
    while node[0] in "+?":
        node = node[1]
    return node[:2]


def align(wrapper: list[Node], page: list[Node]) -> list[Node]:
    """The wrapper that also covers ``page``: matches are merged, mismatches become optional."""
    n, m = len(wrapper), len(page)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = (
                best[i + 1][j + 1] + 1
                if _kernel(wrapper[i]) == _kernel(page[j])
                else max(best[i + 1][j], best[i][j + 1])
            )
    out: list[Node] = []
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and _kernel(wrapper[i]) == _kernel(page[j]):
            out.append(_merge(wrapper[i], page[j]))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append(_optional(wrapper[i]))
            i += 1
        else:
            out.append(_optional(page[j]))
            j += 1
    return _join(out)


def _optional(node: Node) -> Node:
    return node if node[0] == "?" else ("?", node)


def _merge(a: Node, b: Node) -> Node:
    """One node for two with the same kernel."""
    marks = {x for node in (a, b) for x in _marks(node)}
    while a[0] in "+?":
        a = a[1]
    while b[0] in "+?":
        b = b[1]
    core: Node = a if a[0] == "t" else ("e", a[1], tuple(align(list(a[2]), list(b[2]))))
    if "+" in marks:
        core = ("+", core)
    return ("?", core) if "?" in marks else core


def _marks(node: Node) -> Iterator[str]:
    while node[0] in "+?":
        yield node[0]
        node = node[1]


def _join(nodes: list[Node]) -> list[Node]:
    """Neighbours with one kernel become one repeat, so the expression stays short."""
    out: list[Node] = []
    for n in nodes:
        if out and _kernel(out[-1]) == _kernel(n):
            merged = _merge(out[-1], n)
            while merged[0] in "+?":
                merged = merged[1]
            out[-1] = ("+", merged)
        else:
            out.append(n)
    return out


def write(nodes: list[Node] | tuple) -> str:
    """The wrapper as text: ``<name> ... </name>``, ``#``, ``( ... )+``, ``( ... )?``."""
    parts = []
    for n in nodes:
        if n[0] == "t":
            parts.append("#")
        elif n[0] == "e":
            parts.append(f"<{n[1]}>{write(n[2])}</{n[1]}>")
        else:
            parts.append(f"({write([n[1]])}){n[0]}")
    return "".join(parts)


_WRITTEN = re.compile(r"<(/?)([^<>]+)>|(#)|(\()|\)([+?])")


def read(written: str) -> list[Node]:
    stack: list[list] = [[]]
    for m in _WRITTEN.finditer(written):
        if m[3]:
            stack[-1].append(("t", "#"))
        elif m[4] or (m[2] and not m[1]):
            stack.append([])
        elif m[2]:
            children = stack.pop()
            stack[-1].append(("e", m[2], tuple(children)))
        else:
            children = stack.pop()
            stack[-1].append((m[5], children[0]))
    return stack[0]


def infer(streams: list[str]) -> str:
    """One wrapper for all written streams (shortest first, so that the order is fixed)."""
    wrapper: list[Node] | None = None
    for s in sorted(set(streams), key=lambda s: (len(s), s)):
        wrapper = read(s) if wrapper is None else align(wrapper, read(s))
    return write(wrapper or [])


def slots(written: str) -> list[tuple[str, bool]]:
    """``(path, repeated)`` of the wrapper's text slots."""
    out = []

    def walk(nodes: tuple | list, path: tuple[str, ...], repeated: bool) -> None:
        for n in nodes:
            rep = repeated
            while n[0] in "+?":
                rep = rep or n[0] == "+"
                n = n[1]
            if n[0] == "t":
                out.append(("/".join(path), rep))
            else:
                walk(n[2], (*path, n[1]), rep)

    walk(read(written), (), False)
    return out


@lru_cache(maxsize=1 << 16)
def _boilerplate(name: str) -> int:
    """0: not boilerplate by name; 1: named in passing; 2: named so; 3: by its tag."""
    tag, *names = name.split(".")
    if tag in BOILERPLATE_TAGS:
        return 1 if tag in ("form", "fieldset") else 3
    found = 0
    for n in names:
        parts = re.split(r"[-_]+", n)
        if any(part in BOILERPLATE_NAMES for part in parts):
            found = max(found, 2 if parts[0] in BOILERPLATE_NAMES - AROUND_MAIN else 1)
    return found


@lru_cache(maxsize=1 << 16)
def _boilerplate_inside(name: str) -> bool:
    """Is an element below the main region no part of the article?

    By its tag (a header there holds the headings), or by a whole class name, or
    one that begins with a boilerplate word and ends with that of a container
    (``related-posts``). A word inside a name (``market-share``) tells nothing, and
    headings and paragraphs are text whatever their names.
    """
    tag, *names = name.split(".")
    if tag in HEADINGS or tag == "header":
        return False
    if tag in BOILERPLATE_TAGS:
        return True
    for n in names:
        first, *rest = re.split(r"[-_]+", n)
        if first in BOILERPLATE_NAMES - HEADER_NAMES and (not rest or rest[-1] in CONTAINER_NAMES | BOILERPLATE_NAMES):
            return True
    return False


@lru_cache(maxsize=1 << 16)
def _region(name: str) -> bool:
    tag, *names = name.split(".")
    return tag in MAIN or "main" in names


def _page_forms(paths: frozenset[tuple[str, ...]]) -> set[tuple[str, ...]]:
    """The forms that hold the whole page, or its menu or main region: layout, not a form to fill in."""
    forms = {p[: k + 1] for p in paths for k, n in enumerate(p) if n.split(".")[0] == "form"}
    wide = set()
    for form in forms:
        held = [p[len(form) :] for p in paths if p[: len(form)] == form]
        if len(held) == len(paths) or any(_region(n) or n.split(".")[0] == "nav" for p in held for n in p):
            wide.add(form)
    return wide


@lru_cache(maxsize=4096)
def candidates(paths: frozenset[tuple[str, ...]]) -> tuple[bool, frozenset[str], frozenset[str]]:
    """Of a page's paths: whether it has a main region, the paths that are its main text then, and the other good paths.

    An element around the main region is not boilerplate, whatever its name;
    names only tell several regions of a page from each other (the article
    from teasers in a sidebar or comments that are articles too).
    """
    wide = _page_forms(paths)
    regions: list[tuple[str, bool, int, int, int]] = []
    other = set()
    for path in paths:
        at = [k for k, n in enumerate(path) if _region(n)]
        first, last = (at[0], at[-1]) if at else (len(path), -1)
        around = [0, 0, 0, 0]
        bad = False
        for k, n in enumerate(path):
            # a header inside the article holds its headings; outside it is the page's
            if k == first or n.split(".")[0] in ("html", "body") or path[: k + 1] in wide:
                continue
            if at and k > last:
                bad = bad or _boilerplate_inside(n)
                continue
            if k > first and n.split(".")[0] == "header":
                continue
            kind = _boilerplate(n)
            bad = bad or (kind > 0 and k > last)
            around[kind] += 1
        if bad:
            continue
        if at:
            article = any(path[k].split(".")[0] == "article" for k in at)
            regions.append(("/".join(path), article, around[3], around[2], around[1]))
        else:
            other.add("/".join(path))
    if regions:
        tags, names = min(r[2:4] for r in regions)
        regions = [r for r in regions if r[2:4] == (tags, names)]
        least = {kind: min((r[4] for r in regions if r[1] == kind), default=0) for kind in (False, True)}
        if not (tags and other):  # articles in a menu or sidebar only: teasers beside the main text
            return True, frozenset(r[0] for r in regions if r[4] == least[r[1]]), frozenset(other)
    return False, frozenset(), frozenset(other)


def _parent(path: str) -> str:
    return path.rpartition("/")[0]


def dense(written: str, constant: set[str]) -> dict[str, int]:
    """The number of repeated text slots of the wrapper's elements outside main regions, notices and boilerplate."""
    parents: dict[str, int] = {}
    for path, repeated in slots(written):
        names = path.split("/")
        if repeated and path not in constant and not any(
            _region(n) or (_boilerplate(n) and n.split(".")[0] not in ("html", "body", "form")) for n in names
        ):
            parents[_parent(path)] = parents.get(_parent(path), 0) + 1
    return parents


def notice_paths(paths: frozenset[tuple[str, ...]]) -> frozenset[str]:
    """The good paths that a notice may have: outside the main region, headings and paragraphs."""
    return frozenset(p for p in candidates(paths)[2] if p.rpartition("/")[2].split(".")[0] not in HEADINGS)


def main_paths(paths: frozenset[tuple[str, ...]], parents: dict[str, int], constant: set[str]) -> frozenset[str]:
    """The paths of a page that hold main text: its main region, or the densest element that it has."""
    has_region, region, good = candidates(paths)
    if has_region:
        return region
    good = frozenset(p for p in good if p not in constant)
    found = {_parent(p) for p in good if parents.get(_parent(p))}
    if found:
        # the element that holds the most repeated slots, with all its own slots
        top = max(found, key=lambda k: (parents[k], -len(k), k))
        good = frozenset(p for p in good if p == top or p.startswith(f"{top}/") or not top)
    return good


# ------------------------------------------------------------------ Spark
_PAGE_SCHEMA = "host string, stream string, page long, slots array<struct<path:string,text:long>>"


def page_streams(pages: DataFrame) -> DataFrame:
    """``(host, stream, page, slots)``: structure, digest of all texts, and slots that may hold a notice, of every page."""
    kind = pa.list_(pa.struct([("path", pa.string()), ("text", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams, digests, held = [], [], []
            for page in batch.column("html").to_pylist():
                found = list(leaves(page))
                streams.append(write(fold(stream(found))))
                may = notice_paths(frozenset(f.path for f in found))
                by_path: dict[str, xxhash.xxh3_64] = {}
                whole = xxhash.xxh3_64()
                for leaf in found:  # one digest for all texts of a path on this page
                    path = "/".join(leaf.path)
                    whole.update(f"{path}\0{leaf.words[0]}\0")
                    if path in may:
                        by_path.setdefault(path, xxhash.xxh3_64()).update(leaf.words[0])
                digests.append(whole.intdigest() - (1 << 63))
                held.append([{"path": p, "text": h.intdigest() - (1 << 63)} for p, h in by_path.items()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("host"), pa.array(streams, pa.string()), pa.array(digests, pa.int64()), pa.array(held, kind)],
                names=["host", "stream", "page", "slots"],
            )

    return pages.select(F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), "html").mapInArrow(run, _PAGE_SCHEMA)


def wrappers(streams: DataFrame) -> DataFrame:
    """``(host, wrapper)`` from the distinct streams of each host, in a tree of parts of about ``FAN`` each."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "stream": [infer(rows["stream"].tolist())]})

    schema = "host string, stream string"
    level = stored(streams.select("host", "stream").distinct(), "distinct_streams")
    while True:
        sizes = stored(level.groupBy("host").agg(F.ceil(F.count("*") / FAN).alias("parts")), "parts")
        if (sizes.agg(F.max("parts")).first()[0] or 0) <= 1:
            return level.groupBy("host").applyInPandas(run, schema).withColumnRenamed("stream", "wrapper")
        sizes = sizes.withColumnRenamed("host", "of")
        parted = join_small(level, sizes, F.col("host") == F.col("of"), max_rows=MAX_BROADCAST_HOSTS, check=True)
        parted = parted.withColumn("salt", F.pmod(F.xxhash64("stream"), F.col("parts")))
        level = stored(parted.groupBy("host", "salt").applyInPandas(run, schema).distinct(), "wrapper_parts")


def decisions(pages: DataFrame) -> DataFrame:
    """``(host, wrapper, dense, constant)``: each host's wrapper, its dense elements and constant slots."""
    found = stored(page_streams(pages), "streams")
    differing = found.select("host", "page", F.explode("slots").alias("s")).select("host", "page", "s.path", "s.text").distinct()
    shared = differing.groupBy("host", "path").agg(
        F.min("text").alias("lo"), F.max("text").alias("hi"), F.count("*").alias("n")
    )
    constant = shared.where((F.col("lo") == F.col("hi")) & (F.col("n") >= LEAST_PAGES))
    constant = constant.groupBy("host").agg(F.collect_set("path").alias("constant"))
    joined = wrappers(found).join(constant, "host", "left")
    kind = pa.map_(pa.string(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fixed = batch.column("constant").to_pylist()
            written = batch.column("wrapper").to_pylist()
            counts = [list(dense(w, set(c or ())).items()) for w, c in zip(written, fixed, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("host"), batch.column("wrapper"), pa.array(counts, kind), batch.column("constant")],
                names=["host", "wrapper", "dense", "constant"],
            )

    schema = "host string, wrapper string, dense map<string,int>, constant array<string>"
    return joined.select("host", "wrapper", "constant").mapInArrow(run, schema)


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text)``: the main text, blocks joined by an empty line."""
    small_batches(pages.sparkSession)
    decided = stored(decisions(pages), "wrappers").select(F.col("host").alias("of"), "dense", "constant")
    rows = pages.select("page_id", "url", "html", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"))
    rows = join_small(rows, decided, F.col("host") == F.col("of"), "left", max_rows=MAX_BROADCAST_HOSTS, check=True)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            known = zip(batch.column("dense").to_pylist(), batch.column("constant").to_pylist(), strict=True)
            for page, (parents, constant) in zip(batch.column("html").to_pylist(), known, strict=True):
                found = list(leaves(page))
                paths = main_paths(frozenset(f.path for f in found), dict(parents or ()), set(constant or ()))
                texts.append("\n\n".join(f.words[0] for f in found if "/".join(f.path) in paths))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], schema=schema
            )

    return rows.select(F.col("page_id").cast("long"), "url", "html", "dense", "constant").mapInArrow(
        run, "page_id long, url string, text string"
    )
