"""Main-text extraction from HTML with consensus container paths per host and template.

Every page is read into a light tree.  Its containers are scored by the text of
the blocks below them (link text counts against them, text in menus, forms,
notices and the like not at all; a block counts fully for its container, half
for the next one and so on).  Each page votes for the paths of all containers
with a positive score; tags in paths carry their classes with digits
generalised.  A page's template is the set of its container paths without those
in menus and the like.  Spark adds the votes per host and template, and the
winning path re-extracts every page of that template; a page without that path
falls back to its own best container.  A page whose template is unique on its
host therefore votes alone.

Defined results: null and empty pages give an empty text; broken markup is read
as far as it goes; urls that are null or have no host vote together as the
empty host; repeated rows are extracted each; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodweave.llm.common import proven_small
from moodweave.llm.url_gbt import host_of

HOST_ROWS = 1_000_000            # (host hash, template hash, path hash) rows of 24 bytes that may be broadcast

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp rt s "
                   "samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
SKIPPED = frozenset("nav header footer aside form script style noscript template button select textarea iframe svg dialog "
                    "menu title head object canvas audio video fieldset".split())
CONTAINERS = frozenset("body main article section div td blockquote".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 "
                     "h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"),
               "th": ("tr", "table"), "option": ("select",)}
# Class and id words of page furniture, and roles.
FURNITURE = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar "
                      "navigation menu menubar breadcrumb breadcrumbs sidebar aside footer header masthead cookie cookies "
                      "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share "
                      "sharing social related recommended recommendations comment comments disqus reply replies responses "
                      "widget widgets toolbar pagination pager login search skip hidden".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar alert".split())
NEVER_FURNITURE = frozenset("html body main article".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
                    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_DIGITS = re.compile(r"\d+")


class Node:
    __slots__ = ("tag", "path", "parent", "furniture", "block", "link")

    def __init__(self, tag, path, parent, furniture, block, link):
        self.tag, self.path, self.parent = tag, path, parent
        self.furniture, self.block, self.link = furniture, block, link


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)} if text else {}


def _is_furniture(tag: str, attributes: dict[str, str]) -> bool:
    if tag in NEVER_FURNITURE:
        return False
    if tag in SKIPPED or attributes.get("role", "").lower() in ROLES or "hidden" in attributes \
            or attributes.get("aria-hidden", "").lower() == "true":
        return True
    for token in (attributes.get("class", "") + " " + attributes.get("id", "")).lower().split():
        words = [w for w in re.split(r"[-_\d]+", token) if w]
        if words and words[0] not in ("has", "no", "with", "without") and not FURNITURE.isdisjoint(words):
            return True
    return False


def read_blocks(html: str) -> tuple[list[tuple[Node, str, int]], list[Node]]:
    """Blocks (innermost block element, text, characters of link text) in page order, and all containers."""
    root = Node("", "", None, False, True, False)
    stack, blocks, containers = [root], [], []
    buffer: list[str] = []
    linked = 0

    def flush():
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                at = stack[-1]
                while not at.block:
                    at = at.parent
                blocks.append((at, text, min(linked, len(text))))
            buffer.clear()
        linked = 0

    def say(raw: str):
        nonlocal linked
        if raw:
            text = unescape(raw) if "&" in raw else raw
            # text inside skipped inline elements is dropped here, blocks are judged later
            at, link = stack[-1], False
            while not at.block:
                if at.furniture:
                    return
                link |= at.link
                at = at.parent
            buffer.append(text)
            if link:
                linked += len(text)

    def close_to(k: int):
        if any(n.block for n in stack[k:]):
            flush()
        del stack[k:]

    pos, raw_until = 0, None
    lower = None
    while True:
        m = _TOKEN.search(html, pos)
        if m is None:
            say(html[pos:])
            break
        say(html[pos:m.start()])
        pos = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing = (m[1] or m[4]) == "/"
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close_to(k)
                    break
            continue
        if tag == "br" or tag == "wbr":
            buffer.append(" " if tag == "br" else "")
            continue
        block = tag not in INLINE
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close_to(k)
                    break
                if stack[k].tag in CONTAINERS or stack[k].tag in ("table", "button"):
                    break
        elif tag in CLOSES_SAME:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag or (tag in ("dt", "dd") and stack[k].tag in ("dt", "dd")):
                    close_to(k)
                    break
                if stack[k].tag in CLOSES_SAME[tag]:
                    break
        if block:
            flush()
        if tag in VOID:
            continue
        attributes = _attributes(m[3] or m[6] or "")
        if tag in RAW:
            # raw text runs to the matching end tag
            lower = html.lower() if lower is None else lower
            end = lower.find("</" + tag, pos)
            pos = len(html) if end < 0 else end
        above = stack[-1]
        path = above.path
        if block:
            classes = ".".join(sorted({_DIGITS.sub("#", c) for c in attributes.get("class", "").lower().split()}))
            path = f"{path}/{tag}.{classes}" if classes else f"{path}/{tag}"
        node = Node(tag, path, above, _is_furniture(tag, attributes), block, tag == "a")
        if tag in RAW:
            continue
        stack.append(node)
        if tag in CONTAINERS:
            containers.append(node)
    flush()
    return blocks, containers


def _visible_below(node: Node, top: Node | None) -> bool:
    """No furniture from ``node`` up to ``top`` (exclusive; the whole page when None)."""
    while node is not None and node is not top:
        if node.furniture:
            return False
        node = node.parent
    return True


def score_containers(blocks, containers) -> dict[str, float]:
    """Score by container path, best first."""
    score: dict[str, float] = {}
    for at, text, linked in blocks:
        if not _visible_below(at, None):
            continue
        worth, node = float(len(text) - 2 * linked), at
        while node is not None and worth:
            if node.tag in CONTAINERS:
                score[node.path] = score.get(node.path, 0.0) + worth
                worth = worth / 2 if abs(worth) >= 1 else 0.0
            node = node.parent
    return dict(sorted(score.items(), key=lambda x: (-x[1], len(x[0]), x[0])))


def extract(blocks, path: str) -> list[str]:
    """Block texts below the outermost containers with ``path``, in page order, without furniture."""
    out = []
    for at, text, _ in blocks:
        top, node = None, at
        while node is not None:
            if node.path == path and node.tag in CONTAINERS:
                top = node
            node = node.parent
        if top is not None and _visible_below(at, top):
            out.append(text)
    return out


def path_key(path: str) -> int:
    return xxhash.xxh64_intdigest(path) - (1 << 63)


def template_key(containers) -> int:
    return path_key("\n".join(sorted({c.path for c in containers if _visible_below(c, None)})))


def _votes(batches):
    for batch in batches:
        hosts, templates, keys, votes = [], [], [], []
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            blocks, containers = read_blocks(html or "")
            ranked = [x for x in score_containers(blocks, containers).items() if x[1] > 0]
            template = template_key(containers)
            for path, s in ranked:
                hosts.append(host)
                templates.append(template)
                keys.append(path_key(path))
                votes.append(round(1000 * s / ranked[0][1]))   # integers add up alike in any order
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.int64()), pa.array(templates, pa.int64()), pa.array(keys, pa.int64()),
                                          pa.array(votes, pa.int64())], names=["host", "template", "path", "vote"])


def _templates(batches):
    for batch in batches:
        keys = [template_key(read_blocks(html or "")[1]) for html in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=[*batch.schema.names, "template"])


def _extracts(batches):
    for batch in batches:
        texts = []
        for key, html in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            blocks, containers = read_blocks(html or "")
            found: list[str] = []
            for path in dict.fromkeys(c.path for c in containers):
                if path_key(path) == key:
                    found = extract(blocks, path)
            if not found:
                own = next((p for p, s in score_containers(blocks, containers).items() if s > 0), None)
                found = extract(blocks, own) if own is not None else [t for at, t, _ in blocks if _visible_below(at, None)]
            texts.append("\n".join(found))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                                         names=["page_id", "url", "text"])


def host_votes(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, template, path, votes, pages): hashes of host, template and generalised path."""
    rows = pages.select(F.xxhash64(host_of(F.col(url))).alias("host"), F.col(html).alias("html"))
    return rows.mapInArrow(_votes, "host long, template long, path long, vote long").groupBy("host", "template", "path") \
        .agg(F.sum("vote").alias("votes"), F.count(F.lit(1)).alias("pages"))


def winners(votes: DataFrame) -> DataFrame:
    """(host, template, path) with most votes."""
    return votes.groupBy("host", "template").agg(F.max(F.struct("votes", "path")).alias("w")) \
        .select("host", "template", F.col("w.path").alias("path"))


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text) of every row."""
    best = winners(host_votes(pages, url, html)).checkpoint()
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"),
                        F.xxhash64(host_of(F.col(url))).alias("host")) \
        .mapInArrow(_templates, "page_id long, url string, html string, host long, template long")
    joined = rows.join(proven_small(best, HOST_ROWS), ["host", "template"], "left")
    return joined.select("page_id", "url", F.coalesce("path", F.lit(0)).alias("path"), "html") \
        .mapInArrow(_extracts, "page_id long, url string, text string")
