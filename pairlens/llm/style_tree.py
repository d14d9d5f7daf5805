"""Main text of web pages by a site style tree.

A page is read into element nodes, named by the path of tags and classes from the root, and blocks
of text under them. The pages of a host are merged into one tree: for each node, in how many
different pages it occurs, how often with which sequence of children (its presentations), and in how
many pages each block of text stands under it. Two importances follow, both 0 for what all pages
share and 1 for what only one has:

* of a presentation: the entropy of a node's child sequences over the pages, in units of log m for
  the m pages that have it;
* of content: 1 less the entropy of a block's pages, log c / log m for a block found in c of them;
  of a leaf, the mean over its different blocks.

A node's composite importance joins its own with its children's, as much of the former as there are
different presentations (1 - GAMMA ** presentations). Branches below ``min_importance``, and blocks
below it, are removed from each page. Copies and near copies of a page count as one, so an article
stays however often it is published and whatever date or teaser each variant has. Near copies are
found as in ``line_rules``, by sketches of the five-word windows of a page's blocks, without the
blocks that more than half of the host's pages hold: those are its template, unless variants of
one article are more than half of the pages themselves. A class of near copies is represented by one
page. A node or block needs ``min_pages`` different pages to be judged at all.

Entropy cannot tell what is random on every page, so elements that say what they are (navigation,
adverts, forms, comments and the like) count as unimportant from the start, and where a page has
an article or main element the rest does not matter. Where only a class or id says so, an element
that holds an article or main element, or more than half of the page's text, is left to the tree:
a "content-sidebar-wrap" is no sidebar. An article that is named a comment does not count.

Defined results: null and empty pages, and pages without a block left, have an empty text; a null
or odd address is a host of its own; a page that ends inside a tag, comment or script ends there;
repeated rows are copies. Whole pages are read, of any length.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.lineage import cut_lineage
from pairlens.llm.common import OWN, whole
from pairlens.llm.line_rules import HOST, SKETCH, SKETCH_SIZE, near_copies
from pairlens.llm.line_rules import NODE as PAGE_NODE
from pairlens.llm.ngram_join import SHINGLE, mixed_windows, word_hashes

GAMMA = 0.9
SKIPPED = "script style noscript template title head iframe svg math object canvas audio video textarea select option button".split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var".split()
)
NOISE_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner menu nav navbar "
    "navigation sidebar side aside footer foot breadcrumb breadcrumbs cookie cookies consent gdpr notice notices notification "
    "alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended "
    "comment comments commentlist commentform reply replies respondent disqus adsbygoogle copyright widget toolbar pagination pager masthead topbar skip hidden".split()
)
COMMENT_WORDS = frozenset("comment comments reply replies respondent".split())
# A header with one of these in its name belongs to the article.
OWN_HEADER = frozenset("article post entry content story title image".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "option": {"option"},
}
SCOPE = frozenset("ul ol dl table article main section div body aside nav".split())
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(source)} if source.strip(" /") else {}


def says_noise(tag: str, attrs: dict[str, str]) -> bool:
    if tag in NOISE_TAGS or attrs.get("role", "").lower() in NOISE_ROLES:
        return True
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    return bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")))


def named_noise(attrs: dict[str, str]) -> bool:
    return not NOISE_WORDS.isdisjoint(name_words(attrs))


def name_words(attrs: dict[str, str]) -> list[str]:
    """Words of the class and id of an element."""
    return [w.lower() for w in NAME_WORD.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}")]


def is_comment(attrs: dict[str, str]) -> bool:
    return not COMMENT_WORDS.isdisjoint(name_words(attrs))


def named_header(attrs: dict[str, str]) -> bool:
    words = name_words(attrs)
    return "header" in words and OWN_HEADER.isdisjoint(words)


def _hash(text: str, seed: int = 0) -> int:
    value = xxhash.xxh3_64_intdigest(text, seed=seed & (2**64 - 1))
    return value - (1 << 64) if value >> 63 else value


class Page:
    """Blocks of text as (node, text, is noise, is inside the main element), and the parent, depth
    and children of every node. A node is the hash of its path, 0 the root; parents come first."""

    def __init__(self, source: str):
        self.blocks: list[tuple[int, str, bool, bool]] = []
        self.children: dict[int, list[int]] = {0: []}
        self.parent: dict[int, int] = {}
        self.depth: dict[int, int] = {0: 0}
        # Open elements: tag, node, noise, main, the innermost element whose name says noise.
        self.stack: list[tuple[str, int, bool, bool, int]] = [("", 0, False, False, 0)]
        # Such elements: the next one around, whether an article or main element is inside. 0 is the page.
        self.named: list[list] = [[0, False]]
        self.within: list[int] = []  # of each block, the innermost of them
        self.parts: list[str] = []
        self._read(source)
        self._end_block()
        self._judge_names()
        if any(b[3] and not b[2] for b in self.blocks):
            self.blocks = [(p, t, noise or not main, main) for p, t, noise, main in self.blocks]

    def _end_block(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            self.parts = []
            if text:
                _, node, noise, main, name = self.stack[-1]
                self.blocks.append((node, text, noise, main))
                self.within.append(name)

    def _judge_names(self) -> None:
        """Mark the blocks inside elements that are noise by name and hold no main part of the page."""
        held = [0] * len(self.named)
        for (_, text, noise, _), name in zip(self.blocks, self.within):
            held[name] += 0 if noise else len(text)
        for k in range(len(self.named) - 1, 0, -1):  # inner elements come after outer ones
            above, has_main = self.named[k]
            held[above] += held[k]
            self.named[above][1] |= has_main
        noisy = [False] * len(self.named)
        for k in range(1, len(self.named)):
            above, has_main = self.named[k]
            noisy[k] = noisy[above] or not (has_main or 2 * held[k] > held[0])
        self.blocks = [(p, t, noise or noisy[k], main) for (p, t, noise, main), k in zip(self.blocks, self.within)]

    def _open(self, tag: str, source: str) -> None:
        attrs = attributes(source)
        noise = says_noise(tag, attrs)
        whole_page = tag in ("html", "body")
        is_part = tag in ("article", "main") or attrs.get("role", "").lower() == "main"
        named = not whole_page and named_noise(attrs)
        if tag in INLINE and not (noise or named):
            return
        self._end_block()
        if tag not in INLINE:
            self._close_implied(tag)
        _, above, was_noise, main, around = self.stack[-1]
        name = ".".join([tag, *sorted(attrs.get("class", "").split())])
        node = _hash(name, above)
        if node not in self.parent:
            self.parent[node], self.depth[node] = above, self.depth[above] + 1
            self.children[node] = []
        if self.children[above][-1:] != [node]:  # a run of equal children counts once
            self.children[above].append(node)
        noise = was_noise or noise or (not main and tag == "header")
        is_main = is_part and not noise and not (tag == "article" and is_comment(attrs))
        self.named[around][1] |= is_main
        if not noise and tag not in ("article", "main") and (named or not (whole_page or main) and named_header(attrs)):
            self.named.append([around, is_main])
            around = len(self.named) - 1
        self.stack.append((tag, node, noise, main or is_part, around))

    def _close_implied(self, tag: str) -> None:
        if any(x[0] == "p" for x in self.stack[-3:]) and self.stack[-1][0] in ("p", *INLINE):
            while self.stack[-1][0] in ("p", *INLINE):
                self.stack.pop()
        ends = CLOSES.get(tag, ())
        for k in range(len(self.stack) - 1, 0, -1):
            open_tag = self.stack[k][0]
            if open_tag in ends:
                del self.stack[k:]
                break
            if open_tag in SCOPE:
                break

    def _close(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                self._end_block()
                del self.stack[k:]
                return
            if tag in ("p", *INLINE) and self.stack[k][0] in SCOPE:
                break
        if tag not in INLINE:
            self._end_block()

    def _read(self, source: str) -> None:
        at = 0
        while True:
            m = TAG.search(source, at)
            if m is None:
                self.parts.append(source[at:])
                return
            if m.start() > at:
                self.parts.append(source[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                self._close(tag)
            elif tag == "br":
                self.parts.append(" ")
            elif tag in SKIPPED:
                attrs = m[3] or m[6] or ""
                if not attrs.endswith("/"):
                    end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                    if end is None and tag == "head":
                        end = re.compile(r"(?=<body\b)", re.I).search(source, at)
                    if end is None and tag not in ("head", "option", "button", "select"):
                        return
                    at = end.end() if end else at
            elif tag in VOID:
                if tag == "hr":
                    self._end_block()
            else:
                self._open(tag, m[3] or m[6] or "")


NODE = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("node", "parent", "shown")] + [T.StructField("depth", T.IntegerType())]
)
BLOCK = T.StructType([T.StructField(n, T.LongType()) for n in ("node", "block")])
READ_BLOCK = T.StructType([*BLOCK.fields, T.StructField("windows", T.ArrayType(T.IntegerType()))])


def window_sketches(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each block the upper bits of the smallest hashes of its five-word windows (of all its words, if
    it has fewer), one block after the other, and where each begins and the last one ends."""
    words = [t.encode("utf-8", "replace").split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    w = np.fromiter(map(word_hashes.__getitem__, chain.from_iterable(words)), np.uint64, int(sizes.sum()))
    owners, hashes = [], []
    for k in range(1, SHINGLE + 1):
        blocks = np.flatnonzero(sizes == k if k < SHINGLE else sizes >= k)
        counts = sizes[blocks] - k + 1
        ends = np.cumsum(counts)
        at = np.arange(counts.sum()) + np.repeat(starts[blocks] - (ends - counts), counts)
        owners.append(np.repeat(blocks, counts))
        hashes.append(mixed_windows(w, at, k))
    owner, h = np.concatenate(owners), np.concatenate(hashes)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    fresh = np.r_[True, (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])][: len(h)]
    owner, h = owner[fresh], h[fresh]
    least = np.arange(len(owner)) - np.searchsorted(owner, owner) < SKETCH_SIZE
    bounds = np.searchsorted(owner[least], np.arange(len(texts) + 1))
    return (h[least] >> np.uint64(33)).astype(np.int32), bounds.astype(np.int32)


def _lists(counts: list[int], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), values)


def _structs(schema: T.StructType, columns: list) -> pa.StructArray:
    kinds = {T.LongType: pa.int64(), T.IntegerType: pa.int32()}
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, kinds[type(f.dataType)]) for c, f in zip(columns, schema.fields)]
    return pa.StructArray.from_arrays(arrays, names=schema.names)


def read_trees(pages: DataFrame) -> DataFrame:
    """(host, page, nodes, blocks) of each page; ``page`` hashes its text, so copies agree."""
    schema = T.StructType(
        [T.StructField("host", T.LongType()), T.StructField("page", T.LongType())]
        + [T.StructField("nodes", T.ArrayType(NODE)), T.StructField("blocks", T.ArrayType(READ_BLOCK))]
    )

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node: list[list] = [[], [], [], []]
            block: list[list] = [[], []]
            page, n_nodes, n_blocks, texts = [], [], [], []
            for source in batch.column(1).to_pylist():
                tree = Page(source)
                node[0] += tree.parent
                node[1] += tree.parent.values()
                node[2] += [_hash(" ".join(map(str, tree.children[x]))) for x in tree.parent]
                node[3] += [tree.depth[x] for x in tree.parent]
                own = [(x, t) for x, t, noise, _ in tree.blocks if not noise]
                block[0] += [x for x, _ in own]
                block[1] += [_hash(t) for _, t in own]
                texts += [t for _, t in own]
                page.append(_hash("\n".join(t for _, t in own)))
                n_nodes.append(len(tree.parent))
                n_blocks.append(len(own))
            values, bounds = window_sketches(texts)
            windows = pa.ListArray.from_arrays(pa.array(bounds), pa.array(values))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(page, pa.int64()),
                    _lists(n_nodes, _structs(NODE, node)),
                    _lists(n_blocks, _structs(READ_BLOCK, [*block, windows])),
                ],
                names=schema.names,
            )

    return pages.mapInArrow(over, schema)


def distinct_pages(trees: DataFrame, min_pages: int) -> DataFrame:
    """``trees`` without the pages that are near copies of another one of their host."""
    held = trees.select("host", "page", F.explode("blocks.block").alias("block")).distinct()
    counts = held.groupBy("host", "block").agg(F.count(F.lit(1)).alias("c"))
    totals = trees.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    # At most twice as many blocks of a host as its average page has.
    most = counts.join(totals.filter(F.col("n") >= min_pages), "host").filter("2 * c > n")
    template = cut_lineage(most.groupBy("host").agg(F.collect_set("block").alias("template")))
    known = F.coalesce("template", F.array().cast("array<bigint>"))
    own = F.filter("blocks", lambda b: ~F.array_contains(known, b["block"]))
    windows = F.sort_array(F.array_distinct(F.flatten(F.transform(own, lambda b: b["windows"]))))
    node = F.xxhash64("host", "page").alias(PAGE_NODE)
    measured = cut_lineage(
        trees.join(template, "host", "left").select(F.col("host").alias(HOST), node, F.slice(windows, 1, SKETCH_SIZE).alias(SKETCH))
    )
    variants = near_copies(measured).filter("node <> component").select(F.col("node").alias(PAGE_NODE))
    return trees.withColumn(PAGE_NODE, node).join(variants, PAGE_NODE, "left_anti").drop(PAGE_NODE)


def _composite(group: pd.DataFrame, min_importance: float) -> pd.DataFrame:
    """Importance of the nodes of a host from the leaves up; rows of those below the limit."""
    children: dict[int, list[int]] = {}
    for node, parent in zip(group["node"], group["parent"]):
        children.setdefault(parent, []).append(node)
    score: dict[int, float] = {}
    for row in group.sort_values("depth", ascending=False).itertuples():
        below = [score[c] for c in children.get(row.node, []) if c in score]
        if not math.isnan(row.content):
            below.append(row.content)
        own = row.presentation
        if not below:
            score[row.node] = 1.0  # an empty element has nothing to remove
            continue
        share = 1 - GAMMA ** row.styles
        score[row.node] = share * own + (1 - share) * max(below)
    low = [n for n, s in score.items() if s < min_importance]
    return pd.DataFrame({"host": [group["host"].iloc[0]] * len(low), "low": low})


def unimportant(trees: DataFrame, min_pages: int = 3, min_importance: float = 0.2) -> DataFrame:
    """(host, low array) of the nodes and blocks to remove from the pages of a host.

    All counts are of distinct pages, taken in two steps that combine on the map side. Rows that
    reach the grouping by host are nodes of at least ``min_pages`` pages: the site's template.
    """
    nodes = trees.select("host", "page", F.explode("nodes").alias("n")).select("host", "page", "n.*").distinct()
    shown = nodes.groupBy("host", "node", "parent", "depth", "shown").agg(F.count(F.lit(1)).alias("k"))
    k = F.col("k").cast("double")
    styles = (
        shown.groupBy("host", "node", "parent", "depth")
        .agg(F.sum("k").alias("m"), F.count(F.lit(1)).alias("styles"), F.sum(k * F.log(k)).alias("klogk"))
        .filter(F.col("m") >= min_pages)
        .withColumn("presentation", (F.log("m") - F.col("klogk") / F.col("m")) / F.log("m"))
    )
    styles = cut_lineage(styles)
    found = (
        trees.select("host", "page", F.explode("blocks").alias("b"))
        .select("host", "page", "b.*")
        .distinct()
        .groupBy("host", "node", "block")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    judged = cut_lineage(
        found.join(styles.select("host", "node", "m"), ["host", "node"])
        .withColumn("importance", 1 - F.log("c") / F.log("m"))
        .select("host", "node", "block", "importance")
    )
    content = judged.groupBy("host", "node").agg(F.avg("importance").alias("content"))
    template = styles.join(content, ["host", "node"], "left").select(
        "host", "node", "parent", "depth", "styles", "presentation", F.coalesce("content", F.lit(float("nan"))).alias("content")
    )
    low_nodes = template.groupBy("host").applyInPandas(lambda g: _composite(g, min_importance), "host bigint, low bigint")
    low_blocks = judged.filter(F.col("importance") < min_importance).select("host", F.struct("node", "block").alias("both"))
    none = F.lit(None)
    marked = low_nodes.withColumn("both", none.cast(BLOCK)).unionByName(low_blocks.withColumn("low", none.cast("bigint")))
    # A host's removed blocks each stand in many of its pages, so they are few; nodes are its template.
    return marked.groupBy("host").agg(F.collect_set("low").alias("low_nodes"), F.collect_set("both").alias("low_blocks"))


def main_text(source: str, low_nodes: set[int], low_blocks: set[tuple[int, int]]) -> str:
    tree = Page(source)
    stays = {0: True}
    for node, above in tree.parent.items():
        stays[node] = stays[above] and node not in low_nodes
    return " ".join(
        text
        for node, text, noise, _ in tree.blocks
        if not noise and stays[node] and not (low_blocks and (node, _hash(text)) in low_blocks)
    )


def extract(
    pages: DataFrame, id: str = "page_id", url: str = "url", source: str = "html",
    min_pages: int = 3, min_importance: float = 0.2,
) -> DataFrame:
    """(id, url, text) of every row of ``pages``."""
    site = F.lower(F.regexp_extract(whole(F.col(url)), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    host = F.xxhash64(F.when(site == "", F.coalesce(F.col(url), F.lit(""))).otherwise(site)).alias("host")
    read = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), host, whole(F.col(source)).alias("html"))
    trees = cut_lineage(read_trees(read.select("host", "html")))
    trees = cut_lineage(distinct_pages(trees, min_pages).withColumn("blocks", F.transform("blocks", lambda b: b.dropFields("windows"))))
    low = cut_lineage(unimportant(trees, min_pages, min_importance))
    ready = read.join(low, "host", "left").select("id", "url", "host", "html", "low_nodes", "low_blocks")
    kind = read.schema["id"].dataType.simpleString()
    out = f"`{id}` {kind}, `{url}` string, text string"

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[set, set]] = {}
        for batch in batches:
            texts = []
            hosts, sources = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i, (h, s) in enumerate(zip(hosts, sources)):
                if h not in known:
                    if len(known) > 10_000:
                        known.clear()
                    nodes, blocks = batch.column(4)[i].as_py(), batch.column(5)[i].as_py()
                    known[h] = (set(nodes or ()), {(b["node"], b["block"]) for b in blocks or ()})
                texts.append(main_text(s, *known[h]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=[id, url, "text"]
            )

    return ready.mapInArrow(over, out)
