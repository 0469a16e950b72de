"""Operator 5, HTML extraction by consensus host paths.

Every page's containers (article, main, section, div, table cell, body) are
scored by the text they hold without boilerplate and link text.  The page votes
for the generalised tag-class path of its best container; Spark sums the votes
per host and keeps each host's winning path; the page is then extracted again
from the containers on that path (its own best container if it has none there).

Boilerplate is what stands in navigation, header, footer, aside, form and
similar elements, in elements whose class, id or role names such a part
(advert, sidebar, notice, comments, ...; an article only by words for comments), and in
hidden elements.  A name alone does not hide the main text: an element is kept in spite of its
name when the page's largest article, main or so named container lies in it, or when it
holds nearly all of the page's text (``MOST``) and no such container has any, or its name
speaks for main text as well.  Names of comments, notices, adverts and the like (``OTHER``) are kept
so only on pages without an article, main or so named container outside that has
text.  Labels and objects inside a paragraph are text.  Words of a class that says what a layout has
or lacks (has-sidebar, no-banner) name nothing.  A header inside an article, by tag
or by name, keeps its headings.  Blocks are the texts between block-level tags;
``br`` is white space.

Pages are tokenised by one regular expression without nested quantifiers that
could backtrack; tags are closed as browsers do for the cases that matter here
(unclosed p, li, td, inline elements, cut-off pages).

Defined cases: null or empty html and pages without text outside boilerplate
give the empty text.  Pages with a null url vote together as host "".  Repeated
rows give repeated results.  Only page_id, url and html are read.
"""

from __future__ import annotations

import hashlib
import html as charrefs
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.llm.common import enter, query, small_batches, table, written
from plantlens.llm.urls import host

CONTAINERS = frozenset("article main section div td th body html".split())
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr caption blockquote pre figure figcaption address "
    "header footer nav aside form fieldset hr details summary dialog menu center hgroup search".split())
SKIPPED = frozenset(
    "head nav footer aside form button select option menu dialog noscript template iframe object svg canvas audio video "
    "fieldset label input search".split())
RAW = "script style textarea title xmp noembed noframes".split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class, id or role that name boilerplate.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar aside footer header masthead notice notices cookie cookies consent popup modal overlay "
    "newsletter subscribe signup login form search share sharing social related recommended comment comments disqus reply "
    "replies respond widget toolbar pagination pager hidden complementary contentinfo".split())
#: Those of an article that is a reader's comment.
COMMENTS = frozenset("comment comments disqus reply replies respond".split())
#: Words for text that is not the page's own, whatever else the name says; the others of
#: ``NOISE`` say where an element stands, and may name a wrapper of the main text.
OTHER = COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion notice notices cookie cookies consent "
    "popup modal newsletter subscribe sharing social related recommended".split())
#: Skipped elements that are text inside a paragraph (a form is skipped with all its paragraphs).
IN_TEXT = frozenset("label object".split())
#: Words of a class or id that name the main text.
MAIN = frozenset("article content post entry main story text body prose".split())
#: First words of a class that says what the page has, not what the element is.
LAYOUT = frozenset("has no not with without".split())
#: Share of the page's text from which a name does not make an element boilerplate.
MOST = 0.9
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that close an open element of the listed tags, up to the nearest container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}}

#: Characters of a path beyond which its upper part is replaced by a digest.
LONG_PATH = 2000

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<(?P<raw>" + "|".join(RAW) + r")\b[^>]*>(?:.*?</(?P=raw)\s*>|.*)|<[!?][^>]*>?"
    r"|<(?P<end>/)?(?P<tag>[a-z][^\s/><]*)(?P<attr>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+[^<>]*+)>?", re.I | re.S)
_ATTR = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page:
    """Containers and non-boilerplate blocks of a page."""

    def __init__(self, source: str) -> None:
        self.parent, self.path, self.weight, self.depth = [-1], [""], [0.9], [0]
        self.blocks: list[tuple[int, str, int]] = []  # (container, text, characters in links)
        # (tag, container, state, region); state: 0 text, 1 headings only, 2 nothing
        self._stack: list[tuple[str, int, int, int]] = []
        # regions: elements that are boilerplate by name, until _judge; 0 is the page
        self._above, self._mixed, self._region = [0], [0], [0]  # of regions: region around, own container if main by name; of containers: region
        self._other = [False]  # of regions: whether they are named as other text than the page's own
        self._block_region: list[int] = []
        self._opened: Counter = Counter()  # tags in the stack
        self._pieces: dict[int, list[str]] = {}  # by region
        self._links, self._linked = 0, Counter()
        at = 0
        for m in _TOKEN.finditer(source):
            if m.start() > at:
                self._text(source[at:m.start()])
            at = m.end()
            if m["tag"]:
                tag = m["tag"].lower()
                self._close(tag) if m["end"] else self._open(tag, m["attr"])
        if at < len(source):
            self._text(source[at:])
        self._flush()
        self._judge()

    def _top(self) -> tuple[int, int, int]:
        return self._stack[-1][1:] if self._stack else (0, 0, 0)

    def _text(self, raw: str) -> None:
        _, state, region = self._top()
        if state == 0:
            text = charrefs.unescape(raw) if "&" in raw else raw
            self._pieces.setdefault(region, []).append(text)
            if self._links:
                self._linked[region] += len(text.strip())

    def _flush(self) -> None:
        if self._pieces:
            for region, pieces in self._pieces.items():
                text = " ".join("".join(pieces).split())
                if text:
                    self.blocks.append((self._top()[0], text, min(self._linked[region], len(text))))
                    self._block_region.append(region)
            self._pieces = {}
            self._linked.clear()

    def _judge(self) -> None:
        """Take the blocks out that are boilerplate by the name of an element around them."""
        if len(self._above) == 1:
            return
        own, mass = [0.0] * len(self._above), [0.0] * len(self.parent)  # without the regions inside
        for (node, text, linked), region in zip(self.blocks, self._block_region):
            own[region] += len(text) - 0.9 * linked
            if self._region[node] == region:
                mass[node] += len(text) - 0.9 * linked
        for k in range(len(mass) - 1, 0, -1):
            if self._region[k] == self._region[self.parent[k]]:
                mass[self.parent[k]] += mass[k]
        # comments and notices compete only if no main text stands outside, however long they are
        outside = any(m > 0 and w > 1 and not r for m, w, r in zip(mass, self.weight, self._region))
        barred = [outside and other for other in self._other]
        main = max(range(len(mass)), key=lambda k: (mass[k] * (self.weight[k] > 1 and not barred[self._region[k]]), self._region[k] == 0))
        full = max(range(len(own)), key=lambda k: own[k] * (not barred[k]))
        opened = 0
        if own[full] > MOST * sum(own) and (self._mixed[full] or not mass[main] * (self.weight[main] > 1)):
            opened = full
        elif self.weight[main] > 1 and mass[main]:
            opened = self._region[main]
        kept = {0}
        while opened:
            kept.add(opened)
            if self._mixed[opened]:
                self.weight[self._mixed[opened]] = 1.5
            opened = self._above[opened]
        self.blocks = [b for b, region in zip(self.blocks, self._block_region) if region in kept]

    def _open(self, tag: str, attr: str) -> None:
        if tag in VOID:
            if tag == "br":
                self._text(" ")
            elif tag == "hr":
                self._flush()
            return
        if tag in BLOCKS:
            self._flush()
            self._drop({"p", "h1", "h2", "h3", "h4", "h5", "h6"} if tag != "p" else {"p"}, CONTAINERS | {"li", "blockquote", "figure"})
            self._drop(CLOSES.get(tag, ()), {"ul", "ol", "dl", "table", "select"} | (CONTAINERS - {"td", "th"}))
        node, state, region = self._top()
        names = self._names(attr) if attr.strip() else ("", frozenset(), False)
        noise = names[1] & (COMMENTS if tag == "article" else NOISE if tag not in ("body", "html", "main") else frozenset())
        if names[2] or tag in SKIPPED and not (tag in IN_TEXT and self._opened["p"]):
            state = 2
        elif self._opened["article"] and (tag == "header" or noise == {"header"}):
            state = max(state, 1)
        elif tag == "header":
            state = 2
        elif noise and state < 2:
            self._other.append(self._other[region] or bool(noise & OTHER))
            self._above.append(region)
            self._mixed.append(0)
            region = len(self._above) - 1
        if state == 1 and tag in HEADINGS:
            state = 0
        if tag in CONTAINERS and state < 2:
            self.parent.append(node)
            above = self.path[node]
            if len(above) > LONG_PATH:  # of very deep pages, so that paths stay short
                above = hashlib.md5(above.encode()).hexdigest()
            self.path.append(f"{above}/{tag}{names[0]}")
            self.weight.append(1.5 if tag == "main" or tag == "article" and not noise or names[1] & MAIN and not noise and tag in ("div", "section", "td") else 1.0)
            self._region.append(region)
            if noise and names[1] & MAIN and tag in ("div", "section", "td") and region:
                self._mixed[region] = len(self.parent) - 1
            self.depth.append(self.depth[node] + 1)
            node = len(self.parent) - 1
        if tag == "a":
            self._links += 1
        self._stack.append((tag, node, state, region))
        self._opened[tag] += 1

    def _drop(self, tags, until) -> None:
        """Pop an open element of ``tags``, with what is open in it, not beyond ``until``."""
        if not any(self._opened[t] for t in tags):
            return
        for k in range(len(self._stack) - 1, -1, -1):
            if self._stack[k][0] in tags:
                self._pop(k)
                return
            if self._stack[k][0] in until:
                return

    def _pop(self, k: int) -> None:
        for tag, _, _, _ in self._stack[k:]:
            self._links -= tag == "a"
            self._opened[tag] -= 1
        del self._stack[k:]

    def _close(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        if not self._opened[tag]:
            return
        for k in range(len(self._stack) - 1, -1, -1):
            if self._stack[k][0] == tag:
                self._pop(k)
                return
            if tag not in BLOCKS and self._stack[k][0] in CONTAINERS:
                return  # an inline end tag does not close a container
            if tag not in CONTAINERS and tag in BLOCKS and self._stack[k][0] in CONTAINERS - {"td", "th"}:
                return

    @staticmethod
    def _names(attr: str) -> tuple[str, frozenset, bool]:
        """(generalised class suffix, words of class, id and role, is hidden)."""
        classes, words, hidden = "", set(), False
        for name, value in _ATTR.findall(attr):
            name, value = name.lower(), value.strip("\"'")
            if name == "class":
                classes = "".join(f".{c}" for c in sorted({re.sub(r"\d+", "#", c.lower()) for c in value.split()}))
            if name in ("class", "id", "role"):
                for own in value.split():
                    found = [w.lower() for w in _WORD.findall(own)]
                    words |= set(found) if found and not LAYOUT & set(found) else set()
            hidden |= name == "hidden" or name == "aria-hidden" and value == "true" or (
                name == "style" and "display:none" in value.replace(" ", "").lower())
        return classes, frozenset(words), hidden

    def best(self) -> tuple[str, float] | None:
        """Path and share of the page's text of the best container."""
        mass = [0.0] * len(self.parent)
        for node, text, linked in self.blocks:
            mass[node] += len(text) - 0.9 * linked
        for k in range(len(mass) - 1, 0, -1):  # children come after their parents
            mass[self.parent[k]] += mass[k]
        if not mass[0]:
            return None
        top = max(range(len(mass)), key=lambda k: mass[k] * self.weight[k] * (1 + 0.01 * min(self.depth[k], 20)))
        return self.path[top], mass[top] / mass[0]

    def text(self, path: str | None) -> str:
        """The blocks below the containers on a path, joined by line feeds."""
        inside = [p == path for p in self.path]
        for k in range(1, len(inside)):  # parents come before their children
            inside[k] = inside[k] or inside[self.parent[k]]
        return "\n".join(text for node, text, _ in self.blocks if inside[node])


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enter("html_extract")
    for batch in batches:
        hosts, paths, shares = [], [], []
        for name, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            best = Page(source).best() if source else None
            if best:
                hosts.append(name)
                paths.append(best[0])
                shares.append(best[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(shares, pa.float64())], names=["host", "path", "share"])


def consensus(pages: DataFrame) -> DataFrame:
    """(host, path): the generalised path that most pages of the host vote for (then the
    larger share of text, then the first in order)."""
    small_batches(pages.sparkSession)
    votes = (pages.select(host().alias("host"), "html").mapInArrow(_vote, "host string, path string, share double")
             .groupBy("host", "path").agg(F.count("*").alias("votes"), F.round(F.sum("share"), 6).alias("share")))
    return votes.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("v"), (-F.col("share")).alias("s"), "path")).alias("top")).select(
        "host", F.col("top.path").alias("path"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enter("html_extract")
    for batch in batches:
        texts = []
        for source, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            text = ""
            if source:
                page = Page(source)
                text = page.text(path) if path is not None else ""
                if not text and (own := page.best()):
                    text = page.text(own[0])
            texts.append(text)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page, from the winning path of its host."""
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host().alias("_host"))
    winners = written(consensus(pages), "host-paths").withColumnRenamed("host", "_host")
    # a table of known size: Spark broadcasts it only below its own threshold, else splits hot hosts
    return rows.join(winners, "_host", "left").select("page_id", "url", "html", "path").mapInArrow(
        _extract, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string")


@query("op5_html_extract", oracle=r"""
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM (
  SELECT page_id, url, array_to_string(list_filter(list_transform(
      regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1), '(?:<p>|</p>|<h1>|</h1>)+'),
      lambda b: trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(b, '<[^>]*>', ' ', 'g'),
          '&quot;?', '"', 'g'), '&amp;?', chr(1), 'g'), '&lt;', '<'), '&gt;', '>'), chr(1), '&'), '[ \t\n\r]+', ' ', 'g'))),
      lambda b: b <> ''), chr(10)) AS text FROM pages)""")
def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
