"""Main text of web pages: templates deduced from the pages of one host, and tag rules.

Tokens of a page are its tags and the words of its short texts, each with the path of tags above it, and its long texts
as wholes. Tokens of a host that occur equally often on every one of its pages share an occurrence vector and form an
equivalence class. A class is valid if it is large enough and on enough pages; valid classes nest into each other's
gaps and make the host's template. What lies between template tokens are slots. Host-wide figures give them their role: the
article is in the innermost template element whose slots hold most of the text that differs from page to page and is no
link, and all of its h1 headings. Tags and names of classes then rule out what is known to be something else.
"""

from __future__ import annotations

import functools
import html as H
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.llm import textkit as K
from vecloom.llm.storage import table
from vecloom.llm.textkit import mix
from vecloom.llm.urls import host_of

SHORT_WORDS = 12  # texts of up to so many words are tokens word by word
MIN_PAGES = 2  # of a host, for a template: one page alone shows no occurrence vectors
MIN_SHARE = 4  # a class is on at least one page in so many
MIN_CLASS = 3  # tokens
SALTS = 32

# Elements by role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe object svg math canvas audio video head title textarea select".split())
BLOCKS = set("p div section article main h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address hr fieldset details summary header footer nav aside form body html center hgroup search dialog menu button".split())
ENDS_P = BLOCKS - {"html", "body", "button", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
BOILERPLATE = set("nav footer aside form dialog menu button search".split())
BOILERPLATE_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
# Own choice: words in class or id names that mark a block as something other than the article.
BOILERPLATE_NAMES = set(
    "ad ads adv advert advertisement adverts adsense sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
    "subscription signup paywall sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments disqus respond replies reply discussion related recommended "
    "recommendations share sharing social toolbar widget widgets pagination pager skip".split()
)
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>""")
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_END = {name: re.compile(f"</{name}", re.IGNORECASE | re.ASCII) for name in RAW}
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
# Own choice: elements that can hold an article; first words of class names that say what is absent or beside.
CONTAINERS = set("body div section article main center table tbody tr td ul ol dl details header footer nav aside form figure fieldset hgroup search dialog menu".split())
NEGATIONS = set("has no not with without hide is".split())
MOST_DEPTH = 64  # containers around a block, from the outermost, that can be its article
EDGE = 0x5D39A1C4E2B7F683


def events(html: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", name, attributes) and ("close", name, "") in page order; comments, declarations and the
    contents of raw elements are left out."""
    at, size = 0, len(html)
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            yield "text", html[at:], ""
            return
        if lt > at:
            yield "text", html[at:lt], ""
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), lt):
            end = html.find(">", lt)
            at = size if end < 0 else end + 1
            continue
        m = _TAG.match(html, lt)
        if m is None:
            end = html.find(">", lt)
            if end > 0 and re.match("</?[a-zA-Z]", html[lt : lt + 3]):  # quotes that don't match
                name = re.match("</?([a-zA-Z0-9]+)", html[lt : end + 1])[1]
                yield ("close" if html[lt + 1] == "/" else "open"), name.lower(), ""
                at = end + 1
            else:
                yield "text", "<", ""
                at = lt + 1
            continue
        at, name = m.end(), m[2].lower()
        if m[1]:
            yield "close", name, ""
        elif name in RAW:
            end = _END[name].search(html, at)
            close = -1 if end is None else html.find(">", end.end())
            at = size if close < 0 else close + 1
        else:
            yield "open", name, m[3]


def _attributes(raw: str) -> dict[str, str]:
    raw = raw.strip()
    return {m[1].lower(): H.unescape((m[2] or "").strip("\"'")) for m in _ATTR.finditer(raw)} if raw else {}


def _names(attributes: dict[str, str]) -> set[str]:
    return {w.lower() for k in ("class", "id") if k in attributes for w in _NAME.findall(attributes[k])}


def _marked(attributes: dict[str, str]) -> bool:
    """Whether a class or id, taken by itself, is named like something other than the article: `cookie-notice`, `sidebarLeft`, but
    not `has-sidebar`."""
    for name in (attributes.get("class", "") + " " + attributes.get("id", "")).split():
        words = [w.lower() for w in _NAME.findall(name)]
        if words and words[0] not in NEGATIONS and BOILERPLATE_NAMES.intersection(words):
            return True
    return False


@functools.lru_cache(100_000)
def _says(name: str, raw: str) -> tuple[str, bool, bool, bool]:
    """What an element says of itself, whatever is above it: its part of the path, whether it is (or may hold) the article,
    whether it is something else, and whether its class only is named so."""
    attributes = _attributes(raw)
    role = attributes.get("role", "").lower()
    skip = name in BOILERPLATE or role in BOILERPLATE_ROLES or "hidden" in attributes
    skip = skip or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
    part = " ".join([name, *sorted(_names(attributes))])
    outer = name in ("html", "body")
    return part, name in ("article", "main") or role in ("article", "main"), skip and not outer, _marked(attributes) and not outer


@functools.lru_cache(100_000)
def _path(above: int, part: str) -> int:
    return xxhash.xxh3_64_intdigest(part, above)


class Mark:
    """An element whose class is named like something other than the article, and what it turns out to hold."""

    __slots__ = ("articles", "inside", "size")

    def __init__(self, inside: bool):
        self.inside, self.articles, self.size = inside, 0, 0  # inside: of an article


class Node:
    """An open element: its path's hash, and what it and those above it say about the text in it."""

    __slots__ = ("chain", "h1", "link", "main", "marks", "name", "path", "skip")

    def __init__(self, name: str, path: int, main: bool, skip: bool, marks: tuple = (), chain: tuple = (), link: bool = False, h1: bool = False):
        self.name, self.path, self.main, self.skip = name, path, main, skip
        self.marks, self.chain, self.link, self.h1 = marks, chain, link, h1


class Text:
    """A block of text: its path, the containers around it, how many of its characters are links, whether it is in an h1
    heading, whether tags place it in the article, and whether tags or names rule it out."""

    __slots__ = ("chain", "h1", "links", "main", "marks", "order", "parts", "path", "skip", "text")

    def __init__(self, top: Node, order: int):
        self.parts: list[str] = []
        self.main, self.skip, self.path, self.marks, self.chain, self.h1 = top.main, top.skip, top.path, top.marks, top.chain, top.h1
        self.order, self.text, self.links = order, "", 0

    def close(self) -> str:
        raw = "".join(self.parts)
        self.text = " ".join((H.unescape(raw) if "&" in raw else raw).split())
        return self.text


def _rule_out_marked(blocks: list[Text], articles: int) -> None:
    """Names rule out what they are on, but not the only article of a page nor what it is in, and on pages without an article not
    what holds most of the text."""
    total = 0
    for b in blocks:
        if not b.skip:
            total += len(b.text)
            for m in b.marks:
                m.size += len(b.text)
    for b in blocks:
        for m in b.marks:
            spared = not m.inside and (m.articles == articles if articles else 2 * m.size > total)
            b.skip = b.skip or not spared


def read_page(html: str, rules: bool = True) -> tuple[list[tuple[int, int]], list[Text]]:
    """((token, position) of its tags, the blocks of text in page order). Without `rules` no tag or name says what a text is."""
    stack = [Node("", 0, False, False)]
    tags: list[tuple[int, int]] = []
    blocks: list[Text] = []
    current: Text | None = None
    order, articles = 0, 0
    for kind, value, raw in events(html):
        order += 1
        if kind == "text":
            top = stack[-1]
            if current is None:
                if not value.strip():
                    continue
                current = Text(top, order)
                blocks.append(current)
            current.parts.append(value)
            if top.link:
                current.links += len(value)
            continue
        if value in BLOCKS:
            current = None
        elif current is not None and value == "br":
            current.parts.append(" ")
        if kind == "close":
            tags.append((_path(stack[-1].path, "/" + value), order))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == value:
                    del stack[i:]
                    break
                if stack[i].name in ("article", "main", "body") and value not in ("body", "html", "main", "article"):
                    break  # a stray end tag closes nothing outside
            continue
        if value in ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "p":
                    del stack[i:]
                    break
                if stack[i].name in BLOCKS:
                    break
        if value == "li" and stack[-1].name == "li":
            stack.pop()
        above = stack[-1]
        part, article, other, marked = _says(value, raw)
        skip = rules and (above.skip or other or (value == "header" and not above.main))
        main = rules and (above.main or (article and not skip))
        path = _path(above.path, part)
        tags.append((path, order))
        marks = above.marks
        if rules and marked and not skip:
            marks = (*marks, Mark(above.main))
        if main and not above.main:
            articles += 1
            for m in marks:
                m.articles += 1
        if value not in VOID and not raw.endswith("/"):
            chain = (*above.chain, path) if value in CONTAINERS and len(above.chain) < MOST_DEPTH else above.chain
            stack.append(Node(value, path, main, skip, marks, chain, above.link or value == "a", above.h1 or value == "h1"))
    blocks = [b for b in blocks if b.close()]
    _rule_out_marked(blocks, articles)
    return tags, blocks


def text_tokens(block: Text) -> list[int]:
    """A token per word of a short text, one for a long text."""
    if block.text.count(" ") >= SHORT_WORDS:
        return [xxhash.xxh3_64_intdigest(block.text, block.path)]
    return [xxhash.xxh3_64_intdigest(" " + w, block.path) for w in block.text.split()]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


TOKENS = "host string, token long, vector long, pages long, places long, chars long, head long, path long, region long"


def page_tokens(pages: DataFrame) -> DataFrame:
    """(host, token, vector, pages, places, chars, head, path, region) of (page, host, html): per host and token a fingerprint of its
    occurrence vector, the number of pages it is on, and the sum of its first places on them. Token 0 stands for the page.
    A text token has the path of its block and the characters outside links, and those of them in h1 headings. Rows with a
    region are no tokens: they say that blocks of a path lie in a container, and how deep that is (`places`).

    The fingerprint is the sum, modulo 2^64, of a hash of page and count over the pages: it does not depend on order, so
    it is summed within the batch, within the task and behind the shuffle.
    """

    @K.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, number = [], {}
            host_of_row, token, page, count, place, chars, head, path = [], [], [], [], [], [], [], []
            edges: set[tuple[int, int, int, int]] = set()
            for p, host, html in zip(b.column(0).to_numpy(), b.column(1).to_pylist(), b.column(2), strict=True):
                h = number.setdefault(host, len(number))
                if h == len(hosts):
                    hosts.append(host)
                seen: dict[int, list[int]] = {0: [1, 0, 0, 0, 0]}
                tags, blocks = read_page(html.as_py() or "")
                for t, order in tags:
                    if t in seen:
                        seen[t][0] += 1
                    else:
                        seen[t] = [1, order, 0, 0, 0]
                for x in blocks:
                    found = text_tokens(x)
                    share = max(0, len(x.text) - x.links) // len(found)
                    for t in found:
                        v = seen.setdefault(t, [0, x.order, 0, 0, x.path])
                        v[0] += 1
                        v[2] += share
                        v[3] += share * x.h1
                    edges.update((h, x.path, region, depth) for depth, region in enumerate(x.chain))
                n = len(seen)
                host_of_row += [h] * n
                page += [p] * n
                token += list(seen)
                for column, i in ((count, 0), (place, 1), (chars, 2), (head, 3), (path, 4)):
                    column += [v[i] for v in seen.values()]
            if not token:
                continue
            h, t = np.array(host_of_row), np.array(token, np.uint64)
            vector = mix(np.array(page, np.int64).astype(np.uint64) + mix(np.array(count, np.uint64)))
            order = np.lexsort((t, h))
            h, t = h[order], t[order]
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])]))
            sums = [pa.array(np.add.reduceat(np.array(x, np.int64)[order], first)) for x in (place, chars, head)]
            names = TOKENS.replace(",", "").split()[::2]
            none = pa.array(np.zeros(len(first), np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts).take(pa.array(h[first])), _signed(t[first]), _signed(np.add.reduceat(vector[order], first)), pa.array(np.diff(np.append(first, len(t))).astype(np.int64)), *sums, _signed(np.array(path, np.uint64)[order][first]), none], names=names
            )
            if edges:
                e = np.array([[a, 0, 0, d] for a, _, _, d in edges], np.int64)
                block, region = (np.array([x[i] for x in edges], np.uint64) for i in (1, 2))
                none = pa.array(np.zeros(len(e), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(hosts).take(pa.array(e[:, 0])), _signed(mix(block + mix(region + np.uint64(EDGE)))), none, none, pa.array(e[:, 3]), none, none, _signed(block), _signed(region)], names=names)

    return pages.mapInArrow(run, TOKENS)


def templates(pages: DataFrame) -> DataFrame:
    """(host, template, regions): the tokens of the host's valid classes as (place, token, vector, everywhere), in order, and the
    template elements that hold most of the host's text, outermost first, as (depth, region, head).

    A class has at least MIN_CLASS tokens, on one page in MIN_SHARE of a host of at least MIN_PAGES. Every token of it is
    on so many pages that a host has at most MIN_SHARE times as many as a page has, however many pages it has. The text that
    counts is that of tokens on fewer pages than that, or on one only, outside links; an element's is that of all blocks in it.
    """
    wrapped = F.expr("cast(pmod(sum(cast(vector as decimal(38,0))), cast('18446744073709551616' as decimal(38,0))) - cast('9223372036854775808' as decimal(38,0)) as long)")
    sums = [F.sum(c).alias(c) for c in ("pages", "chars", "head")]
    stats = page_tokens(pages).groupBy("host", "token").agg(wrapped.alias("vector"), *sums, F.sum("places").alias("places"), F.max("places").alias("depth"), F.max("path").alias("path"), F.max("region").alias("region"), F.min("region").alias("region_2"))
    stats = table(stats.withColumn("region", F.when(F.col("region") != 0, F.col("region")).otherwise(F.col("region_2"))).drop("region_2"), "tokens")
    tokens = stats.filter("region = 0")
    hosts = tokens.filter("token = 0").select("host", F.col("pages").alias("host_pages")).filter(F.col("host_pages") >= MIN_PAGES)
    known = tokens.filter("token != 0").join(hosts, "host").withColumn("often", F.col("pages") * MIN_SHARE >= F.col("host_pages"))
    classes = known.filter("often").groupBy("host", "vector", "pages", "host_pages").agg(F.collect_list(F.struct((F.col("places") / F.col("pages")).alias("place"), "token")).alias("tokens"))
    valid = classes.filter(F.size("tokens") >= MIN_CLASS).withColumn("everywhere", F.col("pages") == F.col("host_pages"))
    rows = valid.select("host", F.explode("tokens").alias("t"), "vector", "everywhere")
    template = rows.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("t.place", "t.token", "vector", "everywhere"))).alias("template"))

    varying = known.filter("(pages = 1 OR NOT often) AND chars > 0").groupBy("host", "path").agg(F.sum("chars").alias("chars"), F.sum("head").alias("head"))
    total = varying.groupBy("host").agg(F.sum("chars").alias("total"))
    inside = stats.filter("region != 0").select("host", "path", "region", "depth").join(varying, ["host", "path"])
    held = inside.groupBy("host", "region").agg(F.sum("chars").alias("chars"), F.sum("head").alias("head"), F.max("depth").alias("depth"))
    most = held.join(total, "host").filter("2 * chars > total").join(rows.select("host", F.col("t.token").alias("region")), ["host", "region"])
    regions = most.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("depth", "region", "head"))).alias("regions"))
    return template.join(regions, "host", "left")


class Template:
    """Classes of a host nested into each other: a class lies in the gap of another if all its tokens do. And `article`: the
    path of the element that its slots' figures make the article, or None."""

    def __init__(self, rows: list[dict], regions: list[dict] | None = None):
        # Elements with most of the text lie in one another. An inner one is the article unless headings would be left outside.
        self.article: int | None = None
        for outer, inner in zip([None, *(regions or [])], regions or [], strict=False):
            if outer is not None and inner["head"] < outer["head"]:
                break
            self.article = inner["region"] & (1 << 64) - 1
        self.known = {r["token"] & (1 << 64) - 1: r["everywhere"] for r in rows}
        spans: dict[int, list[float]] = {}
        for r in rows:
            spans.setdefault(r["vector"], []).append(r["place"])
        self.gap: dict[int, tuple[int, int] | None] = {}
        outer = sorted(spans, key=lambda c: spans[c][0] - spans[c][-1])
        for k, c in enumerate(outer):
            self.gap[c] = None
            for above in reversed(outer[:k]):  # the narrowest class that has it in one gap
                a, b = np.searchsorted(spans[above], [spans[c][0], spans[c][-1]])
                if a == b and 0 < a < len(spans[above]):
                    self.gap[c] = (above, int(a))
                    break
        # a class that crosses another's tokens, and lies in no gap of any, is not nested: its tokens are content
        root = outer[0] if outer else None
        crossing = {c for c in outer if c != root and self.gap[c] is None}
        self.slots = {r["token"] & (1 << 64) - 1 for r in rows if r["vector"] not in crossing}

    def fixed(self, block: Text) -> bool:
        """Whether a text is all template, on every page of its host."""
        return all(self.known.get(t, False) and t in self.slots for t in text_tokens(block))


def main_text(html: str, template: Template | None, rules: bool = True) -> str:
    """Text of the article, without what tags and names rule out (`rules`). With a template: the blocks in the slots of its
    article, and those that tags place in an article, which may recur on every page. Where a page has none of these, as on hosts
    of copies: all slots; without a template, or where it leaves no slot, the blocks that tags place in the article, or else
    all."""
    _, blocks = read_page(html, rules)
    good = [b for b in blocks if not b.skip]
    slots = [b for b in good if not template.fixed(b)] if template is not None and template.slots else []
    if slots and template.article is not None:
        slots = [b for b in slots if template.article in b.chain] or slots
    inside = set(map(id, slots))
    kept = [b for b in good if b.main or id(b) in inside] if slots else [b for b in good if b.main] or good
    return "\n".join(b.text for b in kept)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: the id, url, text of the article, n_chars (code points).

    A null or empty page has an empty text. Pages without a host make one host of their own; a host of one page
    has no template, and tags alone decide. Repeated rows count as pages of their own and give repeated results;
    other columns are not read; an empty table gives no rows. Very long pages are read whole.

    Templates are summed from all pages before and behind one shuffle. They are small, but grow with the number of
    hosts, so they are joined; Spark broadcasts them only under its threshold, from their size on disk. Otherwise pages
    meet them by host and salt: no host's pages lie in one task.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    keyed = rows.select(F.xxhash64("id", "url").alias("page"), "host", "html")
    found = table(templates(keyed), "templates").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int"))
    joined = salted.join(found, ["host", "salt"], "left").select("id", "url", "host", "html", "template", "regions")
    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    @K.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Template | None] = {}
        for b in batches:
            texts = []
            for host, html, template, regions in zip(b.column(2).to_pylist(), b.column(3), b.column(4), b.column(5), strict=True):
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    rows_ = template.as_py()
                    known[host] = Template(rows_, regions.as_py()) if rows_ else None
                texts.append(main_text(html.as_py() or "", known[host]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return joined.mapInArrow(run, schema)
