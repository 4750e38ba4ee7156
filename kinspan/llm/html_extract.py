"""Main text of web pages by site style trees."""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinspan.llm.common import drop, staged

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=]?[^\s/>=]*)\s*(=?)\s*")
UNQUOTED = re.compile(r"[^\s>]*")
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "noframes", "xmp")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that are not text of a page.
UNSEEN = frozenset("head script style noscript template iframe object embed applet svg math canvas audio video map title noembed noframes".split())
#: Elements whose whole content is never part of an article.
NEVER = frozenset("nav footer aside form button select datalist textarea input label dialog menu marquee".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar tooltip status form".split())
#: Class and id values that mark such branches, alone or joined by a hyphen to one another and to words of place.
MARKS = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager toc header masthead topbar banner footer foot sidebar aside rail widget widgets "
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "comment comments commentlist disqus reply replies respond discussion share sharing social follow subscribe subscription newsletter signup login search related recommended recommendations more-links "
    "tags taglist toolbar skip copyright".split()
)
PLACES = frozenset("main site page global top bottom left right upper lower primary secondary mobile desktop area list box bar block wrap wrapper container section inner outer posts links link buttons button items item module slot unit panel form icons".split())
#: Elements that a class may mark; a paragraph or a heading of an article keeps its text whatever its class.
HOLDERS = frozenset("article aside center dd details dir div dl fieldset figure footer form header hgroup li menu nav ol section span table tr td ul".split())
#: Marks that count in any hyphenated value, and whose branches go whatever share of a page's text they have; words that undo them.
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored".split())
NOTICES = frozenset("cookie cookies consent gdpr popup modal overlay".split())
STRICT = COMMENTS | ADVERTS | NOTICES
UNDONE = frozenset("no not has with without open opened closed count enabled disabled".split())
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset(("header", "masthead", "banner"))
TITLES = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Different pages of a host that make its tree count; importance up to which a branch is the site's own; the share of its most important sibling's.
LEAST_PAGES, LEAST_IMPORTANCE, LEAST_SHARE = 8, 0.1, 0.65
#: Content entropy up to which a branch is compared with its siblings: one that says something else on most pages is kept.
LEAST_CONTENT = 0.5
#: Share of a page's text from which a marked branch is its wrapper, and share below which article elements are teasers.
WRAPPER, TEASER = 0.8, 0.25
IMPLIED = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
IMPLIED = {k: frozenset(v.split()) for k, v in IMPLIED.items()}
LISTS = ("ul", "ol", "dl", "table", "select")
SCOPES = frozenset("table ul ol dl article section div aside nav footer header main body form blockquote td th li".split())


class Node:
    __slots__ = ("tag", "style", "branch", "children", "parent", "noise", "doubted", "main", "unseen", "solid")

    def __init__(self, tag, style, branch, parent, noise, doubted, main, unseen):
        self.tag, self.style, self.branch, self.parent, self.noise, self.doubted, self.main, self.unseen = tag, style, branch, parent, noise, doubted, main, unseen
        self.children, self.solid = [], 0


class Reader:
    """Reads the tags of a page from left to right. A search that finds nothing is not made again, so all is linear."""

    def __init__(self, page: str):
        self.page, self.gone = page, set()

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def attributes(self, at: int) -> tuple[dict[str, str], bool, int]:
        """The attributes from here, whether the tag closes itself, and the place after its `>`; -1 if the page ends first."""
        out: dict[str, str] = {}
        page, n, valued = self.page, len(self.page), -1
        while at < n:
            if page[at] == ">":
                return out, page[at - 1] == "/" and at != valued, at + 1
            m = ATTRIBUTE.match(page, at)
            start, at = at, m.end()
            value = ""
            if m[2] and at < n:
                if page[at] in "\"'":
                    end = self.find(page[at], at + 1)
                    if end < 0:
                        return out, False, -1
                    value, at = page[at + 1 : end], end + 1
                else:
                    u = UNQUOTED.match(page, at)
                    value, at = u[0], u.end()
                    valued = at  # a slash that ends it is part of it
            if m[1]:
                out.setdefault(m[1].lower(), value)
            elif at == start:
                at += 1
        return out, False, -1


def _marked(values: str) -> set[str]:
    """The marks among class or id values; one joined of several words counts if it has no words but marks and places.

    Comments and adverts count as part of any value, but for one like `has-comments`.
    """
    out = set()
    for value in values.lower().split():
        if value in MARKS:
            out.add(value)
            continue
        parts = [w for w in re.split(r"[^a-z]+", value) if w]
        hits = MARKS.intersection(parts)
        if hits and all(w in MARKS or w in PLACES for w in parts):
            out |= hits
        elif not UNDONE.intersection(parts):
            out |= hits & (COMMENTS | ADVERTS)
    return out


class Builder:
    """Open elements, with the depths at which each tag, block and scope is open, so no search walks up the tree."""

    def __init__(self):
        self.root = Node("#root", "", 0, None, False, False, False, False)
        self.stack, self.open, self.blocks, self.scopes, self.nodes = [self.root], {}, [0], [0], [self.root]

    def push(self, node: Node) -> None:
        depth = len(self.stack)
        self.stack.append(node)
        self.open.setdefault(node.tag, []).append(depth)
        if node.tag in BLOCKS:
            self.blocks.append(depth)
        if node.tag in SCOPES:
            self.scopes.append(depth)

    def pop_to(self, depth: int) -> None:
        """Closes the element at this depth and all inside it."""
        while len(self.stack) > depth:
            self.open[self.stack.pop().tag].pop()
        while self.blocks[-1] >= depth:
            self.blocks.pop()
        while self.scopes[-1] >= depth:
            self.scopes.pop()

    def last(self, tag: str) -> int:
        depths = self.open.get(tag)
        return depths[-1] if depths else 0

    def close(self, tag: str) -> None:
        depth = self.last(tag)
        if depth and not (tag not in BLOCKS and self.blocks[-1] > depth) and not (tag == "p" and self.scopes[-1] > depth):
            self.pop_to(depth)

    def imply(self, tag: str) -> None:
        """A block closes an open paragraph; an item or a cell the one before it."""
        if self.blocks[-1] and self.stack[self.blocks[-1]].tag == "p":
            self.pop_to(self.blocks[-1])
        ends = IMPLIED.get(tag)
        if ends:
            floor = max(map(self.last, LISTS))
            inside = [d for d in map(self.last, ends) if d > floor]
            if inside:
                self.pop_to(min(inside))

    def add(self, tag: str, attrs: dict[str, str]) -> Node:
        parent = self.stack[-1]
        names, name = entities.unescape(attrs.get("class", "")), entities.unescape(attrs.get("id", ""))
        style = re.sub(r"\d{2,}", "0", ".".join([tag, *sorted(set(names.lower().split())), *(["#" + name.lower()] if name else [])]))
        role = attrs.get("role", "").lower()
        noise = parent.noise or tag in NEVER or role in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
        doubted = False
        if not noise and tag in HOLDERS and (names or name):
            marks = _marked(f"{names} {name}")
            # an article's own title block is kept
            if marks and (tag == "article" or not (parent.main and marks <= HEADINGS)):
                noise = not STRICT.isdisjoint(marks)
                doubted = not noise
        if not noise and tag == "header" and not parent.main:
            noise = "header" in HEADINGS
        main = parent.main or tag in MAIN or (bool(MAIN) and (role in ("main", "article") or attrs.get("itemprop", "") == "articleBody"))
        branch = xxhash.xxh64_intdigest(f"{parent.branch}/{style}".encode(), 7) >> 1 if tag in BLOCKS and tag != "p" else parent.branch
        node = Node(tag, style, branch, parent, noise, doubted, main, parent.unseen or tag in UNSEEN)
        parent.children.append(node)
        self.nodes.append(node)
        return node


def tree(page: str | None) -> list[Node]:
    """All elements of a page, parents first. Tolerates unclosed and stray tags; a block start closes an open paragraph.

    A tag that the page's end cuts off is dropped. Takes time and memory in proportion to the page.
    """
    page = page or ""
    reader, built = Reader(page), Builder()
    at = 0
    while at < len(page):
        lt = reader.find("<", at)
        if lt < 0:
            built.stack[-1].children.append(page[at:])
            break
        kind = page[lt + 1 : lt + 2]
        end_tag = kind == "/"
        m = NAME.match(page, lt + 1 + end_tag)
        if m is None:
            if kind in ("!", "?") or end_tag:
                if lt > at:
                    built.stack[-1].children.append(page[at:lt])
                comment = page.startswith("<!--", lt)
                end = reader.find("-->" if comment else ">", lt + 2)
                at = len(page) if end < 0 else end + (3 if comment else 1)
            else:
                built.stack[-1].children.append(page[at : lt + 1])
                at = lt + 1
            continue
        if lt > at:
            built.stack[-1].children.append(page[at:lt])
        tag = m[0].lower()
        attrs, closed, at = reader.attributes(m.end())
        if at < 0:
            break
        if end_tag:
            built.close(tag)
            continue
        if tag in BLOCKS:
            built.imply(tag)
        node = built.add(tag, attrs)
        if tag in RAW:
            end = RAW[tag].search(page, at)
            if tag in ("textarea", "title"):
                node.children.append(page[at : end.start() if end else len(page)])
            if end is None:
                break
            gt = reader.find(">", end.end())
            at = len(page) if gt < 0 else gt + 1
        elif tag not in VOID and not (closed and tag not in BLOCKS):
            built.push(node)
    _settle(built.nodes)
    return built.nodes


def _settle(nodes: list[Node]) -> None:
    """Text of each element (solid: characters outside noise and links), and which branches with doubtful marks are noise.

    A class like `sidebar` on an element with nearly all of the page's text is about its layout, so it is no noise.
    """
    for x in reversed(nodes):
        if x.noise or x.unseen or x.tag == "a":
            x.solid = 0
            continue
        x.solid += sum(len(c) - c.count(" ") for c in x.children if isinstance(c, str) and not c.isspace())
        if x.parent is not None:
            x.parent.solid += x.solid
    enough = WRAPPER * nodes[0].solid
    for x in nodes[1:]:
        x.noise = x.noise or x.parent.noise or (x.doubted and (x.solid == 0 or x.solid < enough))


def parse(page: str | None) -> Node:
    return tree(page)[0]


def blocks(root: Node, low: frozenset[int] | set[int]) -> list[str]:
    """Texts of the blocks left when noise and branches of low importance are gone."""
    out: list[str] = []
    held: list[str] = []

    def flush():
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append(text)

    stack: list = [("in", c) for c in reversed(root.children)]
    while stack:
        what, x = stack.pop()
        if isinstance(x, str):
            held.append(x)
            continue
        if what == "out":
            flush()
            continue
        if x.tag == "br":
            held.append(" ")
            continue
        if x.noise or x.unseen or (x.tag in BLOCKS and low and not x.main and x.branch in low):
            if x.tag in BLOCKS:
                flush()
            continue
        if x.tag in BLOCKS:
            flush()
            stack.append(("out", x))
        stack.extend(("in", c) for c in reversed(x.children))
    flush()
    return out


def _main(root: Node) -> list[Node]:
    """The outermost article and main elements, in page order."""
    found, stack = [], [root]
    while stack:
        x = stack.pop()
        if x.main:
            found.append(x)
        else:
            stack.extend(c for c in reversed(x.children) if isinstance(c, Node) and not c.noise and not c.unseen)
    return found


def _extract(root: Node, low: frozenset[int] | set[int] = frozenset()) -> str:
    parts = [t for x in _main(root) for t in blocks(x, low)]
    if parts and "main" in MAIN and not any(x.tag == "main" for x in _main(root)):
        # article elements with little of the page's text are teasers beside it
        page = blocks(root, low)
        if sum(map(len, parts)) < TEASER * sum(map(len, page)):
            parts = page
    return "\n\n".join(parts or blocks(root, low))


def extract(page: str | None, low: frozenset[int] | set[int] = frozenset()) -> str:
    return _extract(parse(page), low)


def branches(page: str | None) -> list[tuple[int, int, int, int, int, int, int]]:
    """(copy, branch, parent, content, presentation, titled, chars) of each block branch with text.

    A branch is the path of element names, classes and ids; paragraphs and inline elements belong to their branch. A page
    has a branch once, with the contents of all its nodes in order, their children's styles as presentation, whether a
    heading is in it (2 for an h1, 1 for another, else 0), and how much text. Branches inside articles and main elements
    are left out. Pages with the same main text have the same value of copy.
    """
    nodes = tree(page)
    content: dict[int, bytes] = {}
    chars: dict[int, int] = {}
    titled: dict[int, int] = {}
    for x in reversed(nodes):
        parts = [content.get(id(c), b"") if isinstance(c, Node) else " ".join(c.split()).encode() for c in x.children if isinstance(c, str) or not c.unseen]
        parts = [p for p in parts if p]
        if parts:
            content[id(x)] = xxhash.xxh64_digest(b"\0".join(parts))
        chars[id(x)] = sum(chars[id(c)] if isinstance(c, Node) else len(c.strip()) for c in x.children if isinstance(c, str) or not c.unseen)
        titled[id(x)] = max(titled.get(id(x), 0), 2 if x.tag == "h1" else int(x.tag in TITLES))
        if x.parent is not None:
            titled[id(x.parent)] = max(titled.get(id(x.parent), 0), titled[id(x)])
    found: dict[int, tuple[int, list[bytes], list[str], list[int], list[int]]] = {}
    for x in nodes[1:]:
        if x.tag in BLOCKS and x.tag not in ("html", "body", "p") and not x.unseen and not x.parent.main and id(x) in content:
            _, contents, styles, heads, sizes = found.setdefault(x.branch, (x.parent.branch, [], [], [], []))
            contents.append(content[id(x)])
            styles.append(">".join(k.style for k in x.children if isinstance(k, Node)))
            heads.append(titled[id(x)])
            sizes.append(chars[id(x)])
    if not found:
        return []
    of = lambda data: xxhash.xxh64_intdigest(data) >> 1
    copy = of(_extract(nodes[0]).encode())
    return [(copy, b, parent, of(b"\0".join(contents)), of("\0".join(styles).encode()), max(heads), sum(sizes)) for b, (parent, contents, styles, heads, sizes) in found.items()]


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, branch, parent, pages, titled, chars, content, presentation, importance): the merged trees of each host's different pages.

    Pages of a host with the same main text, repeated rows among them, count as one. Content and presentation have the
    collision entropy of their variants over a branch's pages, in units of that of LEAST_PAGES different ones and 1 at
    most: 0 where all pages are the same, and neither more pages nor copies make it smaller. importance is their mean, chars
    the mean length of a branch's text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = [(h, *b) for h, page in zip(x["host"], x["html"], strict=True) for b in branches(page)]
            if rows:
                yield pd.DataFrame(rows, columns=["host", "copy", "branch", "parent", "content", "style", "titled", "chars"])

    nodes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInPandas(run, "host string, copy long, branch long, parent long, content long, style long, titled int, chars long")
    # copies can differ in markup; one of them is taken
    once = nodes.groupBy("host", "branch", "copy").agg(F.min("content").alias("content"), F.min("style").alias("style"), F.min("parent").alias("parent"), F.max("titled").alias("titled"), F.max("chars").alias("chars"))
    counts = once.groupBy("host", "branch", "content", "style").agg(F.count("*").alias("n"), F.min("parent").alias("parent"), F.max("titled").alias("titled"), F.sum("chars").alias("chars"))
    counts = staged(counts, "sst-variants")

    def entropy(of: str) -> DataFrame:
        sums = counts.groupBy("host", "branch", of).agg(F.sum("n").alias("n"), F.min("parent").alias("parent"), F.max("titled").alias("titled"), F.sum("chars").alias("chars")).groupBy("host", "branch")
        sums = sums.agg(F.sum("n").alias("pages"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"), F.min("parent").alias("parent"), F.max("titled").alias("titled"), (F.sum("chars") / F.sum("n")).alias("chars"))
        value = F.least(F.lit(1.0), F.log(F.col("pages") * F.col("pages") / F.col("squares")) / math.log(LEAST_PAGES))
        return sums.select("host", "branch", "parent", "pages", "titled", "chars", value.alias(of))

    both = entropy("content").join(entropy("style").select("host", "branch", F.col("style").alias("presentation")), ["host", "branch"])
    out = staged(both.withColumn("importance", (F.col("content") + F.col("presentation")) / 2), "sst-tree")
    drop(counts)
    return out


def low_branches(tree: DataFrame, least_pages: int = LEAST_PAGES, least: float = LEAST_IMPORTANCE, share: float = LEAST_SHARE) -> DataFrame:
    """(host, low): branches that at least least_pages of a host's pages have and whose importance is low.

    It is if it is no more than `least`, so that all pages say the same; or, for a branch without a heading, no more than
    `share` of that of its most important sibling found on at least half as many pages as any of them. However regular its
    markup, a branch that says something else on most pages (LEAST_CONTENT) is only held against a sibling with the page's
    title and with more text.
    """
    siblings = Window.partitionBy("host", "parent")
    tree = tree.where(F.col("pages") >= least_pages).withColumn("most", F.max("pages").over(siblings))
    often = 2 * F.col("pages") >= F.col("most")
    best = F.max(F.when(often, F.col("importance"))).over(siblings)
    story = F.max(F.when(often & (F.col("titled") == 2), F.struct("importance", "chars"))).over(siblings)
    tree = tree.withColumns({"best": best, "story": story})
    regular = (F.col("content") <= LEAST_CONTENT) & (F.col("importance") <= share * F.col("best"))
    beside = (F.col("importance") <= share * F.col("story.importance")) & (F.col("chars") < F.col("story.chars"))
    low = tree.where((F.col("importance") <= least) | ((F.col("titled") == 0) & (regular | beside)))
    return low.groupBy("host").agg(F.collect_list("branch").alias("low"))


def extract_pages(pages: DataFrame, keep=()) -> DataFrame:
    """page_id, url, the columns in keep, text and n_chars: each page's main text, from the whole html.

    Branches outside articles and main elements that the host's style tree finds of low importance go, and those that
    markup names as menu, header, footer, sidebar, notice, advert, form, script, style or comments, which is all there is
    to go by on a host with few pages. If a page has article or main elements, the outermost of them are taken, in page
    order, with all in them but such markup. Blocks have white space turned into single spaces, references decoded, and are
    joined by two newlines.

    Null and empty html give an empty text; pages with a null url, or one without a host, share a tree; repeated rows
    repeat; branches of equal importance have the same fate; very long and malformed pages are parsed whole in linear time;
    an empty table gives an empty result. Other columns are ignored; those in keep must not be called text or n_chars.
    """
    low = staged(low_branches(style_tree(pages)), "sst-low")
    columns = list(dict.fromkeys(["page_id", "url", *keep]))
    d = pages.select(*columns, "html", host_of(F.col("url")).alias("_host"))
    d = d.join(low.withColumnRenamed("host", "_low_host"), F.col("_host") == F.col("_low_host"), "left").drop("_host", "_low_host")
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in columns) + ", text string, n_chars long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = x[columns].copy()
            out["text"] = [extract(page, frozenset(low.tolist()) if low is not None else frozenset()) for page, low in zip(x["html"], x["low"], strict=True)]
            out["n_chars"] = [len(t) for t in out["text"]]
            yield out

    return d.mapInPandas(run, schema)
