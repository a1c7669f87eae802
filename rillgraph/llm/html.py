"""Main text of web pages by consensus host paths.

1. Every page is parsed and each container scored: the text directly inside its block children, less link text. The best
   containers vote, in Spark, for their generalised path (tag and classes, digit runs as `#`) on the page's host.
2. Votes are summed before the shuffle, so a host with a third of the pages costs one row a task.
3. Every page is parsed again and the text taken from the container at its host's winning path, raised to the `article`
   around it, or to the container that it shares with the `h1`; a page without that path falls back to its own best
   container, then to its body.

The parser reads each character about once: a quote opens a value only behind `=`, and nodes name their parent, so stray quotes
and deep nesting cost no more than their length. An element that is not the article by its tag or by a word of its class or id is
judged by what it holds: a form, or a word that a layout may carry too, is no noise where it holds most of the page's text
(words of menus, adverts or comments: only if the page's articles and h1 headings are in it, or none is anywhere), and a `header` with
paragraphs or headings inside an article belongs to it. Names such as `has-sidebar` are no such words. Entries of one shape with a writer and a
day each, beside the article, are comments without any word. A page whose whole text is noise by words alone gives its largest such part.

Winners (one short row a host) are counted and measured: up to `BROADCAST_HOSTS` rows and `BROADCAST_BYTES` of paths they are
broadcast; beyond, pages and winners are joined by host and salt, so a hot host is spread over `SALTS` tasks.

Defined results: null or empty html gives an empty text; a null url is host '' and votes like any host; repeated rows
come back as often; ties of votes go to the path that sorts first; unclosed, nested and unknown tags are closed as browsers roughly
do, and a tag without its `>` ends with the page. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import heapq
import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches

BROADCAST_HOSTS, BROADCAST_BYTES, SALTS, VOTES = 100_000, 16 << 20, 64, 3

# Elements by their standard role, and words by which pages mark what is not the article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed"}
DROPPED = set("script style noscript template svg math iframe object canvas video audio title head nav footer aside button select textarea input option label menu dialog".split())
BLOCK = set("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPHS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "dd", "dt", "b", "br", "table", "ul", "ol", "tr", "tbody", "dl", "i", "em", "strong", "a", "span"}
# Words of class and id names. Those of layouts too are judged by the text that they hold; after some words a name tells of a page's layout.
NOISE = re.compile(
    r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|nav|navbar|navigation|menu\w*|breadcrumbs?|sidebar|footer|comments?|commentlist|disqus|respond|replies|reply|"
    r"remarks?|guestbook|cookies?|consent|gdpr|newsletter|subscribe|related|recommend\w*|pagination|pager")  # fmt: skip
LAYOUT = re.compile(
    r"banner|side|header|masthead|foot|notice|popup|modal|overlay|signup|login|share|sharing|social|widget|toolbar|skip|search|form|alert|disclaimer|copyright")
TELLS_LAYOUT = set("has with no not without non is free less hide hides hidden layout page template theme open opened closed active enabled disabled ready on off toggled collapsed expanded sticky fixed".split())
#: What names the writer and the day of a comment.
WRITER = set("author user username name avatar by byline nick nickname poster who".split())
DAY = set("date time timestamp day when posted ago published".split())
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "toolbar", "alertdialog"}
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
PARTS = re.compile(r"[_-]+")
OWN_HEADER = re.compile(r"(?:^|[\s_-])(?:entry|post|article|story|content)[_-]header", re.I)
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*)?")
BARE = re.compile(r"[^\s>]*")
DIGITS = re.compile(r"\d+")
#: What an element is by its tag and words: text, never text, noise unless it holds an h1 and most of the text, noise unless it holds most, a header.
TEXT, NEVER, WORD, SOFT, HEADER = range(5)


@functools.lru_cache(maxsize=65_536)
def kind_of(names: str) -> int:
    """TEXT, WORD or SOFT by the names in a class and id. A name counts by its parts (`main-nav`, `sidebarLeft`) unless one of them
    tells of a layout: `has-sidebar`, `no-comments` and `ad-free` say what a page is like, not what an element holds."""
    kind = TEXT
    for name in CAMEL.sub("-", names).lower().split():
        parts = PARTS.split(name)
        if not TELLS_LAYOUT.intersection(parts):
            if any(map(NOISE.fullmatch, parts)):
                return WORD
            if any(map(LAYOUT.fullmatch, parts)):
                kind = SOFT
    return kind


@functools.lru_cache(maxsize=65_536)
def signs_of(names: str) -> int:
    """1 if a class names a writer, 2 if a day, 3 if both."""
    parts = {p for name in CAMEL.sub("-", names).lower().split() for p in PARTS.split(name)}
    return (not WRITER.isdisjoint(parts)) + 2 * (not DAY.isdisjoint(parts))


class Node:
    """An element. `path` numbers its generalised path within its page; `size` is the text in it outside links and scripts; `heads`
    counts articles and headings h1 in it, `signs` says whether it names a writer and a day."""

    __slots__ = ("tag", "parent", "path", "items", "kind", "noise", "size", "h1", "paragraphs", "article", "heads", "signs")

    def __init__(self, tag: str, parent: Node | None, path: int, kind: int):
        self.tag, self.parent, self.path, self.kind = tag, parent, path, kind
        self.items, self.noise, self.size, self.h1, self.paragraphs, self.article, self.heads, self.signs = [], False, 0, False, False, None, 0, 0


class Page:
    """The elements of a page in their order, the root first, and its paths as (path of the parent, name)."""

    def __init__(self, html: str):
        self.nodes: list[Node] = [Node("", None, 0, TEXT)]
        self.paths: list[tuple[int, str]] = [(-1, "")]
        self.known: dict[tuple[int, str], int] = {}
        self._read(html)
        self._judge()

    @property
    def root(self) -> Node:
        return self.nodes[0]

    def path_text(self, path: int) -> str:
        names = []
        while path > 0:
            path, name = self.paths[path]
            names.append(name)
        return ">".join(reversed(names))

    def path_of(self, text: str | None) -> int | None:
        """The number of a path; None if this page doesn't have it."""
        at = 0
        for name in (text or "").split(">"):
            if (at := self.known.get((at, name))) is None:
                return None
        return at

    def _read(self, html: str) -> None:
        stack, opened, at = [self.root], {}, 0
        last = {quote: html.rfind(quote) for quote in "\"'"}
        lower = None
        while (start := html.find("<", at)) >= 0:
            if start > at:
                stack[-1].items.append(html[at:start])
            mark = html[start + 1 : start + 2]
            if mark in "!?" and mark:
                comment = html.startswith("<!--", start)
                end = html.find("-->", start + 2) if comment else html.find(">", start)
                at = len(html) if end < 0 else end + (3 if comment else 1)
                continue
            closing = mark == "/"
            if not (name := NAME.match(html, start + 1 + closing)):
                if closing and html[start + 2 : start + 3]:  # a bogus comment
                    end = html.find(">", start)
                    at = len(html) if end < 0 else end + 1
                else:
                    stack[-1].items.append("<")
                    at = start + 1
                continue
            tag = name[0].lower()
            if closing:
                end = html.find(">", name.end())
                at = len(html) if end < 0 else end + 1
                if opened.get(tag):
                    while True:
                        opened[(top := stack.pop()).tag] -= 1
                        if top.tag == tag:
                            break
                continue
            given, empty, at = self._attributes(html, name.end(), last)
            if tag in BLOCK and tag != "br":
                while len(stack) > 1 and (stack[-1].tag == "p" or stack[-1].tag in ("b", "i", "em", "strong", "span", "font", "u") and any(n.tag == "p" for n in stack[-3:])):
                    opened[stack.pop().tag] -= 1
            if tag in ("li", "tr", "td", "th", "dd", "dt", "option") and stack[-1].tag == tag:
                opened[stack.pop().tag] -= 1
            node = self._node(tag, stack[-1], given)
            if tag in RAW:
                lower = html.lower() if lower is None else lower  # same length but for a few letters, which the check below sees
                close = lower.find(f"</{tag}", at) if len(lower) == len(html) else next((m.start() for m in re.compile(f"</{tag}", re.I).finditer(html, at)), -1)
                end = len(html) if close < 0 else close
                node.items.append(html[at:end])
                at = end
            elif tag not in VOID and not empty:
                stack.append(node)
                opened[tag] = opened.get(tag, 0) + 1
        if at < len(html):
            stack[-1].items.append(html[at:])

    @staticmethod
    def _attributes(html: str, at: int, last: dict[str, int]) -> tuple[dict[str, str], bool, int]:
        """Attributes by name, whether the tag ends in `/>`, and the place behind it. A quote without its end is a plain character."""
        given: dict[str, str] = {}
        while m := ATTRIBUTE.match(html, at):
            at, value = m.end(), ""
            if html[m.end(1) : at].strip() == "=":
                quote = html[at : at + 1]
                if quote and quote in last and last[quote] > at:
                    end = html.index(quote, at + 1)
                    value, at = html[at + 1 : end], end + 1
                else:
                    bare = BARE.match(html, at)
                    value, at = bare[0], bare.end()
            given.setdefault(m[1].lower(), value)
        end = html.find(">", at)
        return given, end > 0 and html[end - 1] == "/" and not (given and next(reversed(given.values())).endswith("/")), len(html) if end < 0 else end + 1

    def _node(self, tag: str, parent: Node, given: dict[str, str]) -> Node:
        classes = unescape(given.get("class", ""))
        kind, words = TEXT, kind_of(f"{classes} {given.get('id', '')}")
        if tag in DROPPED or "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", ""):
            kind = NEVER
        elif tag == "header":
            kind = HEADER
        elif tag not in ("html", "body", "article", "main"):
            if words == WORD:
                kind = WORD
            elif tag == "form" or given.get("role", "").lower() in {*NOISE_ROLES, "form"} or words == SOFT:
                kind = SOFT
        if kind == HEADER and OWN_HEADER.search(classes):
            kind = TEXT
        name = DIGITS.sub("#", ".".join([tag, *sorted(classes.lower().split())])).replace(">", "")
        if (path := self.known.get((parent.path, name))) is None:
            path = self.known[parent.path, name] = len(self.paths)
            self.paths.append((parent.path, name))
        node = Node(tag, parent, path, kind)
        node.heads = int(tag in ("h1", "main") or tag == "article" and words != WORD)
        node.signs = signs_of(classes) | (2 if tag == "time" else 1 if given.get("rel") == "author" else 0)
        parent.items.append(node)
        self.nodes.append(node)
        return node

    def _judge(self) -> None:
        """Decide what is noise: sizes are summed from the last element to the first, so children come before their parents."""
        for node in reversed(self.nodes):
            if node.kind == NEVER:
                node.size = 0
            elif node.tag != "a":
                node.size += sum(len(x.strip()) for x in node.items if isinstance(x, str))
            if node.kind != NEVER and (up := node.parent):
                up.size += node.size
                up.h1 |= node.h1 or node.tag == "h1"
                up.paragraphs |= node.paragraphs or node.tag in ("p", "h1", "h2", "h3")
                up.heads += node.heads
                up.signs |= node.signs
        most = self.root.size / 2
        self._find_comments()
        for node in self.nodes:
            up = node.parent
            node.article = node if node.tag == "article" or node.tag == "main" and not (up and up.article) else up and up.article
            large = node.size > most
            if node.kind == NEVER:
                node.noise = True
            elif node.kind == WORD:
                node.noise = not large or not self._holds_the_page(node)
            elif node.kind == SOFT:
                node.noise = not large
            elif node.kind == HEADER:
                node.noise = not (large or node.article and node.paragraphs)
            node.noise |= up is not None and up.noise


    def _holds_the_page(self, node: Node) -> bool:
        """Of an element with most of the text: whether the article is in it, or at least none is beside it."""
        beside = self.root.heads - node.heads
        return node.heads > 0 or not beside and 4 * (self.root.size - node.size) < node.size

    def _find_comments(self) -> None:
        """Lists of reader comments without a known word: two or more children of one path and shape, each with a writer, a day and
        text, beside what has the page's articles and headings."""
        for node in self.nodes:
            if node.kind != TEXT or node.signs != 3 or node.heads or not self.root.heads:
                continue
            own = [n for n in node.items if isinstance(n, Node)]
            entries = [n for n in own if n.signs == 3 and n.size and n.tag not in ("p", "tr", "td")]
            if len(entries) > 1 and len({n.path for n in entries}) == 1 and len({tuple(c.path for c in n.items if isinstance(c, Node) and c.tag != "p") for n in entries}) == 1 and len(own) - len(entries) <= 2:
                node.kind = WORD

    def rescued(self) -> Node | None:
        """Where all text lies in noise: the largest element that is noise by a word alone and holds paragraphs or much text; its
        words, and those of what it lies in, no longer count."""
        found = [n for n in self.nodes if n.kind in (WORD, SOFT, HEADER) and n.size and (n.paragraphs or n.size >= 200)]
        best = max(found, key=lambda n: n.size, default=None)
        if best:
            best.noise, inside = False, {id(best)}
            for n in self.nodes:
                if id(n.parent) in inside:
                    inside.add(id(n))
                    n.noise = n.parent.noise or n.kind in (NEVER, WORD) or n.kind in (SOFT, HEADER) and 2 * n.size <= best.size
        return best


def text_of(node: Node) -> str:
    """References decoded, white space inside a block one space, blocks joined by one space."""
    blocks: list[list[str]] = [[]]
    todo = [iter(node.items)]
    ends: list[bool] = []
    while todo:
        for item in todo[-1]:
            if isinstance(item, str):
                blocks[-1].append(item)
            elif not item.noise:
                if block := item.tag in BLOCK:
                    blocks.append([])
                todo.append(iter(item.items))
                ends.append(block)
                break
        else:
            todo.pop()
            if ends and ends.pop():
                blocks.append([])
    words = (" ".join(unescape("".join(b)).split()) for b in blocks if b)
    return " ".join(w for w in words if w)


def scores(page: Page) -> dict[int, float]:
    """Score by path of each container: characters of text in it that no deeper container holds, less link text; a container also
    stands for four fifths of what its children hold, so an article in parts beats its longest part."""
    found: dict[int, float] = {}
    todo: list = [(page.root, page.root.path, False)]
    while todo:
        node, home, link = todo.pop()
        for item in node.items:
            if isinstance(item, str):
                found[home] = found.get(home, 0) + (-1 if link else 1) * len(item.strip())
            elif not item.noise:
                at = home if item.tag in PARAGRAPHS else item.path
                if item.tag in ("article", "main"):
                    found[at] = found.get(at, 0) + 200
                todo.append((item, at, link or item.tag == "a"))
    total: dict[int, float] = {}
    for path, score in found.items():
        share = 1.0
        while path > 0 and share > 0.2:
            total[path] = total.get(path, 0) + share * score
            path, share = page.paths[path][0], share * 0.8
    return total


def ranked(page: Page, n: int) -> list[tuple[str, float]]:
    """The n best paths and their scores; ties go to the path that the page has first."""
    best = heapq.nsmallest(n, ((-s, p) for p, s in scores(page).items() if s > 0))
    return [(page.path_text(p), -s) for s, p in best]


def at_path(page: Page, path: str | None) -> list[Node]:
    """Elements at this path that lie in no noise."""
    if not path or (at := page.path_of(path)) is None:
        return []
    return [n for n in page.nodes if n.path == at and not n.noise]


def raised(found: list[Node]) -> list[Node]:
    """Each container raised to the nearest article around it, or else to the one that it shares with the page's h1 (or to `main`)
    if that adds less than half of its own text; never to the body."""
    out: dict[int, Node] = {}
    for node in found:
        best = node.article if node.article and node.article.tag == "article" else node
        if best is node and len(found) == 1:
            up = node
            for _ in range(4):
                if up is None or up.tag in ("", "html", "body"):
                    break
                if (up.h1 or up.tag == "main") and 2 * (up.size - node.size) < node.size:
                    best = up
                    break
                up = up.parent
        out[id(best)] = best
    return list(out.values())


def extract(html: str | None, path: str | None) -> str:
    page = Page(html or "")
    for found in (at_path(page, path), *(at_path(page, p) for p, _ in ranked(page, 1))):
        if text := " ".join(t for n in raised(found) if (t := text_of(n))):
            return text
    return text_of(page.root) or ((best := page.rescued()) and text_of(best)) or ""


def _votes():
    def own(b: dict) -> dict:
        votes: dict = {}
        for host, html in zip(b["host"], b["html"]):
            for place, (path, _) in enumerate(ranked(Page(html or ""), VOTES)):
                key = host, path
                votes[key] = votes.get(key, 0) + VOTES - place + (place == 0)
        return {"host": [k[0] for k in votes], "path": [k[1] for k in votes], "votes": list(votes.values())}

    return own


def _extract():
    def own(b: dict) -> dict:
        texts = [extract(h, p) for h, p in zip(b["html"], b["path"])]
        return {"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": list(map(len, texts)), "path": b["path"]}

    return own


def winners(pages: DataFrame) -> DataFrame:
    """host, path: the path with most votes of each host."""
    votes = map_batches(pages.select(host_column("url").alias("host"), "html"), ["host", "html"], _votes, "host string, path string, votes long")
    votes = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return votes.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), "path")).alias("path"))


def host_column(url: str):
    host = F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"^(?:[a-zA-Z][\w+.-]*:)?//+", "")
    return F.lower(F.substring_index(F.regexp_extract(host, r"^([^/?#]*)", 1), "@", -1))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, path for every row of pages(page_id, url, html)."""
    pages = pages.select("page_id", "url", "html")
    won = cut(winners(pages))
    keyed = pages.withColumn("host", host_column("url"))
    size = won.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("host") + F.octet_length("path")).alias("bytes")).first()
    if size["n"] <= BROADCAST_HOSTS and (size["bytes"] or 0) <= BROADCAST_BYTES:
        joined = keyed.join(F.broadcast(won), "host", "left")
    else:
        salted = won.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    return map_batches(joined, ["page_id", "url", "html", "path"], _extract, "page_id long, url string, text string, n_chars long, path string")
