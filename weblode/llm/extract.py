"""Main text of HTML pages by composite text density."""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from weblode.llm.ship import ship

# Linear on any input: no repetition gives back, and an unclosed comment, quote or tag takes the rest of the page.
_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|\Z))"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+))*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>]++)))?+")
_TELLING = re.compile("class|id|role|hidden", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp noscript".split())
INLINE = frozenset((
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr").split())
#: Elements that are never article text.
DROPPED = RAW | frozenset((
    "head nav footer aside form button select option input menu dialog template svg math canvas object applet audio video map"
    " frameset datalist fieldset").split())
#: Words of class and id that name something other than the article, and roles that do.
BOILERPLATE = frozenset((
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb"
    " breadcrumbs footer sidebar aside masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter"
    " subscribe subscription signup login form search comment comments reply replies disqus share sharing social related recommended"
    " recommendations trending widget pagination pager toolbar copyright").split())
#: Words that make a class or id a state, layout or topic of what it is on, not its kind: has-sidebar, content-sidebar-wrap, category-social.
QUALIFIERS = frozenset((
    "has no not non with without is hide hides hidden show shows open opened closed content layout category categories cat tag tags"
    " topic type format template").split())
#: Words that name a box of whatever stands beside them: ad-slot, share-buttons, related-posts (but not share-prices, related-work).
BOXES = frozenset((
    "slot container box block wrap wrapper list area section bar buttons button links icons posts articles items item unit placement inner outer"
    " body title row").split())
#: Words of an article's class that make it an advert or a reader's comment.
NOT_ARTICLE = frozenset("ad ads advert adverts advertisement promo promos comment comments reply replies".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_ARTICLE = frozenset(("article", "main"))
_CLOSES_P = frozenset((
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr li main menu nav ol p pre section summary table ul").split())
_SCOPE = frozenset("html table td th caption button object template".split())
#: What an opening element closes when open, and the elements that such a search does not leave.
_IMPLIED = {
    "li": (frozenset(["li"]), _SCOPE | {"ul", "ol", "menu"}), "dt": (frozenset(["dt", "dd"]), _SCOPE | {"dl"}),
    "dd": (frozenset(["dt", "dd"]), _SCOPE | {"dl"}), "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])), "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}


def _names(value: str, words: frozenset, whole: bool = False) -> bool:
    """Whether a token of a class or id is one of ``words``, or a compound without a qualifier that starts or ends with one; with ``whole``,
    a compound of such words and boxes only."""
    for token in value.split():
        parts = [x.lower() for x in _PARTS.findall(token)]
        if not parts:
            continue
        if token.lower() in words:
            return True
        if QUALIFIERS.isdisjoint(parts) and (parts[0] in words or parts[-1] in words):
            if not whole or all(x in words or x in BOXES or x.isdigit() for x in parts):
                return True
    return False


_HEADERS = BOILERPLATE | {"header"}


def _unwanted(name: str, attrs: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is never article text, and whether its class or id says that it is boilerplate."""
    if name in DROPPED or name == "header" and not in_article:
        return True, False
    if not attrs or name in ("html", "body") or not _TELLING.search(attrs):
        return False, False
    named, seen = False, set()
    for m in _ATTRIBUTE.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in seen:
            continue
        seen.add(key)
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "role" and value.lower() in ROLES:
            return True, False
        if key in ("class", "id") and name not in _ARTICLE:
            named = named or _names(value, BOILERPLATE if in_article else _HEADERS, in_article)
        elif key == "class":
            named = named or _names(value, NOT_ARTICLE)
    return False, named


class Page:
    """A page's elements in document order, each with its parent; texts with their element and block number."""

    def __init__(self, html: str):
        self.name, self.parent, self.skip, self.article = ["#page"], [0], [False], [False]
        self.named = [False]
        self.texts: list[tuple[int, int, str]] = []
        self.block = 0
        open_: list[int] = [0]
        opened: dict[str, list[int]] = {}  # places in ``open_`` by name
        self._inline: list[dict[str, int]] = [{}]  # for every open block: the inline elements open in it, by name
        self._walls: list[int] = []  # places of open blocks that an end of a paragraph does not reach past
        at = 0
        while m := _TOKEN.search(html, at):
            self._text(open_[-1], html[at:m.start()])
            at, name = m.end(), m["name"]
            if not name:
                continue
            name = name.lower()
            if m["end"]:
                if opened.get(name):
                    self._close(open_, opened, name)
                elif name not in INLINE:
                    self.block += 1
                continue
            if name in ("html", "body") and opened.get(name):
                continue
            if name in _CLOSES_P and opened.get("p"):
                self._close_in(open_, opened, frozenset(["p"]), _SCOPE)
            if name in _IMPLIED:
                closing, scope = _IMPLIED[name]
                self._close_in(open_, opened, closing, scope)
            up = open_[-1]
            node = len(self.name)
            self.name.append(name)
            self.parent.append(up)
            never, named = _unwanted(name, m["attrs"], self.article[up])
            self.skip.append(self.skip[up] or never)
            self.named.append(named)
            self.article.append(self.article[up] or name in _ARTICLE)
            if name not in INLINE:
                self.block += 1
            elif name == "br":
                self.texts.append((node, self.block, " "))
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(html, at)
                at = close.start() if close else len(html)
                if close:
                    at = _TOKEN.match(html, at).end() if _TOKEN.match(html, at) else len(html)
                continue
            if name in VOID or m["attrs"].endswith("/") and name in ("svg", "math"):
                continue
            opened.setdefault(name, []).append(len(open_))
            if name in INLINE:
                self._inline[-1][name] = self._inline[-1].get(name, 0) + 1
            else:
                self._inline.append({})
                if name not in _CLOSES_P:
                    self._walls.append(len(open_))
            open_.append(node)
        self._text(open_[-1], html[at:])
        if any(self.named):
            self._skip_named()
        self.texts = [(node, block, entities.unescape(raw) if "&" in raw and not self.skip[node] else raw) for node, block, raw in self.texts]

    def _skip_named(self) -> None:
        """Skips what is named boilerplate, but no element around the whole content.

        That is one that encloses every article and main element of the page (those apart that are skipped or named themselves), or,
        on a page without any, most of its unlinked text. Nothing is skipped that would leave a page without text.
        """
        n = len(self.name)
        held, own, linked, skip = [0] * n, [0] * n, [False] * n, self.skip[:]
        apart = [False] * n
        for i in range(1, n):
            up = self.parent[i]
            linked[i] = self.name[i] == "a" or linked[up]
            apart[i] = skip[i] or apart[up] or self.name[i] in _ARTICLE and self.named[i]
            held[i] = int(self.name[i] in _ARTICLE and not apart[i])
        for node, _, raw in self.texts:
            if not linked[node]:
                own[node] += sum(map(len, raw.split()))
        for i in range(n - 1, 0, -1):
            held[self.parent[i]] += held[i]
            own[self.parent[i]] += own[i]
        for i in range(1, n):
            around = held[i] == held[0] if held[0] else 2 * own[i] > own[0]
            skip[i] = skip[i] or skip[self.parent[i]] or self.named[i] and not around
        if any(not skip[node] and not raw.isspace() for node, _, raw in self.texts):
            self.skip = skip

    def _text(self, node: int, raw: str) -> None:
        if raw:
            self.texts.append((node, self.block, raw))

    def _pop(self, open_: list[int], opened: dict[str, list[int]]) -> str:
        name = self.name[open_.pop()]
        opened[name].pop()
        if name in INLINE:
            self._inline[-1][name] -= 1
        else:
            self._inline.pop()
            if name not in _CLOSES_P:
                self._walls.pop()
            self.block += 1
        return name

    def _close(self, open_: list[int], opened: dict[str, list[int]], name: str) -> None:
        if name in INLINE and not self._inline[-1].get(name):  # a stray end of an inline element closes no block
            return
        while self._pop(open_, opened) != name:
            pass

    def _close_in(self, open_: list[int], opened: dict[str, list[int]], names: frozenset, scope: frozenset) -> None:
        """Close the innermost open element of ``names``, unless something of ``scope`` stands in between. Costs a look at a few names."""
        def innermost(some: frozenset) -> int:
            return max((opened[x][-1] for x in some if opened.get(x)), default=0)

        at = innermost(names)
        if not at or innermost(scope) > at or "p" in names and self._walls and self._walls[-1] > at:
            return
        while len(open_) > at:
            self._pop(open_, opened)

    def densities(self) -> tuple[list[float], list[float], list[int]]:
        """Composite text density of every element, the sum over its children, and the last element inside it."""
        n = len(self.name)
        chars, linked, tags, links, last = [0] * n, [0] * n, [0] * n, [0] * n, list(range(n))
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = self.name[i] == "a" or in_link[self.parent[i]]
        for node, _, text in self.texts:
            size = sum(map(len, text.split()))
            chars[node] += size
            if in_link[node]:
                linked[node] += size
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            chars[up] += chars[i]
            linked[up] += linked[i]
            tags[up] += tags[i] + 1
            links[up] += links[i] + (self.name[i] == "a")
            last[up] = max(last[up], last[i])
        share = linked[0] / max(chars[0], 1)
        density, sums = [0.0] * n, [0.0] * n
        for i in range(n):
            c, t, lc, lt = chars[i], max(tags[i], 1), max(linked[i], 1), max(links[i], 1)
            if c:
                base = math.log(c / max(c - linked[i], 1) * linked[i] + share * c + math.e)
                density[i] = c / t * math.log(c * t / (lc * lt) + 1) / math.log(base + math.e - 1)
            if i:
                sums[self.parent[i]] += density[i] * (not self.skip[i])
        return density, sums, last

    def main(self) -> tuple[int, int]:
        """First and last element of the subtree taken as the article.

        From the element with the largest density sum the choice climbs towards the body: to an enclosing article or main element
        if there is one, else as long as the parent is denser than the body, the least dense end of the path, and on to where text
        beside the choice is as plain as the page's.
        """
        density, sums, last = self.densities()
        alive = [i for i in range(len(sums)) if not self.skip[i]]
        best = max(alive, key=lambda i: (sums[i], -i), default=0)
        if not best or not sums[best]:
            return 0, last[0]
        body = next((i for i, name in enumerate(self.name) if name == "body"), 0)
        path, up = [], best
        while up:
            path.append(up)
            up = self.parent[up]
        outer = [i for i in path if self.name[i] in _ARTICLE]
        if outer:
            best = outer[-1] if self.name[outer[-1]] == "article" or not any(self.name[i] == "article" for i in outer) else next(
                i for i in reversed(outer) if self.name[i] == "article")
            return best, last[best]
        for i in path[1:]:
            if i == body or density[i] <= density[body]:
                break
            best = i
        return self._with_neighbours(best, path, last)

    def _with_neighbours(self, best: int, path: list[int], last: list[int]) -> tuple[int, int]:
        """The choice, or the ancestor around it where text beside it is no less plain: mostly unlinked, with as many characters a tag as
        all of the page's text that is not skipped."""
        n = len(self.name)
        chars, linked, tags, in_link = [0] * n, [0] * n, [0] * n, [False] * n
        for i in range(1, n):
            in_link[i] = self.name[i] == "a" or in_link[self.parent[i]]
        for node, _, text in self.texts:
            if not self.skip[node]:
                size = sum(map(len, text.split()))
                chars[node] += size
                linked[node] += size * in_link[node]
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            chars[up] += chars[i]
            linked[up] += linked[i]
            tags[up] += tags[i] + (not self.skip[i])
        for up in path[path.index(best) + 1:] + [0]:
            beside, tagged = chars[up] - chars[best], max(tags[up] - tags[best] - 1, 1)
            if beside and 2 * (linked[up] - linked[best]) < beside and beside * max(tags[0], 1) >= chars[0] * tagged:
                best = up
        return best, last[best]

    def article_text(self) -> str:
        first, last = self.main()
        blocks: list[list[str]] = []
        at = None
        for node, block, text in self.texts:
            if first <= node <= last and not self.skip[node]:
                if block != at:
                    blocks.append([])
                    at = block
                blocks[-1].append(text)
        return "\n\n".join(filter(None, (" ".join("".join(b).split()) for b in blocks)))


def main_text(html: str | None) -> str:
    return Page(html).article_text() if html else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page.as_py()) for page in batch.column("html")]
        yield pa.record_batch(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html, ...)`` to one row per input row: page_id, url, text, n_chars (code points).

    The page is read as a tree; every element's characters per tag, adjusted for links, is its density. The subtree with the
    largest sum of child densities leads to the article, out of which named boilerplate (menus, headers, footers, sidebars, notices,
    adverts, forms, comments) and non-text are left out. Character references are decoded, white space in a block becomes one
    space, blocks are joined by an empty line. A class or id names boilerplate by a whole token (sidebar, ad-slot; not has-sidebar),
    and never on an element around all articles of the page or, where it has none, around most of its unlinked text.

    A null, empty or text-less page has the empty text. Truncated pages, unclosed tags, quotes and comments end with the page.
    Pages are read whole, each alone, in the scan: repeated rows get equal texts, nothing is shuffled, an empty table gives no rows.
    Null page_id and url pass through; other columns are ignored.
    """
    ship(pages.sparkSession)
    return pages.selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url", "cast(html as string) as html").mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long")
