"""Main text of web pages (operator 6), with site template removal.

A page is read into elements, leniently: end tags may be missing, quotes and
comments may be left open. Elements that by their name, role or class are page
furniture (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
reader comments) are dropped, unless they hold the page's main text: layout
wrappers have such names, too, and some sites put a page into one form. The
text is that of the page's articles, else of its main element, else of its body.

Site templates: each element's subtree is hashed (names, classes, texts, in
order), hashes are counted by host in Spark, one count for each different
page, and subtrees on enough pages (``needed_pages``) are deleted wherever they
occur. Pages with the same main text count once, so that a page published many
times is none. Inside an article, headings, paragraphs and other prose elements
are never deleted so, as quoted passages recur, too; nor is a subtree that is
most of the text on most of its pages, which is an article published twice.

Style: Python over Arrow batches for reading pages; the counting is a
DataFrame aggregation. Pages are read twice and never shuffled, unless there
are more than ``BROADCAST_HASHES`` template hashes.

Defined results
---------------
null, empty or unreadable html: an empty text. A null url belongs to the host
"". Repeated ids and rows: each row is extracted by itself; equal pages count
once for their host's templates. Extra columns are dropped. Empty tables give
an empty result. Long pages: time and memory are linear in the page.
"""

from __future__ import annotations

import heapq
import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

# Element names of the HTML standard by the part they play.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
DROPPED = frozenset(
    "script style title textarea iframe noembed noframes xmp noscript template nav header footer aside form button select option datalist"
    " input label fieldset dialog menu svg canvas object audio video head map".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p li blockquote pre dd dt td th tr tbody thead figcaption article main body html".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: An element that opens closes open ones of these names, up to a container.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: Words in class or id that mark furniture.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox adunit sponsor sponsored sponsors promo promotion promoted banner cookie cookies consent gdpr"
    " notice notices alert newsletter subscribe subscription signup share sharing social sidebar rail comment comments reply replies disqus respond"
    " related recommended recommendations breadcrumb breadcrumbs menu nav navbar navigation topbar footer header masthead popup modal overlay login"
    " paywall pagination pager toolbar widget widgets skip copyright disclaimer".split()
)
ROOTS = frozenset(("html", "body", "article", "main"))
#: Marks of what readers and other pages say, and of offers; such an element is hardly ever a layout wrapper.
OTHERS_SAY = frozenset(
    "comment comments reply replies disqus respond related recommended recommendations newsletter subscribe subscription signup cookie cookies consent gdpr"
    " advert adverts advertisement sponsor sponsored sponsors promo promotion promoted paywall login popup modal".split()
)
#: A class name with one of these words says something of the layout (has-sidebar, ad-free, comments-open), not what the element is.
MODIFIERS = frozenset("has no with without free open closed enabled disabled".split())
#: What may stand in a head; anything else ends it.
HEAD = frozenset("title meta link base basefont bgsound script style noscript template".split())
#: Dropped by name, but a wrapper if the page's main text is inside.
WRAPPERS = frozenset("form fieldset header".split())
#: Inline elements within these are prose, whatever their class.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th figcaption caption summary address".split())
#: Words that mark an article as one beside the page's own.
OTHER_ARTICLES = frozenset("comment comments reply replies related recommended teaser sponsored promo".split())

_TOKEN = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*)|<[!?/]")
_QUOTED, _QUOTE = re.compile(r"""\"[^"]*\"|'[^']*'"""), re.compile("[\"']")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_HIDDEN = re.compile(r"display\s*:\s*none")
_MAIN = re.compile(r"""\brole\s*=\s*["']?main\b""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: A template is on so many different pages of its host at least; on a larger host on this share of its pages, or, where that is less, on their number's square root.
MIN_PAGES, MIN_SHARE = 5, 0.1
#: Template hashes up to which their list (8 bytes each) is broadcast.
BROADCAST_HASHES = 500_000
#: Parts into which a host's pages are dealt where they are joined to its templates.
SALTS = 16
_KEPT, _WRAPPER, _GONE = 0, 1, 2


def _marks(found: dict[str, str]) -> set[str]:
    """The words of class names and id, but of those that speak of the layout."""
    out: set[str] = set()
    for name in (*found.get("class", "").split(), found.get("id", "")):
        words = {w.lower() for w in _WORDS.findall(name)}
        if words.isdisjoint(MODIFIERS):
            out |= words
    return out


def _furniture(name: str, raw: str, inside: bool, running: bool) -> tuple[int, bool]:
    """Whether an element is kept, furniture unless it turns out a wrapper of the main text, or gone; and whether it holds what others say.

    ``inside``: within an article. ``running``: within a paragraph or the like.
    """
    if name in DROPPED and not (name == "header" and inside):
        return (_WRAPPER if name in WRAPPERS else _GONE), False
    if not raw or name in ROOTS - {"article"}:
        return _KEPT, False
    found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(raw)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "").lower()):
        return _GONE, False
    if found.get("role", "").lower() in ROLES:
        return _WRAPPER, False
    if name in HEADINGS or running and name not in BLOCKS:
        return _KEPT, False
    marked = _marks(found)
    if inside:  # an article's own header holds its title
        marked.discard("header")
    if (OTHER_ARTICLES if name == "article" else MARKS).isdisjoint(marked):
        return _KEPT, False
    return _WRAPPER, not OTHERS_SAY.isdisjoint(marked)


class Page:
    """A page's elements and texts in order. Elements are numbered as they open."""

    def __init__(self, source: str):
        self.names, self.parents, self.kinds = ["#"], [-1], [""]
        self.items: list[tuple[int, str | None]] = []  # (element, text), or (element, None) where a block begins or ends
        stack, at, lone, opened = [0], 0, set(), Counter()

        def tag_end(start: int) -> int:
            """Where a tag's ``>`` is: the first outside of quotes. A quote that is never closed is none."""
            end = source.find(">", start)
            while end >= 0:
                open_quote = _QUOTE.search(_QUOTED.sub("", source[start:end]))
                if not open_quote or open_quote[0] in lone:
                    break
                if (shut := source.find(open_quote[0], end)) < 0:
                    lone.add(open_quote[0])
                    break
                end = source.find(">", shut)
            return end

        def text(to: int) -> None:
            if to > at:
                if self.names[stack[-1]] == "head" and not source[at:to].isspace():
                    close(len(stack) - 1)
                self.items.append((stack[-1], source[at:to]))

        def close(depth: int) -> None:
            while len(stack) > depth:
                name = self.names[stack.pop()]
                opened[name] -= 1
                if name in BLOCKS:
                    self.items.append((stack[-1], None))

        while m := _TOKEN.search(source, at):
            text(m.start())
            if m[2]:
                end = tag_end(m.end())
            elif m[0] == "<!--":
                end = source.find("-->", m.end())
                end += 2 if end >= 0 else 0
            else:
                end = source.find(">", m.end())
            at = end + 1 if end >= 0 else len(source)  # what never ends is no text
            if not m[2] or end < 0:
                continue
            name = m[2].lower()
            if m[1]:
                for depth in range(len(stack) - 1, 0, -1) if opened[name] > 0 else ():
                    if self.names[stack[depth]] == name:
                        close(depth)
                        break
                    if name not in BLOCKS and self.names[stack[depth]] in BLOCKS:
                        break
                continue
            raw = source[m.end() : end]
            if name == "br":
                self.items.append((stack[-1], " "))
            if opened["head"] > 0 and name not in HEAD and (name == "body" or self.names[stack[-1]] == "head"):
                close(next(d for d, e in enumerate(stack) if self.names[e] == "head"))
            if name in BLOCKS:
                shut, within = CLOSES.get(name, ({"p"}, ROOTS | {"div", "section", "li", "td", "th", "blockquote", "button", "aside"}))
                for depth in range(len(stack) - 1, 0, -1) if any(opened[x] > 0 for x in shut) else ():
                    if self.names[stack[depth]] in shut:
                        close(depth)
                        if name not in CLOSES:
                            break
                    elif self.names[stack[depth]] in within:
                        break
            parent = stack[-1]
            me = len(self.names)
            self.names.append(name)
            self.parents.append(parent)
            self.kinds.append(f"{name} {raw.strip()}" if raw.strip() else name)
            if name in BLOCKS:
                self.items.append((parent, None))
            if name in VOID or raw.endswith("/") and name not in BLOCKS and name not in RAW:
                continue
            stack.append(me)
            opened[name] += 1
            if name in RAW:
                end = re.compile(f"</{name}", re.I).search(source, at)
                at = end.start() if end else len(source)
        text(len(source))
        close(1)
        self._weigh()

    def _weigh(self) -> None:
        """Finds what is furniture: ``dropped``, and the outermost article around each element (``articles``)."""
        n = len(self.names)
        state, says, held, running, linked, main = [_KEPT] * n, [False] * n, [False] * n, [False] * n, [False] * n, [False] * n
        for me in range(1, n):
            up, name, raw = self.parents[me], self.names[me], self.kinds[me][len(self.names[me]) + 1 :]
            running[me] = name in RUNNING or running[up] and name not in BLOCKS
            linked[me] = linked[up] or name == "a"
            state[me], says[me] = _furniture(name, raw, held[up], running[up])
            if state[up] == _GONE:
                state[me] = _GONE
            main[me] = state[me] != _GONE and (name == "main" or bool(raw) and _MAIN.search(raw) is not None)
            held[me] = held[up] or name == "article" and state[me] == _KEPT
        if _WRAPPER in state:
            self._rescue(state, says, linked, main)
        self.dropped, self.articles = [False] * n, [-1] * n
        for me in range(1, n):
            up = self.parents[me]
            self.dropped[me] = self.dropped[up] or state[me] != _KEPT
            # Comments are articles within articles.
            self.articles[me] = self.articles[up] if self.articles[up] >= 0 else me if self.names[me] == "article" and not self.dropped[me] else -1
        self.mains = [i for i in range(1, n) if main[i] and not self.dropped[i]]

    def _rescue(self, state: list[int], says: list[bool], linked: list[bool], main: list[bool]) -> None:
        """Keeps marked elements that hold the main text. Text in links has no weight, so that menus have none."""
        n = len(self.names)
        weight, strong, title = [0] * n, [False] * n, [False] * n  # below: of the whole subtree
        for me, words in self.items:
            if words is not None and state[me] != _GONE and not linked[me]:
                weight[me] += len(words) - words.count(" ") - words.count("\n")
        own = list(weight)
        for me in range(n - 1, 0, -1):
            if state[me] != _GONE:
                strong[me] = strong[me] or main[me] or self.names[me] == "article" and state[me] == _KEPT
                title[me] = title[me] or self.names[me] == "h1"
                up = self.parents[me]
                weight[up], strong[up], title[up] = weight[up] + weight[me], strong[up] or strong[me], title[up] or title[me]
        last = list(range(n))  # the subtree of an element is all from it to its last one
        for me in range(n - 1, 0, -1):
            last[self.parents[me]] = max(last[self.parents[me]], last[me])
        outer: list[tuple[int, int]] = []  # the outermost marked elements, the heaviest first
        free, strong_free, title_free, at, end = own[0], False, False, 1, n - 1
        while True:
            while at <= end:  # what is newly free; every element is walked once
                if state[at] == _WRAPPER:
                    heapq.heappush(outer, (-weight[at], at))
                if state[at] != _KEPT:
                    at = last[at] + 1
                    continue
                free += own[at]
                strong_free = strong_free or main[at] or self.names[at] == "article"
                title_free = title_free or self.names[at] == "h1"
                at += 1
            if not outer:
                return
            best = heapq.heappop(outer)[1]
            if weight[best] <= free or not self._is_wrapper(weight[best], free, strong[best], title[best], says[best], strong_free, title_free):
                return
            state[best], at, end = _KEPT, best, last[best]

    @staticmethod
    def _is_wrapper(weight: int, free: int, strong: bool, title: bool, says: bool, strong_free: bool, title_free: bool) -> bool:
        """Whether the heaviest marked element, heavier than all free text, holds the main text. strong: an article or main element; title: an h1."""
        if says:
            return (strong or title) and not strong_free and not title_free
        if strong != strong_free:
            return strong or weight > 3 * free
        if not strong and title != title_free:
            return title
        return weight > 3 * free

    def root(self) -> set[int] | None:
        """The elements whose text counts: the outermost articles, else the first main element, else (None) all. Articles beside a longer main element are others."""
        found = {a for a, d in zip(self.articles, self.dropped, strict=True) if a >= 0 and not d}
        if not self.mains:
            return found or None
        main = self.mains[0]
        if not found:
            return {main}
        around = [False] * len(self.names)
        for me in range(main, len(self.names)):
            around[me] = me == main or around[self.parents[me]]
        within = {a for a in found if around[a]}
        if within or any(a < main and self.articles[main] == a for a in found):
            return within or found
        size = {main: 0, **dict.fromkeys(found, 0)}
        for me, words in self.items:
            if words is not None and not self.dropped[me]:
                if around[me]:
                    size[main] += len(words)
                elif self.articles[me] >= 0:
                    size[self.articles[me]] += len(words)
        return {main} if size[main] >= sum(v for k, v in size.items() if k != main) else found

    def inside(self) -> list[bool]:
        """For each element, whether its text counts."""
        roots = self.root()
        out = [roots is None]
        for me in range(1, len(self.names)):
            out.append(not self.dropped[me] and (roots is None or me in roots or out[self.parents[me]]))
        if any(n == "header" for n in self.names):  # of an article's header, only its headings
            within = [False] * len(self.names)
            for me in range(1, len(self.names)):
                up = self.parents[me]
                opens = self.names[me] == "header" and self.articles[me] >= 0
                within[me] = (opens or within[up]) and self.names[me] not in HEADINGS and self.names[up] not in HEADINGS
                out[me] = out[me] and not within[me]
        return out

    def subtrees(self) -> tuple[list[int], list[int]]:
        """A hash and the length of the text of each element's subtree."""
        parts: list[list[bytes]] = [[k.encode()] for k in self.kinds]
        sizes = [0] * len(self.names)
        placed = [False] * len(self.names)
        order: dict[int, list] = {i: [] for i in range(len(self.names))}
        for me, words in self.items:
            if words is not None and (short := " ".join(words.split())):
                order[me].append(short)
                sizes[me] += len(short)
        hashes = [0] * len(self.names)
        for me in range(len(self.names) - 1, 0, -1):  # children have higher numbers
            mine = xxhash.xxh3_64_intdigest(b"\x00".join(parts[me] + [s.encode() for s in order[me]]))
            hashes[me] = mine - (1 << 64) if mine >= 1 << 63 else mine
            up = self.parents[me]
            parts[up].insert(1, mine.to_bytes(8, "little")) if not placed[up] else parts[up].append(mine.to_bytes(8, "little"))
            placed[up] = True
            sizes[up] += sizes[me]
        return hashes, sizes

    def candidates(self, keep: list[bool] | None = None) -> tuple[list[tuple[int, int, bool]], int]:
        """(element, hash, whether it is most of the page's text) of elements that may be a site's template, and a hash of the page's text."""
        keep = keep or self.inside()
        articles = self.articles
        able = [i for i in range(1, len(self.names)) if keep[i] and self.names[i] in BLOCKS and self.names[i] not in ROOTS and not (articles[i] >= 0 and self.names[i] in PROSE)]
        if not able:
            return [], 0
        hashes, sizes = self.subtrees()
        whole, kept = xxhash.xxh3_64(), 0
        for me, words in self.items:
            if words is not None and keep[me] and (short := " ".join(words.split())):
                whole.update(short)
                kept += len(short)
        digest = whole.intdigest()
        return [(i, hashes[i], 2 * sizes[i] > kept) for i in able if sizes[i]], digest - (1 << 64) if digest >= 1 << 63 else digest

    def main_text(self, templates: frozenset[int] | set[int] = frozenset()) -> str:
        keep = self.inside()
        if templates:
            gone = {i for i, h, _ in self.candidates(keep)[0] if h in templates}
            for me in range(1, len(self.names)):
                if me in gone or self.parents[me] in gone:
                    gone.add(me)
                    keep[me] = False
        blocks, now = [], []
        for me, words in self.items:
            if words is None:
                if now:
                    blocks.append("".join(now))
                    now = []
            elif keep[me]:
                now.append(words)
        blocks.append("".join(now))
        return "\n".join(b for b in (" ".join(entities.unescape(x).split()) for x in blocks) if b)


def host(url: str = "url") -> Column:
    return F.lower(F.coalesce(F.try_parse_url(F.col(url), F.lit("HOST")), F.lit(""))).alias("__host")


def template_counts(pages: DataFrame) -> DataFrame:
    """(host, subtree, pages, most_of): on how many different pages of its host each candidate subtree is, and on how many it is most of the text."""

    def hashed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for site, source in zip(batch["__host"], batch["html"], strict=True):
                found, page = Page(source or "").candidates()
                out += [(site, h, page, most) for h, most in {h: most for _, h, most in found}.items()]
            yield pd.DataFrame(out, columns=["host", "subtree", "page", "most"])

    each = pages.select(host(), "html").mapInPandas(hashed, "host string, subtree long, page long, most boolean")
    once = each.groupBy("host", "subtree", "page").agg(F.max("most").alias("most"))
    return once.groupBy("host", "subtree").agg(F.count("*").alias("pages"), F.count_if("most").alias("most_of"))


def needed_pages(of_host: Column, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> Column:
    """On how many of its host's pages a template must be."""
    return F.greatest(F.lit(float(min_pages)), F.least(of_host * min_share, F.sqrt(of_host)))


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, subtree) of site templates."""
    counts = materialize(template_counts(pages).where((F.col("pages") >= min_pages) & (2 * F.col("most_of") <= F.col("pages"))), "subtree-counts")
    sizes = pages.select(host()).groupBy(F.col("__host").alias("host")).agg(F.count("*").alias("all"))
    found = counts.join(sizes, "host").where(F.col("pages") >= needed_pages(F.col("all"), min_pages, min_share))
    return found.select("host", "subtree")


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(page_id, url, text, n_chars)."""
    spark = pages.sparkSession
    found = materialize(templates(pages, min_pages, min_share), "templates")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", host())
    schema = "page_id long, url string, text string, n_chars long"
    if found.count() <= BROADCAST_HASHES:
        by_host: dict[str, set[int]] = {}
        for r in found.collect():
            by_host.setdefault(r.host, set()).add(r.subtree)
        sent = spark.sparkContext.broadcast(by_host)
    else:
        lists = found.groupBy("host").agg(F.collect_list("subtree").alias("subtrees"))  # of a host, as many as it has templates
        lists = lists.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = rows.withColumn("__part", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        rows = dealt.join(lists, (F.col("__host") == F.col("host")) & (F.col("__part") == F.col("part")), "left").select("page_id", "url", "html", "__host", "subtrees")
        sent = None

    def texts(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known = batch["subtrees"] if sent is None else [None] * len(batch)
            out = []
            for site, source, own in zip(batch["__host"], batch["html"], known, strict=True):
                gone = sent.value.get(site, frozenset()) if sent else frozenset(own if own is not None else ())
                out.append(Page(source or "").main_text(gone))
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": out, "n_chars": [len(t) for t in out]})

    return rows.mapInPandas(texts, schema)
