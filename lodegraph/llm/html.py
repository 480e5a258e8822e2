"""HTML extraction by a site style tree.

Pages of one host are merged by the paths of their elements (tag, class and id names). For each path the tree keeps
how the element is laid out (the run-collapsed sequence of its children) and what its branch says, over all pages
that have it. Importance is (1 - CONTENT) of the layouts' entropy and CONTENT of the contents', each over the log of
the number of pages: near 0 for branches that say the same everywhere, near 1 for those that always differ. Branches
of importance below LEAST, on hosts with at least PAGES pages with the path, are removed from each page, inside an
article too. If the body itself is of low importance, or more than half of a page's article would go, the host's
pages are copies and the tree says nothing about that page.

Independent of the host, these go: head, scripts, styles, navigation, footers, asides, dialogs and the like, hidden
elements, and branches whose class, id or role names say that they are menus, page headers, notices, adverts, sharing
tools or comments: names count whole, or by their first or last part ("post-comments", but not "has-sidebar"). Names
remove no main element, and an article only if they are those of comments, adverts or teasers. Forms go, unless a
main part is inside. If a page has article or main elements, only their text is taken. Without them, a form or named
branch with most of the page's text stays, if it isn't of comments or adverts; lines of several links go.

Text: character references decoded, white space inside a block made one space, blocks in page order joined by one
newline. Null or empty HTML gives an empty text; pages with a null URL, or one without ://, belong to the host "".
Markup that breaks off is read as far as it goes. Elements below NESTING levels are read as parts of the one above.
Repeated rows get a result each; columns other than the three do not matter; an empty table gives an empty result.

Scale: two passes, linear in a page's length. The first emits hashes, counted with partial aggregation by path (a
path's hash begins with its host), so a hot host is no hot task. The paths found low are broadcast as a sorted array
if at most LOW_PATHS. Beyond that, pages' own paths are joined with them, and what a page has of them with the page:
neither a host nor a path's pages are ever collected.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, join_repeated, map_batches, worker_cache
from .urlfilter import host

PAGES, LEAST, CONTENT = 8, 0.2, 0.9
#: Low paths that are broadcast, 8 bytes each.
LOW_PATHS = 4_000_000
NESTING = 512

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z](?:[^>]*>|[^>]*\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - frozenset("td th tr tbody thead tfoot li dt dd body html head caption option legend".split())
_GONE = frozenset("head script style noscript template iframe svg canvas object embed nav footer aside button select option datalist textarea input label dialog menu menuitem audio video map title xmp noembed noframes search".split())
_MAIN = frozenset(("article", "main"))
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar tooltip".split())
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner banners promo promotion promoted sponsor sponsored sponsors sidebar sidebars aside rail widget widgets nav navs navbar navigation menu menus submenu breadcrumb breadcrumbs"
    " masthead topbar footer footers bottombar colophon cookie cookies consent gdpr notice notices notification notifications alert alerts warning popup popover modal overlay lightbox newsletter subscribe subscription signup signin login register paywall form forms searchform searchbox search"
    " share sharing shares sharebar social socials comment comments commentlist commentary respond reply replies disqus discussion livefyre guestbook related recommended recommendations recirc trending popular pagination pager paging toolbar skip skiplink copyright legal disclaimer tagcloud blogroll".split()
)
#: Of these, what an article element may be instead of the page's article; most of a page's text may be comments, too.
_TEASERS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot promo promotion promoted sponsor sponsored sponsors related recommended recommendations recirc trending popular"
    " comment comments commentlist commentary respond reply replies disqus discussion livefyre guestbook".split()
)
#: First parts of names that tell of the element's surroundings.
_ABOUT = frozenset("has have no not non with without is hide show".split())
_HEADERS = frozenset("header headers pageheader siteheader".split())
_IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th")}
_SCOPES = frozenset("ul ol dl table select html body article main div section td th".split())

_GOES, _IS_MAIN, _IS_HEADER, _LINK, _NAMED, _TEASER, _FORM = 1, 2, 4, 8, 16, 32, 64
#: Attributes up to this length are remembered, so many of them; those of links are mostly new.
_ATTRIBUTES, _KINDS = 200, 20_000


def _kind(tag: str, attributes: str) -> tuple[str, int]:
    """The name of an element in paths, and what it is."""
    cache = worker_cache().setdefault("html kinds", {})
    known = cache.get((tag, attributes))
    if known is not None:
        return known
    names, flags = [], 0
    if tag in _GONE:
        flags |= _GOES
    if tag in _MAIN:
        flags |= _IS_MAIN
    if tag == "header":
        flags |= _IS_HEADER
    if tag == "a":
        flags |= _LINK
    if tag == "form":
        flags |= _FORM
    whole = tag == "main"
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if name in ("class", "id"):
            names.extend(sorted(value.lower().split()))
        elif name == "role":
            if value.lower() in _ROLES:
                flags |= _GOES
            elif value.lower() in ("main", "article"):
                flags |= _IS_MAIN
                whole = whole or value.lower() == "main"
            elif value.lower() == "form":
                flags |= _FORM
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
            flags |= _GOES
        elif name == "itemprop" and value.lower() == "articlebody":
            flags |= _IS_MAIN
    words = set()
    for n in names:
        parts = [w for w in re.split(r"[^a-z0-9]+", n) if w]
        parts = [re.sub(r"(?<=[a-z])[0-9]+$", "", w) for w in parts if not w.isdigit()]
        if parts and parts[0] not in _ABOUT:
            words |= {parts[0], parts[-1], "".join(parts)}
    if tag not in ("html", "body"):
        if words & _TEASERS:
            flags |= _TEASER
        if words & _NAMES and not whole and not (flags & _IS_MAIN and not words & _TEASERS):
            flags |= _NAMED
        if words & _HEADERS:
            flags |= _IS_HEADER
    if flags & (_GOES | _NAMED):
        flags &= ~_IS_MAIN
    # Long numbers in names are per page, not per site.
    out = tag + "".join("." + re.sub(r"[0-9]{2,}", "0", n) for n in names), flags
    if len(attributes) <= _ATTRIBUTES:
        if len(cache) >= _KINDS:
            cache.clear()
        cache[(tag, attributes)] = out
    return out


class Page:
    """A page's elements and texts. Element i: parent[i], name[i], flags[i], path[i] (hash of names from the root).
    pieces: (element, text), with None as text where a block ends."""

    def __init__(self, source: str, host: str = ""):
        self.parent, self.name, self.flags, self.path, self.tag = [-1], [""], [0], [hash_of(host)], [""]
        opened: Counter = Counter()  # by tag, of the open elements
        skipped: Counter = Counter()  # by tag, of those too deep to be opened

        def close(k: int) -> None:
            for i in open_[k:]:
                opened[self.tag[i]] -= 1
            del open_[k:]

        self.pieces: list[tuple[int, str | None]] = []
        open_, at = [0], 0
        pieces = self.pieces
        pos, size = 0, len(source)
        search = _TOKEN.search
        while pos < size:
            m = search(source, pos)
            if m is None:
                pieces.append((open_[-1], source[pos:]))
                break
            if m.start() > pos:
                pieces.append((open_[-1], source[pos : m.start()]))
            pos = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                if skipped[tag]:
                    skipped[tag] -= 1
                    if tag in _BLOCK:
                        pieces.append((open_[-1], None))
                    continue
                for k in range(len(open_) - 1, 0, -1) if opened[tag] else ():
                    if self.tag[open_[k]] == tag:
                        if tag in _BLOCK or any(self.tag[i] in _BLOCK for i in open_[k:]):
                            pieces.append((open_[-1], None))
                        close(k)
                        break
                    if self.tag[open_[k]] in _SCOPES and tag not in _BLOCK:
                        break
                continue
            if tag in _BLOCK:
                pieces.append((open_[-1], None))
                implied = ("p",) if tag in _CLOSES_P else ()
                implied += _IMPLIED.get(tag, ())
                if any(opened[t] for t in implied):
                    for k in range(len(open_) - 1, 0, -1):
                        t = self.tag[open_[k]]
                        if t in implied:
                            close(k)
                            if t == "p":
                                break
                        elif t in _SCOPES:
                            break
            elif tag == "br":
                pieces.append((open_[-1], " "))
            name, flags = _kind(tag, m[3])
            up = open_[-1]
            at = len(self.parent)
            self.parent.append(up)
            self.name.append(name)
            self.flags.append(flags)
            self.tag.append(tag)
            self.path.append(hash_of(f"{self.path[up]}>{name}"))
            if tag in _RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, pos)
                pos = end.end() if end else size
            elif tag not in _VOID:  # a slash closes only void elements
                if len(open_) < NESTING:
                    open_.append(at)
                    opened[tag] += 1
                else:
                    skipped[tag] += 1

    def sizes(self, goes: list[bool]) -> list[int]:
        """Characters of text in each element's branch, without what goes."""
        out = [0] * len(self.parent)
        for i, t in self.pieces:
            if t and not goes[i]:
                out[i] += len(t.strip())
        for i in range(len(out) - 1, 0, -1):
            out[self.parent[i]] += out[i]
        return out

    def text(self, low: frozenset[int] | set[int] = frozenset()) -> str:
        """The main text; low: hashes of paths of little importance."""
        n, parent, flags = len(self.parent), self.parent, self.flags
        hard = [False] * n
        for i in range(1, n):
            hard[i] = hard[parent[i]] or bool(flags[i] & _GOES)
        holds_main, holds_whole = [False] * n, [False] * n
        for i in range(n - 1, 0, -1):
            if not hard[i]:
                own = bool(flags[i] & _IS_MAIN)
                holds_main[parent[i]] |= own or holds_main[i]
                holds_whole[parent[i]] |= own and self.tag[i] == "main" or holds_whole[i]
        size = None if holds_main[0] else self.sizes(hard)
        goes, main, link = [False] * n, [False] * n, [False] * n
        for i in range(1, n):
            up, f = parent[i], flags[i]
            soft = f & _NAMED and not holds_whole[i] or f & _FORM and not holds_main[i]
            if soft and size is not None and not f & _TEASER and size[i] * 2 > size[0]:
                soft = False
            main[i] = main[up] or bool(f & _IS_MAIN)
            goes[i] = goes[up] or bool(f & _GOES) or bool(soft) or bool(f & _IS_HEADER) and not main[up]
            link[i] = link[up] or bool(f & _LINK)
        only_main = any(main[i] and not goes[i] for i in range(n))
        if low and not any(t == "body" and p in low for t, p in zip(self.tag, self.path)):
            pruned = list(goes)
            for i in range(1, n):
                # What holds a main part, or is its root, stays as such.
                root = only_main and (holds_main[i] or flags[i] & _IS_MAIN)
                pruned[i] = goes[i] or pruned[parent[i]] or self.path[i] in low and not root
            if not only_main:
                goes = pruned
            else:
                left = lambda g: sum(len(t.strip()) for i, t in self.pieces if t and main[i] and not g[i])
                if left(pruned) * 2 >= left(goes):
                    goes = pruned
        out, block, links, linked = [], [], set(), 0
        for i, t in [*self.pieces, (0, None)]:
            if t is None:
                if block:
                    whole = " ".join(html.unescape("".join(block)).split())
                    if whole and (only_main or len(links) < 2 or linked * 2 <= len(whole)):
                        out.append(whole)
                block, links, linked = [], set(), 0
            elif not goes[i] and (main[i] or not only_main):
                block.append(t)
                if link[i] and not only_main and t.strip():
                    linked += len(t.strip())
                    links.add(i)
        return "\n".join(out)

    def styles(self) -> list[tuple[int, int, int]]:
        """(path, hash of its layouts, hash of its branch's text) of every path on the page. An element's text hash is
        made of its own texts' and its children's, in page order, so each text counts once and not for all above it."""
        n = len(self.parent)
        children: list[list[str]] = [[] for _ in range(n)]
        for i in range(1, n):
            c = children[self.parent[i]]
            if not c or c[-1] != self.name[i]:
                c.append(self.name[i])
        says: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for at, (i, t) in enumerate(self.pieces):
            if t and not t.isspace():
                says[i].append((at, hash_of(" ".join(t.split()))))
        content = [0] * n
        for i in range(n - 1, 0, -1):
            if says[i]:
                says[i].sort()
                content[i] = hash_of(",".join(str(h) for _, h in says[i]))
                says[self.parent[i]].append((says[i][0][0], content[i]))
        by_path: dict[int, tuple[dict[str, None], list[int]]] = {}
        for i in range(1, n):
            if self.tag[i] in _GONE:
                continue
            a, b = by_path.setdefault(self.path[i], ({}, []))
            a[" ".join(children[i])] = None
            b.append(content[i])
        return [(p, hash_of("\n".join(a)), hash_of(",".join(map(str, b)))) for p, (a, b) in by_path.items()]


def hash_of(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


def _rows(pages: DataFrame, url_col: str, html_col: str) -> list:
    return [host(F.col(url_col)).alias("host"), F.col(html_col).alias("x")]


def site_styles(pages: DataFrame, url_col: str = "url", html_col: str = "html", least_pages: int = PAGES, least: float = LEAST) -> DataFrame:
    """path (a hash that begins with the host) of the branches of little importance."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        seen: Counter = Counter()
        for h, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for p, layout, content in Page(x or "", h).styles():
                seen[(p, 0, layout)] += 1
                seen[(p, 1, content)] += 1
        rows = list(seen)
        return pa.RecordBatch.from_pydict({"path": pa.array([r[0] for r in rows], pa.int64()), "kind": pa.array([r[1] for r in rows], pa.int32()), "h": pa.array([r[2] for r in rows], pa.int64()), "n": pa.array([seen[r] for r in rows], pa.int64())})

    each = map_batches(pages.select(*_rows(pages, url_col, html_col)), run, "path bigint, kind int, h bigint, n bigint")
    counts = each.groupBy("path", "kind", "h").agg(F.sum("n").alias("n"))
    both = counts.groupBy("path", "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"))
    # Entropy over m pages is ln m - (sum of n ln n) / m; as a share of ln m:
    share = F.when(F.col("m") > 1, 1 - F.col("s") / (F.col("m") * F.log("m"))).otherwise(1.0)
    weight = F.when(F.col("kind") == 1, CONTENT).otherwise(1 - CONTENT)
    both = both.groupBy("path").agg(F.max("m").alias("m"), F.sum(share * weight).alias("importance"))
    return both.filter((F.col("m") >= least_pages) & (F.col("importance") < least)).select("path")


def _own_low(pages: DataFrame, low: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """key (hash of host and HTML), n (pages with it) and low (paths) of the pages with low paths, as a checkpoint."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        key, path = [], []
        for k, h, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            some = set(Page(x or "", h).path)
            key.extend([k] * len(some))
            path.extend(some)
        return pa.RecordBatch.from_pydict({"key": pa.array(key, pa.int64()), "path": pa.array(path, pa.int64())})

    h, x = _rows(pages, url_col, html_col)
    each = map_batches(pages.select(F.xxhash64(h, x).alias("key"), h, x), run, "key bigint, path bigint")
    each = each.groupBy("key", "path").agg(F.count(F.lit(1)).alias("n")).join(low, "path")
    return checkpoint(each.groupBy("key").agg(F.max("n").alias("n"), F.collect_list("path").alias("low")))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", id_col: str = "page_id", least_pages: int = PAGES, least: float = LEAST, low_paths: int = LOW_PATHS) -> DataFrame:
    """id, url, text, n_chars of every row."""
    low = checkpoint(site_styles(pages, url_col, html_col, least_pages, least))
    h, x = _rows(pages, url_col, html_col)
    rows = pages.select(F.col(id_col).alias("i"), F.col(url_col).alias("u"), x, h.alias("h"))
    known: np.ndarray | None = None
    if low.count() <= low_paths:
        known = np.sort(low.toPandas()["path"].to_numpy(np.int64))
        rows = rows.withColumn("low", F.lit(None).cast("array<bigint>"))
    else:
        own = _own_low(pages, low, url_col, html_col)
        rows = join_repeated(rows.withColumn("key", F.xxhash64("h", "x")), own, "key", "n").select("i", "u", "x", "h", "low")

    def text(x: str | None, h: str, own: list[int] | None) -> str:
        page = Page(x or "", h)
        if known is not None:
            paths = np.unique(np.array(page.path, np.int64))
            at = np.searchsorted(known, paths)
            own = paths[(at < len(known)) & (known[np.minimum(at, len(known) - 1)] == paths)].tolist() if len(known) else ()
        return page.text(frozenset(own or ()))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = [text(x, h, some) for x, h, some in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)))]
        return pa.RecordBatch.from_pydict({"i": b.column(0), "u": b.column(1), "text": pa.array(out, pa.string()), "n_chars": pa.array(np.array([len(t) for t in out], np.int64))})

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return map_batches(rows, run, f"i {kinds[id_col]}, u {kinds[url_col]}, text string, n_chars bigint").toDF(id_col, url_col, "text", "n_chars")
