"""The main text of web pages, by composite text density.

A page is parsed to a tree with the end tags that HTML implies. Elements that are menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles or reader comments by their tag, role, class or id are cut away: a class or
id by its whole name (`cookie-bar`), and where it only holds such a word (`related-work`) if the element is mostly
links. Then densities choose, and no tag does:

1. A node's density is its characters per tag, times a logarithm that falls with the share of its characters and tags
   that are links, on a base that grows with the links of the page (`densities`). Its density sum is that of its
   children's densities; of a leaf, its own density.
2. The least density on the path from the subtree with the greatest sum up to the body is the threshold. The best
   subtree of every node that is reached from the body over nodes at or above the threshold belongs to the article.
3. The article is the least subtree that holds all of these, widened while what its parent holds besides is mostly
   not links (a heading before it, short blocks after it), short of the body unless it is a mere paragraph of it. Of that, containers go that are under
   the threshold and either mostly links or outside what density chose. Headings right under the body that come
   before belong to it.

Defined results: a null or empty page has an empty text. Pages without a tag give their whole text. Ties between
density sums go to the node that starts first. Very long and very deep pages are parsed whole, in time that grows with
their length. Repeated rows are extracted alike; an empty table gives an empty result; extra columns are left out
unless named in `keep`, and one called like the result is replaced by it.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh, quoted, table

# Element names as HTML has them, and words that name page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
FURNITURE = frozenset("head nav aside footer form script style noscript template iframe button select textarea title svg canvas object dialog menu audio video noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Parts of class names and ids that name furniture wherever all other parts are `STRUCTURE`.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent gdpr popup modal overlay newsletter subscribe sidebar nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus toolbar pagination pager login signup widget widgets topbar".split()
)
#: Parts that name furniture or the subject of a text: alone or beside other words, only links confirm them.
DOUBTFUL = frozenset("notice notices notification alert promotion subscription side menu respond replies discussion share sharing social related recommended recommendations search header".split())
#: Such of them as name furniture when a class says nothing else; ids may be slugs of headings.
PLAIN = frozenset("notice notices notification alert promotion subscription menu share sharing".split())
STRUCTURE = frozenset("area bar block bottom box button buttons center container content fixed global group header holder inner item items left link links list main outer page panel post posts primary reader right row secondary section site slot sticky text title top user wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("ul ol div section table dl".split())
TEXTS = HEADINGS | frozenset("p pre blockquote".split())
OUTERMOST = frozenset({"#root", "html", "body"})

#: An open element of the first kind is closed by the opening of one of the second, unless one of the third lies between.
IMPLIED = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "tbody": (frozenset({"tr", "td", "th", "thead", "tbody", "tfoot"}), frozenset({"table"})),
    "tfoot": (frozenset({"tr", "td", "th", "thead", "tbody", "tfoot"}), frozenset({"table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
P_SCOPE = frozenset({"html", "table", "td", "th", "caption", "button", "object", "template"})

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.DOTALL,
)
#: One attribute: its whole name and, if any, its value.
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?|.", re.DOTALL)
_PART = re.compile(r"[\s_-]+")


class _Page:
    """A parsed page: parallel lists by node, in page order, and the texts with the node each belongs to."""

    def __init__(self, source: str):
        self.tag, self.parent, self.cut = ["#root"], [-1], [False]
        #: (node, text), or (-1, "") where a block begins or ends
        self.texts: list[tuple[int, str]] = []
        self.in_article = [False]
        #: Nodes whose class or id may name furniture.
        self.doubtful: list[int] = []
        #: How many elements of each name are open, so that no search for one that isn't runs up a deep stack.
        self.open: dict[str, int] = defaultdict(int)
        self._parse(source)

    def _parse(self, source: str) -> None:
        tag, parent, cut, texts, stack = self.tag, self.parent, self.cut, self.texts, [0]
        at, end, sections = 0, len(source), True
        while at < end:
            m = _TOKEN.search(source, at)
            begin = m.start() if m else end
            if begin > at:
                texts.append((stack[-1], source[at:begin]))
            if not m:
                break
            at = m.end()
            name = m[2] or m[5]
            if not name:
                if m[0] == "<![CDATA[":
                    # Up to its end, or a comment up to the next bracket; a missing end is looked for once.
                    close = source.find("]]>", at) if sections else -1
                    sections = close >= 0
                    at = close + 3 if sections else (source.find(">", at) + 1 or end)
                continue
            name = name.lower()
            if name in BLOCK:
                texts.append((-1, ""))
            if m[1] or m[4]:
                if self.open[name]:
                    i = len(stack) - 1
                    while tag[stack[i]] != name:
                        i -= 1
                    self._pop(stack, i)
                continue
            attributes = m[3] or m[6] or ""
            if name in CLOSES_P:
                self._close(frozenset({"p"}), P_SCOPE, stack)
            if name in IMPLIED:
                self._close(*IMPLIED[name], stack)
            above = stack[-1]
            node = len(tag)
            tag.append(name)
            parent.append(above)
            self.in_article.append(self.in_article[above] or name in ("article", "main"))
            verdict = cut[above] or self._furniture(name, attributes, self.in_article[above])
            cut.append(bool(verdict))
            if verdict is None:
                self.doubtful.append(node)
            if name in VOID or attributes.endswith("/") and name not in BLOCK and name not in RAW:
                continue
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(source, at)
                at = close.end() if close else end
                continue
            stack.append(node)
            self.open[name] += 1

    def _pop(self, stack: list[int], i: int) -> None:
        for node in stack[i:]:
            self.open[self.tag[node]] -= 1
        del stack[i:]

    def _close(self, names, scope, stack: list[int]) -> None:
        """Closes the nearest open element of `names`, and what is in it, unless one of `scope` lies between."""
        i = len(stack) - 1
        while any(self.open[x] for x in names):
            name = self.tag[stack[i]]
            if name in names:
                self._pop(stack, i)
            elif name in scope:
                return
            i -= 1

    @staticmethod
    def _furniture(name: str, attributes: str, in_article: bool) -> bool | None:
        """Whether an element is cut; None if that is for its links to say."""
        if name in FURNITURE:
            return True
        if name in ("html", "body", "main", "article"):
            return False
        if name == "header" and not in_article:
            return True
        if not attributes:
            return False
        seen, doubtful = set(), False
        for a in _ATTRIBUTE.finditer(attributes):
            what, value = (a[1] or "").lower(), a[2] or a[3] or a[4] or ""
            if what in seen:
                continue  # the first of a name counts
            seen.add(what)
            if what == "hidden":
                return True
            if what == "role":
                if value.strip().lower() in ROLES:
                    return True
            elif what == "class" or what == "id" and name not in HEADINGS:
                for word in value.lower().split():
                    parts = {x for x in _PART.split(word) if x and not x.isdigit()}
                    if parts & NAMES and parts <= NAMES | DOUBTFUL | STRUCTURE:
                        return True
                    if what == "class" and name not in HEADINGS and parts & PLAIN and parts <= PLAIN | STRUCTURE:
                        return True
                    if not in_article and "header" in parts and parts <= {"header", "site", "top", "global", "main"} or not in_article and word == "site-title":
                        return True
                    doubtful = doubtful or bool(parts & (NAMES | DOUBTFUL))
        return None if doubtful else False


def densities(chars: list[int], link_chars: list[int], tags: list[int], link_tags: list[int], page: float) -> list[float]:
    """The composite text density of every node, by the characters and tags in it and those of them in links.

    `page` is the share of links in the characters of the whole page. Counts of 0 are 1 where they divide; where the
    logarithm's base would be 1 (no link anywhere), all that is left is characters per tag.
    """
    out = []
    for c, lc, t, lt in zip(chars, link_chars, tags, link_tags, strict=True):
        per_tag = c / (t or 1)
        base = math.log(math.log(c / max(1, c - lc) * lc + page * c + math.e))
        out.append(per_tag * math.log(max(1, c) / (lc or 1) * max(1, t) / (lt or 1)) / base if c and base > 1e-9 else per_tag)
    return out


def main_text(source: str | None) -> str:
    """The article of a page: blocks in page order, one space between them and for any white space within."""
    if not source:
        return ""
    page = _Page(source)
    tag, parent, cut = page.tag, page.parent, page.cut
    n = len(tag)
    chars, link_chars = [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = in_link[parent[i]] or tag[i] == "a"
    texts, page_chars, page_links = [], 0, 0
    for node, raw in page.texts:
        if node < 0:
            texts.append((node, raw))
            continue
        text = html_lib.unescape(raw) if "&" in raw else raw
        size = len("".join(text.split()))
        page_chars += size
        page_links += size * in_link[node]
        if not cut[node]:
            texts.append((node, text))
            chars[node] += size
            link_chars[node] += size * in_link[node]
    if page.doubtful:
        all_chars, all_links = list(chars), list(link_chars)
        for i in range(n - 1, 0, -1):
            all_chars[parent[i]] += all_chars[i]
            all_links[parent[i]] += all_links[i]
        for i in page.doubtful:
            # A link by itself, or in one, is no list of links.
            cut[i] = cut[i] or not in_link[i] and 2 * all_links[i] > all_chars[i]
        for i in range(1, n):
            if cut[parent[i]] and not cut[i]:
                cut[i] = True
        texts = [(node, text) for node, text in texts if node < 0 or not cut[node]]
        for i in range(n):
            if cut[i]:
                chars[i] = link_chars[i] = 0
    tags, link_tags = [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        if not cut[i]:
            p = parent[i]
            chars[p] += chars[i]
            link_chars[p] += link_chars[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + in_link[i]
    density = densities(chars, link_chars, tags, link_tags, page_links / max(1, page_chars))
    sums, leaf = [0.0] * n, [True] * n
    for i in range(1, n):
        if not cut[i]:
            sums[parent[i]] += density[i]
            leaf[parent[i]] = False
    for i in range(n):
        if leaf[i] and not cut[i]:
            sums[i] = density[i]
    best = max((i for i in range(n) if not cut[i]), key=lambda i: (sums[i], -i), default=0)
    threshold, i = density[best], best
    while i > 0:
        i = parent[i]
        if tag[i] not in ("html", "#root"):
            threshold = min(threshold, density[i])
    core = region = _around(_dense(tag, parent, cut, density, sums, threshold) | {best}, parent)
    while tag[region] not in OUTERMOST and (tag[above := parent[region]] not in OUTERMOST or tag[region] in TEXTS):
        if 2 * (link_chars[above] - link_chars[region]) > chars[above] - chars[region]:
            break
        region = above
    inside, chosen = _below(region, parent), _below(core, parent)
    # Of what widening brought in, and of what holds links, containers under the threshold go.
    dropped = [False] * n
    on_path = {region, *_path(core, region, parent)}
    for i in range(1, n):
        sparse = inside[i] and i not in on_path and tag[i] in CONTAINERS and density[i] < threshold
        dropped[i] = dropped[parent[i]] or sparse and (2 * link_chars[i] > chars[i] or not chosen[i])
    kept = [inside[i] and not dropped[i] for i in range(n)]
    for i in range(1, n):
        # A title that stands before the article, right under the body.
        if i < region and not cut[i] and (kept[parent[i]] and tag[parent[i]] not in OUTERMOST or tag[i] in HEADINGS and tag[parent[i]] in OUTERMOST):
            kept[i] = True
    out = "".join(" " if node < 0 else text if kept[node] else "" for node, text in texts)
    return " ".join(out.split())


def _dense(tag: list[str], parent: list[int], cut: list[bool], density: list[float], sums: list[float], threshold: float) -> set[int]:
    """The best subtrees of every node that is reached from the root over nodes at or above the threshold."""
    best = list(range(len(parent)))
    for i in range(len(parent) - 1, 0, -1):
        if not cut[i]:
            best[parent[i]] = min(best[parent[i]], best[i], key=lambda k: (-sums[k], k))
    reached, found = [True] + [False] * (len(parent) - 1), set()
    for i in range(1, len(parent)):
        reached[i] = reached[parent[i]] and not cut[i] and (tag[i] == "html" or density[i] >= threshold)
        if reached[i] and tag[i] != "html" and sums[best[i]] > 0:
            found.add(best[i])
    return found


def _around(nodes: set[int], parent: list[int]) -> int:
    """The least subtree that holds all `nodes`."""
    if not nodes:
        return 0
    held = [0] * len(parent)
    for i in range(len(parent) - 1, 0, -1):
        held[i] += i in nodes
        if held[i] == len(nodes):
            return i
        held[parent[i]] += held[i]
    return 0


def _below(top: int, parent: list[int]) -> list[bool]:
    inside = [False] * len(parent)
    inside[top] = True
    for i in range(top + 1, len(parent)):
        inside[i] = inside[parent[i]]
    return inside


def _path(i: int, top: int, parent: list[int]) -> Iterator[int]:
    while i > 0 and i != top:
        yield i
        i = parent[i]


def extracted(df: DataFrame, html: str = "html", keep: list[str] | None = None, column: str = "text") -> DataFrame:
    """The columns `keep` of `df` (all but the page itself, if None) and the main text; one of the same name goes."""
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in (html.lower(), column.lower())]
    source = fresh("_html", keep)
    chosen = df.select(*(quoted(c) for c in keep), quoted(html).alias(source))
    schema = chosen.drop(source).withColumn(column, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x.as_py()) for x in batch.column(len(keep))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], texts], names=[*keep, column])

    return chosen.mapInArrow(run, schema)


def op4_composite_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extracted(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return pages.withColumn("n_chars", F.length("text").cast("long"))
