"""Main text of web pages by composite text density.

For every DOM node: C characters and T tags in its subtree, LC characters and LT tags
inside links. Its density is characters per tag, adjusted for links:

    C / T * log(C / LC * T / LT) / log(log(C / (C - LC) * LC + LCb / Cb * C + e))

(``b``: the body; zero denominators count as 1). The node with the largest sum of child
densities is the core of the article. The smallest density on the path from the body
to the core is the threshold. A core without blocks in it stands for its container; then
the selection climbs to the parent, below the body and not out of an article element,
while another child there reaches the threshold. If an article or main element holds
the core, all of it is taken but lists of links beside the core; else the blocks from the
page's headline (h1) to the core, or unlinked texts right before the core, come with it.

Scripts, styles, menus, page headers and footers, sidebars, notices, adverts, forms and
reader comments are left out before that: by element, by role, and by names in class and
id. A name counts where it is the last part of a class or id ("main-sidebar") or the first
one before words for containers ("sidebar-wrap"), not in a layout's name
("content-sidebar-wrap", "with-sidebar", "layout--sidebar"). An element that is named so, or
is a form, stays all the same if it holds a main element, the page's first article or h1,
or (reader comments excepted) more than half of the page's text outside links. White space inside a block becomes one blank, blocks are trimmed and joined by one
line end; a line break element is white space. Character references are decoded.

Null, empty or text-free html gives the empty text. A tag cut off at the end of the page is
dropped. Repeated rows and null ids are pages like any other; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, map_arrow, text_slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(
    "head script style noscript template nav aside footer button select textarea input iframe "
    "object svg canvas dialog menu audio video map".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr img".split())
# an opening tag of the key closes an open element of the value
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr"},
          "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = frozenset("html body table ul ol dl div article section main td th blockquote".split())
KEPT_ROOT = frozenset("html body article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
_NAME = re.compile(
    r"(?:ads?|adsby\w*|advert\w*|adsense|adbox|banner|sidebar|side|menu\w*|nav\w*|foot|footer|header|masthead|"
    r"cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|share|sharing|social|related|"
    r"recommend\w*|comments?|commentlist|respond|disqus|replies|newsletter|subscribe|subscription|promo\w*|"
    r"sponsor\w*|breadcrumbs?|widget|pagination|pager|toolbar|copyright|login|signup|widgets)")
_COMMENT = re.compile(r"comments?|commentlist|respond|disqus|replies")
_NOT_BEFORE = frozenset("has with without no is not by".split())
_CONTAINERS = frozenset(
    "area list wrap wrapper container box block section group row col column inner outer content body panel item "
    "items link links icon icons button buttons btn bar form post posts article articles title heading left right "
    "top bottom primary secondary main unit slot zone thread text message image logo site page".split())
LEAD = 60       # characters other than white space of a text before the core that counts as its lead without a headline
_CUT_TAG = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")


def _name_kind(token: str) -> str | None:
    """"comment" or "other" if a class or id names something that is not main text."""
    token = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", token).lower()     # siteFooter
    split = [p for p in re.split(r"([-_]+)", token) if p]
    words = [(re.sub(r"\d.*", "", p), split[i - 1] if i else "") for i, p in enumerate(split) if p[0] not in "-_"]
    words = [w for w in words if w[0]]
    if not words or words[0][0] in _NOT_BEFORE:
        return None
    last, glue = words[-1]
    named = None
    if _NAME.fullmatch(last) and glue != "--" and (len(words) < 2 or words[-2][0] not in _NOT_BEFORE):
        named = last
    elif _NAME.fullmatch(words[0][0]) and all(w in _CONTAINERS or _NAME.fullmatch(w) for w, _ in words[1:]):
        named = words[0][0]
    else:
        inner = [w for w, _ in words]
        while inner and inner[-1] in _CONTAINERS:
            inner.pop()
        if inner and len(inner) < len(words) and _COMMENT.fullmatch(inner[-1]):
            return "other"            # post-comments-section: unless it holds the main text
    return named and ("comment" if _COMMENT.fullmatch(named) else "other")


class Page(HTMLParser):
    """Builds the tree: nodes in document order with parent, tag and text runs."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.runs = [-1], ["html"], []   # runs: (node, text)
        self.stack = [0]
        self.names = ["html"]
        self.hidden = 0          # open elements inside a dropped one
        self.hidden_names: list[str] = []
        self.doubtful: dict[int, tuple[str, int]] = {}    # node -> kind of name, its first run

    def _dropped(self, tag: str, attrs) -> bool:
        if tag in DROPPED:
            return True
        if tag in KEPT_ROOT:
            return False
        if tag == "header":
            return not ("article" in self.names or "main" in self.names)
        for k, v in attrs:
            if not v:
                continue
            if k == "role" and v.strip().lower() in ROLES:
                return True
            if k == "hidden" or k == "aria-hidden" and v == "true":
                return True
        return False

    def _doubt(self, tag: str, attrs) -> str | None:
        """The kind of an element that goes unless it holds the main text."""
        if tag in KEPT_ROOT or tag == "header":
            return None
        kinds = {_name_kind(t) for k, v in attrs if k in ("class", "id") and v for t in v.split()}
        if tag == "form" or "other" in kinds or any(k == "role" and v and v.strip().lower() == "form" for k, v in attrs):
            return "other"
        return "comment" if "comment" in kinds else None

    def handle_starttag(self, tag, attrs):
        if self.hidden_names:
            if tag == "body":        # a head that never ended
                self.hidden_names.clear()
            elif tag not in VOID:
                self.hidden_names.append(tag)
                return
            else:
                return
        if tag in ("html", "body") and tag in self.names:
            return
        if tag not in INLINE:
            self._close_before(tag)
        if tag not in VOID and self._dropped(tag, attrs):
            self.runs.append((self.stack[-1], None))
            self.hidden_names.append(tag)
            return
        if tag in DROPPED:
            return
        self.parent.append(self.stack[-1])
        self.tag.append(tag)
        node = len(self.tag) - 1
        doubt = self._doubt(tag, attrs) if tag not in VOID else None
        if doubt:
            self.doubtful[node] = doubt, len(self.runs)
        self.runs.append((node, None if tag not in INLINE else " " if tag == "br" else ""))
        if tag not in VOID:
            self.stack.append(node)
            self.names.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close_before(self, tag: str) -> None:
        """End tags that html lets authors leave out."""
        shut = CLOSES.get(tag, frozenset())
        for i in range(len(self.names) - 1, 0, -1):
            name = self.names[i]
            if name == "p" or name in shut:
                del self.names[i:], self.stack[i:]
                if name != "p":
                    return
            elif name in SCOPE:
                return

    def handle_endtag(self, tag):
        if self.hidden_names:
            if tag in ("body", "html"):
                self.hidden_names.clear()
            elif tag in self.hidden_names:
                while self.hidden_names.pop() != tag:
                    pass
            return
        if tag in ("html", "body") or tag in VOID:
            return
        for i in range(len(self.names) - 1, 0, -1):
            if self.names[i] == tag:
                if tag not in INLINE:
                    self.runs.append((self.stack[i], None))
                del self.names[i:], self.stack[i:]
                return
            if tag in INLINE and self.names[i] not in INLINE:
                return

    def handle_data(self, data):
        if not self.hidden_names:
            self.runs.append((self.stack[-1], data))


def _drop_doubtful(page: Page) -> None:
    """Take doubtful elements that do not hold the main text out of the tree."""
    if not page.doubtful:
        return
    n = len(page.tag)
    parent, tag = page.parent, page.tag
    plain, in_link, holds = [0] * n, [False] * n, [False] * n
    for i in range(1, n):
        in_link[i] = tag[i] == "a" or in_link[parent[i]]
    for node, text in page.runs:
        if text and not in_link[node]:
            plain[node] += len("".join(text.split()))
    for name in ("article", "h1"):
        if name in tag:
            holds[tag.index(name)] = True
    for i in range(n - 1, 0, -1):
        plain[parent[i]] += plain[i]
        holds[parent[i]] = holds[parent[i]] or holds[i] or tag[i] == "main"
    gone = [False] * n
    runs: list = list(page.runs)
    for i in range(1, n):
        gone[i] = gone[parent[i]]
        if i in page.doubtful and not gone[i]:
            kind, at = page.doubtful[i]
            gone[i] = not holds[i] and (kind == "comment" or 2 * plain[i] <= plain[0])
            if gone[i]:
                runs[at] = parent[i], None        # a dropped element ends a block
    at = {i: k for k, i in enumerate(i for i in range(n) if not gone[i])}
    page.parent = [at.get(parent[i], -1) for i in at]
    page.tag = [tag[i] for i in at]
    page.runs = [(at[node], text) for node, text in runs if node in at]


def _density(c: float, t: float, lc: float, lt: float, body_ratio: float) -> float:
    base = math.log(c / max(c - lc, 1) * lc + body_ratio * c + math.e)
    spread = c / max(lc, 1) * max(t, 1) / max(lt, 1)
    # the base nears 1 where there are no links at all: log(base) stays above 0
    return c / max(t, 1) * math.log(max(spread, 1)) / max(math.log(base), 1e-3)


def main_text(html: str) -> str:
    page = Page()
    page.feed(_CUT_TAG.sub("", html))
    page.close()
    _drop_doubtful(page)
    n = len(page.tag)
    parent, tag = page.parent, page.tag
    chars, tags, link_chars, link_tags = ([0] * n for _ in range(4))
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = tag[i] == "a" or in_link[parent[i]]
    for node, text in page.runs:
        if text:
            size = len("".join(text.split()))
            chars[node] += size
            if in_link[node]:
                link_chars[node] += size
    for i in range(n - 1, 0, -1):        # children come after their parents
        p = parent[i]
        chars[p] += chars[i]
        link_chars[p] += link_chars[i]
        tags[p] += tags[i] + 1
        link_tags[p] += link_tags[i] + (tag[i] == "a")
    body = tag.index("body") if "body" in tag else 0
    if not chars[body]:
        body = 0
    if not chars[body]:
        return ""
    ratio = link_chars[body] / chars[body]
    density = [_density(chars[i], tags[i], link_chars[i], link_tags[i], ratio) if chars[i] else 0.0
               for i in range(n)]
    total = [0.0] * n
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        total[parent[i]] += density[i]
        children[parent[i]].append(i)
    core = max(range(n), key=lambda i: (total[i], chars[i], -i))
    path = [core]
    while path[-1] not in (body, 0):
        path.append(parent[path[-1]])
    least = min(density[i] for i in path)
    at = core
    # an inline element, or a block without blocks in it, stands for its container
    while at not in (body, 0) and (tag[at] in INLINE or all(tag[j] in INLINE for j in children[at])):
        at = parent[at]
    while at not in (body, 0) and tag[at] not in KEPT_ROOT:
        up = parent[at]
        if up in (body, 0) or not any(j != at and density[j] >= least and chars[j] for j in children[up]):
            break
        at = up
    linked = [2 * link_chars[i] > chars[i] for i in range(n)]
    semantic = at
    while semantic not in (body, 0) and tag[semantic] not in ("article", "main"):
        semantic = parent[semantic]
    if semantic not in (body, 0):
        # the whole article, without lists of links beside the path to its core
        without = set()
        while at != semantic:
            without.update(j for j in children[parent[at]] if j != at and linked[j])
            at = parent[at]
        return _blocks(page, {at}, without)
    return _blocks(page, {at, *_opening(page, children, at, body, [
        chars[i] and not linked[i] for i in range(n)], [
        chars[i] >= LEAD and not link_chars[i] for i in range(n)])}, set())


def _opening(page: Page, children: list, at: int, body: int, plain: list, lead: list) -> list[int]:
    """Blocks before the core ``at`` that belong to it: from the page's headline on, or else
    the unlinked texts right before it."""
    parent, tag = page.parent, page.tag
    path = [at]
    while path[-1] not in (body, 0):
        path.append(parent[path[-1]])
    heads = [i for i in range(at) if tag[i] == "h1"]
    if heads and not any(t == "h1" and _inside(parent, i, at) for i, t in enumerate(tag)):
        head = heads[-1]
        while parent[head] not in path and head > 0:
            head = parent[head]
        up = parent[head]
        if up in path[1:] and (up not in (body, 0) or tag.count("h1") == 1):
            end = path[path.index(up) - 1]
            return [j for j in children[up] if head <= j < end and (plain[j] or j == head)]
    out = []
    if len(path) > 1:
        for j in reversed([j for j in children[path[1]] if j < at]):
            if not lead[j]:
                break
            out.append(j)
    return out


def _inside(parent: list, i: int, root: int) -> bool:
    while i > root:
        i = parent[i]
    return i == root


def _blocks(page: Page, roots: set, without: set) -> str:
    inside = [False] * len(page.tag)
    for i in range(len(page.tag)):
        inside[i] = i not in without and (i in roots or (i > 0 and inside[page.parent[i]]))
    blocks, run = [], []
    for node, text in page.runs:
        if text is None:                 # a block begins or ends
            blocks.append(run)
            run = []
        elif text and inside[node]:
            run.append(text)
    blocks.append(run)
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` per page."""
    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "html"):
                texts = [main_text(h) if h else "" for h in column(part, "html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [column(part, "page_id"), column(part, "url"), pa.array(texts, pa.string()),
                     pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    src = pages.select(F.col(id_col).cast("long").alias("page_id"),
                       F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return map_arrow(src, run, "page_id long, url string, text string, n_chars long")
