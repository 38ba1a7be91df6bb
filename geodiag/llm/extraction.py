"""Operator 12: main text of web pages by the distribution of line blocks.

Markup is stripped to lines: each start or end of a block element begins the next line, so nested
containers leave empty lines between texts. Lines of elements that are no article by their name or
by the words of their class, id or role (menus, notices, adverts, forms and the like) weigh
nothing, and neither do the texts of links outside of a declared article.

Weights are then summed over windows of ``WINDOW`` lines. The sums rise from zero at a surge point
and fall back to zero at a dive point; the text between the two is kept if the sums reach the
threshold in between. A page that declares its article (``article``, ``main`` or a container named
so) has weight there alone, and every surge in it counts, however short its text.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geodiag.llm.tables import table
from geodiag.runtime import ship

#: lines of a window, and the sum of characters that a surge reaches (less on pages whose highest sum is below twice that)
WINDOW, SURGE = 6, 86

# Names of HTML elements, and words by which pages name their parts.
RAW = frozenset("script style textarea noscript iframe xmp noembed noframes template title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
NEVER = frozenset("head nav footer aside dialog search menu button select datalist svg canvas object audio video applet map label fieldset legend".split())
REFUSED = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar sidenav aside footer header masthead cookie cookies consent gdpr notice notices alert disclaimer popup modal overlay newsletter subscribe subscription signup login search searchbox form share sharing social related recommended recommendations widget widgets toolbar pagination pager comment comments disqus respond responses replies reply complementary contentinfo skip tags".split()
)
#: in a name these say that an element's parts, or none of them, are what follows
ABOUT = frozenset("has with no without".split())
NAMED = frozenset("article content post entry story main".split())
BODIES = frozenset("article main post entry story articlebody entrycontent postcontent maincontent articlecontent postbody storybody content".split())
#: an open element of the first kind ends where one of its group begins, unless one of the second kind was opened since
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",)), "tfoot": (("thead", "tbody", "tr", "td", "th"), ("table",)), "option": (("option",), ("select",)), "a": (("a",), ("table",)), "body": (("head",), ()),
}

MARKUP = re.compile(r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|/(?:[^a-zA-Z>][^>]*(?:>|\Z)|>)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
CLOSING = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in RAW}

#: what an open element says of its text
REFUSE, LINK, HEADS = 1, 2, 4


class Lines:
    """Lines of one page: text, characters in links, and the open element that says most of them."""

    def __init__(self, page: str):
        self.text: list[str] = []
        self.linked: list[int] = []
        self.refused: list[int] = []  # 0, or the number of the outermost refused element
        self.bodies: list[tuple[int, ...]] = []  # declared articles that hold the line
        self.kinds = {0: ""}  # of refused elements
        self.ranks: dict[int, int] = {}  # of declared articles: the lower, the surer
        self.at = 0
        self.places: list[int] = []
        self._read(page)

    def _read(self, page: str) -> None:
        stack, opened, parts, linked, spot = [], {}, [], 0, 0
        # an entry: name, whether in a link, number of the refusing element, declared articles, whether only headings count
        link, refused, bodies, heads = False, 0, (), False

        def flush() -> None:
            nonlocal linked
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.text.append(text)
                    self.linked.append(linked)
                    self.refused.append(refused or (-1 if heads and not any(x[0] in HEADING for x in stack) else 0))
                    self.bodies.append(bodies)
                    self.places.append(self.at)
                parts.clear()
                linked = 0
            self.at += 1

        def close(depth: int) -> None:
            nonlocal link, refused, bodies, heads
            if any(x[0] in BLOCK for x in stack[depth:]):
                flush()
            while len(stack) > depth:
                name, link, refused, bodies, heads = stack.pop()
                opened[name].pop()

        def add(raw: str) -> None:
            nonlocal linked
            if raw:
                text = html.unescape(raw)
                parts.append(text)
                if link:
                    linked += len(text.strip())

        for m in iter(lambda: MARKUP.search(page, spot), None):
            add(page[spot : m.start()])
            spot = m.end()
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                if opened.get(name):
                    close(opened[name][-1])
                elif name in BLOCK:
                    flush()
                elif name == "br":
                    parts.append(" ")
                continue
            if name in RAW:
                end = CLOSING[name].search(page, spot)
                spot = end.end() if end else len(page)
                continue
            if name in BLOCK:
                if opened.get("p"):
                    close(opened["p"][-1])
                if name in HEADING and stack and stack[-1][0] in HEADING:
                    close(len(stack) - 1)
            if name in ENDS:
                group, scope = ENDS[name]
                since = max((opened[s][-1] for s in scope if opened.get(s)), default=-1)
                if open_ := [opened[g][-1] for g in group if opened.get(g) and opened[g][-1] > since]:
                    close(min(open_))
            if name in VOID or name == "plaintext":
                if name in BLOCK:
                    flush()
                elif name in ("br", "wbr"):
                    parts.append(" " if name == "br" else "")
                continue
            if name in BLOCK:
                flush()
            opened.setdefault(name, []).append(len(stack))
            stack.append((name, link, refused, bodies, heads))
            link = link or name == "a"
            if not refused:
                kind, rank = _kind(name, m[3], bool(bodies))
                if kind == "head":
                    heads = True
                elif kind:
                    refused = len(self.kinds)
                    self.kinds[refused] = kind
                elif rank:
                    number = len(self.ranks)
                    self.ranks[number] = rank
                    bodies = (*bodies, number)
        add(page[spot:])
        flush()


def _kind(name: str, attributes: str, within: bool) -> tuple[str, int]:
    """Why an element's text is refused ("": it isn't), and its rank among declared articles (0: it's none). ``within``: a declared article holds it."""
    names, role, body = [], "", ""
    for key, *values in ATTRIBUTE.findall(attributes) if attributes and not attributes.isspace() else ():
        value, key = next(filter(None, values), ""), key.lower()
        if key == "hidden" or key == "style" and HIDDEN.search(value):
            return "hidden", 0
        if key in ("class", "id"):
            names += value.split()
        elif key == "role":
            role = value.lower()
        elif key == "itemprop":
            body = value.lower()
    if name in NEVER or role in REFUSED:
        return name, 0
    if name == "header" and not within:
        return name, 0
    words = [[w.lower() for w in WORD.findall(n)] for n in names]
    if name not in ("html", "body") and not (name in HEADING and within):
        for w in words:
            if not REFUSED.isdisjoint(w) and ABOUT.isdisjoint(w):
                if "header" in w and within and REFUSED.intersection(w) == {"header"}:
                    return "head", 0
                if not (name == "main" or name == "article" and not {"comment", "ad", "ads", "sponsored", "promo", "related"}.intersection(w)):
                    return "named", 0
    if name == "form":
        return name, 0
    if name == "header":
        return "head", 0
    if name == "article":
        return "", 1
    if name == "main" or role == "main" or body == "articlebody":
        return "", 2
    if name not in ("html", "body", "p", "span", "a") and any("".join(w) in BODIES or name in ("div", "section", "td") and len(w) > 1 and NAMED.issuperset(w) for w in words):
        return "", 3
    return "", 0


def surges(weight: np.ndarray, at: np.ndarray, threshold: float | None = None, window: int = WINDOW) -> np.ndarray:
    """Which lines stand between a surge point and its dive point. Lines with text, in page order: their weights and line numbers.

    The sum of a window is zero just where ``window`` lines in a row have no weight. Between two such places the text is kept
    if any window's sum reaches the threshold (default: 86 characters, or half the highest sum if that is less).
    """
    kept = np.zeros(len(weight), bool)
    heavy = np.flatnonzero(weight > 0)
    if not len(heavy):
        return kept
    total = np.concatenate([[0], np.cumsum(weight)])
    # a window that begins at a line with weight has the highest sum of those that end before the next
    sums = total[np.searchsorted(at, at[heavy] + window)] - total[heavy]
    if threshold is None:
        threshold = min(float(SURGE), sums.max() / 2)
    first = np.concatenate([[0], np.flatnonzero(np.diff(at[heavy]) > window) + 1])
    last = np.append(first[1:], len(heavy)) - 1
    high = np.maximum.reduceat(sums, first) >= threshold
    for a, b in zip(heavy[first[high]], heavy[last[high]]):
        kept[a : b + 1] = True
    return kept


def main_text(page: str | None) -> str:
    """Blocks of a page's main text, joined by one line feed; white space (Unicode's) within a block is one space."""
    lines = Lines(page or "")
    if not lines.text:
        return ""
    size = np.array([len(t) for t in lines.text])
    refused = np.array(lines.refused)
    # a form around a whole page is no form of the article
    for number, kind in lines.kinds.items():
        if kind == "form" and 2 * size[refused == number].sum() > size[refused <= 0].sum() + size[refused == number].sum():
            refused[refused == number] = 0
    weight = np.where(refused == 0, size, 0)
    at = np.array(lines.places)
    # the declared article with the most text, of the surest rank that has any
    mass: dict[int, int] = {}
    for w, held in zip(weight.tolist(), lines.bodies):
        for number in held:
            mass[number] = mass.get(number, 0) + w
    if declared := [n for n, w in mass.items() if w]:
        rank = min(lines.ranks[n] for n in declared)
        best = max((n for n in declared if lines.ranks[n] == rank), key=lambda n: (mass[n], -n))
        kept = surges(np.where([best in held for held in lines.bodies], weight, 0), at, 1)
        kept &= np.array([best in held for held in lines.bodies])
    else:
        linked = np.minimum(np.array(lines.linked), size)
        kept = surges(np.where(2 * linked > size, 0, np.maximum(weight - linked, 0)), at)
    kept &= refused == 0
    return "\n".join(t for t, k in zip(lines.text, kept) if k)


TEXT = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): ``page_id, url, text, n_chars``, the code points of ``text``.

    Whole pages are read. A null or empty page, and one without any article text, has the empty text. Broken markup is read as
    browsers do: tags may be left open, a tag or comment that never ends goes to the page's end. Rows are treated alone, so
    ties and repeated rows give equal rows; null page_id and url stay null, and an empty table gives none. Other columns are ignored.
    """

    def one(batches):
        for batch in batches:
            pages = batch["html"]
            text = pa.array([main_text(pages[k].as_py()) for k in range(batch.num_rows)], pa.string())
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], text, pa.array([len(t.as_py()) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    ship(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(one, TEXT)


def op12_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


#: for pages with one article element of headings and paragraphs, as the given ones are
OP12_SQL = r"""
with parts as (
    select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) as body from pages
), blocks as (
    select page_id, url, list_filter([trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '</?b>', '', 'g'), '&quot;', '"'), '&amp;', '&'), '&amp', '&'), '[ \t\n\r\f\v]+', ' ', 'g')) for x in regexp_split_to_array(body, '</?(?:p|h1)>')], lambda x: x <> '') as kept from parts
)
select page_id, url, coalesce(array_to_string(kept, chr(10)), '') as text, cast(length(coalesce(array_to_string(kept, chr(10)), '')) as bigint) as n_chars from blocks
"""
