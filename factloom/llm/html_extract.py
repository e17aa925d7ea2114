r"""Main-text extraction from HTML by tree scoring (operator 10).

A page becomes a tree (end tags implied as browsers do; comments, scripts and
styles skipped). Navigation, headers, footers, asides, forms and hidden parts are
cut off with all below them, and so are elements one of whose class or id names, or
whose role, says nothing but that they are an advert, notice, menu, sidebar,
comment thread or the like ("site-header", "cookie-notice"). A name that only
mentions one ("has-sidebar", "no-comments") lowers the element's score. The
header of an article keeps its headings. Where nothing outside the elements cut
for a layout name scores, those are taken back, so that no article is lost to its class name.

Each remaining paragraph passes points for its length and commas to its ancestors:
whole to the parent, half to the next, a third of that and so on further up; a
container's score is discounted by the share of its text inside links. The best
container (its enclosing article or main element, if it has one) is kept with
those siblings that score near it or are prose themselves; inside, link lists are
left out.

Character references are decoded once, white space inside a block becomes one
space, blocks are trimmed and joined in page order by two \n. A br is white
space. Reading takes constant time a tag, also for stray end tags and under deep
nesting: for each tag it is known where it was opened last.

Nulls and odd rows: null or empty html gives an empty text; a page cut off in
mid-tag loses the unfinished tag only; a page without a scoring paragraph gives
all its remaining blocks. Rows are independent, so repeated rows agree. Further
columns pass through, but for text and n_chars, which are replaced.
"""

from __future__ import annotations

import html as entities
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.shared import table

RAW = frozenset("script style noscript template textarea iframe title svg math object xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CUT = frozenset("nav header footer aside form head button select option menu dialog fieldset label canvas audio video datalist".split()) | RAW
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li".split()
)
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table body html article section div main blockquote".split())
#: Names of parts that are no main text, by themselves or numbered; those that only tell where a part stands; and words that say nothing of a part.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promos promotion promoted comment comments disqus reply replies respond "
    "breadcrumb breadcrumbs cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations toolbar pagination pager copyright legal disclaimer search tags".split()
)
LAYOUT = frozenset("sidebar side menu nav navigation navbar footer foot header masthead widget widgets skip".split())
NEUTRAL = frozenset("box wrap wrapper container section list area block bar top bottom left right inner outer site global page primary secondary main sub row col links items module panel".split())
GOOD_NAME = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|post|story|text|blog|page)(?:$|[\s_-])", re.I)
BAD_ROLE = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"']+)*+)>|<(/?)([a-zA-Z][^\s/><]*)([^<>]*)>""")
ATTR = re.compile(r"""([a-zA-Z_:-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
LEAST, LINKED = 25, 0.5


def name_says(names: str) -> str:
    """What class and id names say of an element: "noise" or "layout" if one says only that, "hint" if one mentions it, else nothing."""
    told = ""
    for name in names.lower().split():
        words = [w.rstrip("0123456789") for w in re.split("[^a-z0-9]+", name) if w.rstrip("0123456789")]
        bad = [w for w in words if w in NOISE or w in LAYOUT]
        if bad and all(w in NOISE or w in LAYOUT or w in NEUTRAL for w in words):
            if any(w in NOISE for w in bad):
                return "noise"
            told = "layout"
        elif bad and not told:
            told = "hint"
    return told


class Page:
    """The tree as parallel lists; a node's parent always comes before it."""

    def __init__(self, source: str):
        self.tags, self.parents, self.cut, self.weight = ["#root"], [0], [False], [0.0]
        self.layout = [False]  # inside an element cut for a layout name
        self.blocks: list[tuple[int, str, int]] = []  # node, text, characters in links
        self.open, self.buffer, self.linked, self.in_link = [0], [], 0, 0
        self.depths: dict[str, list[int]] = {}  # where in the stack each tag is open
        self.bounds: list[int] = []  # where tags of SCOPE are
        self.blocks_open = [0]  # nodes that are no inline element
        self._read(source)

    def _flush(self) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            if text:
                self.blocks.append((self.blocks_open[-1], text, min(self.linked, len(text))))
        self.buffer, self.linked = [], 0

    def _text(self, piece: str) -> None:
        if piece and not self.cut[self.open[-1]]:
            piece = entities.unescape(piece) if "&" in piece else piece
            self.buffer.append(piece)
            if self.in_link:
                self.linked += len(" ".join(piece.split()))

    def _pop_to(self, depth: int) -> None:
        """Closes open elements down to a depth of the stack."""
        while len(self.open) > depth:
            tag = self.tags[self.open.pop()]
            self.depths[tag].pop()
            self.in_link -= tag == "a"
            if tag in SCOPE:
                self.bounds.pop()
            if tag not in INLINE:
                self.blocks_open.pop()

    def _close(self, names, scoped: bool) -> None:
        """Closes the innermost open element of these names, unless a scope's element is inside it."""
        depth = max((self.depths[n][-1] for n in names if self.depths.get(n)), default=0)
        if depth and not (scoped and self.bounds and self.bounds[-1] > depth):
            self._pop_to(depth)

    def _start(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            self._flush()
        if tag in CLOSES_P:
            self._close(("p",), True)
        if tag in SAME:
            self._close(SAME[tag], True)
        if tag == "a" and self.in_link:
            self._close(("a",), True)
        parent, cut, weight, layout = self.open[-1], tag in CUT, 25.0 if tag in ("article", "main") else 0.0, False
        if tag == "header" and (self.depths.get("article") or self.depths.get("main")):
            cut = False
        if self.tags[parent] == "header" and not self.cut[parent] and tag not in ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "div") and tag not in INLINE:
            cut = True
        if attributes and not self.cut[parent]:
            found = {k.lower(): a or b or c for k, a, b, c in ATTR.findall(attributes)}
            names = f"{found.get('class', '')} {found.get('id', '')}"
            if tag not in ("html", "body"):
                said = name_says(names)
                layout = said == "layout"
                cut |= said == "noise" or found.get("role", "").lower() in BAD_ROLE
                cut |= "hidden" in found or found.get("aria-hidden", "").lower() == "true"
                cut |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I))
                weight -= 10.0 if said == "hint" else 0.0
            weight += 10.0 if GOOD_NAME.search(names) else 0.0
        self.tags.append(tag)
        self.parents.append(parent)
        self.cut.append(cut or self.cut[parent])
        self.layout.append(layout or self.layout[parent])
        self.weight.append(weight)
        self.depths.setdefault(tag, []).append(len(self.open))
        if tag in SCOPE:
            self.bounds.append(len(self.open))
        self.open.append(len(self.tags) - 1)
        if tag not in INLINE:
            self.blocks_open.append(len(self.tags) - 1)
        self.in_link += tag == "a"

    def _read(self, source: str) -> None:
        at, lower = 0, None
        while (lt := source.find("<", at)) >= 0:
            self._text(source[at:lt])
            if source.startswith("<!--", lt):
                end = source.find("-->", lt + 4)
                at = len(source) if end < 0 else end + 3
            elif source.startswith(("<!", "<?"), lt):
                end = source.find(">", lt)
                at = len(source) if end < 0 else end + 1
            elif not (m := TAG.match(source, lt)):
                if not re.match(r"</?[a-zA-Z]|</?$", source[lt : lt + 3]):
                    self._text("<")
                    at = lt + 1
                    continue
                at = source.find("<", lt + 1)  # a tag that was cut off
                at = len(source) if at < 0 else at
            else:
                at, tag = m.end(), (m[2] or m[5]).lower()
                attributes = m[3] or m[6] or ""
                if m[1] or m[4]:
                    if tag not in INLINE:
                        self._flush()
                    self._close((tag,), False)
                elif tag in VOID:
                    if tag in ("br", "wbr", "img"):
                        self._text(" " if tag == "br" else "")
                    else:
                        self._flush()
                else:
                    self._start(tag, attributes)
                    if tag in RAW:
                        lower = lower or source.lower()
                        at = lower.find(f"</{tag}", at) if len(lower) == len(source) else self._raw_end(source, tag, at)
                        at = len(source) if at < 0 else at
        if at < len(source):
            self._text(source[at:])
        self._flush()

    @staticmethod
    def _raw_end(source: str, tag: str, at: int) -> int:
        m = re.compile(f"</{tag}", re.I).search(source, at)
        return m.start() if m else -1


def scores(text: str, inside: int) -> bool:
    """Whether a block scores: long enough, and not mostly links."""
    return len(text) >= LEAST and inside <= LINKED * len(text)


def chosen_blocks(page: Page) -> list[str]:
    n = len(page.tags)
    if any(page.layout):  # nothing is taken back where an article stands outside
        outside = [b for b in page.blocks if not page.layout[b[0]]]
        if any(scores(t, inside) for _, t, inside in outside):
            page.blocks, page.cut = outside, [c or x for c, x in zip(page.cut, page.layout, strict=True)]
    score, length, linked = list(page.weight), [0] * n, [0] * n
    scored = False
    for node, text, inside in page.blocks:
        length[node] += len(text)
        linked[node] += inside
        if not scores(text, inside):
            continue
        points = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - inside / len(text))
        scored = True
        own = node if page.tags[node] not in ("p", "pre", "blockquote", "li", "td") else page.parents[node]
        share = 1.0
        for level in range(6):
            score[own] += points * share
            if own == 0:
                break
            own, share = page.parents[own], 0.5 if level == 0 else share / 3
    for i in range(n - 1, 0, -1):
        length[page.parents[i]] += length[i]
        linked[page.parents[i]] += linked[i]
    if not scored and not any(page.tags[i] in ("article", "main") and length[i] and not page.cut[i] for i in range(n)):
        return [t for _, t, inside in page.blocks if inside <= LINKED * len(t)]
    density = [b / a if a else 0.0 for a, b in zip(length, linked, strict=True)]
    final = [s * (1 - d) if ln else -1.0 for s, d, ln in zip(score, density, length, strict=True)]
    best = max((i for i in range(n) if not page.cut[i]), key=lambda i: (final[i], -i))
    up = best
    while up:
        if page.tags[up] in ("article", "main"):
            best = up
        up = page.parents[up]
    keep = [False] * n
    keep[best] = True
    bar = max(10.0, 0.2 * final[best])
    for i in range(1, n):
        if best and page.parents[i] == page.parents[best] and i != best and not page.cut[i]:
            prose = page.tags[i] in ("p", "blockquote", "pre") and (length[i] > 80 and density[i] < 0.25 or length[i] and not linked[i])
            title = page.tags[i] in ("h1", "h2") and i < best and density[i] < 0.25
            keep[i] = final[i] >= bar or prose or title
    for i in range(1, n):
        keep[i] = keep[i] or keep[page.parents[i]]
    lists = [page.tags[i] in ("ul", "ol", "dl", "table") and density[i] > LINKED for i in range(n)]
    for i in range(1, n):
        lists[i] = lists[i] or lists[page.parents[i]]
    return [t for node, t, inside in page.blocks if keep[node] and not lists[node] and (inside < len(t) or page.tags[node] == "p")]


def main_text(source: str | None) -> str:
    """The article of a page, blocks joined by blank lines."""
    return "\n\n".join(chosen_blocks(Page(source))) if source else ""


@F.pandas_udf(T.StringType())
def main_text_column(pages: pd.Series) -> pd.Series:
    return pd.Series([main_text(x) for x in pages], dtype="object")


def extract(pages: DataFrame) -> DataFrame:
    """The pages with the columns text and n_chars; a text column of theirs is replaced."""
    return pages.withColumn("text", main_text_column("html")).withColumn("n_chars", F.length("text").cast("long"))


def op10_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")
