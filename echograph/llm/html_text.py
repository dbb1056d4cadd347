"""Main text of web pages by line-block distribution.

A page becomes a list of blocks at its block-level tags. Scripts, styles, comments, the head and form
controls are no text at all. A block's weight is the length of its text outside links. Blocks inside
menus, page headers, footers, sidebars, notices, adverts, forms and reader comments are left out first:
tags and roles say so for certain, names of class and id only where the element does not hold the page's
article or title, or without these nearly all of its text.

Weights are summed over a sliding window of three blocks. A region runs from the surge point, where the
sum leaves nothing, to the dive point, where it falls back to nothing; the region with most text holds
the main text. Its container is then widened: to the element around it as long as more prose stands
there, up to the article or main element, else below the body. What the container holds between its
first and its last block is the main text, short lines and link lists in between included; where text
stands in the body itself, all from the first to the last region that has text directly in a
container of the best one is. Marked articles beside each other are taken together.

Null or empty html, and pages without text outside what is left out: empty text. Where all text is in
links, links weigh as text. Equal regions: the first. Broken markup is read as far as it goes, and the
time is linear in the page: a quote that never closes ends nothing, a `<` without `>` is text. Rows are
independent: repeated pages give repeated rows, and columns other than key, url and html are not carried.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

NAME = "op7_html_text"
WINDOW = 3
#: On a page without article, main and h1, an element that only its name calls noise is noise up to this part of the page's text.
HINTED = 0.9
#: Length of a block that is prose without a full stop.
LONG = 80
#: Containers inside each other that are told apart; deeper ones count as the one at this depth.
DEPTH = 100

#: Elements whose content is no running text.
RAW = frozenset("script style noscript template textarea select svg iframe object title".split())
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
BARE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset("nav footer aside form menu dialog".split())
OUTER = frozenset("article main".split())
#: End tags close nothing beyond these.
BARRIERS = ASIDE | OUTER | {"td", "th"}
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
#: Parts of class and id names that call an element noise, and parts that say nothing either way.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar cookie cookies consent gdpr notice alert newsletter subscribe signup popup modal overlay comment comments disqus replies respond share sharing social related recommended widget widgets pagination pager".split()
)
NEUTRAL = frozenset("side bar page site top bottom left right main box block wrap wrapper container content area section slot unit list items item inner outer links link bar row col panel posts articles stories news form thread feed buttons icons js".split())
DENIALS = frozenset("no not non has with without".split())
NAMED = re.compile(r"\b(class|id|role)\b\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*))", re.I)
PROSE = re.compile(r"[.!?…。！？:;][\"'”’»)\]]*$")
#: A paragraph ends where one of these begins.
CLOSES_P = BLOCKS - {"html", "body", "head"}
#: Blocks that are text, not containers of text.
LINES = frozenset("p h1 h2 h3 h4 h5 h6".split())
#: Inside running text names of these tell of style, not of noise.
INLINE = frozenset("p b i em strong span h1 h2 h3".split())


def called_noise(name: str) -> bool:
    """Whether a class or id says noise: its last part does, or all parts do or say nothing and one does."""
    for word in name.lower().split():
        parts = [p for p in re.split(r"[-_]+|(?<=\D)(?=\d)", word) if p and not p.isdigit()]
        if parts and not any(p in DENIALS for p in parts) and (parts[-1] in NOISE or any(p in NOISE for p in parts) and all(p in NOISE or p in NEUTRAL for p in parts)):
            return True
    return False


def _noise(tag: str, attr: str, inside: bool) -> tuple[bool, bool]:
    """Noise for certain, noise by its name. inside: within an article, where a header holds its title."""
    if tag in ASIDE or (tag == "header" and not inside):
        return True, False
    hinted = False
    if attr and tag not in ("html", "body", "main"):
        for name, a, b, c in NAMED.findall(attr):
            value, name = a or b or c, name.lower()
            if name == "role" and value.lower() in ROLES:
                return True, False
            hinted = hinted or name != "role" and not (inside and tag in INLINE) and called_noise(value)
    return False, hinted


def tokens(page: str) -> Iterator[tuple[str, bool, str, str]]:
    """(text before a tag, whether it closes, tag, attributes) in page order; the tag is empty for the text at the end."""
    at, start, n = 0, 0, len(page)
    tag_of, open_raw = TAG, set()
    while True:
        i = page.find("<", at)
        if i < 0:
            break
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            yield page[start:i], False, "", ""
            start = at = n if end < 0 else end + 3
            continue
        if page[i + 1 : i + 2] in ("!", "?"):
            end = page.find(">", i)
            yield page[start:i], False, "", ""
            start = at = n if end < 0 else end + 1
            continue
        m = None
        if page[i + 1 : i + 2] == "/" or page[i + 1 : i + 2].isalpha():
            m = tag_of.match(page, i)
            if m is None and tag_of is TAG and page[i + 1 : i + 3].strip("/")[:1].isalpha():
                tag_of = BARE_TAG  # a quote stays open to the end: from here on quotes do not count
                m = tag_of.match(page, i)
            if m is None and tag_of is BARE_TAG and page.find(">", i) < 0:
                break  # no tag ends any more
        if m is None:
            at = i + 1
            continue
        closing, tag, attr = m[1] == "/", m[2].lower(), m[3]
        yield page[start:i], closing, tag, attr
        start = at = m.end()
        if tag in RAW and not closing and not attr.endswith("/") and tag not in open_raw:
            end = re.compile(rf"</{tag}\s*+>", re.I).search(page, at)
            if end:
                start = at = end.end()
            elif tag in ("script", "style"):
                start = at = n
            else:
                open_raw.add(tag)  # never closed: its content is read as text
    yield page[start:], False, "", ""


class Element:
    """An open container: the one around it, its depth, what its names say, what it holds."""

    __slots__ = ("up", "tag", "depth", "hinted", "titled", "weight", "flag")

    def __init__(self, up: Element | None, tag: str, hinted: bool, titled: bool = False):
        self.up, self.tag, self.hinted, self.titled, self.weight, self.flag = up, tag, hinted, titled, 0, False
        self.depth = up.depth + 1 if up else 0


def blocks(page: str) -> tuple[list[tuple[str, int, bool, Element]], list[Element]]:
    """Blocks in page order (text, its length outside links, whether it is noise for certain, the element that holds it), and the elements, outer ones first."""
    out: list[tuple[str, int, bool, Element]] = []
    words: list[str] = []
    linked = links = inside = 0
    in_head = noise = False
    here = Element(None, "", False)
    elements = [here]
    stack: list[tuple[str, bool, Element, int]] = []  # open elements: tag; noise, element and marks around it
    scopes: list[dict[str, int]] = [{}]  # how many of a tag are open, within the innermost article or aside

    def flush() -> None:
        nonlocal words, linked
        if words:
            text = " ".join(entities.unescape("".join(words)).split())
            if text:
                out.append((text, max(0, len(text) - linked), noise, here))
            words, linked = [], 0

    def close(tag: str) -> None:
        """Closes the innermost open `tag` of this scope and all that is open inside it."""
        nonlocal noise, here, inside
        while True:
            t, noise, here, inside = stack.pop()
            if t in BARRIERS:
                scopes.pop()
            else:
                scopes[-1][t] -= 1
            if t == tag:
                return

    for some, closing, tag, attr in tokens(page):
        if some and not in_head:
            words.append(some)
            if links:
                linked += len(some)
        if not tag:
            continue
        if tag == "br":
            words.append(" ")
            continue
        if tag in ("a", "button"):
            links = 0 if closing else 1
            continue
        if tag == "head":
            in_head = not closing
            continue
        if tag == "body":
            in_head = False
        if closing:
            if tag in BLOCKS:
                flush()
            if scopes[-1].get(tag):  # a stray end tag closes nothing beyond its container
                flush()
                close(tag)
                links = 0
            continue
        if tag in VOID or attr.endswith("/"):
            if tag in BLOCKS:
                flush()
            continue
        sure, hinted = _noise(tag, attr, bool(inside)) if attr or tag in ASIDE or tag == "header" else (False, False)
        if tag not in BLOCKS and not sure and not hinted:
            continue
        flush()
        if tag in CLOSES_P and scopes[-1].get("p"):
            close("p")
        if tag in ("html", "body"):
            continue
        stack.append((tag, noise, here, inside))
        if tag in BARRIERS:
            scopes.append({tag: 1})
        else:
            scopes[-1][tag] = scopes[-1].get(tag, 0) + 1
        if (hinted or tag in BLOCKS and tag not in LINES) and here.depth < DEPTH:
            here = Element(here, tag, hinted, tag in OUTER and not inside and not hinted)
            elements.append(here)
        elif tag == "h1":
            here.titled = True
        if tag in OUTER:
            inside += 1
        noise = noise or sure
    flush()
    return out, elements


def _common(a: Element, b: Element) -> Element:
    while a is not b:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
    return a


def regions(weight: list[int]) -> list[tuple[int, int]]:
    """(first, after last) of the runs of blocks between surge and dive points, without weightless blocks at their ends."""
    out, start, last = [], None, 0
    for i, w in enumerate(weight):
        if w:
            if start is not None and i - last > WINDOW:  # a whole window without text lies between
                out.append((start, last + 1))
                start = None
            start = i if start is None else start
            last = i
    if start is not None:
        out.append((start, last + 1))
    return out


def _drop_hinted(found: list, elements: list[Element]) -> list:
    """Without blocks inside elements that their names call noise, but for those that hold the page's article, title or nearly all text."""
    for _, w, _, e in found:
        e.weight += w
    for e in reversed(elements[1:]):
        e.up.weight += e.weight
        e.up.titled = e.up.titled or e.titled
    most = elements[0].weight if elements[0].titled else HINTED * elements[0].weight
    for e in elements[1:]:
        e.flag = e.up.flag or e.hinted and not e.titled and e.weight <= most
    return [b for b in found if not b[3].flag]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found, elements = blocks(page)
    found = _drop_hinted([b for b in found if not b[2]], elements)
    weight = [b[1] for b in found]
    if not any(weight):
        weight = [len(b[0]) for b in found]
    runs = regions(weight)
    if not runs:
        return ""
    held = [{found[i][3] for i in range(a, b) if weight[i]} for a, b in runs]
    best = max(range(len(runs)), key=lambda k: (sum(weight[slice(*runs[k])]), -k))
    box = found[max(range(*runs[best]), key=lambda i: (weight[i], -i))][3]
    mark, e = None, box
    while e is not None:
        mark, e = (e if e.tag in OUTER else mark), e.up
    if mark is None:
        box = _widened(found, weight, runs[best], box)
        if box.up is None:
            same = [r for r, h in zip(runs, held, strict=True) if h & held[best]]
            return "\n".join(b[0] for b in found[same[0][0] : same[-1][1]])
    for e in elements:  # outer ones come first
        e.flag = e is box if mark is None else e.tag in OUTER and e.up is mark.up
        e.flag = e.flag or e.up is not None and e.up.flag
    return "\n".join(b[0] for b in found if b[3].flag)


def _widened(found: list, weight: list[int], run: tuple[int, int], box: Element) -> Element:
    """The innermost element around the heaviest block of a region outside which no prose stands; the page if its own text is part of the region."""
    if any(found[i][3].up is None for i in range(*run) if weight[i]):
        while box.up is not None:
            box = box.up
        return box
    for i, b in enumerate(found):
        if weight[i] and (weight[i] >= LONG or PROSE.search(b[0])):
            wider = _common(box, b[3])
            box = box if wider.up is None else wider
    return box


def extract(df: DataFrame, html: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """key, url, text, n_chars."""
    common.ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                texts = [main_text(x) for x in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [key, url, "text", "n_chars"])

    kinds = [df.schema[c].dataType.simpleString() for c in (key, url)]
    return df.select(F.col(key), F.col(url), F.col(html)).mapInArrow(run, f"`{key}` {kinds[0]}, `{url}` {kinds[1]}, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(common.table(spark, sf_dir, "pages"))


ORACLE_SQL = None
