"""Operator 5: main text of web pages by the distribution of text over blocks of lines."""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from strandlake.llm.exchange import fresh
from strandlake.llm.kernels import portions

#: Lines per block, and the block length in characters at which text surges outside a marked article.
BLOCK, SURGE = 3, 86
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|<[a-zA-Z/!?][^>]*(?:>|\Z)""", re.S | re.I)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead title tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements and words of class, id or role that never hold main text.
OUTSIDE = frozenset("head title nav footer aside form button menu dialog label input fieldset".split())
HINTS = frozenset(
    "nav navbar navigation menu menus menubar breadcrumb breadcrumbs sidebar sidebars rail footer foot header masthead topbar banner banners ad ads advert adverts advertisement advertising "
    "adslot sponsor sponsored promo promos promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations comment comments commentlist commenting disqus discussion discussions reply replies respond response responses thread threads feedback imprint impressum widget widgets pagination pager toolbar search form copyright contentinfo complementary".split()
)

#: Words that say nothing beside a hint, as in "sidebar-box-left"; any other word makes a name a subject, as in "social-history".
NEUTRAL = frozenset(
    "area articles bar block bottom box button buttons col column container content count desktop email entries entry fixed global group holder icon icons inline inner item items js large left link links list "
    "community reader readers user users visitor visitors your "
    "mail main mobile module outer page panel post posts primary region right row secondary section site slot small sticky stories story text title top unit wrap wrapper zone".split()
)
#: A header of one of these is the article's own.
HEADED = frozenset("article post entry story content".split())
#: Further words of a name that marks an article on a page without article or main elements, as in "story-body".
BODY = frozenset("body text main full page single".split())


def _clutter(name: str) -> bool:
    """Whether a class, an id or a role names something beside the article."""
    words = {x.lower() for x in _NAME.findall(name)}
    hints = words & HINTS
    if hints == {"header"} and not words.isdisjoint(HEADED):
        return False
    return bool(hints) and all(w in HINTS or w in NEUTRAL or w in HEADED or w.isdigit() for w in words)


def _article(attributes: str) -> bool:
    """Whether a class or an id names an article, as "story" or "post-content"."""
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id"):
            for name in (m[2] or "").strip("\"'").split():
                words = {x.lower() for x in _NAME.findall(name)}
                if words & HEADED and words <= HEADED | BODY:
                    return True
    return False


def _outside(tag: str, attributes: str, inside_article: bool) -> bool:
    if tag in OUTSIDE or tag == "header" and not inside_article:
        return True
    if attributes and tag not in ("body", "html", "main"):
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or "").strip("\"'")
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            if name in ("class", "id", "role"):
                # Ids made from titles: of any heading, and of a section if they have other words too.
                if name == "id" and inside_article and (tag in HEADINGS or tag == "section" and not {x.lower() for x in _NAME.findall(value)} <= HINTS):
                    continue
                if any(_clutter(x) for x in value.split()):
                    if not (inside_article and value.lower() == "header"):
                        return True
    return False


def lines_of(page: str, named: bool = False) -> list[tuple[str, int, int, bool, int]]:
    """(text, characters outside links, empty lines before, is a heading, number of the outermost article around it or 0).

    With ``named`` elements whose class or id names an article count as one.  A row
    for each block with text that is not outside, in order.  A block tag begins
    a line, so two paragraphs have one empty line between them, and blocks of
    different containers have more.  What is outside leaves no trace.
    """
    out, parts, stack = [], [], []
    linked = articles = gap = 0
    outside = article = links = headings = 0

    def flush() -> None:
        nonlocal parts, linked, gap
        text = " ".join(html.unescape("".join(parts)).split()) if not outside else ""
        if text:
            out.append((text, max(0, len(text) - linked), max(0, gap), headings > 0, articles if article else 0))
            gap = -1  # the tag that ends the block ends its line
        parts, linked = [], 0

    def close(to: int) -> None:
        nonlocal outside, article, links, headings
        while len(stack) > to:
            tag, was_outside, was_article = stack.pop()
            outside -= was_outside
            article -= was_article
            headings -= tag in HEADINGS
            links -= tag == "a"

    at = 0
    for m in _TOKEN.finditer(page):
        text = page[at : m.start()]
        at = m.end()
        if text:
            parts.append(text)
            linked += len(text) if links else 0
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag in BLOCKS:
            flush()
        elif tag in ("br", "td", "th"):
            parts.append(" ")
        if tag in VOID:
            continue
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    gap += tag in BLOCKS and not outside
                    close(k)
                    break
        else:
            if tag == "p" and stack and stack[-1][0] == "p":
                close(len(stack) - 1)
            hint = _outside(tag, m[4], article > 0)
            marks = tag in ("article", "main") or named and tag in BLOCKS and tag not in ("html", "body") and bool(m[4]) and _article(m[4])
            stack.append((tag, hint, marks))
            outside += hint
            gap += tag in BLOCKS and not outside
            headings += tag in HEADINGS
            if marks:
                articles += article == 0
                article += 1
            links += tag == "a"
    parts.append(page[at:])
    flush()
    return out


def main_text(page: str | None) -> str:
    """The blocks of the article, joined by one line feed.

    Markup, scripts, comments and what is named as a menu, header, footer, form,
    advert and the like are stripped and each block becomes a line.  A line's weight
    is its number of characters outside links; lines outside any article of a page
    that marks some have none.  The block length at a line is the sum of the weights
    of BLOCK lines from there on.  Text surges where the block length passes the
    threshold, and dives where another container begins and the block length is
    under it.  Every surge is kept, with the headings that lead to it.  An article in
    which text surges is kept whole, and marked articles without a surge, such as
    teasers of others, are not.  Where no element is an article, those that are named
    one count.  On a page without either, any line with weight between the first and
    the last surge is kept, with single lines of links between two such, and lines
    before and after, such as unnamed menus and notices, are not.
    """
    blocks = lines_of(page or "")
    if not any(number for *_, number in blocks):
        blocks = lines_of(page or "", named=True)
    marked = any(number for *_, number in blocks)
    lines = [x for x in blocks if x[4] or not marked]
    if not lines:
        return ""
    # A text's place among all lines; more empty lines than a block has change nothing.
    place = np.cumsum([1 + min(gap, BLOCK) for _, _, gap, *_ in lines])
    weight = np.zeros(int(place[-1]) + BLOCK + 1, np.int64)
    weight[place] = [n for _, n, *_ in lines]
    total = np.concatenate([[0], np.cumsum(weight)])
    block = total[BLOCK:] - total[:-BLOCK]
    threshold = min(SURGE, int(block.max()) // 2)
    number = {int(p): k for k, p in enumerate(place)}
    found, i = [], 0
    while i < len(block):
        if block[i] > threshold and i in number and weight[i]:
            dive = i
            while dive < len(block) and not (block[dive] <= threshold and dive not in number and dive + 1 not in number):
                dive += 1
            first = number[i]
            while first and lines[first - 1][3]:
                first -= 1
            found.append((first, int(np.searchsorted(place, dive))))
            i = dive
        i += 1
    if marked:
        # An article of links alone has no weight; it is better than nothing.
        chosen = {lines[k][4] for a, b in found for k in range(a, b)}
        return "\n".join(x[0] for x in lines if x[4] in chosen or not found)
    last = found[-1][1] if found else 0
    keep = {k for a, b in found for k in range(a, b) if lines[k][1] or lines[k][3]} | {k for k in range(found[0][0] if found else 0, last) if lines[k][1]}
    # A block that is wholly a link belongs to the run it stands in; several in a row are a menu.
    keep |= {k for k in range(1, len(lines) - 1) if k - 1 in keep and k + 1 in keep}
    return "\n".join(lines[k][0] for k in sorted(keep))


def extract_main_text(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """Adds the main text of each page; null, empty and text-free pages give an empty string.

    Pages are read whole, whatever their length.  Rows repeated in full are
    extracted each; a column named like the new one stays, and the new one is
    named anew.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*pages.schema.fields, T.StructField(fresh(pages, out), T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for record in batches:
            for batch in portions(record, html_col):
                texts = pa.array([main_text(p) for p in batch.column(html_col).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*batch.columns, texts], arrow)], schema=arrow)

    return pages.mapInArrow(run, schema)


def op5_html_extract(pages: DataFrame) -> DataFrame:
    """Main text of all pages."""
    done = extract_main_text(pages.select("page_id", "url", "html"))
    return done.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
