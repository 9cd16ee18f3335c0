"""HTML extraction (operator 3): line-block distribution.

Markup is stripped into lines, a line for each block. A line's weight is the length of its text outside links (of
headings: the whole length); it is zero in navigation, forms, notices, adverts, comments, and outside the article that
a page names. Over the lines slides a window of WINDOW lines; its sum of weights makes the distribution.

Main text lies between a surge and the next dive: a dive is where the sum falls to zero, and a stretch between dives
surges if its sum reaches SURGE of the largest one of the page. A stretch that never surges (a line of a sidebar, a
plain notice) is left out. The points are then set to lines: a stretch begins and ends at lines with a weight, and
where the page names no article, short lines at either end that are no heading and no sentence go. Between the points
every line stays, linked ones too, but for those in unwanted parts.

Null or empty html gives the empty text; a page without text too; repeated rows give repeated results.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_texts, map_batches

WINDOW, SURGE = 3, 0.25
#: Characters from which a line at the end of a stretch counts as text by itself.
EDGE = 25
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|svg|iframe|object|select|canvas|math)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
#: Elements by what they do to text.
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIP = frozenset("nav footer aside form head menu dialog button header".split())
#: They hold the whole page or the article, whatever their class says.
_WHOLE = frozenset("html body main article".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SAYS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_BAD = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|sponsor(?:ed)?|promo(?:tion)?|banner|menu|nav(?:bar|igation)?|breadcrumbs?|sidebar|side|aside|footer|foot|header|masthead|cookies?|consent|notices?|alert|popup|modal|"
    r"newsletter|subscribe|signup|login|search|share|social|related|recommended|widget|comments?|replies|respond|disqus|pagination|pager|complementary|contentinfo)(?:$|[\s_\d-])",
    re.I,
)
_SPACES = re.compile(r"\s+")


_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_NOTICE = re.compile(r"^\s*(?:©|\(c\)\s|copyright\b)|\ball rights reserved\b", re.I)


class Line(NamedTuple):
    text: str
    #: Characters within links.
    linked: int
    heading: bool
    #: In a part that holds no main text.
    unwanted: bool
    #: In an element that names itself the article.
    article: bool


def lines_of(page: str) -> tuple[list[Line], bool]:
    """The lines of a page; whether it names an article."""
    out: list[Line] = []
    held: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, bool]] = []
    named = bad = article = heading = False
    links = 0

    def squeezed(parts: Iterable[str]) -> str:
        return _SPACES.sub(" ", html.unescape("".join(parts))).strip()

    def flush() -> None:
        if held:
            text = squeezed(t for t, _ in held)
            if text:
                linked = sum(len(squeezed([t])) for t, inside in held if inside)
                out.append(Line(text, linked, heading, bad, article))
            held.clear()

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            held.append((page[at : m.start()], links > 0))
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            if m["raw"]:
                held.append((" ", False))
            continue
        if name == "a":
            links = 0 if m["end"] else 1
        if name in _INLINE:
            if name == "br":
                held.append((" ", False))
            if not _SAYS.search(m["rest"]) or name in _VOID:
                continue
        if m["end"]:
            if any(s[0] == name for s in stack):
                flush()
                while stack.pop()[0] != name:
                    pass
        elif name in _VOID:
            flush()
        else:
            says = " ".join(x for s in _SAYS.findall(m["rest"]) for x in s)
            unwanted = bool(says and name not in _WHOLE and _BAD.search(says)) or name in _SKIP and not (name == "header" and article)
            if name not in _INLINE:
                flush()
                links = 0
                if name in _CLOSES_P and any(s[0] == "p" for s in stack):
                    while stack.pop()[0] != "p":
                        pass
                if name == "li" and stack and stack[-1][0] == "li":
                    stack.pop()
            elif not unwanted:
                continue
            else:
                flush()
            inside = name in ("article", "main") or 'itemprop="articlebody"' in m["rest"].lower()
            named |= inside
            stack.append((name, unwanted, inside))
        bad, article = any(s[1] for s in stack), any(s[2] for s in stack)
        heading = any(s[0] in _HEADINGS for s in stack)
    if at < len(page):
        held.append((page[at:], links > 0))
    flush()
    return out, named


def weights(lines: list[Line], named: bool) -> list[int]:
    """What each line adds to the distribution."""
    out = []
    for x in lines:
        if x.unwanted or named and not x.article or not named and _NOTICE.search(x.text):
            out.append(0)
        else:
            out.append(len(x.text) if x.heading else max(0, len(x.text) - x.linked))
    return out


def stretches(weight: list[int], window: int = WINDOW, surge: float = SURGE) -> list[tuple[int, int]]:
    """First and last line of each stretch between a surge and its dive."""
    sums = [sum(weight[i : i + window]) for i in range(len(weight))]
    least = surge * max(sums, default=0)
    found, start, peak = [], None, 0
    for i, s in enumerate([*sums, 0]):
        if s:
            start, peak = (i if start is None else start), max(peak, s)
        elif start is not None:
            if peak >= least:
                held = [k for k in range(start, i) if weight[k]]
                found.append((held[0], held[-1]))
            start, peak = None, 0
    return found


def _is_text(x: Line) -> bool:
    return x.heading or len(x.text) - x.linked >= EDGE or x.text.endswith((".", "!", "?", "…", '."', ".)", "”", "»", "。"))


def main_text(page: str) -> str:
    lines, named = lines_of(page)
    weight = weights(lines, named)
    out = []
    for first, last in stretches(weight):
        if not named:
            while first < last and not _is_text(lines[first]):
                first += 1
            while last > first and not _is_text(lines[last]):
                last -= 1
        out += [x.text for x in lines[first : last + 1] if not x.unwanted and (x.article or not named)]
    return "\n\n".join(out)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars; a row per page."""

    def run(batch: pa.RecordBatch) -> dict:
        found = [main_text(x) for x in as_texts(batch, html_col)]
        return {id_col: batch.column(id_col), url_col: batch.column(url_col), "text": found, "n_chars": [len(x) for x in found]}

    return map_batches(pages.select(id_col, url_col, html_col), run, f"{id_col} bigint,{url_col} string,text string,n_chars bigint")
