"""Main text of web pages by line-block distribution.

Markup is stripped to lines: one a block-level element, with its text and the share of it in links; lines are never
dropped for their markup before they are weighed. The block at a line is the sum of unlinked text lengths over a window of
WINDOW lines; text begins where a block surges over the threshold and ends where it dives below it. What lies between
stays. Markup only refines this: lines in what is never article text (menus, notices, adverts, comments, hidden parts)
weigh nothing and are cut out of a stretch; headings and paragraphs that adjoin a stretch join it; within
a window of its ends it loses lines of links, and lines that are not headings or paragraphs where it has such (not in an
article, where there is one).

Defined results: a null or empty page, and one without visible text, gives the empty string; unclosed tags end
where their parent ends; character references without a meaning stay as they are. A form, or an element marked by words
of its class, id or role, counts for text if it holds an article or half of the page's unlinked text.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import small_arrow_batches

WINDOW, SURGE = 3, 80
_RAW = re.compile(r"<(script|style|noscript|template|svg|math|iframe|object|canvas|audio|video|select|datalist|textarea|button|title)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>")
_ATTR = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
# Element names and the words in class, id and role that mark what is not article text.
_BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OFF = frozenset("nav aside footer form menu dialog head".split())
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption caption".split())
_BAD = frozenset("ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion promoted sidebar sidenav menu menubar nav navbar navigation breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice notices disclaimer newsletter subscribe subscription signup signin login paywall popup modal overlay share sharing social related recommended recommendations comment comments commentlist disqus respond replies reply widget toolbar pagination pager skip search complementary contentinfo banner toc teaser outbrain taboola alert".split())
_ARTICLE = frozenset("article post entry content story main body text".split())


@dataclass
class Line:
    text: str
    linked: int
    tag: str
    off: bool
    inside: bool


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)} if "=" in raw else {}


def _off(tag: str, raw: str, inside: bool) -> int:
    """2 for elements that are never article text, 1 for those that say so by a word, 0 for others."""
    if tag == "form":
        return 1
    if tag in _OFF or (tag == "header" and not inside):
        return 2
    if tag in ("html", "body", "main", "article") or not raw:
        return 0
    at = _attributes(raw)
    if re.search(r"(?:^|\s)hidden(?:\s|=|$)", raw) or at.get("aria-hidden") == "true" or "display:none" in at.get("style", "").replace(" ", "").lower():
        return 2
    words: set[str] = set()
    for k in ("class", "id", "role"):
        if k in at:
            words.update(_WORDS.findall(_CAMEL.sub(" ", at[k]).lower()))
    if words & _BAD:
        return 1
    return int("header" in words and not inside and not words & _ARTICLE)


def _uncommented(page: str) -> str:
    """The page without comments (to the end, if not closed), CDATA sections, declarations and instructions, by one scan."""
    out, at, last_section, last = [], 0, page.rfind("]]>"), page.rfind(">")
    for m in re.finditer("<[!?]", page):
        start = m.start()
        if start < at:
            continue
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            end = len(page) if end < 0 else end + 3
        elif page.startswith("<![CDATA[", start) and start + 9 <= last_section:
            end = page.find("]]>", start + 9) + 3
        elif start + 2 <= last:
            end = page.find(">", start + 2) + 1
        else:
            break
        out.append(page[at:start])
        at = end
    return "".join([*out, page[at:]])


def lines(page: str) -> tuple[list[Line], bool]:
    """The lines of a page and whether it has an article or main; each tag is looked at a fixed number of times."""
    page = _RAW.sub(" ", _uncommented(page))
    tags = [(m.start(), m.end(), bool(m[1]), m[2].lower(), m[3]) for m in _TAG.finditer(page)]
    ends: dict[int, int] = {}
    open_: dict[str, list[int]] = {}
    text, texts, articles, in_link, at = 0, [], [0], 0, 0
    for i, (start, stop, close, tag, raw) in enumerate(tags):
        text += 0 if in_link else len(page[at:start].strip())
        at = stop
        texts.append(text)
        articles.append(articles[-1] + (tag in ("article", "main") and not close))
        if close:
            if open_.get(tag):
                ends[open_[tag].pop()] = i
        elif tag not in _VOID and not raw.endswith("/"):
            open_.setdefault(tag, []).append(i)
        if tag == "a":
            in_link = not close
    text += 0 if in_link else len(page[at:].strip())

    out: list[Line] = []
    buf: list[str] = []
    linked, at, in_link, inside, until = 0, 0, 0, 0, -1
    stack: list[str] = []
    blocks: list[str] = []
    held: Counter[str] = Counter()
    seen = False

    def flush():
        nonlocal linked
        got = _SPACE.sub(" ", _html.unescape("".join(buf))).strip()
        if got:
            out.append(Line(got, min(linked, len(got)), blocks[-1] if blocks else "", until >= 0, inside > 0))
        buf.clear()
        linked = 0

    for i, (start, stop, close, tag, raw) in enumerate(tags):
        piece = page[at:start]
        if piece:
            buf.append(piece)
            if in_link:
                linked += len(piece.strip())
        at = stop
        if tag in _BLOCK or i == until:
            flush()
        if i == until:
            until = -1
        if close:
            if tag == "a":
                in_link = 0
            last = None
            while held[tag] and last != tag:
                last = stack.pop()
                held[last] -= 1
                if last in _BLOCK:
                    blocks.pop()
            if tag in ("article", "main") and inside:
                inside -= 1
            continue
        if tag in _VOID or raw.endswith("/"):
            continue
        kind = _off(tag, raw, bool(inside)) if until < 0 else 0
        if kind and i in ends:
            end = ends[i]
            if kind == 2 or (articles[end] == articles[i] and 2 * (texts[end] - texts[i]) < text):
                flush()
                until = end
        if tag == "a":
            in_link = 1
        if tag in ("article", "main"):
            seen = seen or until < 0
            inside += 1
        stack.append(tag)
        held[tag] += 1
        if tag in _BLOCK:
            blocks.append(tag)
    buf.append(page[at:])
    flush()
    return out, seen


def stretches(weight: list[int]) -> list[tuple[int, int]]:
    """Where blocks of WINDOW lines surge to the threshold and dive below it again: half-open ranges of lines."""
    n = len(weight)
    sums = [sum(weight[i : i + WINDOW]) for i in range(n)]
    limit = min(SURGE, max(sums, default=0)) or 1
    out: list[tuple[int, int]] = []
    i = 0
    while i < n:
        if sums[i] < limit:
            i += 1
            continue
        surge = i
        while i < n and sums[i] >= limit:
            i += 1
        dive = min(n, i - 1 + WINDOW)
        # Lines without weight at either end are only in the window.
        while not weight[surge]:
            surge += 1
        while not weight[dive - 1]:
            dive -= 1
        if out and surge <= out[-1][1]:
            surge, dive = out[-1][0], max(dive, out.pop()[1])
        out.append((surge, dive))
    return out


def extract(page: str | None) -> str:
    if not page:
        return ""
    every, seen = lines(page)
    seen = seen and any(x.inside and not x.off for x in every)
    plain = lambda x: not x.off and 2 * x.linked <= len(x.text)
    good = lambda x: x.tag in _TEXT and plain(x) and (x.inside or not seen)
    found: list[tuple[int, int]] = []
    for a, b in stretches([0 if x.off else max(0, len(x.text) - 2 * x.linked) for x in every]):
        a = _extended(every, a - 1, found[-1][1] - 1 if found else -1, -1, good) + 1
        b = _extended(every, b, len(every), 1, good)
        if not found or b > found[-1][1]:
            found.append((max(a, found[-1][1] if found else 0), b))
    some = any(good(x) for a, b in found for x in every[a:b])
    fits = good if some else lambda x: not _stray(x)
    # Between two stretches of one article nothing is dropped but what is never its text.
    whole = [all(x.off or (x.inside if seen else good(x)) for x in every[b : found[i + 1][0]]) for i, (_, b) in enumerate(found[:-1])]
    kept: list[str] = []
    for i, (first, last) in enumerate(found):
        a, b = first, last
        # A surge or dive is known to within a window, so the ends move by less than that.
        while not (i and whole[i - 1]) and a < min(b, first + WINDOW) and not fits(every[a]):
            a += 1
        while not (i < len(whole) and whole[i]) and b > max(a, last - WINDOW) and not fits(every[b - 1]):
            b -= 1
        if a == b and not some and any(plain(x) for x in every[first:last]):
            a, b = first, last  # nothing but short lines: they are the text
        kept += _without_islands(every[a:b])
        if i < len(whole) and whole[i]:
            kept += [x.text for x in every[last : found[i + 1][0]] if not x.off]
    return " ".join(kept)


def _extended(every: list[Line], at: int, end: int, step: int, good) -> int:
    """The first line from at towards end that does not join a stretch: headings and paragraphs do, across short islands too."""
    while at != end:
        ahead = at
        while ahead != end and every[ahead].off and abs(ahead - at) < WINDOW:
            ahead += step
        if ahead == end or not good(every[ahead]):
            break
        at = ahead + step
    return at


def _without_islands(part: list[Line]) -> list[str]:
    """The texts without lines of other markup; runs of WINDOW such lines dive and are never inside a stretch."""
    out: list[str] = []
    for off, run in groupby(part, key=lambda x: x.off):
        run = list(run)
        out += [x.text for x in run] if not off or len(run) >= WINDOW else []
    return out


def _stray(x: Line) -> bool:
    if x.off or x.linked * 2 > len(x.text):
        return True
    return x.tag not in _TEXT and len(x.text) < SURGE and (not re.search(r"[.!?…:;]['\"”»)]*$", x.text) or bool(re.match(r"(©|\(c\)|copyright)", x.text, re.I)))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages(page_id, url, html)."""
    small_arrow_batches(pages.sparkSession)

    def run(batches):
        for b in batches:
            text = [extract(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    slim = pages.select("page_id", "url", F.col("html"))
    schema = pages.select("page_id", "url").schema.add("text", "string")
    return slim.mapInArrow(run, schema).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
