"""Main text of web pages by line-block distribution.

Markup is stripped (comments, scripts, styles, templates, noscript, svg, the head and closed
nav and footer elements with their content; tags of block elements, also of forms and asides,
end a line, all others vanish), entities are resolved and each line is trimmed.  The block of a line is the sum of the text lengths of it and the ``WINDOW - 1``
lines after it.  Text surges at a line whose block is over ``SURGE`` characters while none
of the next two blocks is empty, and dives at the first line after it whose block, or the
next, is empty; or, with lines that never leave a gap, at the end.  The lines between are
kept if they reach ``LEAST`` characters of text.

Navigation links, list items and footers are short lines, so a line counts towards a block
only from ``LINE`` characters on, or if it ends a sentence; a short line inside the text
does no harm, as its neighbours carry the block.

Defined results: a null page gives null text, an empty one empty text; a page without a
surge gives empty text; unclosed tags, comments, scripts and styles end with the page, other
elements that are not closed lose only their tag; repeated rows and null ids are carried; an
empty table gives an empty result; other columns are not read.  Pages are processed whole.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

WINDOW = 3
SURGE = 86
LEAST = 86
LINE = 25

_BLOCKS = r"p|div|article|section|main|header|h[1-6]|ul|ol|li|dl|dt|dd|table|tr|td|th|blockquote|pre|br|hr|figure|figcaption|nav|footer|aside|form|select|option|iframe"
#: What is not main text; without its end only a comment or raw text runs to the end of the page.
_UNSEEN = re.compile(r"<!--|<(script|style|noscript|template|svg|head|nav|footer)\b[^>]*>|<![^>]*>|<\?[^>]*>", re.I)
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template", "svg")} | {
    "<!--": re.compile("-->"),
    "head": re.compile(rf"(?=</head\s*>|<body\b|<(?:{_BLOCKS})\b)", re.I),
    # One that is not closed before the next, or before the text, is open: its end tag is another's.
    "nav": re.compile(r"(</nav\s*>)|<(?:nav|main|article|h1|footer)\b|</(?:body|html)\b", re.I),
    "footer": re.compile(r"(</footer\s*>)|<(?:footer|main|article|h1)\b|</(?:article|body|html)\b", re.I),
}
_RAW = {"<!--", "script", "style"}
_BREAK = re.compile(rf"</?(?:{_BLOCKS}|head|body|html|title)\b[^>]*>", re.I)
_TAG = re.compile(r"<[a-zA-Z/][^>]*>?")
_BLANKS = re.compile(r"[^\S\n]+")
_SENTENCE = re.compile(r"[.!?…]['\"”»)]*$")


def _seen(page: str) -> str:
    """A page without comments, declarations and unseen elements, a line break for each.

    The content of a head is taken up to its end tag, the body or the first block element.
    """
    out, at, never = [], 0, set()
    for m in iter(lambda: _UNSEEN.search(page, at), None):
        name = (m[1] or ("<!--" if m[0] == "<!--" else "")).lower()
        end = _ENDS[name].search(page, m.end()) if name and name not in never else None
        open_ = end is not None and end.re.groups and end[1] is None
        out += (page[at : m.start()], "\n")
        if end is None and name in _RAW:
            return "".join(out)
        if end is None:  # so that a tag that is never closed is looked for once
            never.add(name)
        at = m.end() if end is None or open_ else end.end()
    return "".join([*out, page[at:]])


def lines_of(page: str) -> list[str]:
    """The trimmed lines of a page without its markup."""
    text = _TAG.sub("", _BREAK.sub("\n", _seen(page.replace("\r", "\n").replace("\n", " "))))
    return [line.strip() for line in _BLANKS.sub(" ", html.unescape(text)).split("\n")]


def extract(page: str | None, window: int = WINDOW, surge: int = SURGE, least: int = LEAST) -> str | None:
    """The main text of a page, one line a block element."""
    if page is None:
        return None
    lines = lines_of(page)
    sizes = [len(s) if len(s) >= LINE or (len(s) > 1 and _SENTENCE.search(s)) else 0 for s in lines]
    n, sums, total = len(lines), [], 0
    for i in range(n):  # blocks by a running sum
        total = sum(sizes[:window]) if i == 0 else total - sizes[i - 1] + (sizes[i + window - 1] if i + window <= n else 0)
        sums.append(total)
    out, start, i = [], None, 0
    at = lambda k: sums[k] if k < n else None
    while i < n:
        if start is None:
            if sums[i] > surge and all(at(i + k) != 0 for k in (1, 2)):
                start = i
        elif sums[i] == 0 or at(i + 1) == 0:
            out.append((start, i + 1))
            start = None
        i += 1
    if start is not None:
        out.append((start, n))
    kept = [[s for s in lines[a:b] if s] for a, b in out]
    return "\n".join("\n".join(k) for k in kept if sum(map(len, k)) >= least)


@F.arrow_udf(T.StringType())
def _extract(pages: pa.Array) -> pa.Array:
    return pa.array([extract(p) for part in slices(pages) for p in part.to_pylist()], pa.string())


def extracted(pages: DataFrame) -> DataFrame:
    """One row a page: page_id, url, text, n_chars."""
    t = pages.select("page_id", "url", _extract("html").alias("text"))
    return t.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
