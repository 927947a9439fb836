"""HTML to text by a tokenising state machine."""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.plans.registry import query
from marlstone.session import Tables

# Elements that begin a line of their own.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead title tr ul".split()
)
# Elements whose content is no markup; of the last two it is text, of the others nothing is shown.
RAW = frozenset("script style xmp iframe noembed noframes title textarea".split())
SHOWN = frozenset("title textarea".split())

_NAME = re.compile(r"</?[A-Za-z][^\s/>]*+")
#: Attributes up to the end of a tag. A quote counts after an equals sign alone, and then hides ``>``.
_ATTRIBUTES = re.compile(r"""(?>[\s/]+|[^\s/>][^\s/>=]*+(?>\s*+=\s*+(?>"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?)?)*+>""")
_SPACE = re.compile(r"[ \t\n\f\r]+")

#: What `html_fields` gives for each page.
FIELDS = "struct<title string, text string, blocks long, links long>"
_ARROW = pa.struct([("title", pa.string()), ("text", pa.string()), ("blocks", pa.int64()), ("links", pa.int64())])


def tokens(page: str):
    """The tokens of a page in order: ("text", words), ("raw", words of a title or text area), ("open", name) and ("close", name).

    One pass, each character is read a bounded number of times. A comment, a tag or a
    script that isn't closed runs to the end of the page; a ``<`` before anything but a
    letter, ``/``, ``!`` or ``?`` is text.
    """
    at, end, state = 0, len(page), ""
    while at < end:
        if state:  # inside an element without markup: only its own end tag counts
            close = re.compile(rf"</{state}(?=[\s/>])", re.IGNORECASE).search(page, at)
            stop = close.start() if close else end
            if state in SHOWN and stop > at:
                yield "raw", page[at:stop]
            at, state = stop, ""
            continue
        start = page.find("<", at)
        if start < 0:
            start = end
        if start > at:
            yield "text", page[at:start]
        if start == end:
            return
        if page.startswith("<!--", start):
            if page.startswith((">", "->"), start + 4):
                at = page.index(">", start) + 1
                continue
            stop = re.compile("--!?>").search(page, start + 4)
            at = stop.end() if stop else end
        elif name := _NAME.match(page, start):
            tag = _ATTRIBUTES.match(page, name.end())
            if not tag:
                return
            at, word = tag.end(), name[0].strip("</").lower()
            yield ("close" if name[0][1] == "/" else "open"), word
            if name[0][1] != "/" and word in RAW:
                state = word
        elif page.startswith(("<!", "<?", "</"), start):
            stop = page.find(">", start)
            at = stop + 1 if stop >= 0 else end
        else:
            yield "text", "<"
            at = start + 1


def fields(page: str | None) -> dict | None:
    """Title, lines of text, and the numbers of lines and of links of a page; None for none."""
    if page is None:
        return None
    lines, line, title, links, titled = [], [], None, 0, False
    for kind, value in tokens(page):
        if kind in ("text", "raw"):
            value = entities.unescape(value)
            line.append(value)
            if kind == "raw" and titled and title is None:
                title = _SPACE.sub(" ", value).strip(" ")
        else:
            titled = kind == "open" and value == "title"
            links += kind == "open" and value == "a"
            if value in BLOCKS:
                lines.append("".join(line))
                line = []
    lines.append("".join(line))
    lines = [x for x in (_SPACE.sub(" ", x).strip(" ") for x in lines) if x]
    return {"title": title, "text": "\n".join(lines), "blocks": len(lines), "links": links}


def html_fields(page: Column | str) -> Column:
    """Title, text, number of lines of text and number of links of a column of pages, as a struct of type `FIELDS`.

    Block elements and ``<br>`` end a line, spaces run together, lines without text go,
    lines are joined by a newline. Entities are those of HTML 5. Scripts, styles, comments
    and tags are left out, attributes may hold ``>`` in quotes, and what isn't closed runs
    to the end. Null gives null; an empty page has an empty text and no title. Batches travel in
    Arrow, a page is never cut, and no shuffle is needed.
    """

    @F.arrow_udf(FIELDS)
    def parse(pages: pa.Array) -> pa.Array:
        return pa.array([fields(p.as_py()) for p in pages], type=_ARROW)

    return parse(page)


_TWIN = r"""WITH bare AS (SELECT page_id, html, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<(script|style)\b[^>]*>.*?</(script|style)>', '', 'g') AS h FROM pages),
lined AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(h, '[ \t\n\f\r]+', ' ', 'g'), '(?i)</?(html|head|title|body|nav|ul|li|div|article|h1|p|br|footer)\b[^>]*>', chr(10), 'g'), '<[!/a-zA-Z][^>]*>', '', 'g') AS h FROM bare),
told AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '&quot;?', '"', 'g'), '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g') AS h FROM lined),
tidy AS (SELECT page_id, html, trim(regexp_replace(regexp_replace(h, ' +', ' ', 'g'), ' *\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) AS text FROM told)
SELECT page_id, CASE WHEN regexp_matches(html, '(?s)<title>.+?</title>') THEN regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), '&quot;?', '"', 'g'), '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g') END AS title, text,
CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS blocks, len(regexp_extract_all(html, '<a ')) AS links FROM tidy"""


@query(_TWIN)
def html_blocks(t: Tables) -> DataFrame:
    """Title, lines of text and links of whole pages."""
    return t.pages.select("page_id", html_fields("html").alias("_f")).select("page_id", "_f.*")
