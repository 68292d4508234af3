"""Reading HTML as it comes: broken tags, attributes that hold `>`, raw text, unclosed comments, character references of all kinds."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: Possessive throughout, so that no markup makes the search step back.
_ATTRIBUTE = r"""[\s/]*+[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+|[\s/]*+="""
_MARK = re.compile(
    rf"""<!--(?:-?>|.*?(?:--!?>|\Z))      # comment
    |<[!?][^>]*+(?:>|\Z)                  # declaration or instruction
    |</[^a-zA-Z>][^>]*+(?:>|\Z)|</>       # end tag without a name, read as a comment
    |<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<more>(?:{_ATTRIBUTE})*+)[\s/]*+(?:(?P<closed>>)|\Z)
    |<(?=/?[a-zA-Z]).*\Z                  # a tag that never ends takes the rest""",
    re.S | re.X,
)
_NAMED = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*))?)?""")
#: Elements whose content is no markup: up to their own end tag it is text.
RAW = frozenset(("script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp"))
#: Raw elements whose character references are read.
DECODED = frozenset(("title", "textarea"))
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


def marks(text: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): ("text", "", decoded text), ("start", name, attributes), ("end", name, "") or ("raw", name, content), in order."""
    at, n = 0, len(text)
    while at < n:
        found = _MARK.search(text, at)
        if found is None:
            yield "text", "", html.unescape(text[at:])
            return
        if found.start() > at:
            yield "text", "", html.unescape(text[at : found.start()])
        at = found.end()
        name = found["name"]
        if not name or not found["closed"]:
            continue
        name = name.lower()
        if found["end"]:
            yield "end", name, ""
            continue
        yield "start", name, found["more"]
        if name in RAW:
            end = _RAW_END[name].search(text, at)
            held = text[at : end.start() if end else n]
            yield "raw", name, html.unescape(held) if name in DECODED else held
            at = end.start() if end else n


def attributes(rest: str) -> dict[str, str]:
    """Attributes of a start tag; of repeated ones the first counts."""
    out: dict[str, str] = {}
    for name, *values in _NAMED.findall(rest):
        out.setdefault(name.lower(), html.unescape("".join(values)))
    return out


#: Elements that stand inside a line; all others are blocks.
INLINE = frozenset(
    ("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "output", "q", "rb", "rp", "rt", "rtc", "ruby", "s")
    + ("samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr")
    + ("audio", "button", "canvas", "iframe", "math", "meter", "noscript", "object", "picture", "progress", "script", "select", "slot", "style", "svg", "template", "textarea", "title", "video")
    + ("area", "base", "br", "embed", "img", "input", "link", "meta", "param", "source", "track")
)
#: Elements without content or end tag.
VOID = frozenset(("area", "base", "basefont", "bgsound", "br", "col", "embed", "frame", "hr", "img", "input", "keygen", "link", "meta", "param", "source", "track", "wbr"))
#: The start of one of these ends an open one of the same group, unless an element named last stands between them.
_ENDS = (
    (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir"))),
    (frozenset(("dt", "dd")), frozenset(("dl",))),
    (frozenset(("option", "optgroup")), frozenset(("select",))),
    (frozenset(("td", "th")), frozenset(("tr", "table"))),
    (frozenset(("tr", "td", "th")), frozenset(("table",))),
    (frozenset(("thead", "tbody", "tfoot", "tr", "td", "th")), frozenset(("table",))),
)
_GROUP = {"li": 0, "dt": 1, "dd": 1, "option": 2, "optgroup": 2, "td": 3, "th": 3, "tr": 4, "thead": 5, "tbody": 5, "tfoot": 5}


class Nesting:
    """The blocks that are open, with the end tags that authors leave out."""

    def __init__(self) -> None:
        self.open: list[str] = []

    def start(self, name: str) -> list[str]:
        """Opens a block; the blocks that this ends, innermost first."""
        ended = [self.open.pop()] if self.open and self.open[-1] == "p" else []
        if name in _GROUP:
            same, between = _ENDS[_GROUP[name]]
            at = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k] in between), -1)
            first = next((k for k in range(at + 1, len(self.open)) if self.open[k] in same), None)
            if first is not None:
                ended += reversed(self.open[first:])
                del self.open[first:]
        if name not in VOID:
            self.open.append(name)
        return ended

    def end(self, name: str) -> list[str]:
        """Ends the nearest open block of that name and all inside it; none if there is none."""
        if name not in self.open:
            return []
        at = len(self.open) - 1 - self.open[::-1].index(name)
        ended = self.open[at:][::-1]
        del self.open[at:]
        return ended


#: Elements that end a line of plain text.
LINES = frozenset(("p", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6"))


def plain_text(text: str | None) -> str | None:
    """What a reader sees, a line for each block: lines stripped, at most one empty line in a row, None for blank input."""
    if text is None or not text.strip():
        return None
    out, nesting = [], Nesting()
    for kind, name, rest in marks(text):
        ended = []
        if kind == "text" or (kind == "raw" and name == "textarea"):
            out.append(rest)
        elif kind == "start" and name == "br":
            out.append("\n")
        elif kind == "start" and name not in INLINE:
            ended = nesting.start(name)
        elif kind == "end" and name not in INLINE:
            ended = nesting.end(name)
        out += ["\n" for block in ended if block in LINES]
    lines = [line.strip() for line in "".join(out).replace("\xa0", " ").splitlines()]
    return re.sub("\n{3,}", "\n\n", "\n".join(lines)).strip()


@F.pandas_udf(StringType())
def plain(texts: pd.Series) -> pd.Series:
    return texts.map(plain_text)


def plain_html(text: Column) -> Column:
    """plain_text of a column, in Arrow batches: quotes, raw elements and nesting are beyond expressions."""
    return plain(text)


def whole_number(text: str | None) -> int:
    """A span as authors write it: its leading digits, 1 without any or for none at all."""
    digits = re.match(r"\s*(\d{1,4})", text or "")
    return max(1, int(digits[1])) if digits else 1


def table_cells(text: str | None) -> list[tuple[int, int, int, int, str]]:
    """(row, col, rowspan, colspan, text) of the cells of a table, in order. Each takes the first columns of its row that no span from above has left taken."""
    out, row, below, col, said = [], -1, {}, 0, None
    for kind, name, rest in marks(text or ""):
        if kind == "text":
            if said is not None:
                said.append(rest)
        elif name == "tr" and kind == "start":
            # Columns that a cell above still spans; each row uses one of its rows up.
            row, col, said = row + 1, 0, None
            below = {c: n - 1 for c, n in below.items() if n > 1}
        elif name in ("td", "th"):
            said = None
            if kind == "start" and row >= 0:
                held = attributes(rest)
                rows, cols = whole_number(held.get("rowspan")), whole_number(held.get("colspan"))
                while col in below:
                    col += 1
                said = []
                out.append((row, col, rows, cols, said))
                below |= {c: max(rows, below.get(c, 0)) for c in range(col, col + cols)}
                col += cols
    return [(r, c, rs, cs, "".join(x).strip()) for r, c, rs, cs, x in out]


CELL = StructType([StructField(n, IntegerType()) for n in ("row", "col", "rowspan", "colspan")] + [StructField("text", StringType())])


# Not by Arrow: its batches are of 10,000 tables with all cells, where these are of 100.
@F.udf(ArrayType(CELL), useArrow=False)
def cells_of(text: str | None) -> list[tuple[int, int, int, int, str]]:
    """array<struct<row, col, rowspan, colspan, text>>: which columns a cell takes depends on all before it."""
    return table_cells(text)
