"""Layout-aware text of HTML pages.

A tokenizer and a tree builder with implied tags (html, head, body, and the elements whose end
tags may be left out) give a tree; its visible text is rendered as a page would show it: blocks on
lines of their own, paragraphs and headings set off by an empty line, lists with their marks and
indents, preformatted text as it is, and the cells of a table's columns aligned.

Hidden: head, script, style and other elements without rendering, what the attribute ``hidden`` or
a style of ``display:none`` hides, what a style of ``visibility:hidden`` hides until an element
inside is ``visible`` again, and closed ``details`` but for their summary. Of svg, the text elements
are shown, of math all but annotations. Cells that span columns or rows keep the columns beside
them in line, and wide characters (East Asian) count as two.

A quote opens a value after an equals sign alone; if nothing closes it, the tag ends at the next
``>``, and a tag that has none is no text.

Defined results: null or empty html has the empty text; any markup, however broken, has a text;
repeated rows give repeated results; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shipped

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSHOWN = frozenset("head script style title template noscript iframe object audio video canvas datalist annotation annotation-xml".split())
RAW = frozenset("script style title textarea xmp iframe noframes".split())
HEAD_ONLY = frozenset("base link meta title style script template noscript".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure".split())
BLOCK = SPACED | frozenset("address article aside body caption center dd details dialog div dt fieldset figcaption footer form header hgroup hr html legend li main menu nav section summary tbody td tfoot th thead tr".split())
#: What a start tag ends, and the elements in which the search for it stops.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)),
    "thead": (("thead", "tbody", "tfoot"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
}
#: Of a drawing only what stands in these is text; never what stands in the others. What is not drawn ends it.
DRAWN, UNDRAWN = frozenset("text foreignobject".split()), frozenset("desc metadata defs symbol clippath mask marker pattern".split())
UNDRAWABLE = frozenset("b big blockquote br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 hr i img li listing menu nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: Tables inside tables are aligned down to this depth, since each is laid out inside a cell; deeper ones are shown as blocks.
TABLE_DEPTH = 64
#: Columns or rows that a cell spans at most, as pages are shown.
SPANNED = 1000
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>=]++|=(?:\s*+(?:"[^"]*+"|'[^']*+'))?+)*+)>|([^<]+|<)""", re.DOTALL)
_OPENING = re.compile("<[a-zA-Z]")
#: One attribute: its name, and its value in quotes or bare; and whether a look at all of them is worth it.
_ATTRIBUTE = re.compile(r"""([^\s/=>][^\s/=>]*+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_LOOK = re.compile("hidden|style", re.IGNORECASE)
_SPAN = re.compile("(?:col|row)span", re.IGNORECASE)
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.DOTALL)
_START = re.compile(r"\s*(\d{1,9})")
_BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "shown", "start", "children", "drawing", "line", "silent", "closed", "spans")

    def __init__(self, tag: str, shown: bool = True, start: int = 1):
        self.tag, self.shown, self.start, self.children = tag, shown, start, []
        self.drawing, self.line = False, tag in BLOCK or tag in ("option", "optgroup")  # whether text in it is not shown; whether it has lines of its own
        self.silent, self.closed = False, False  # whether its visibility hides it; whether it shows a summary alone
        self.spans = (1, 1)  # columns and rows of a cell


def attributes_of(written: str) -> dict[str, str]:
    """Names, in lower case, and values of a start tag's attributes; of repeated ones the first."""
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(written):
        out.setdefault(name.lower(), html.unescape("".join(values)))
    return out


def style_of(written: str) -> tuple[bool, str]:
    """Whether a start tag's attributes take its element away (``hidden``, or display none), and the visibility that its style asks for."""
    if not _LOOK.search(written):
        return False, ""
    attributes, style = attributes_of(written), {}
    for declaration in _COMMENT.sub("", attributes.get("style", "")).lower().split(";"):
        name, _, value = declaration.partition(":")
        value, mark, _ = value.partition("!")
        if mark or not style.get(name.strip(), ("", ""))[1]:
            style[name.strip()] = (value.strip(), mark)
    return "hidden" in attributes or style.get("display", ("",))[0] == "none", style.get("visibility", ("",))[0]


def _number(value: str | None, least: int) -> int:
    found = _START.match(value or "")
    return min(SPANNED, max(least, int(found[1]))) if found else 1


def tree(page: str) -> Node:
    """The element tree of a page: html, with a head and a body."""
    root, head, body = Node("html"), Node("head", False), Node("body")
    root.children = [head, body]
    open_: list[Node] = [body]
    at, in_head, last = 0, True, page.rfind(">")
    while at < len(page) and not (at > last and _OPENING.match(page, at)):
        m = _TOKEN.match(page, at)
        at = m.end()
        ending, tag, attributes, text = m.groups()
        if text is not None:
            if in_head and text.isspace():
                continue
            in_head = False
            inner = open_[-1]
            if not (inner.drawing or inner.silent or inner.closed):
                inner.children.append(html.unescape(text) if "&" in text else text)
        elif tag is not None:
            tag = tag.lower()
            if tag in ("html", "head", "body"):
                in_head = in_head and tag != "body"
                if tag == "body":
                    gone, visibility = style_of(attributes)
                    body.shown = body.shown and not gone
                    body.silent = visibility in ("hidden", "collapse") if visibility else body.silent
                continue
            inside_head = in_head and tag in HEAD_ONLY
            in_head = inside_head
            while tag in UNDRAWABLE and open_[-1].drawing:
                open_.pop()
            if not inside_head:
                _end_implied(open_, tag)
            outer = open_[-1]
            drawing = outer.drawing
            gone, visibility = style_of(attributes) if attributes else (False, "")
            shown = tag not in UNSHOWN and not (drawing and tag in UNDRAWN) and not gone and not (outer.closed and tag != "summary")
            node = Node(tag, shown)
            node.silent = visibility in ("hidden", "collapse") if visibility and visibility != "inherit" else outer.silent
            node.closed = tag == "details" and "open" not in attributes_of(attributes)
            if tag in ("td", "th") and _SPAN.search(attributes):
                spans = attributes_of(attributes)
                node.spans = _number(spans.get("colspan"), 1), _number(spans.get("rowspan"), 0)
            node.drawing = tag == "svg" or drawing and tag not in DRAWN and tag != "desc"
            node.line = node.line or drawing and tag in DRAWN
            if tag == "ol" and (start := _START.match(attributes_of(attributes).get("start", ""))):
                node.start = int(start[1])
            (head if inside_head else outer).children.append(node)
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
                held = page[at : close.start() if close else len(page)]
                if shown and not node.silent:
                    node.children.append(html.unescape(held))
                at = close.end() if close else len(page)
            elif tag not in VOID and not inside_head and not attributes.endswith("/"):
                open_.append(node)
            elif tag not in VOID and not inside_head and tag in BLOCK:
                open_.append(node)  # a slash means nothing on these
        elif ending is not None:
            ending = ending.lower()
            if ending in ("html", "body", "head"):
                in_head = in_head and ending != "head"
            elif ending == "br":
                open_[-1].children.append(Node("br"))
            else:
                _end(open_, ending)
    return root


def _end_implied(open_: list[Node], tag: str) -> None:
    if tag in BLOCK:
        _end(open_, "p", ("button", "table", "td", "th", "caption"))
    if tag in ENDS:
        ended, bounds = ENDS[tag]
        for i in range(len(open_) - 1, 0, -1):
            if open_[i].tag in bounds:
                break
            if open_[i].tag in ended:
                del open_[i:]
                break
    if tag in ("td", "th") and open_[-1].tag in ("table", "tbody", "thead", "tfoot"):
        row = Node("tr")
        open_[-1].children.append(row)
        open_.append(row)


def _end(open_: list[Node], tag: str, bounds: tuple = ("table", "td", "th")) -> None:
    """End the innermost open element of this name, and all in it; none beyond a bound."""
    for i in range(len(open_) - 1, 0, -1):
        if open_[i].tag == tag:
            del open_[i:]
            return
        if open_[i].tag in bounds and tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th"):
            return


class Page:
    """Text as it is laid out: what is written, and what spacing is due before the next text."""

    def __init__(self):
        self.out: list[str] = []
        self.breaks, self.blank, self.mark = 0, False, ""

    def write(self, text: str, indent: int, pre: bool) -> None:
        if not text:
            return
        if not pre:
            if text[0] in " \t\n\r\f":
                self.blank = True
            inner = _BLANKS.sub(" ", text).strip(" ")
            if not inner:
                return
            trailing = text[-1] in " \t\n\r\f"
        else:
            inner, trailing = text.replace("\n", "\n" + "  " * indent), False
            if not inner:
                return
        if self.breaks or not self.out:
            if self.out:
                self.out.append("\n" * self.breaks)
            self.out.append("  " * max(0, indent - bool(self.mark)) + self.mark)
            self.mark = ""
        elif self.blank:
            self.out.append(" ")
        self.out.append(inner)
        self.breaks, self.blank = 0, trailing

    def due(self, breaks: int) -> None:
        self.breaks, self.blank = max(self.breaks, breaks), False

    def text(self) -> str:
        return "".join(self.out)


def rendered(top: Node, depth: int = 0) -> str:
    """The visible text below a node. Walks with its own stack, so nesting has no limit but tables' inner alignment."""
    page = Page()
    # (node or text, indent, preformatted, list that a li belongs to); a node that is left again comes as (node,)
    stack: list[tuple] = [(x, 0, False, None) for x in reversed(top.children)]
    numbers: dict[int, int] = {}
    while stack:
        item = stack.pop()
        x = item[0]
        if len(item) == 1:
            page.due(2 if x.tag in SPACED else 1)
            continue
        _, indent, pre, parent = item
        if isinstance(x, str):
            page.write(x, indent, pre)
            continue
        tag = x.tag
        if not x.shown:
            continue
        if tag == "br":
            page.breaks, page.blank = (page.breaks + 1 if page.out else 0), False
            continue
        if tag == "hr":
            page.due(1)
            if not x.silent:
                page.write("---", indent, False)
            page.due(1)
            continue
        if tag == "table" and depth < TABLE_DEPTH:
            page.due(2)
            if lines := _table(x, depth + 1):
                page.write(lines, indent, True)
            page.due(2)
            continue
        if x.line:
            nested = tag in ("ul", "ol") and parent is not None
            page.due(1 if nested or tag not in SPACED else 2)
            stack.append((Node("div") if nested else x,))
        if tag in ("ul", "ol"):
            numbers[id(x)] = x.start
            stack += [(c, indent + 1, pre, x) for c in reversed(x.children)]
            continue
        if tag == "li":
            page.mark = "" if x.silent else "- "
            if parent is not None and parent.tag == "ol":
                page.mark = "" if x.silent else f"{numbers[id(parent)]}. "
                numbers[id(parent)] += 1
            stack += [(c, max(indent, 1), pre, parent) for c in reversed(x.children)]
            continue
        if tag in ("blockquote", "dd"):
            indent += 1
        if tag in ("td", "th") and depth >= TABLE_DEPTH:
            page.blank = True
        stack += [(c, indent, pre or tag in ("pre", "textarea", "xmp"), parent) for c in reversed(x.children)]
    return page.text()


def _wide(line: str) -> int:
    """The columns that a line takes: wide characters two, marks over others none."""
    return len(line) if line.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in line)


def _table(table: Node, depth: int) -> str:
    """A table's caption and rows, cells padded to the width of their columns."""
    rows: list[dict[int, tuple[int, list[str]]]] = []  # of each row: column, and there the columns spanned and the lines
    out: list[str | int] = []  # lines, and places of rows among them
    stack, taken = list(reversed(table.children)), {}  # taken: how many rows more a column is held by a cell from above
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            if x and not x.isspace():
                out.append(_BLANKS.sub(" ", x).strip(" "))
        elif not x.shown:
            continue
        elif x.tag == "tr":
            cells, loose, at = {}, Node("div"), 0
            for c in x.children:
                if isinstance(c, Node) and c.tag in ("td", "th"):
                    if not c.shown:
                        continue
                    while taken.get(at, 0):
                        at += 1
                    columns, down = c.spans
                    cells[at] = columns, rendered(c, depth).split("\n")
                    for k in range(at, at + columns if down != 1 else at):
                        taken[k] = down if down else 1 << 30  # itself included; 0 rows: to the end
                    at += columns
                else:
                    loose.children.append(c)
            taken = {k: n - 1 for k, n in taken.items() if n > 1}
            if text := rendered(loose, depth):
                out.append(text)
            out.append(len(rows))
            rows.append(cells)
        elif x.tag in ("thead", "tbody", "tfoot"):
            stack += reversed(x.children)
        else:
            around = Node("div")
            around.children = [x]
            if text := rendered(around, depth):
                out.append(text)
    widths: dict[int, int] = {}
    for cells in rows:
        for c, (n, lines) in cells.items():
            if n == 1:
                widths[c] = max(widths.get(c, 0), *map(_wide, lines))
    last = max((c for cells in rows for c in cells), default=-1)
    for cells in rows:  # what spans columns widens the last of them, if they are too narrow, where other cells follow
        for c, (n, lines) in cells.items():
            if n > 1 and c + n <= last:
                room = sum(widths.get(k, 0) + 2 for k in range(c, c + n)) - 2
                widths[c + n - 1] = widths.get(c + n - 1, 0) + max(0, *(_wide(line) - room for line in lines))
    begins, at = [], 0
    for c in range(last + 1):
        begins.append(at)
        at += widths.get(c, 0) + 2
    before: list[str] = []
    for x in out:
        if isinstance(x, str):
            before.append(x)
            continue
        for i in range(max((len(lines) for _, lines in rows[x].values()), default=0)):
            line, at = [], 0
            for c, (_, lines) in rows[x].items():
                if i < len(lines) and lines[i]:
                    line += [" " * (begins[c] - at), lines[i]]
                    at = begins[c] + _wide(lines[i])
            if line := "".join(line).rstrip():
                before.append(line)
    return "\n".join(before)


def text_of(page: str | None) -> str:
    if not page:
        return ""
    root = tree(page)
    return rendered(root) if root.children[1].shown else ""


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, text and n_chars of every page; nothing is shuffled."""
    shipped(pages.sparkSession)

    def extract(batches):
        for batch in batches:
            texts = [text_of(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(extract, "page_id long, text string, n_chars long")
