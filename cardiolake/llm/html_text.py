"""Layout-aware HTML to text: a small tree builder with implied tags, visibility rules and a block renderer.

Tree: comments, declarations and raw-text elements are dropped (``textarea`` and ``xmp`` keep their text); void elements never
open; a start tag closes what it implies closed (``p`` before blocks, ``li``, ``dt``/``dd``, ``option``, table parts), text and
other tags close an open head; cells outside a row get one; an end tag closes up to its match, or nothing. Builder and renderer
keep their own stacks, so elements may nest to any depth, and the builder looks open elements up by name.

A slash ends elements of ``svg`` and ``math`` alone; after ``plaintext`` all is text, ``listing`` is a ``pre``.

Visibility: head, script, style, template, noscript and embedded objects are invisible, as is any element with ``hidden`` or
``display:none``; ``visibility:hidden`` (or ``collapse``) hides text until an element inside says ``visibility:visible``. Of an
``svg`` the ``text`` elements are visible; of closed ``details`` the summary, of a closed ``dialog`` nothing.

Layout: white space collapses outside ``pre``; blocks start on a line of their own; paragraphs, headings, lists, tables and
quotes keep one blank line around them; list items carry ``-`` or their number and are indented by level; table cells are
padded to their column's width and parted by `` | ``, cells that span columns or rows leave the covered places empty (columns
in which no cell begins are left out); ``br`` breaks the line. Indents end at ``MOST_INDENT`` blanks and columns at ``MOST_WIDTH``, and a
table whose alignment would need over eight times its text and 40 blanks a cell has its cells unaligned: only blanks and bars depend on
these bounds, never text, and a page's text is at most a small multiple of its markup.

Defined cases: null HTML gives null text; empty HTML or HTML without visible text gives an empty text; malformed or cut-off
markup is rendered as far as it goes; very long pages are rendered whole, one after the other; repeated rows give repeated rows;
only the named columns are read, so further columns don't matter.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"""([^<]++)|<!--(?:-?>|.*?--!?>|.*)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>"']++|"[^<"]*+"|'[^<']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)|<[!?/][^>]*+>?|(<)""",
    re.S,
)
_PLAIN = re.compile(r"""[^>"']*+""")
_HIDING = re.compile(r"hidden|display|visibility", re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?+""")
_STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)
_START = re.compile(r"-?\d+")
_SPACES = re.compile(r"[ \t\n\r\f\v]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = "script style textarea title xmp iframe noembed noframes noscript template".split()
#: Raw-text elements and what ends them, sought in the markup as it is (folding case could change its length).
RAW = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I | re.A) for tag in _RAW}
INVISIBLE = frozenset("head script style title template noscript iframe noembed noframes object canvas audio video datalist".split())
#: Their own and their inner elements end with a slash; all others don't.
FOREIGN = ("svg", "math")
SVG_INVISIBLE = frozenset("clippath defs desc marker mask metadata pattern symbol".split())
BLOCK = frozenset("address article aside body center dd details dialog div dl dt fieldset figcaption figure footer form header hgroup html li legend main nav optgroup option section summary tbody tfoot thead tr".split())
SPACED = frozenset("blockquote dl h1 h2 h3 h4 h5 h6 hr ol p pre table ul".split())
CLOSES_P = (BLOCK | SPACED) - {"body", "html", "option", "optgroup", "tbody", "tfoot", "thead", "tr"}
# start tag -> (open elements it closes, elements at which the search for them ends)
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th", "caption", "colgroup"}, {"table", "tr"}),
    "th": ({"td", "th", "caption", "colgroup"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
IMPLIED["thead"] = IMPLIED["tfoot"] = IMPLIED["tbody"]
HEAD = frozenset("base link meta noscript script style template title".split())
SCOPE = frozenset({"table", "td", "th", "caption", "html", "button"})
#: End tags that close elements beyond a cell or a table.
CLOSES_FAR = SCOPE | {"tr", "tbody", "thead", "tfoot", "body"}


#: Blanks that a line is indented by, at most; deeper levels are not indented further.
MOST_INDENT = 80
#: A cell beyond this width stands out of its column.
MOST_WIDTH = 100


class Tags:
    """Where tags end whose attributes hold a ``<`` or quotes without an end. A search that comes to where one that failed has been fails, too,
    so all searches of a page take no longer than a few passes over it."""

    def __init__(self, markup: str):
        self.markup, self.failed, self.run = markup, set(), (0, -1)
        self.last = {c: markup.rfind(c) for c in "\"'<>"}

    def end(self, at: int) -> int:
        """The place of the ``>`` that ends the attributes from ``at`` on, quotes minded; if there is none, of the next ``>``; else -1."""
        seen, first = [], at
        while at not in self.failed:
            seen.append(at)
            if not self.run[0] <= at <= self.run[1]:
                self.run = (at, _PLAIN.match(self.markup, at).end())
            at = self.run[1]
            if at == len(self.markup):
                break
            mark = self.markup[at]
            if mark == ">":
                return at
            if self.last[mark] <= at:
                break
            at = self.markup.find(mark, at + 1) + 1
        self.failed.update(seen)
        return self.markup.find(">", first) if self.last[">"] >= first else -1


def attribute(attributes: str, name: str) -> str | None:
    """The value of an element's first attribute ``name`` (empty without one), or null; names inside other values don't count."""
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() == name:
            return html.unescape(m[2] or m[3] or m[4] or "")
    return None


def shown(node: list) -> list | None:
    """An element as far as it is open: a closed dialog not at all, of closed details the first summary alone."""
    if node[0] not in ("dialog", "details") or attribute(node[1], "open") is not None:
        return node
    if node[0] == "dialog":
        return None
    return [node[0], node[1], [x for x in node[2] if x.__class__ is not str and x[0] == "summary"][:1]]


def visibility(attributes: str, inherited: bool) -> bool | None:
    """Whether an element's text is visible, or null if the element isn't displayed at all."""
    if not attributes or not _HIDING.search(attributes):
        return inherited
    if attribute(attributes, "hidden") is not None:
        return None
    last = {m[1].lower(): m[2].lower() for m in _STYLE.finditer(attribute(attributes, "style") or "")}
    if last.get("display") == "none":
        return None
    return {"visible": True, "hidden": False, "collapse": False}.get(last.get("visibility"), inherited)


class Stack:
    """Open elements, with their places by tag, so that no search walks over them."""

    def __init__(self, root: list):
        self.nodes, self.at = [root], defaultdict(list)

    def push(self, node: list) -> None:
        self.nodes[-1][2].append(node)
        self.at[node[0]].append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, place: int) -> None:
        for node in self.nodes[place:]:
            self.at[node[0]].pop()
        del self.nodes[place:]

    def nearest(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def close(self, tags, stops) -> None:
        """Closes the outermost of ``tags`` that is open above the nearest of ``stops``."""
        floor, found = None, []
        for t in tags:
            places = self.at.get(t)
            if places:
                floor = self.nearest(s for s in stops if s not in tags) if floor is None else floor
                i = bisect_right(places, floor)
                found += places[i : i + 1]
        if found:
            self.cut(min(found))


def build(markup: str) -> list:
    """Tree of ``[tag, attributes, children]``; texts are strings."""
    root = ["html", "", []]
    stack, match, at, end = Stack(root), _TOKEN.match, 0, len(markup)
    nodes, tags = stack.nodes, Tags(markup)
    while at < end:
        m = match(markup, at)
        if m is None:  # cannot happen: the last branch takes any "<"
            break
        at = m.end()
        text, closing, tag, attributes, closing2, tag2, lone = m.groups()
        if tag2 is not None:
            stop = tags.end(at)
            if stop >= 0:
                attributes, at = markup[at:stop], stop + 1
            elif tags.last["<"] > m.start():
                tag2, lone, at = None, "<", m.start() + 1
            else:  # an unfinished tag ends the page
                break
        if text is not None or lone is not None:
            if nodes[-1][0] == "head" and (lone or not text.isspace()):
                stack.cut(len(nodes) - 1)
            nodes[-1][2].append(text or "<")
            continue
        tag = tag or tag2
        if tag is None:
            continue
        tag, attributes = tag.lower(), attributes or ""
        if closing or closing2:
            tag = "pre" if tag == "listing" else tag
            place = stack.nearest((tag,))
            if place and (tag in CLOSES_FAR or place > stack.nearest(SCOPE)):
                stack.cut(place)
            continue
        if nodes[-1][0] == "head" and tag not in HEAD:
            stack.cut(len(nodes) - 1)
        if tag in CLOSES_P:
            stack.close(("p",), SCOPE)
        if tag in IMPLIED:
            stack.close(*IMPLIED[tag])
            if tag in ("td", "th") and nodes[-1][0] != "tr":
                stack.push(["tr", "", []])
        if tag == "html":
            continue
        node = [tag, attributes, []]
        if tag in VOID:
            nodes[-1][2].append(node)
        elif tag in RAW:
            nodes[-1][2].append(node)
            stop = RAW[tag].search(markup, at)
            stop = stop.start() if stop else end
            if tag == "textarea":
                node[2].append(markup[at:stop])
            elif tag == "xmp":
                node[0] = "pre"
                node[2].append(html.escape(markup[at:stop], quote=False))
            at = markup.find(">", stop) + 1 or end
        elif tag == "plaintext":
            nodes[-1][2].append(["pre", "", [html.escape(markup[at:], quote=False)]])
            break
        elif attributes.endswith("/") and (tag in FOREIGN or stack.nearest(FOREIGN) > stack.nearest(("foreignobject", "annotation-xml"))):
            nodes[-1][2].append(node)
        else:
            if tag == "listing":
                node[0] = "pre"
            stack.push(node)
    return root


class Page:
    """Lines under construction. ``gap`` is what stands before the next word: 0 nothing, 1 a space."""

    def __init__(self):
        self.lines: list[str] = []
        self.words: list[str] = []
        self.gap = self.blank = False
        self.indent, self.mark = "", ""

    def text(self, s: str) -> None:
        s = _SPACES.sub(" ", html.unescape(s) if "&" in s else s)
        if s == " " or not s:
            self.gap |= bool(s)
            return
        if s[0] == " ":
            self.gap, s = True, s[1:]
        if self.gap and self.words:
            self.words.append(" ")
        self.gap = s[-1] == " "
        self.words.append(s[:-1] if self.gap else s)

    def line(self) -> None:
        """Ends the line, if it has anything."""
        if self.words:
            self.put("".join(self.words))
            self.words = []
        self.gap = False

    def put(self, s: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        self.lines.append((self.indent[:MOST_INDENT] + self.mark + s).rstrip())
        if self.mark:
            self.indent += " " * len(self.mark)
            self.mark = ""

    def space(self) -> None:
        self.line()
        self.blank = True


def render(node: list, page: Page) -> None:
    """Renders an element. Each step hands out the steps of its children, which run on a stack of their own."""
    steps = [_steps(node, page, None, True, 0)]
    while steps:
        inner = next(steps[-1], None)
        if inner is None:
            steps.pop()
        else:
            steps.append(inner)


def _steps(node: list, page: Page, number: list | None, visible: bool, svg: int) -> Iterator[Iterator]:
    """``number``: the next number of a list (empty without numbers), or null outside of lists. ``svg``: 1 within graphics, 2 in
    their text."""
    for child in node[2]:
        if child.__class__ is str:
            if visible and svg != 1:
                page.text(child)
            continue
        tag, attributes, inner = child
        if tag == "br":
            if page.words:
                page.line()
            elif page.lines and not page.blank:
                page.blank = True
            continue
        if tag in INVISIBLE or svg and tag in SVG_INVISIBLE:
            continue
        seen = visibility(attributes, visible) if attributes else visible
        if seen is None:
            continue
        if tag in ("dialog", "details"):
            child = shown(child)
            if child is None:
                continue
        if tag == "pre":
            _pre(child, page, seen)
        elif tag == "table":
            yield _table(child, page, seen)
        elif tag in ("ul", "ol"):
            outer = number is None
            page.space() if outer else page.line()
            start = _START.match((attribute(attributes, "start") or "").strip()) if tag == "ol" and attributes else None
            keep, mark = page.indent, page.mark
            if mark:
                page.put("")
                keep = page.indent
            page.mark = ""
            yield _steps(child, page, [int(start[0]) if start else 1] if tag == "ol" else [], seen, 0)
            page.line()
            page.indent = keep
            if outer:
                page.blank = True
        elif tag == "li":
            page.line()
            keep = page.indent
            if number:
                page.mark, number[0] = f"{number[0]}. ", number[0] + 1
            else:
                page.mark = "- "
            yield _steps(child, page, [], seen, 0)
            page.line()
            page.indent, page.mark = keep, ""
        elif tag in SPACED:
            # inside a list item, spacing would tear the item from its mark
            page.line() if page.mark else page.space()
            keep = page.indent
            if tag == "blockquote":
                page.indent += "    "
            yield _steps(child, page, number if tag != "dl" else None, seen, 0)
            page.line()
            if tag == "blockquote":
                page.indent = keep
            page.blank = True
        elif tag in BLOCK:
            page.line()
            keep = page.indent
            if tag == "dd":
                page.indent += "    "
            yield _steps(child, page, number, seen, 0)
            page.line()
            if tag == "dd":
                page.indent = keep
        elif inner:
            if tag == "q" and seen:
                page.text('"')
            if tag == "svg":
                inside = 1
            elif svg and tag in ("text", "foreignobject"):
                inside, page.gap = 2 if tag == "text" else 0, True
            else:
                inside = svg
            yield _steps(child, page, number, seen, inside)
            if inside != svg:
                page.gap = True
            if tag == "q" and seen:
                page.text('"')


def _pre(node: list, page: Page, visible: bool) -> None:
    page.space()
    text = html.unescape("".join(_raw(node, visible))).replace("\r\n", "\n")
    if text or visible:
        for s in text.removeprefix("\n").rstrip("\n").split("\n"):
            page.put(s)
    page.blank = True


def _raw(node: list, visible: bool) -> Iterator[str]:
    """The visible text of an element as it stands."""
    todo = [(iter(node[2]), visible)]
    while todo:
        children, visible = todo[-1]
        child = next(children, None)
        if child is None:
            todo.pop()
        elif child.__class__ is str:
            if visible:
                yield child
        elif child[0] == "br":
            yield "\n"
        elif child[0] not in INVISIBLE:
            seen, child = visibility(child[1], visible), shown(child)
            if seen is not None and child is not None:
                todo.append((iter(child[2]), seen))


def _rows(node: list, visible: bool, extras: list) -> Iterator[tuple[list, bool]]:
    """The cells of each row, with the row's visibility; what is no part of a table goes to ``extras``."""
    todo = [(iter(node[2]), visible)]
    while todo:
        children, visible = todo[-1]
        child = next(children, None)
        if child is None:
            todo.pop()
            continue
        if child.__class__ is str:
            if child.strip():
                extras.append((["p", "", [child]], visible))
            continue
        if child[0] in INVISIBLE:
            continue
        seen = visibility(child[1], visible)
        if seen is None:
            continue
        if child[0] == "tr":
            yield [c for c in child[2] if c.__class__ is not str or c.strip()], seen
        elif child[0] in ("tbody", "thead", "tfoot"):
            todo.append((iter(child[2]), seen))
        elif child[0] not in ("colgroup", "col"):
            extras.append((child, visible))


def _span(attributes: str, name: str, most: int) -> int:
    """How many columns or rows a cell covers; ``most`` is the HTML standard's bound (1000 columns, 65534 rows). A rowspan of 0
    goes on to the end."""
    value = (attribute(attributes, name) or "").strip() if attributes else ""
    if not value.isascii() or not value.isdigit():
        return 1
    return min(int(value[:9]) or (most if name == "rowspan" else 1), most)


def _table(node: list, page: Page, visible: bool) -> Iterator[Iterator]:
    page.space()
    extras: list = []
    grid: list[dict[int, list[str]]] = []  # column -> lines
    spans: list[tuple[int, int, int]] = []  # cells further up that still cover (first column, past the last, past the last row)
    for y, (row, shown) in enumerate(_rows(node, visible, extras)):
        spans = sorted(x for x in spans if x[2] > y)
        cells, at, i, more = {}, 0, 0, []
        for cell in row:
            attributes = "" if cell.__class__ is str else cell[1]
            seen = None if cell.__class__ is not str and cell[0] in INVISIBLE else visibility(attributes, shown)
            if seen is None:
                continue
            while i < len(spans) and spans[i][0] <= at:
                at, i = max(at, spans[i][1]), i + 1
            wide, high = _span(attributes, "colspan", 1000), _span(attributes, "rowspan", 65534)
            inner = Page()
            yield _steps(["td", "", [cell]] if cell.__class__ is str else cell, inner, None, seen, 0)
            inner.line()
            cells[at] = inner.lines or [""]
            if high > 1:
                more.append((at, at + wide, y + high))
            at += wide
        spans += more
        grid.append(cells)
    for extra, shown in extras:
        yield _steps(["div", "", [extra]], page, None, shown, 0)
        page.line()
    width: dict[int, int] = {}
    for cells in grid:
        for x, lines in cells.items():
            width[x] = max(width.get(x, 0), min(MOST_WIDTH, max(map(len, lines))))
    columns = sorted(width)
    if len(columns) == 1:
        width[columns[0]] = 0
    # aligned, unless blanks would be far more than the table has of text and cells
    upto = [0, *accumulate(width[x] + 3 for x in columns)]
    places = {id(cells): bisect_right(columns, max(cells)) for cells in grid if cells}
    cost = sum(upto[places[id(cells)]] * max(map(len, cells.values())) for cells in grid if cells)
    have = sum(40 + sum(map(len, lines)) for cells in grid for lines in cells.values())
    for cells in grid:
        if any(any(x) for x in cells.values()):
            own = columns[: places[id(cells)]] if cost <= 8 * have else sorted(cells)
            for k in range(max(map(len, cells.values()))):
                page.put(" | ".join((cells[x][k] if k < len(cells.get(x, ())) else "").ljust(width[x] if cost <= 8 * have else 0) for x in own))
    page.blank = True


def to_text(markup: str | None) -> str | None:
    """The visible text of a page."""
    if markup is None:
        return None
    page = Page()
    render(build(markup), page)
    page.line()
    return "\n".join(page.lines)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([*batch.columns[1:], pa.array([to_text(x.as_py()) for x in batch.column(0)], pa.string())], names=[*batch.schema.names[1:], "text"])


def extract_text(pages: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Columns ``keep`` and the ``text`` of every page."""
    rows = pages.select(F.col(html_column).alias("h"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:]), "text string"])
    return rows.mapInArrow(_extract, schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text")
