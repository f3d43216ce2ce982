"""HTML to text as laid out: a tree with implied tags, then a walk that renders what is visible.

The tree builder closes and opens tags as the standard implies them (paragraphs,
list items, table parts). The walk leaves out what is never shown (scripts, styles,
templates, the head, elements without a box, text that inherits ``visibility: hidden``, svg
outside its text elements) and keeps the layout: blocks on lines of their
own with a blank line around paragraphs, headings, lists and tables, list markers with
nesting, preformatted text as it stands, and table cells in aligned columns, spans
included. Both are loops with stacks of their own, so depth of nesting is no limit.

All visible text is in the layout. ``EXACT``, which ``extract`` takes unless told otherwise, has no
limit: every column of every table is aligned and every list indented, so that a hostile
page can make its text the square of its own size. Only drawing takes that long: until then
padding is a number and lines that begin alike share their beginning, so that a page in the
making holds memory in proportion to itself, and a text is handed on in parts as it is drawn.

``BOUNDED`` makes the text linear too, for a caller who wants that: a line is padded up to a column
that begins within the first 100 characters, and text wider than 60 moves what follows it on
its own line only; columns beyond the fortieth are one; items nested deeper than eight lists
are indented like the last level before; a table within three tables is laid out as blocks.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from heapq import heappop, heappush
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofly.llm.words import slices

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas datalist title meta link annotation annotation-xml".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure form fieldset hr".split())
BLOCK = SPACED | frozenset("address article aside body caption center dd details dialog div dt fieldset figcaption footer header hgroup html legend li main menu nav optgroup option search section summary tr".split())
CLOSES_P = BLOCK - frozenset("body caption html legend option optgroup tr".split())
CELLS = frozenset(("td", "th"))
ROW_GROUPS = frozenset(("tbody", "thead", "tfoot"))
SVG_TEXT = frozenset(("text", "foreignobject"))
# An opened tag, the open elements that it ends, and the elements that the search for them stops at.
IMPLIED_END = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "option": (frozenset(("option",)), frozenset(("select", "optgroup", "datalist"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "td": (CELLS, frozenset(("tr", "table"))),
    "th": (CELLS, frozenset(("tr", "table"))),
    "tr": (CELLS | {"tr"}, ROW_GROUPS | {"table"}),
    "tbody": (CELLS | ROW_GROUPS | {"tr", "caption", "colgroup"}, frozenset(("table",))),
    "thead": (CELLS | ROW_GROUPS | {"tr", "caption", "colgroup"}, frozenset(("table",))),
    "tfoot": (CELLS | ROW_GROUPS | {"tr", "caption", "colgroup"}, frozenset(("table",))),
}

# Attribute text is matched possessively: a tag that doesn't end costs one pass, not one for each way to pair its quotes.
TAG = re.compile(r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']+|"[^"]*"|'[^']*'|["'])*+)>)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
UNSHOWN = re.compile(r"(?<![\w-])display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"(?<![\w-])visibility\s*:\s*(visible|hidden|collapse)", re.I)
WHITE = re.compile(r"[ \t\n\r\f]+")
RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.I) for tag in RAW}
SPAN = re.compile(r"\s*\+?(\d+)")

#: A text longer than this and than its page is in several rows of ``extract``.
WHOLE = 1 << 20
#: Characters in each of them; few, as Spark reads files thousands of rows at a time.
PART = 1 << 14
#: Longest line that is kept as a string when it is put together; longer ones keep their parts.
SHORT = 256
#: Padding is written in runs of at most this; a lead longer than ``KNOWN`` isn't kept as a text.
SPACES = " " * (1 << 16)
KNOWN = 1 << 20


@dataclass(frozen=True)
class Layout:
    """Limits of the layout, None for none: offset up to which columns are aligned, widest cell line that widens its
    column, columns kept track of, levels of lists that indent, tables within tables laid out as grids."""

    aligned: int | None = 100
    cell_width: int | None = 60
    columns: int | None = 40
    indents: int | None = 8
    grids: int | None = 3


BOUNDED, EXACT = Layout(), Layout(None, None, None, None, None)


def _within(n: int, limit: int | None) -> bool:
    return limit is None or n <= limit


class Node:
    """An element; children are nodes and strings."""

    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs = tag, attrs
        self.children: list[Node | str] = []


def build(html: str) -> Node:
    """The tree of a page."""
    root = Node("html")
    open_ = [root]
    count: Counter = Counter()  # open elements by tag: spares walking the stack for one that isn't there

    def text(s: str) -> None:
        if s:
            open_[-1].children.append(s)

    def end(names: frozenset[str], stop: frozenset[str], every: bool = False) -> None:
        """Close the open elements up to the innermost one of ``names`` (or all of them) before ``stop``."""
        cut = None
        if not any(count[n] for n in names):
            return
        for k in range(len(open_) - 1, 0, -1):
            if open_[k].tag in names:
                cut = k
                if not every:
                    break
            elif open_[k].tag in stop:
                break
        if cut is not None:
            count.subtract(n.tag for n in open_[cut:])
            del open_[cut:]

    def enter(node: Node) -> None:
        open_.append(node)
        count[node.tag] += 1

    # Behind the last ">" no tag can end; without this bound each "<" there would be tried up to the end.
    at, bound = 0, html.rfind(">") + 1
    if (begun := html.find("<!--", bound)) >= 0:
        html = html[:begun]
    while m := TAG.search(html, at, bound):
        text(html[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<!--") and not m[0].endswith(("-->", "--!>")):
                at = len(html)  # a comment without an end hides all that follows
                break
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not count["p"]:
                open_[-1].children.append(Node("p"))
            elif tag == "br":
                open_[-1].children.append(Node("br"))
            else:
                # a cell's or an item's end tag doesn't reach out of its table or list
                stop = frozenset() if tag in BLOCK or tag == "table" else CELLS | {"table"}
                end(frozenset((tag,)), stop if tag not in CELLS | {"tr"} | ROW_GROUPS else frozenset(("table",)))
            continue
        if tag in ("html", "body"):
            if tag == "body":
                end(frozenset(("head",)), frozenset())
            open_[-1].attrs = open_[-1].attrs if open_[-1] is not root else m[3]
            continue
        if open_[-1].tag == "head" and tag not in ("title", "meta", "link", "script", "style", "base", "noscript", "template"):
            count[open_.pop().tag] -= 1
        if tag in CLOSES_P:
            end(frozenset(("p",)), frozenset(("table", "td", "th", "button", "caption")))
        if tag in IMPLIED_END:
            end(*IMPLIED_END[tag], every=True)
            inner = open_[-1].tag
            if tag in CELLS and inner in ROW_GROUPS | {"table"}:
                row = Node("tr")
                open_[-1].children.append(row)
                enter(row)
        node = Node(tag, m[3])
        open_[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            close = RAW_END[tag].search(html, at)
            node.children.append(html[at : close.start() if close else len(html)])
            at = close.end() if close else len(html)
            continue
        enter(node)
    text(html[at:])
    return root


def _attrs(raw: str) -> dict[str, str]:
    return {k.lower(): unescape(v[1:-1] if v[:1] in "\"'" and v else v) for k, v in ATTRIBUTE.findall(raw)}


def shown(node: Node, inherited: bool) -> bool | None:
    """Whether an element's own text is seen, which its children inherit; None if the element has no box at all."""
    if node.tag in HIDDEN:
        return None
    if not node.attrs or not node.attrs.strip():
        return inherited
    low = node.attrs.lower()
    if "hidden" not in low and "style" not in low:
        return inherited
    attrs = _attrs(node.attrs)
    style = attrs.get("style", "")
    if "hidden" in attrs or attrs.get("type", "").lower() == "hidden" or UNSHOWN.search(style):
        return None
    own = VISIBILITY.findall(style)
    return own[-1].lower() == "visible" if own else inherited


# A line is a string or, if long, its length and parts: lines, strings and numbers of spaces.
Line = str | tuple[int, tuple]


def size(x: Line | int) -> int:
    """Characters of a line or of a part of one."""
    return len(x) if isinstance(x, str) else x if isinstance(x, int) else x[0]


def joined(*parts: Line | int) -> Line:
    n = sum(map(size, parts))
    return (n, parts) if n > SHORT else "".join([x if isinstance(x, str) else " " * x for x in parts])


def stripped(line: Line) -> Line:
    """Without white space at the end; of a long line only the last text can have any."""
    if isinstance(line, str):
        return line.rstrip()
    *parts, last = line[1]
    return joined(*parts, last.rstrip()) if isinstance(last, str) and last[-1:].isspace() else line


class Block:
    """Lines (and blocks) that all begin alike, with ``lead`` and, unless empty, a space."""

    __slots__ = ("body", "height", "lead", "width")

    def __init__(self, lead: Line | None, body: list[Line | Block], high: int, inner: int):
        self.lead, self.body, self.height = lead, body, high
        self.width = inner if lead is None else size(lead) + (inner + 1 if inner else 0)


def width(body: list[Line | Block]) -> int:
    return max([x.width if isinstance(x, Block) else size(x) for x in body], default=0)


def height(body: list[Line | Block]) -> int:
    return sum([x.height if isinstance(x, Block) else 1 for x in body])


def block(lead: Line | None, body: list[Line | Block]) -> Line | Block:
    """The body behind a lead; blocks with nothing beside them become one, however deep."""
    if len(body) == 1:
        only = body[0]
        if lead is None:
            return only
        if isinstance(only, Block):
            made = Block(lead, only.body, only.height, only.width)
            made.lead = _leads(lead, only.lead)
            return made
    return Block(lead, body, height(body), width(body))


def _leads(outer: Line | None, inner: Line | None) -> Line | None:
    return inner if outer is None else outer if inner is None else joined(outer, " ", inner)


def _behind(lead: Line | None, line: Line) -> Line:
    return line if lead is None else joined(lead, " ", line) if size(line) else lead


def lines_of(body: list[Line | Block]) -> Iterator[Line]:
    """Every line, one at a time."""
    open_: list[tuple] = [(None, iter(body))]
    while open_:
        lead, rest = open_[-1]
        for x in rest:
            if isinstance(x, Block):
                open_.append((_leads(lead, x.lead), iter(x.body)))
                break
            yield _behind(lead, x)
        else:
            open_.pop()


def take(body: list[Line | Block], n: int) -> tuple[list[Line], list[Line | Block]]:
    """The first lines of a body (all, if it has fewer), and the rest of it."""
    taken: list[Line] = []
    open_: list[tuple] = [(None, None, iter(body))]  # lead, the same with those around it, what is left
    while open_ and len(taken) < n:
        _, lead, left = open_[-1]
        if (x := next(left, None)) is None:
            open_.pop()
        elif isinstance(x, Block):
            open_.append((x.lead, _leads(lead, x.lead), iter(x.body)))
        else:
            taken.append(_behind(lead, x))
    rest: list[Line | Block] = []
    while open_:
        lead, _, left = open_.pop()
        rest += left
        if open_ and rest:
            rest = [block(lead, rest)]
    return taken, rest


def flat(line: Line) -> Iterator[str | int]:
    """Texts and numbers of spaces of a line; short ones next to each other are one text."""
    held: list[str] = []
    stack: list = [line]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            stack.extend(reversed(x[1]))
        elif isinstance(x, str):
            held.append(x)
        elif x <= SHORT:
            held.append(SPACES[:x])
        else:
            yield "".join(held)
            yield x
            held = []
    yield "".join(held)


def _spaced(pieces: Iterable[str | int]) -> Iterator[str]:
    for x in pieces:
        if isinstance(x, str):
            yield x
        else:
            for at in range(0, x, len(SPACES)):
                yield SPACES[: x - at]


def draw(body: list[Line | Block]) -> Iterator[str]:
    """The text of a body piece by piece, without empty lines at its ends."""
    begun, empty = False, 0
    lead: list[str | int] = []  # what lines of the innermost open block begin with, its characters and, unless too long, its text
    long, known = 0, ""
    open_: list[tuple] = [(0, 0, iter(body))]  # pieces and characters of the lead around it, what is left
    while open_:
        mark, outer, left = open_[-1]
        for x in left:
            if isinstance(x, Block):
                open_.append((len(lead), long, iter(x.body)))
                if x.lead is not None:
                    own = [*flat(x.lead), " "]
                    lead += own
                    long += size(x.lead) + 1
                    known = known + "".join(_spaced(own)) if known is not None and long <= KNOWN else None
                break
            if not long and not size(x):
                empty += begun
                continue
            if begun:
                yield "\n" * (empty + 1)
            begun, empty = True, 0
            if known is None and long <= KNOWN:
                known = "".join(_spaced(lead))
            if known is None:
                yield from _spaced(lead if size(x) else lead[:-1])
            elif long:
                yield known if size(x) else known[:-1]
            if isinstance(x, str):
                yield x
            else:
                yield from _spaced(flat(x))
        else:
            open_.pop()
            if len(lead) > mark:
                del lead[mark:]
                long, known = outer, None if known is None else known[:outer]


def parts(pieces: Iterable[str], most: int) -> Iterator[str]:
    """A text in parts of ``most`` characters, the last one of fewer; an empty text is one part."""
    held, n, whole = [], 0, True
    for s in pieces:
        while n + len(s) > most:
            cut = most - n
            held.append(s[:cut])
            yield "".join(held)
            held, n, s, whole = [], 0, s[cut:], False
        held.append(s)
        n += len(s)
    if n or whole:
        yield "".join(held)


class Flow:
    """Lines of one box; white space collapses and blank lines between blocks don't add up."""

    def __init__(self):
        self.lines: list[Line | Block] = []
        self.line: list[str] = []
        self.space = False
        self.gap = False
        self.marker: tuple[int, str] | None = None  # spaces and sign before the next line

    def word(self, s: str) -> None:
        """Inline text, white space collapsed."""
        parts = WHITE.sub(" ", s)
        if parts == " " or not parts:
            self.space = self.space or bool(parts)
            return
        if self.line and (self.space or parts[0] == " "):
            self.line.append(" ")
        self.space = parts[-1] == " "
        self.line.append(parts.strip(" "))

    def flush(self) -> None:
        """End the line, if there is one."""
        if self.line:
            self.put("".join(self.line))
            self.line = []
        self.space = False

    def put(self, line: Line) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        if self.marker:
            indent, sign = self.marker
            line, self.marker = joined(indent, sign + line if isinstance(line, str) else joined(sign, line)), None
        self.lines.append(line)

    def add(self, body: list[Line | Block]) -> None:
        """Lines that are laid out already."""
        if not body:
            return
        first, rest = take(body, 1) if self.marker or self.gap else ([], body)
        for line in first:
            self.put(line)
        if rest:
            self.lines.append(block(None, rest))

    def blank(self) -> None:
        """A blank line before whatever comes next."""
        self.flush()
        self.gap = True


def _span(attrs: str, name: str, most: int) -> int:
    """A cell's ``colspan`` or ``rowspan``: at least one, zero rows meaning all that follow."""
    if name not in attrs.lower():
        return 1
    found = SPAN.match(_attrs(attrs).get(name, ""))
    n = min(int(found[1][:9]), most) if found else 1
    return n or (most if name == "rowspan" else 1)


class Held:
    """Columns that cells from above hold, as pieces with the row in which each is free again."""

    def __init__(self):
        self.starts, self.until = [0], [0]  # pieces in order, the last without an end; 0: free
        self.free = [0]  # starts of the free pieces, no two of which touch
        self.ends: list[tuple[int, int]] = []  # heap of (row, start)

    def row(self, row: int) -> None:
        """Free what is held up to this row."""
        while self.ends and self.ends[0][0] <= row:
            _, start = heappop(self.ends)
            k = bisect_left(self.starts, start)
            if k == len(self.starts) or self.starts[k] != start or not 0 < self.until[k] <= row:
                continue
            self.until[k] = 0
            insort(self.free, start)
            for n in (k + 1, k):
                if n and not self.until[n] and not self.until[n - 1]:
                    del self.free[bisect_left(self.free, self.starts[n])]
                    del self.starts[n], self.until[n]

    def first(self, at: int) -> int:
        """The first free column from here on."""
        return at if not self.until[bisect_right(self.starts, at) - 1] else self.free[bisect_right(self.free, at)]

    def _cut(self, at: int) -> None:
        k = bisect_left(self.starts, at)
        if k == len(self.starts) or self.starts[k] != at:
            until = self.until[k - 1]
            self.starts.insert(k, at)
            self.until.insert(k, until)
            if until:
                heappush(self.ends, (until, at))
            else:
                insort(self.free, at)

    def hold(self, at: int, end: int, until: int) -> None:
        """Hold columns up to a row; what is held for longer stays so."""
        self._cut(at)
        self._cut(end)
        k = bisect_left(self.starts, at)
        while self.starts[k] < end:
            if self.until[k] < until:
                if not self.until[k]:
                    del self.free[bisect_left(self.free, self.starts[k])]
                self.until[k] = until
                heappush(self.ends, (until, self.starts[k]))
            k += 1


class Grid:
    """Cells of a table in the making: rows of (column, lines)."""

    def __init__(self, layout: Layout = BOUNDED):
        self.layout = layout
        self.rows: list[list[tuple[int, list[Line | Block]]]] = []
        self.held = Held()
        self.widths: dict[int, int] = {}
        self.at = 0

    def row(self) -> None:
        self.held.row(len(self.rows))
        self.rows.append([])
        self.at = 0

    def cell(self, body: list[Line | Block], attrs: str) -> None:
        """Put a cell into the first free column; it holds its columns for its rows. Columns beyond the last tracked one are one."""
        most = self.layout.columns
        at = self.held.first(self.at)
        wide, high = _span(attrs, "colspan", 1000), _span(attrs, "rowspan", 65534)
        end = at + wide
        if most is not None:
            at, end = min(at, most - 1), min(end, most - 1)
        if high > 1 and at < end:
            self.held.hold(at, end, len(self.rows) - 1 + high)
        if wide == 1:
            limit = self.layout.cell_width
            self.widths[at] = max(self.widths.get(at, 0), width(body) if limit is None else max([n for n in map(size, lines_of(body)) if n <= limit], default=0))
        self.at = end
        self.rows[-1].append((at, body))

    def lines(self) -> list[Line | Block]:
        """Rows with cells at the offsets of their columns; a cell's further lines stay in its column."""
        rows = [r for r in self.rows if any(width(body) for _, body in r)]
        begin, starts = 0, {}
        for k in sorted({at for r in rows for at, _ in r}):
            starts[k] = begin
            begin += self.widths.get(k, 0) + 3
        pad = lambda at, length: max(0, starts[at] - 3 - length) if _within(starts[at], self.layout.aligned) else 0
        out: list[Line | Block] = []
        for row in rows:
            # lines that cells share are put together; what the tallest has below them is one block
            high = [height(body) for _, body in row]
            tall = high.index(max(high))
            shared = max(high[:tall] + high[tall + 1 :] + [1]) if len(row) > 1 else 0
            rest: list[Line | Block] = []
            live = []
            for n, (at, body) in enumerate(row):
                if n == tall:
                    lines, rest = take(body, shared)
                else:
                    lines = list(lines_of(body))
                live.append((at, lines))
            for k in range(shared):
                if k:
                    live = [c for c in live if len(c[1]) > k]
                line, length = [], 0
                for n, (at, lines) in enumerate(live):
                    text = lines[k] if lines else ""
                    if n == len(live) - 1:
                        text = stripped(text)
                    if at or n:
                        line += (pad(at, length), " | " if size(text) or n < len(live) - 1 else " |")
                        length += line[-2] + 3
                    line.append(text)
                    length += size(text)
                out.append(joined(*line))
            if rest:
                at = row[tall][0]
                out.append(block(joined(pad(at, 0), " |") if at else None, [x if isinstance(x, Block) else stripped(x) for x in rest]))
        return out


def render(html: str | None, layout: Layout = BOUNDED) -> str:
    """The visible text of a page as laid out; null is empty."""
    return "".join(draw(lay_out(html, layout)))


def lay_out(html: str | None, layout: Layout) -> list[Line | Block]:
    """The lines of a page's visible text, to be drawn.

    A comment ends at ``-->`` or ``--!>``, an empty one at ``<!-->`` or ``<!--->``; one that
    doesn't end hides the rest. ``visibility`` is inherited, so a child may be seen within a
    hidden parent. Of svg its text and foreign objects are shown, of math all but annotations.
    """
    if not html:
        return []
    flows = [Flow()]
    grids: list[Grid | None] = []  # None: a table laid out as blocks
    lists: list[list] = []
    pre = 0
    seen = [True]  # visibility of the open elements
    svg: list[int] = []  # open svg elements, each with its open elements that show text
    # a node is pushed once to be opened and once, as a pair, to be closed
    stack: list = [build(html)]
    while stack:
        x = stack.pop()
        flow = flows[-1]
        if isinstance(x, str):
            if not seen[-1] or (svg and not svg[-1]):
                continue
            if pre:
                first, *rest = unescape(x).replace("\r\n", "\n").split("\n")
                flow.line.append(first)
                for s in rest:
                    flow.put("".join(flow.line))
                    flow.line = [s]
            elif x:
                flow.word(unescape(x))
            continue
        if isinstance(x, Node):
            if (own := shown(x, seen[-1])) is None:
                continue
            tag = x.tag
            if tag == "br":
                flow.put("".join(flow.line))
                flow.line, flow.space = [], False
                continue
            if tag in SPACED and not (tag in ("ul", "ol") and lists):
                flow.blank()
            elif tag in BLOCK:
                flow.flush()
            if tag in VOID:
                continue
            seen.append(own)
            if tag == "svg":
                svg.append(0)
            elif svg and tag in SVG_TEXT:
                svg[-1] += 1
                flow.space = True
            if tag in ("ul", "ol"):
                lists.append([tag, 0])
            elif tag == "li":
                depth = max(0, len(lists) - 1)
                depth = depth if _within(depth, layout.indents) else layout.indents
                kind = lists[-1] if lists else ["ul", 0]
                kind[1] += 1
                flow.marker = (2 * depth, f"{kind[1]}. " if kind[0] == "ol" else "- ") if own else None
            elif tag == "pre":
                pre += 1
            elif tag == "table":
                grids.append(Grid(layout) if _within(len(grids) + 1, layout.grids) else None)
            elif tag == "tr" and grids and grids[-1]:
                grids[-1].row()
            elif tag in CELLS and grids:
                if not grids[-1]:
                    flow.flush()
                else:
                    if not grids[-1].rows:
                        grids[-1].row()
                    flows.append(Flow())
            stack.append((x, len(flows)))
            stack.extend(reversed(x.children))
            continue
        node, _ = x
        tag = node.tag
        seen.pop()
        if tag == "svg":
            svg.pop()
        elif svg and tag in SVG_TEXT:
            svg[-1] -= 1
            flow.space = True
        if tag in CELLS and grids:
            flow.flush()
            if grids[-1]:
                flows.pop()
                grids[-1].cell(flow.lines, node.attrs)
            continue
        if tag == "pre":
            pre -= 1
        if tag == "table":
            flow.flush()
            if grid := grids.pop():
                flow.add(grid.lines())
        if tag in ("ul", "ol") and lists:
            lists.pop()
        if tag == "li":
            flow.flush()
            flow.marker = None
        if tag in SPACED and not (tag in ("ul", "ol") and lists):
            flow.blank()
        elif tag in BLOCK:
            flow.flush()
    flows[0].flush()
    return flows[0].lines


def extract(pages: DataFrame, html: str = "html", key: str = "page_id", layout: Layout = EXACT, whole: int = WHOLE, part: int = PART) -> DataFrame:
    """key, text, n_chars, n_lines, text_sha256, part of every page.

    A page is rendered whole. A text longer than ``whole`` characters and than its page is in several
    rows of ``part`` characters, numbered by the column ``part`` from 0, whose texts joined are the
    page's; the other columns are the whole page's in each of them. Null and empty pages have empty texts (and no lines). Repeated rows give repeated
    results, null keys stay null, and other columns are not read; an empty table gives no rows.
    """
    source = pages.select(F.col(key).cast("long").alias("key"), F.col(html).alias("html"))

    def texts(page: str | None) -> Iterator[tuple]:
        body = lay_out(page, layout)
        n_chars, breaks, digest, first = 0, 0, sha256(), None
        for n, s in enumerate(parts(draw(body), max(whole, len(page or "")))):
            n_chars, breaks = n_chars + len(s), breaks + s.count("\n")
            digest.update(s.encode())
            first = s if n == 0 else None
        # a text of one row is at hand; a longer one is drawn again, since its figures are known at its end only
        for k, s in enumerate(parts(draw(body), part) if first is None else (first,)):
            yield s, n_chars, breaks + (n_chars > 0), digest.hexdigest(), k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_lines", pa.int64()), ("text_sha256", pa.string()), ("part", pa.int32())])
        for batch in slices(batches):
            rows, held = [], 0
            for k, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for text in texts(page):
                    rows.append((k, *text))
                    held += len(text[0])
                    if held >= WHOLE:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    made = source.mapInArrow(run, "key long, text string, n_chars long, n_lines long, text_sha256 string, part int")
    return made.withColumnRenamed("key", key)
