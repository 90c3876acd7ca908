"""Visible text of web pages, laid out.

A tree builder reads the tags: void elements, implied end tags (a block ends
an open paragraph, an item the item before it, a cell the cell before it, the
first thing that is not head content the head) and end tags that close what is
still open inside; svg, math and what they hold may close themselves.  Rendering the tree skips what
a browser does not show, puts blocks on lines of their own with a blank line
between paragraphs, marks list items, and aligns the cells of a table in
columns.  All visible text comes out, in order.

Not shown are elements without a box (``display: none``, ``hidden``, scripts and
the like) with all they hold, and text whose inherited ``visibility`` is not
``visible``.  Both properties are read from ``style`` attributes and from the
page's own style sheets, there by type, class and id selectors and their
compounds; selectors with combinators, attributes or pseudo-classes, and media
conditions beyond ``all`` and ``screen``, match nothing.

Cells take the columns that ``colspan`` and ``rowspan`` leave them.  A row whose
text lies in one cell keeps the lines of that cell; else a cell is one line.
Tables lie in tables to any depth.  White space added before a text is at most
``MOST_GAP`` characters, so the text of a page grows with the page: cells longer
than that widen no column, and a cell further off follows after two spaces.

Pages are independent: one narrow pass in Arrow batches, no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from branchwise.llm.common import quoted, with_arrow_column

# The elements of HTML by how they are read or shown.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("head script style template noscript title datalist iframe object audio video canvas".split())
#: What an open head may hold; any other tag, and text, ends it.
HEAD = set("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: In svg and math: what is not shown, where HTML goes on, and the tags that
#: end the whole drawing or formula.
FOREIGN_HIDDEN = set("desc metadata defs symbol clippath mask pattern marker annotation annotation-xml mphantom".split())
HTML_AGAIN = {"svg": {"foreignobject"}, "svg text": set(), "math": set("mi mo mn ms mtext".split())}
BREAKS_OUT = set("""b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu
meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var""".split())
BLOCK = set("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul""".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure fieldset".split())
ENDS_P = BLOCK - {"body", "html", "li", "dd", "dt", "legend", "summary"} | {"li", "dd", "dt"}
#: A start tag ends the nearest open element of these, unless one of the
#: bounds is nearer.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
SPACE = re.compile(r"[ \t\n\r\f]+")
#: The most white space put before a text, and the longest cell that widens its column.
MOST_GAP = 40
NUMBER = re.compile(r"[ \t\n\r\f]*\+?([0-9]{1,9})")
COMMENT = re.compile(r"/\*.*?(\*/|$)", re.S)
SELECTOR = re.compile(r"(\*|[a-z][\w-]*)?((?:[.#][\w-]+)*)", re.I)
PROPERTIES = re.compile(r"display|visibility", re.I)


class Node:
    """``space`` is empty in HTML, else ``svg``, ``svg text`` or ``math``."""

    __slots__ = ("tag", "attrs", "children", "space")

    def __init__(self, tag: str, attrs: dict, around: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []
        if tag in ("svg", "math"):
            self.space = tag
        elif around and tag in HTML_AGAIN[around]:
            self.space = ""
        else:
            self.space = "svg text" if around == "svg" and tag == "text" else around


class TreeBuilder(HTMLParser):
    """Builds the tree; end tags without a start are ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]
        self.places: dict[str, list[int]] = defaultdict(list)  # of each tag in ``open``

    def _push(self, node: Node) -> None:
        self.places[node.tag].append(len(self.open))
        self.open.append(node)

    def _pop(self) -> None:
        self.places[self.open.pop().tag].pop()

    def _nearest(self, tags: set) -> int:
        nearest = 0
        for tag in tags:
            if (own := self.places.get(tag)) and own[-1] > nearest:
                nearest = own[-1]
        return nearest

    def _end_upto(self, tags: set, bounds: set) -> None:
        nearest = self._nearest(tags)
        if nearest and (nearest == len(self.open) - 1 or nearest >= self._nearest(bounds)):
            while len(self.open) > nearest:
                self._pop()

    def handle_starttag(self, tag, attrs):
        if tag in BREAKS_OUT:
            while self.open[-1].space:
                self._pop()
        if self.open[-1].tag == "head":
            if tag in ("head", "html"):
                return
            if tag not in HEAD:
                self._pop()
        around = self.open[-1].space
        if tag in ENDS_P and not around:
            self._end_upto({"p"}, {"td", "th", "table", "button", "object", "caption"})
        if tag in ENDS and not around:
            self._end_upto(*ENDS[tag])
        node = Node(tag, {k: v or "" for k, v in attrs}, around)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self._push(node)

    def handle_startendtag(self, tag, attrs):
        """Only svg, math and what is in them can close themselves."""
        around = self.open[-1].space
        self.handle_starttag(tag, attrs)
        if self.open[-1].tag == tag and (tag in ("svg", "math") or around and tag not in BREAKS_OUT | VOID):
            self._pop()

    def handle_endtag(self, tag):
        bounds = {"table"} if tag not in ("table", "body", "html") else set()
        self._end_upto({tag}, bounds)

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)

    def handle_data(self, data):
        if self.open[-1].tag == "head" and SPACE.sub("", data):
            self._pop()
        self.open[-1].children.append(data)


class Page:
    """Lines of text with blank lines where blocks ask for space."""

    def __init__(self, room: int = MOST_GAP):
        self.lines, self.line, self.gap, self.space, self.prefix = [], [], 0, False, ""
        self.room = room  # for indents
        self.lists: list[list] = []  # tag and next number of the open lists

    def end_line(self, gap: int = 0) -> None:
        if self.line:
            self.lines.append("".join(self.line))
            self.line = []
        self.space = False
        self.gap = max(self.gap, gap if self.lines else 0)

    def put(self, text: str) -> None:
        if not self.line:
            self.lines.extend([""] * self.gap)
            self.gap = 0
            if self.prefix:
                self.line.append(self.prefix)
                self.prefix = " " * min(len(self.prefix), self.room)
        elif self.space:
            self.line.append(" ")
        self.space = False
        self.line.append(text)

    def flow(self, data: str) -> None:
        """Text with its white space collapsed."""
        words = [w for w in SPACE.split(data) if w]
        if data[:1] in " \t\n\r\f" and data and self.line:
            self.space = True
        if words:
            self.put(" ".join(words))
            self.space = data[-1] in " \t\n\r\f"

    def block(self, lines: list[str]) -> None:
        """Whole lines; an empty page takes the list over."""
        self.end_line()
        if not self.prefix and lines:
            self.lines, self.gap = self.lines + [""] * self.gap + lines if self.lines else lines, 0
            return
        for line in lines:
            if line:
                self.put(line)
                self.end_line()
            else:
                self.gap = max(self.gap, 1)

    def finished(self) -> list[str]:
        self.end_line()
        return self.lines


def number(text: str, most: int, default: int) -> int:
    """A whole number as HTML reads it, at most ``most``."""
    found = NUMBER.match(text)
    return min(int(found[1]), most) if found else default


def declarations(body: str) -> dict[str, tuple[bool, str]]:
    """Whether important, and the value, of the properties that hide."""
    found: dict[str, tuple[bool, str]] = {}
    for part in body.split(";") if PROPERTIES.search(body) else ():
        name, _, value = part.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        important = value.endswith("important") and value[:-9].rstrip().endswith("!")
        value = value[:-9].rstrip()[:-1].rstrip() if important else value
        if name in ("display", "visibility") and value and important >= found.get(name, (False, ""))[0]:
            found[name] = (important, value)
    return found


def on_screen(media: str) -> bool:
    return not media.strip() or any(m.strip().lower() in ("all", "screen", "only screen") for m in media.split(","))


class Sheet:
    """The rules of a page's style sheets that show or hide elements, each under
    one id, class or tag that it asks for."""

    def __init__(self, root: Node):
        self.rules, self.known, self.found = defaultdict(list), set(), {}
        order, stack = 0, [root]
        while stack:
            node = stack.pop()
            if node.tag != "style":
                stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
            elif on_screen(node.attrs.get("media", "")):
                css = "".join(c for c in node.children if isinstance(c, str))
                if PROPERTIES.search(css):
                    order = self._read(COMMENT.sub(" ", css), order)

    def _read(self, css: str, order: int) -> int:
        around: list[str] = []
        applies = [True]  # of the blocks around
        parts = re.split(r"([{}])", css)
        for text, mark in zip(parts[::2], [*parts[1::2], "}"]):
            if mark == "{":
                prelude = text.rpartition(";")[2].strip()
                around.append(prelude)
                at, _, media = prelude.partition(" ")
                applies.append(applies[-1] and (not at.startswith("@") or at.lower() in ("@supports", "@layer")
                                                or at.lower() == "@media" and on_screen(media)))
            elif around:
                selectors, live = around.pop(), applies.pop()
                if live and not selectors.startswith("@") and (wanted := declarations(text)):
                    for one in selectors.split(","):
                        order += 1
                        self._add(one.strip(), wanted, order)
        return order

    def _add(self, selector: str, wanted: dict, order: int) -> None:
        found = SELECTOR.fullmatch(selector)
        if not found or not selector:
            return
        tag = (found[1] or "*").lower()
        names = set(re.findall(r"[.#][\w-]+", found[2]))
        ids = sum(n[0] == "#" for n in names)
        weight = (ids, len(names) - ids, tag != "*", order)
        self.known |= names
        self.rules[min(names, default=tag)].append((tag, names, weight, wanted))

    def styles(self, node: Node) -> dict[str, str]:
        """The values that win for an element."""
        own = declarations(node.attrs["style"]) if "style" in node.attrs else {}
        if not self.rules:
            return {name: value for name, (_, value) in own.items()}
        names = {"." + c for c in SPACE.split(node.attrs.get("class", ""))} | {"#" + node.attrs.get("id", "")}
        key = (node.tag, frozenset(names & self.known))
        best = self.found.get(key)
        if best is None:
            best = self.found[key] = {}
            for tag, asked, weight, wanted in (r for k in ("*", key[0], *key[1]) for r in self.rules.get(k, ())):
                if tag in ("*", key[0]) and asked <= key[1]:
                    for name, (important, value) in wanted.items():
                        best[name] = max(best.get(name, ((), "")), ((important, *weight), value))
        won = {name: value for name, (_, value) in best.items()}
        won.update((name, value) for name, (important, value) in own.items() if important or name not in best or not best[name][0][0])
        return won

    def shows(self, node: Node, shown: bool) -> tuple[bool, bool]:
        """Whether the element has a box, and whether its text is visible when
        that of its parent is ``shown``."""
        if node.tag in HIDDEN or node.space and node.tag in FOREIGN_HIDDEN:
            return False, False
        won = self.styles(node) if self.rules or "style" in node.attrs else {}
        closed = "hidden" in node.attrs or node.tag == "dialog" and "open" not in node.attrs
        visibility = won.get("visibility", "inherit")
        return (won["display"] != "none" if "display" in won else not closed,
                visibility in ("visible", "initial") or shown and visibility not in ("hidden", "collapse"))


def shown_children(node: Node) -> list:
    """What a closed element shows: a select its choice, details its summary,
    a drawing the elements in it but no loose text.  The parts of a fraction
    and the cells of a matrix stand apart."""
    tags = [c for c in node.children if isinstance(c, Node)]
    if node.space == "svg":
        return tags
    if node.space == "math" and node.tag in ("mfrac", "mtable", "mtr"):
        return [x for c in node.children for x in (c, " ")][:-1]
    if node.tag == "select":
        options = [o for c in tags for o in ([c] if c.tag == "option" else c.children) if isinstance(o, Node)]
        return [o for o in options if "selected" in o.attrs][:1] or options[:1]
    if node.tag == "details" and "open" not in node.attrs:
        return [c for c in tags if c.tag == "summary"][:1]
    return node.children


class Columns:
    """Columns of a row group that no cell from above reaches into, as sorted
    gaps: a row looks only at gaps it puts cells into.  Where cells overlap, an
    error in HTML, the first of them holds the shared columns."""

    def __init__(self):
        self.free, self.ends, self.row = [(0, float("inf"))], defaultdict(list), 0

    def place(self, cells: list[tuple[list, int, int]]) -> list[tuple[int, int]]:
        """First column and width of the next row's cells, each with its
        ``colspan`` and ``rowspan``."""
        for span in self.ends.pop(self.row, ()):
            insort(self.free, span)
        self.row += 1
        placed, taken, gap, at = [], [], 0, 0
        for _, wide, high in cells:
            while self.free[gap][1] <= at:
                gap += 1
            at = max(at, self.free[gap][0])
            placed.append((at, wide))
            if high > 1:
                taken.append((at, at + wide, self.row - 1 + high))
            at += wide
        for first, end, until in reversed(taken):
            self._take(first, end, until)
        return placed

    def _take(self, first: int, end: int, until: int) -> None:
        k = max(bisect_right(self.free, (first, float("inf"))) - 1, 0)
        while k < len(self.free) and self.free[k][0] < end:
            a, b = self.free[k]
            if b <= first:
                k += 1
                continue
            left = [(a, first)] if a < first else []
            right = [(end, b)] if end < b else []
            self.ends[until].append((max(a, first), min(b, end)))
            self.free[k:k + 1] = left + right
            k += len(left)


class Table:
    """Texts outside of cells, and the rows' cells by row group."""

    def __init__(self):
        self.loose, self.groups, self.row = [], [[]], None

    def new_row(self) -> list:
        self.row = []
        self.groups[-1].append(self.row)
        return self.row

    def lines(self) -> list[str]:
        rows = []
        for group in self.groups:
            columns = Columns()
            for row in group:
                places = columns.place(row)
                rows.append([(at, wide, lines) for (at, wide), (lines, _, _) in zip(places, row, strict=True) if lines])
        rows = [[(at, wide, lines if len(row) == 1 else [" ".join(x.strip() for x in lines if x)]) for at, wide, lines in row]
                for row in rows if row]
        if len(rows) == 1 and len(rows[0]) == 1:
            return rows[0][0][2]
        used = sorted({at for row in rows for at, _, _ in row})
        needs = defaultdict(list)  # of a column: the cells that end before it
        for row in rows:
            for at, wide, lines in row[:-1]:
                if len(lines[0]) <= MOST_GAP:
                    needs[used[bisect_left(used, at + wide)]].append((at, len(lines[0]) + 2))
        starts, start = {}, 0
        for at in used:
            starts[at] = start = max([start, *(starts[a] + n for a, n in needs[at])])
        return [line for row in rows for line in self._line(row, starts)]

    @staticmethod
    def _line(row: list, starts: dict[int, int]) -> list[str]:
        if len(row) == 1 and len(row[0][2]) > 1:
            return row[0][2]
        parts, length = [], 0
        for k, (at, _, lines) in enumerate(row):
            gap = starts[at] - length
            if k and gap < 2 or gap > MOST_GAP:
                gap = 2
            parts += [" " * gap, lines[0]]
            length += gap + len(lines[0])
        return ["".join(parts)]


class Renderer:
    """Walks the tree with a stack of its own, so nesting may be deeper than
    Python's calls.  A cell is laid out on a page of its own, which its table
    takes when the cell ends; the lines of a table go to the page around it."""

    def __init__(self, root: Node):
        self.sheet = Sheet(root)
        self.pages, self.tables, self.steps = [Page()], [], []
        self._next(self.flow, root.children, False, True)

    def _next(self, step, nodes: list, pre: bool, shown: bool) -> None:
        self.steps.extend((step, node, pre, shown) for node in reversed(nodes))

    def lines(self) -> list[str]:
        while self.steps:
            step, *args = self.steps.pop()
            step(*args)
        return self.pages[0].finished()

    def flow(self, node: Node | str, pre: bool, shown: bool) -> None:
        page = self.pages[-1]
        if isinstance(node, str):
            if not shown:
                return
            if not pre:
                page.flow(node)
                return
            for i, part in enumerate(node.split("\n")):
                if i:
                    page.end_line()
                if part:
                    page.put(part)
            return
        boxed, shown = self.sheet.shows(node, shown)
        if not boxed:
            return
        tag = node.tag
        if tag == "br":
            if not page.line:
                page.gap += bool(page.lines)
            page.end_line()
            return
        if tag == "img":
            if shown and (alt := node.attrs.get("alt", "").strip()):
                page.flow(alt)
            return
        if tag in BLOCK:
            page.end_line(1 if tag in SPACED and not (tag in ("ul", "ol") and page.lists) else 0)
        if tag == "input":
            if shown and node.attrs.get("type", "").lower() in ("submit", "button", "reset"):
                page.flow(node.attrs.get("value", ""))
            return
        if tag in ("td", "th", "tr"):
            page.end_line()
        if tag == "table":
            self.tables.append(Table())
            self.steps.append((self.end_table,))
            self._next(self.part, node.children, pre, shown)
            return
        if node.space == "svg text" and tag == "text":
            page.space = bool(page.line)
        before = page.prefix
        if tag in ("ul", "ol", "menu"):
            page.lists.append([tag, number(node.attrs.get("start", ""), 10**9, 1)])
        elif tag == "li":
            mark = "- "
            if page.lists and page.lists[-1][0] == "ol":
                mark = f"{page.lists[-1][1]}. "
                page.lists[-1][1] += 1
            page.prefix = " " * min(len(before), page.room) + mark
        elif tag == "blockquote" and len(before) + 2 <= page.room:
            page.prefix = before + "  "
        self.steps.append((self.leave, node, before))
        self._next(self.flow, shown_children(node), pre or tag == "pre", shown)

    def leave(self, node: Node, before: str) -> None:
        page, tag = self.pages[-1], node.tag
        if tag in ("ul", "ol", "menu"):
            page.lists.pop()
        if tag in ("li", "blockquote"):
            page.end_line()
            page.prefix = before
        if node.space == "svg text" and tag == "text":
            page.space = bool(page.line)
        if tag in BLOCK:
            page.end_line(1 if tag in SPACED and not (tag in ("ul", "ol") and page.lists) else 0)

    def part(self, node: Node | str, pre: bool, shown: bool) -> None:
        """What stands in a table: rows and cells, and texts around them."""
        table = self.tables[-1]
        if isinstance(node, str):
            if shown and (words := [w for w in SPACE.split(node) if w]):
                table.loose.append(" ".join(words))
            return
        boxed, visible = self.sheet.shows(node, shown)
        if not boxed:
            return
        if node.tag in ("td", "th"):
            self.pages.append(Page(self.inner_room()))
            self.steps.append((self.end_cell, node))
            self._next(self.flow, node.children, pre, visible)
        elif node.tag == "tr":
            table.new_row()
            self.steps.append((self.end_row, False))
            self._next(self.part, node.children, pre, visible)
        elif node.tag in ("thead", "tbody", "tfoot", "colgroup"):
            self.end_row(node.tag != "colgroup")
            self.steps.append((self.end_row, node.tag != "colgroup"))
            self._next(self.part, node.children, pre, visible)
        else:
            self.pages.append(Page(self.inner_room()))
            self.steps.append((self.end_loose,))
            self._next(self.flow, [node], pre, shown)

    def inner_room(self) -> int:
        return max(self.pages[-1].room - len(self.pages[-1].prefix), 0)

    def end_cell(self, node: Node) -> None:
        table, lines = self.tables[-1], self.pages.pop().finished()
        row = table.new_row() if table.row is None else table.row
        wide = max(number(node.attrs.get("colspan", ""), 1000, 1), 1)
        high = number(node.attrs.get("rowspan", ""), 65534, 1) or 65534  # 0: to the end of the group
        row.append((lines, wide, high))

    def end_loose(self) -> None:
        self.tables[-1].loose.extend(self.pages.pop().finished())

    def end_row(self, group: bool) -> None:
        self.tables[-1].row = None
        if group and self.tables[-1].groups[-1]:
            self.tables[-1].groups.append([])

    def end_table(self) -> None:
        table, page = self.tables.pop(), self.pages[-1]
        page.block(table.loose + table.lines() if table.loose else table.lines())
        page.end_line(1)


def visible_text(html: str | None) -> str:
    """The visible text of a page; null and empty pages have none."""
    if not html:
        return ""
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    return "\n".join(Renderer(builder.root).lines())


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """Every row of ``pages`` with its columns other than the page itself, and
    ``text``.  An own column named ``text`` gives way.  Rows stay as they are
    otherwise, nulls and repeated rows too; broken markup is read as far as
    it goes and never fails.  An empty table gives none."""
    made = lambda html: pa.array([visible_text(h) for h in html.to_pylist()], pa.string())
    return with_arrow_column(pages.select(*quoted([c for c in pages.columns if c != "text"])), column, "text", T.StringType(), made
                             ).drop(*quoted([column]))
