"""HTML layout against a slow renderer that knows the page it wrote."""

from __future__ import annotations

import random

import pytest

from branchwise.llm import html

WORDS = ["a", "bb", "ccc", "long word", "é日", "x" * 50]


def element(rng, depth):
    """A random tree: (kind, shown, css class, children or cells)."""
    kind = rng.choice(["text", "text", "div", "p", "ul", "span"] + ["table"] * (depth < 3)) if depth < 5 else "text"
    state = rng.choice(["", "", "", "none", "hide", "show", "gone", "mute"])
    if kind == "text":
        return kind, "", rng.choice(WORDS)
    if kind == "table":
        rows = [[(rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 1, 2, 3]), rng.choice(["", "", "", "hide", "none"]), element(rng, depth + 1))
                 for _ in range(rng.randrange(4))] for _ in range(rng.randrange(1, 5))]
        return kind, state, rows
    return kind, state, [element(rng, depth + 1) for _ in range(rng.randrange(4))]


ATTRS = {"": "", "none": ' style="display : NONE"', "hide": ' style="visibility:hidden"', "show": ' style="visibility: visible"',
         "gone": ' class="q gone"', "mute": " class=mute"}
SHEET = "<style>@media print { * {display:none} } .gone.q , #no {display:none} /* p{display:none} */ .mute { visibility:hidden }</style>"


def written(node, rng):
    kind, state, inside = node
    if kind == "text":
        return f" {inside} "
    attrs, end = ATTRS[state], lambda tag: rng.choice([f"</{tag}>", ""])
    if kind == "table":
        rows = "".join("<tr>" + "".join(f"<td colspan={w} rowspan={h}{ATTRS[st]}>{written(x, rng)}{end('td')}" for w, h, st, x in row)
                       + end("tr") for row in inside)
        return f"<table{attrs}>{rows}</table>"
    body = "".join(f"<li>{written(c, rng)}{end('li')}" if kind == "ul" else written(c, rng) for c in inside)
    return f"<{kind}{attrs}>{body}</{kind}>"


def plain(tree):
    """A paragraph holds no block; those would end it."""
    kind, state, inside = tree
    if kind == "text":
        return tree
    if kind == "table":
        return kind, state, [[(w, h, st, plain(x)) for w, h, st, x in row] for row in inside]
    inside = [plain(c) for c in inside]
    return kind, state, [c for c in inside if c[0] == "text"] if kind in ("p", "span") else inside


def words_by_hand(node, shown=True):
    """The visible words of a tree, without marks of list items."""
    kind, state, inside = node
    if kind == "text":
        return inside.split() if shown else []
    if state in ("none", "gone"):
        return []
    shown = state == "show" or shown and state not in ("hide", "mute")
    if kind == "table":
        return [w for row in inside for _, _, st, x in row if st != "none" for w in words_by_hand(x, shown and st != "hide")]
    return [w for c in inside for w in words_by_hand(c, shown)]


def grid_by_hand(rows):
    """Cells on a matrix, square after square; then columns set apart one by one."""
    taken, placed = set(), []
    for i, row in enumerate(rows):
        at = 0
        for wide, high, text in row:
            while (i, at) in taken:
                at += 1
            own = {(i + y, at + x) for y in range(high) for x in range(wide)}
            if own & taken:
                return None  # cells overlap, an error in HTML
            taken |= own
            placed.append((i, at, wide, text))
            at += wide
    placed = [p for p in placed if p[3]]
    used = sorted({p[1] for p in placed})
    last = {i: max(at for j, at, _, _ in placed if j == i) for i, _, _, _ in placed}
    starts = {}
    for k, c in enumerate(used):
        ends = [starts[at] + len(t) + 2 for i, at, wide, t in placed
                if at < c and last[i] > at and at + wide <= c and not any(at + wide <= u < c for u in used)]
        starts[c] = max([*ends, starts[used[k - 1]] if k else 0])
    lines = []
    for i in sorted(last):
        line = ""
        for _, at, _, t in sorted(p for p in placed if p[0] == i):
            gap = starts[at] - len(line)
            line += " " * (2 if line and gap < 2 or gap > 40 else gap) + t
        lines.append(line)
    return lines


def test_visible_words_of_random_pages():
    rng = random.Random(11)
    some = 0
    for _ in range(600):
        tree = plain(("div", "", [element(rng, 0) for _ in range(rng.randrange(4, 16))]))
        want = words_by_hand(tree)
        page = SHEET + written(tree, rng)
        assert [w for w in html.visible_text(page).split() if w != "-"] == want, page
        some += len(want) > 5
    assert some > 100


def test_grids_of_random_tables():
    rng = random.Random(12)
    compared = 0
    for _ in range(1500):
        rows = [[(rng.choice([1, 1, 2, 3]), rng.choice([1, 1, 2, 4]), rng.choice(["", "a", "bb", "ccccc"])) for _ in range(rng.randrange(5))]
                for _ in range(rng.randrange(1, 7))]
        page = "<table>" + "".join("<tr>" + "".join(f"<td colspan={w} rowspan={h}>{t}" for w, h, t in row) for row in rows) + "</table>"
        if (want := grid_by_hand(rows)) is not None:
            compared += 1
            assert html.visible_text(page).split("\n") == (want or [""]), page
    assert compared > 500


INNER = "<table><tr><td>a<td>b<tr><td>ccc<td>d</table>"


@pytest.mark.parametrize("page, text", [
    ("<div style=visibility:hidden>no<span style=visibility:visible>YES</span></div>", "YES"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
    ("<table><tr><td colspan=2>long one<td>z<tr><td>p<td>q<td>r</table>", "long one  z\np  q      r"),
    ("<table><thead><tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
    ("<style>.x{display:none}</style><p class=x>no<p class='y x'>no<p>yes", "yes"),
    ("<style media=print>p{display:none}</style><style>@media print{p{display:none}} div p{display:none}</style><p>yes", "yes"),
    ("<style>.x{display:none!important}.x{display:block}</style><p class=x style=display:block>no</p>yes", "yes"),
    ("<style>#a{display:block}.x{display:none}</style><p class=x id=a>yes<p class=x style='display:block'>too", "yes\n\ntoo"),
    ("<style>.x{visibility:hidden}.y{visibility:visible}</style><div class=x>no<b class=y>yes<i class=x>no</i></b></div>", "yes"),
    ("<table><tr><td><h1>T</h1><p>one<p>two</table>", "T\n\none\n\ntwo"),
    ("<table><caption>C</caption><tr><td>a<td>b</table>", "C\na  b"),
    (f"<ol start={'9' * 5000}><li>x</ol><table><tr><td colspan={'9' * 5000}>y</table>", "999999999. x\n\ny"),
    ("<ol><li style=display:none>no<li>x</ol>", "1. x"),
])
def test_layout(page, text):
    assert html.visible_text(page) == text


def test_tables_in_tables_to_any_depth():
    for depth in (1, 39, 41, 2000):
        assert html.visible_text("<table><tr><td>" * depth + INNER) == "a    b\nccc  d"
        assert html.visible_text("<table><tr><td>x<td>" * depth + INNER).endswith("x  a    b ccc  d")


@pytest.mark.parametrize("page", [
    "<table><tr>" + "<td>a" * 1000 + "<tr><td colspan=999>a<td>b" * 2400,
    "<table><tr><td>" + "w" * 34000 + "<td>x" + "<tr><td>a<td>b" * 2400,
    "<table><tr>" + "<td rowspan=9999>x" * 2000 + "<tr><td>a" * 3700,
    "<ul><li>x" * 7500, "<blockquote>x" * 5000, "<table><tr><td><li>a" * 3400, "<table><tr><td>ab<tr><td><td>" * 2300 + "x",
    "<p><button>" + "<div>" * 13000 + "x", "<div>" * 13000 + "x",
])
def test_hostile_pages_stay_small(page):
    assert 0 < len(html.visible_text(page)) < 1_000_000


def test_extract_of_an_empty_table(spark):
    got = html.extract(spark.createDataFrame([], "page_id bigint, url string, html string, `a.b` string"))
    assert got.columns == ["page_id", "url", "a.b", "text"] and got.count() == 0
