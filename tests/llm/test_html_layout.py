"""HTML extraction against a plain layout of the same document, made from its structure instead of its tags."""

import hashlib
import random
import time
import tracemalloc

import pytest

from asofly.llm.html_text import BOUNDED, EXACT, Held, draw, extract, lay_out, parts, render
from asofly.llm.queries import op9_html_extraction


def layout(blocks, limits=BOUNDED):
    """Text of a list of blocks: lines, and None for a blank line before what follows."""
    out = []

    def items(kind, entries, depth):
        for n, (text, below) in enumerate(entries, 1):
            out.append("  " * (depth if limits.indents is None else min(depth, limits.indents)) + (f"{n}. " if kind == "ol" else "- ") + text)
            if below:
                items(*below, depth + 1)

    def walk(blocks):
        for kind, body in blocks:
            if kind == "div":
                walk(body)
            elif kind == "line":
                out.append(body)
            elif kind != "hidden":
                out.append(None)
                if kind == "p":
                    out.append(body)
                elif kind in ("ul", "ol"):
                    items(kind, body, 0)
                else:
                    out.extend(table(body, limits))
                out.append(None)

    walk(blocks)
    lines = []
    for x in out:
        if x is None and lines and lines[-1]:
            lines.append("")
        elif x is not None:
            lines.append(x)
    return "\n".join(lines).strip("\n")


def table(rows, limits):
    """Every place of the grid is noted, then each row is drawn at the columns' offsets."""
    taken, placed = set(), []
    for r, row in enumerate(rows):
        c = 0
        for text, wide, high in row:
            while (r, c) in taken:
                c += 1
            taken |= {(r + i, c + j) for i in range(high) for j in range(wide)}
            placed.append((r, c, wide, text))
            c += wide
    shown = {r for r, _, _, t in placed if t}
    used = sorted({c for r, c, _, _ in placed if r in shown})
    width = {c: max([len(t) for r, k, w, t in placed if k == c and w == 1 and (limits.cell_width is None or len(t) <= limits.cell_width)], default=0) for c in used}
    out = []
    for r in sorted(shown):
        line = ""
        for n, (_, c, _, text) in enumerate(x for x in placed if x[0] == r):
            offset = sum(width[k] + 3 for k in used if k < c)
            if c or n:
                line = (line.ljust(offset - 3) if limits.aligned is None or offset <= limits.aligned else line) + " | "
            line += text
        out.append(line.rstrip())
    return out


def tags(rnd, blocks):
    """HTML of the blocks; end tags that may be left out sometimes are, white space and case vary."""
    maybe = lambda end: rnd.choice((end, end.upper(), ""))
    words = lambda t: t.replace("&", "&amp;").replace(" ", rnd.choice((" ", "\n", "  ", " <b></b>")))

    def entries(kind, items):
        return f"<{kind}>" + "".join(f"<li>{words(t)}{entries(*below) if below else ''}{maybe('</li>')}" for t, below in items) + f"</{kind}>"

    out = ""
    for kind, body in blocks:
        if kind == "div":
            out += f"<div>{tags(rnd, body)}</div>"
        elif kind == "line":
            seen = rnd.choice(("<div>{}</div>", "<div><svg><text>{}</text></svg></div>", "<div><math><mi>{}</mi></math></div>", "<div style='visibility: hidden'><b style='visibility:visible'>{}</b></div>", "<div style='backface-visibility: hidden'>{}</div>"))
            out += seen.format(words(body))
        elif kind == "p":
            out += f"<p>{words(body)}</p>" if rnd.random() < 0.5 else f"<p class='x>y'>{words(body)}</p >"
        elif kind == "hidden":
            out += rnd.choice(("<!-->", "<!--->", "<!-- no --!>", "<svg><title>no</title><g>no</g></svg>", "<div style='visibility:hidden'>no<p>no</div>", "<math><annotation>no</annotation></math>", "<script>x < y</script >", "<div hidden>no<p>no</div>", "<!-- no -->", "<style>p{}</style x>", "<span style='display:none'>no</span>"))
        elif kind in ("ul", "ol"):
            out += entries(kind, body)
        else:
            cell = lambda c: f"<td{f' colspan={c[1]}' if c[1] > 1 else ''}{f' rowspan={c[2]}' if c[2] > 1 else ''}>{words(c[0])}{maybe('</td>')}"
            out += "<table>" + rnd.choice(("", "<tbody>")) + "".join("<tr>" + "".join(map(cell, r)) + maybe("</tr>") for r in body) + "</table>"
    return out


def document(rnd, depth=0):
    text = lambda most=6: " ".join(rnd.choice(("a", "bb & c", "word", "longer-word", "é")) for _ in range(rnd.randint(1, most)))

    def entries(level):
        return [(text(), (rnd.choice(("ul", "ol")), entries(level + 1)) if level < 3 and rnd.random() < 0.3 else None) for _ in range(rnd.randint(1, 4))]

    def block():
        kind = rnd.choice(("p", "line", "div", "ul", "ol", "table", "table", "hidden"))
        if kind == "div":
            return kind, document(rnd, depth + 1) if depth < 3 else [("line", text())]
        if kind in ("p", "line"):
            return kind, text()
        if kind == "table":
            size = rnd.choice((2, 2, 6, 30))
            return kind, [[(rnd.choice((text(), text(), "", text(40) if size == 2 else "x")), rnd.choice((1, 1, 1, 2, 3)), rnd.choice((1, 1, 1, 2, 3))) for _ in range(rnd.randint(1, 4))] for _ in range(size)]
        return kind, entries(0) if kind in ("ul", "ol") else None

    return [block() for _ in range(rnd.randint(1, 5))]


@pytest.mark.parametrize("limits", [BOUNDED, EXACT], ids=["bounded", "exact"])
@pytest.mark.parametrize("seed", range(300))
def test_layout(seed, limits):
    rnd = random.Random(seed)
    blocks = document(rnd)
    assert render(tags(rnd, blocks), limits) == layout(blocks, limits)


@pytest.mark.parametrize(
    "page,text",
    [
        ("<!-->b<p>c", "b\n\nc"), ("<!--->b<p>c", "b\n\nc"), ("a<!-- x --!>b", "ab"), ("a<!-- x -- >b", "a"), ("a<!--", "a"), ("a<!-- <b>x</b>", "a"), ("a<!----!>b", "ab"), ("a<!--x->y-->b", "ab"),
        ("<svg><text>shown</text></svg>", "shown"), ("<svg>no<text>a<tspan>b</tspan></text><desc>no</desc><text>c</text></svg>d", "ab c d"), ("<math><mi>x</mi><mo>=</mo></math>", "x="),
        ("<svg><foreignObject><p>in</p></foreignObject></svg>", "in"), ("<div style='visibility:hidden'>a<span style='visibility: visible'>b</span>c</div>", "b"),
        ("<ul style='visibility:hidden'><li>a<li style='visibility:visible'>b</ul>", "- b"), ("<div style='display:none'>a<span style='visibility: visible'>b</span></div>c", "c"),
        ("<table><tr><td style='visibility:hidden'>aa<td>b<tr><td>c<td>d</table>", "  | b\nc | d"),
    ],
)
def test_seen_text(page, text):
    assert render(page) == text


def test_exact_layout_has_no_limits():
    """Columns far to the right, wide cells, a hundred columns, deep lists and deep tables are laid out alike."""
    rows = ["<tr>" + "".join(f"<td>{'x' * (1 + (i * k) % 70)}" for k in range(100)) for i in (1, 2, 3)]
    lines = render(f"<table>{''.join(rows)}</table>", EXACT).split("\n")
    bars = [[i for i, c in enumerate(line) if c == "|"] for line in lines]
    assert len(bars[0]) == 99 and bars[0] == bars[1] == bars[2]
    assert render("<ul><li>a" * 12, EXACT).split("\n")[-1] == "  " * 11 + "- a"
    deep = render("<table><tr><td>p<td>" * 5 + "q" + "</table>" * 5, EXACT)
    assert deep == "p | " * 5 + "q"


HOSTILE = {
    "a long cell and many rows": lambda n: "<table><tr><td>" + "x" * n + "<tr><td>a<td>b" * (n // 14),
    "nested lists": lambda n: "<ul><li>a" * (n // 9),
    "many cells, many lines": lambda n: "<table><tr>" + "<td>a" * (n // 10) + "<br>x" * (n // 10),
    "nested tables": lambda n: "<table><tr><td>x<td>" * (n // 40) + "a<br>" * (n // 10),
    "row spans": lambda n: "<table><tr>" + "<td rowspan=9999>x" * (n // 36) + "<tr><td>y" * (n // 18),
    "column spans": lambda n: "<table>" + "<tr><td>a<td colspan=1000>b<td>c" * (n // 32),
    "unclosed attributes": lambda n: "<a b='" * (n // 6),
}


@pytest.mark.parametrize("page", HOSTILE.values(), ids=HOSTILE)
def test_linear(page):
    """Ten times the page is about ten times the text, and a megabyte takes seconds."""
    small, large = render(page(100_000)), None
    began = time.process_time()
    large = render(page(1_000_000))
    assert time.process_time() - began < 60
    assert len(large) <= 11 * len(small) + 1000 and len(large) <= 20 * 1_000_000


def test_all_text_stays():
    """Text wider than its column, beyond the aligned columns, or in tables deep within tables is all there."""
    cells = [f"c{k}" * (1 + k % 40) for k in range(100)]
    got = render("<table><tr>" + "".join(f"<td>{c}" for c in cells) + "<tr>" + "".join(f"<td>{c}" for c in reversed(cells)) + "</table>")
    assert got.split("\n")[0].replace(" ", "").split("|") == cells and got.count("|") == 198
    deep = render("".join(f"<table><tr><td>x{k}<td>" for k in range(BOUNDED.grids + 4)) + "end")
    assert all(f"x{k}" in deep for k in range(BOUNDED.grids + 4)) and deep.endswith("end")
    assert render("<script>a</script x>b<title>t</title\n>c") == "bc"


BEYOND = {
    "columns": "<table>" + "".join("<tr>" + "".join(f"<td>{'x' * (1 + i * k % 3)}" for k in range(60)) for i in (1, 2)) + "</table>",
    "far columns": "<table>" + "".join("<tr>" + "".join(f"<td>{'x' * (1 + i * k % 30)}" for k in range(12)) for i in (1, 2)) + "</table>",
    "wide cells": f"<table><tr><td>{'w' * 61}<td>b<tr><td>a<td>b</table>",
    "deep lists": "<ul><li>a" * 12,
    "deep tables": "<table><tr><td>p<td>" * 5 + "q" + "</table>" * 5,
}


def test_query_has_no_limits(spark, tmp_path):
    """The query lays out each page as the exact layout does, whichever bound it is beyond."""
    spark.createDataFrame(list(enumerate(BEYOND.values())), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in op9_html_extraction(spark, str(tmp_path)).collect()}
    for k, page in enumerate(BEYOND.values()):
        whole = render(page, EXACT)
        assert whole != render(page, BOUNDED)
        assert (got[k].text, got[k].n_chars, got[k].n_lines, got[k].part) == (whole, len(whole), whole.count("\n") + 1, 0)
    bars = [[i for i, c in enumerate(line) if c == "|"] for line in got[0].text.split("\n")]
    assert len(bars[0]) == 59 and bars[0] == bars[1]


def test_long_texts_go_on_in_further_rows(spark):
    wide = "<table><tr><td>" + "é" * 40 + "<td>b" + "<tr><td>a<td>b" * 9
    pages = [(1, "<ul><li>a" * 40), (2, None), (3, "é" * 100), (4, "é" * 101), (5, wide), (None, "<pre>a\n\nb</pre>")]
    rows = extract(spark.createDataFrame(pages, "page_id long, html string"), whole=100, part=30).collect()
    for key, page in pages:
        mine = sorted((r for r in rows if r.page_id == key), key=lambda r: r.part)
        whole = render(page, EXACT)
        assert "".join(r.text for r in mine) == whole and [r.part for r in mine] == list(range(len(mine))) and len(mine) == (1 if len(whole) <= max(100, len(page or "")) else -(-len(whole) // 30))
        assert (len(mine) > 1) == (key in (1, 5))
        figures = (len(whole), whole.count("\n") + 1 if whole else 0, hashlib.sha256(whole.encode()).hexdigest())
        assert {(r.n_chars, r.n_lines, r.text_sha256) for r in mine} == {figures}


@pytest.mark.parametrize("page", HOSTILE.values(), ids=HOSTILE)
def test_exact_layout_is_small_until_drawn(page):
    """Whatever its text comes to, a page in the making and what is drawn of it at a time hold some hundred bytes a character."""
    html = page(20_000)
    tracemalloc.start()
    n = most = 0
    for s in parts(draw(lay_out(html, EXACT)), 100_000):
        n, most = n + len(s), max(most, len(s))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8_000_000 and most <= 100_000
    assert n == len(render(html, EXACT))


@pytest.mark.parametrize("seed", range(40))
def test_held_columns(seed):
    """Held columns against a list of each column's row."""
    rnd, held, until = random.Random(seed), Held(), [0] * 2000
    for row in range(60):
        held.row(row)
        at = 0
        for _ in range(rnd.randint(0, 8)):
            want = next(k for k in range(at, 2000) if until[k] <= row)
            assert (at := held.first(at)) == want
            end, to = at + rnd.choice((1, 1, 2, 5, 20)), row + rnd.randint(2, 9)
            held.hold(at, end, to)
            until[at:end] = [max(x, to) for x in until[at:end]]
            at = end
    assert len(held.free) == len(set(held.free)) and held.free == sorted(held.free)
