"""Reading of HTML as it comes."""

import random
import time

import pytest

from tessera.functions.markup import attributes, marks, plain_text, table_cells


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, None),
        (" \n", None),
        ("<p> a &#39;b&copy; &#x41;&amp; &nosuch; </p>", "a 'b© A& &nosuch;"),
        ("a < b <3 <p class=\"x>y\" title='>' q=a'b>t</p>", "a < b <3 t"),
        ("<p>x<!-- c > --><script>var a='</p>';</script>y<p class=\"un", "xy"),
        ("<title>head</title><STYLE>p{}</STYLE ><div>one<br/>two</div>three", "one\ntwo\nthree"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb c\n\nd".replace("b c", "bc")),
        ("<p>a<p><b>b<div>c</div>&nbsp; <p></p><p></p><p>d", "a\nb\nc\n\nd"),
        ("<table><tr><td>a<td>b<tr><td>c</table>z", "ab\nc\nz"),
        ("<textarea><b>&amp;</textarea>z</>q</ 1>r<!-->s", "<b>&zqrs"),
    ],
)
def test_plain_text(source, text):
    assert plain_text(source) == text


def test_attributes():
    found = [attributes(rest) for kind, _, rest in marks("<a HREF='x>' href=y b c = \"1&amp;2\"d=e/f>") if kind == "start"]
    assert found == [{"href": "x>", "b": "", "c": "1&2", "d": "e/f"}]


@pytest.mark.parametrize("bad", ["<", "<a ", '<a b="', "<!--", "<script>", "</", "<a b='>", "&", "<a =", "<p><li><td>"])
def test_time_is_linear(bad):
    began = time.perf_counter()
    list(marks(bad * 50_000))
    assert time.perf_counter() - began < 2


@pytest.mark.parametrize(
    ("source", "cells"),
    [
        ("<table><tr><td rowspan='2'>a</td><td colspan='2'>b</td></tr><tr><td>c</td><td> d&#33; </td></tr></table>", [(0, 0, 2, 1, "a"), (0, 1, 1, 2, "b"), (1, 1, 1, 1, "c"), (1, 2, 1, 1, "d!")]),
        ('<tr><th ROWSPAN = 3 >x<td rowspan="0">y<tr><td colspan=2x>z<tr><td>u<td>v<tr><td>w', [(0, 0, 3, 1, "x"), (0, 1, 1, 1, "y"), (1, 1, 1, 2, "z"), (2, 1, 1, 1, "u"), (2, 2, 1, 1, "v"), (3, 0, 1, 1, "w")]),
        ("<td>no row</td>", []),
        (None, []),
    ],
)
def test_table_cells(source, cells):
    assert table_cells(source) == cells


def test_neighbours_pass_over_spans(spark):
    from tessera.operators.parsing import neighbours

    def plain(cells):
        grid, out = {}, []
        for at, row, col, rows, cols, text in cells:
            grid |= {(r, c): (at, text) for r in range(row, row + rows) for c in range(col, col + cols)}
        for (r, c), (at, text) in grid.items():
            for way, dr, dc in (("right", 0, 1), ("down", 1, 0)) if text.strip() else ():
                k = 1
                while (there := grid.get((r + k * dr, c + k * dc))) and (there[0] == at or not there[1].strip()):
                    k += 1
                if there:
                    out.append((text, there[1], way))
        return sorted(out)

    rng = random.Random(7)
    tables = [[(0, 0, 0, 1, 1, "A"), (1, 0, 1, 2, 1, "B"), (2, 0, 2, 1, 1, "C"), (3, 1, 0, 1, 1, "D"), (4, 1, 2, 1, 1, "E")]]
    tables += [[(k, rng.randrange(5), rng.randrange(5), rng.randint(1, 3), rng.randint(1, 3), rng.choice(["a", "b", "c", " "])) for k in range(8)] for _ in range(30)]
    rows = [(t, *cell) for t, cells in enumerate(tables) for cell in cells]
    got = neighbours(spark.createDataFrame(rows, "tab int, at int, row int, col int, rowspan int, colspan int, text string"), "tab").collect()
    assert plain(tables[0])[:3] == [("A", "B", "right"), ("A", "D", "down"), ("B", "C", "right")]
    for t, cells in enumerate(tables):
        assert sorted((r.text, r.next_text, r.direction) for r in got if r.tab == t) == plain(cells)
