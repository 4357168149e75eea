"""Visible text that implied ends, foreign elements and form controls used to lose."""

import pytest

pytest.importorskip("lamina.llm.common")


@pytest.mark.parametrize(
    "html, text",
    [
        ("<html><head><title>t</title><body><p>x", "x"),
        ("<head><meta charset=utf-8><style>p{}</style><p>x</p>y", "x\n\ny"),
        ("<head><title>t</title>plain", "plain"),
        ("<head><template><p>no</p></template><script>n</script></head><p>x", "x"),
        ("<div>a<head>b</div>c", "ab\nc"),
        ('<div>a <svg width="9"/> b <math/> c</div>', "a b c"),
        ("<div>a <svg width=9/><path d='M0'/></svg> b</div>", "a b"),
        ("<div>a <svg><style/><path/></svg>b</div>", "a b"),
        ("x = <math><mi>y</mi><mspace/><mo>+</mo><mn>1</mn><annotation>no</annotation></math>!", "x = y+1!"),
        ("<div><table><tr><td>a</div>b</td><td>c</td></tr></table></div>", "ab  c"),
        ("<table><tr><td>x<ul><li>p<li>q</ul><td>y</table>", "x    y\n- p\n- q"),
        ("<b>a<table><tr><td>x</b>y</table>z</b>", "a\nxy\nz"),
        ("a <svg><title>no</title><text>shown</text><desc>no</desc></svg> <object>fallback</object>", "a shown fallback"),
        ("<p>Pick <select><option>a<option>b<optgroup><option>c</select> now", "Pick\na\nb\nc\nnow"),
    ],
)
def test_all_visible_text(html, text):
    from lamina.llm.markup import render

    assert render(html) == text


def test_extract_keeps_every_row(spark):
    from lamina.llm.markup import extract, render

    pages = [(1, "<p>one", "u"), (1, "<p>one", "u"), (2, None, "u"), (3, "", None), (None, "<b>x</b>", "u"), (4, "<div>" * 3000 + "deep " + "<p>word " * 20000, "u")]
    frame = spark.createDataFrame(pages, "page_id long, html string, text string")
    got = sorted((r["page_id"] or -1, r["text"]) for r in extract(frame).collect())
    assert got == sorted((p or -1, render(h or "")) for p, h, _ in pages)
    assert extract(frame.limit(0)).count() == 0 and extract(frame).columns == ["page_id", "text"]


def test_open_quotes_take_linear_time():
    import time

    from lamina.llm.markup import render

    begun = time.perf_counter()
    render("<a '" * 20001 + "x")
    render('<a href="' * 20001)
    assert render("<i '>" * 20000 + "<i '>end") == "end"
    assert time.perf_counter() - begun < 20
