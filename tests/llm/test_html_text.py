import re
import time
from html.parser import HTMLParser

import pytest
from helpers import empty

from ordertide.llm import queries
from ordertide.llm.html_text import extract_text, page_text

SF_DIR = "/root/testdata/sf0.01"

LAID_OUT = [
    ("a<p>b<p>c", "a\n\nb\n\nc"),
    ("<ul><li>one<li>two<ul><li>x<li>y</ul><li>three</ul>end", "- one\n- two\n  - x\n  - y\n- three\n\nend"),
    ("<ol start=9><li>a<li>b</ol>", "9. a\n10. b"),
    (
        "<table><caption>T</caption><tr><th>Name<th>Q<tr><td>apple<td>10<tr><td>fig<td>2</table>after",
        "T\nName   Q\napple  10\nfig    2\n\nafter",
    ),
    ("<table><tr><td colspan=2>ab<td>c<tr><td>d<td>e<td>f</table>", "ab     c\nd   e  f"),
    ("<table><tr><td>x<br>y<td>z</table>", "x  z\ny"),
    ("x <b>y</b>z  \n w<br>v<br><br>u", "x yz w\nv\n\nu"),
    ("<pre>a\n  b\n\nc</pre>d", "a\n  b\n\nc\n\nd"),
    ("<div hidden>no</div><p style='Display : none'>no<p>yes<input type=hidden>", "yes"),
    ("a < b &amp; c &lt;p&gt; &eacute;&#x1F600;&nosuch;", "a < b & c <p> é\U0001f600&nosuch;"),
    ("<script>var x='</p>';</script>t<!-- <p>c -->u<style>p{}</style>", "tu"),
    ("<details><summary>s</summary>no</details><details open><summary>s</summary>yes</details>", "s\ns\nyes"),
    ("<dl><dt>t<dd>d1<dd>d2</dl>", "t\n  d1\n  d2"),
    ("<head><title>no</title><meta><body>yes", "yes"),
    ("<title>no</title>yes", "yes"),
    ("<p>un<b>closed <i>x</p>y</b></nothing>", "unclosed x\n\ny"),
    ("<div><p>a</div>b</p>c<br/>d", "a\n\nb\n\nc\nd"),
    ("<select><option>a<option>b</select>", "a\nb"),
    ("<a title='x>y' href=z>link</a> <img alt='a picture'>", "link a picture"),
    ("<p>open <a href=\"x", "open"),
    ("text <", "text <"),
    ("<td>loose<td>cell", "loose  cell"),
    ("no tags at  all", "no tags at all"),
    ("area <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> unit", "area x=2 unit"),
    (
        "<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><path d='M0'/>no<g><text x=1>Axis</text>"
        "<text><tspan>10</tspan> km</text></g><foreignObject><p>page</p></foreignObject></svg>after",
        "Axis\n10 km\n\npage\n\nafter",
    ),
    ("<svg><defs/><text>seen</text></svg><map name=m><area alt=no><a>spot</a></map>", "seen\nspot"),
    ("a<!-->b<!--->c<!-- x --!>d<!-- > -->e", "abcde"),
    (
        "<table><tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e<tr><td>f<td>g<td>h</table>",
        "a  b  c\n   d  e\nf  g  h",
    ),
    (
        "<table><tr><td>a<td rowspan=3 colspan=2>bb<td>c<tr><td>d<td>e<tr><td>f<td>g</table>",
        "a  bb  c\nd      e\nf      g",
    ),
    ("<table><tbody><tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
    ("<ol><li value=7>a<li>b<li value=x>c</ol>", "7. a\n8. b\n9. c"),
    ("<ol reversed><li>a<li>b<li>c</ol>", "3. a\n2. b\n1. c"),
    ("<ol type=A start=26><li>a<li>b</ol><ol type=i start=4><li>a<li value=1949>b</ol>", "Z. a\nAA. b\n\niv. a\nmcmxlix. b"),
    ("<pre>\n a\n\n b</pre><pre>c</pre>", " a\n\n b\n\nc"),
    ("<form>Name <input value=no> <input type=Submit value='Send it'><input type=button></form>", "Name Send it"),
    (
        f"<table><tr><td>{'long ' * 20}<td>x<tr><td>short<td>y</table>",
        f"{('long ' * 20).strip()}  x\n{'short'.ljust(99)}  y",
    ),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize(("page", "text"), LAID_OUT)
def test_layout(page, text):
    assert page_text(page) == text


class Visible(HTMLParser):
    """Words outside elements that are not shown, by the standard library's tokenizer."""

    def __init__(self):
        super().__init__()
        self.words, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("head", "script", "style", "title"):
            self.hidden += 1

    def handle_endtag(self, tag):
        if tag in ("head", "script", "style", "title"):
            self.hidden -= 1

    def handle_data(self, data):
        if not self.hidden:
            self.words += data.split()


def test_query_has_all_visible_words_in_order(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    rows = queries.op7_html_extraction(spark, SF_DIR).collect()
    assert len(rows) == len(pages)
    for r in rows:
        reader = Visible()
        reader.feed(pages[r.page_id] or "")
        reader.close()
        plain = re.sub(r"^ *(- |\d+\. )", "", r.text, flags=re.M)
        assert "".join(plain.split()) == "".join("".join(reader.words).split())


def test_awkward_rows(spark):
    pages = spark.createDataFrame(
        [(1, None, "x"), (1, "", "x"), (None, "<p>a", "x"), (None, "<p>a", "x"), (2, "<p>" + "long " * 100_000, "x")],
        "page_id bigint, html string, text string",
    )
    rows = [tuple(r) for r in extract_text(pages).collect()]
    assert sorted(rows, key=repr) == sorted(
        [(1, ""), (1, ""), (None, "a"), (None, "a"), (2, ("long " * 100_000).strip())], key=repr
    )
    assert extract_text(empty(spark), id_col="doc_id", html_col="text").count() == 0


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 50_000 + "x",
        "<table><tr><td>" * 1000 + "x",
        '<a "' * 50_000,
        '<a "' * 50_000 + ">",
        "<" * 50_000,
        "<!--" * 50_000,
        "<p>" * 50_000 + "</p>" * 50_000,
        "<li>" * 50_000,
        "<p><button>" + "<div>" * 50_000,
        "<b>" * 50_000 + "</i>" * 50_000,
        "<table>" + "<tr><td>" + "w" * 50_000 + "<tr><td>x" * 20_000,
        "<table>" + "<tr><td>" + "w" * 50_000 + "<td>v" + "<tr><td>x<td>y" * 2_000,
        "<table><tr>" + "<td rowspan=0>" * 300 + "<tr><td>x" * 300,
        "<svg>" * 50_000 + "<text>x" * 1_000,
    ],
)
def test_hostile_pages_take_time_in_proportion(page):
    began = time.monotonic()
    text = page_text(page)
    assert time.monotonic() - began < 20
    assert len(text) < 3 * len(page)
