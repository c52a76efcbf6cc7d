"""Markup, templates by host, and odd pages."""

from __future__ import annotations

import pytest

from tablegauge.llm import html_text


def text(html, template=()):
    root = html_text.parse(html)
    html_text.hashed(root)
    return html_text.main_text(root, frozenset(template))


@pytest.mark.parametrize(("html", "want"), [
    ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b", "a\nb"), ("<p>a <b>b</b>\n c</p>", "a b c"),
    ("<article><h1>T</h1><p><b>x<br><p>y</article><footer>f</footer>", "T\nx\ny"),
    ("<nav><ul><li>n</ul></nav><main><ul><li>1<li>2</ul></main>", "1\n2"), ("<script>var t='</p>';</script><p>x", "x"),
    ("<style>p{}</style><!-- c --><div class='ad'>buy</div><p>x&nbsp;y &#233; &lt;b&gt;</p>", "x y é <b>"),
    ("<div class='cookie-notice'>ok?</div><div id=comments><p>first!</p></div><div class='story'>s</div>", "s"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<p>a < b and 1<2</p>", "a < b and 1<2"), ("<p title='>'>q</p>", "q"),
    ("<div><p>one</div>two", "one\ntwo"), ("<body hidden><form>f</form><p>x</p></body>", "x"), ("<P>Up</P><BR><aside>no</aside>", "Up"),
    ("<article><header><h1>H</h1></header><p>x</p></article><header>site</header>", "H\nx"), ("<p", ""), ("a<!-- open", "a"),
    ("<pre>a\n\n b</pre>", "a b"), ("<p>" + "word " * 30_000 + "</p>", "word " * 29_999 + "word"), ("<b>" * 5000 + "deep", "deep"),
])
def test_text(html, want):
    assert text(html) == want


def pages(host, n, body):
    return [(i, f"https://{host}/p/{i}?x=1", body(i)) for i in range(n)]


def test_templates(spark):
    site = pages("a.example.org", 40, lambda i: f"<div><span>Shared bar {'x' * 9}</span></div><div><p>Text of {i}</p></div>"
                 f"<article><p>Story {i % 3}</p><section><div>Read this too</div></section></article>")
    bare = pages("b.example.org", 40, lambda i: f"<div>Strip</div><div>Own words of page {i}</div>")
    copied = pages("d.example.org", 40, lambda i: "<article><h1>Head</h1><p><b>Told <i>again</i><br><p>Rest <a href=x>of</a> it</article>")
    small = pages("c.example.org", 2, lambda i: "<div>Said twice</div>")
    rows = [(i, url, html) for i, (_, url, html) in enumerate(site + bare + small + copied)] + [(900, None, None), (901, "nonsense", ""), (None, "", "<p>x")]
    rows += rows[:1]
    frame = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, HOST string").repartition(4)
    found = html_text.extract(frame).collect()
    assert len(found) == len(rows)
    got = {r.page_id: r.text for r in found}
    assert all(got[i] == f"Story {i % 3}" for i in range(40))  # recurs on the host, but is the article; the section goes
    assert all(got[40 + i] == f"Own words of page {i}" for i in range(40))
    assert {got[82 + i] for i in range(40)} == {"Head\nTold again\nRest of it"}
    assert got[80] == got[81] == "Said twice" and got[900] == got[901] == "" and got[None] == "x"


def test_empty(spark):
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_hot_host_counts_are_whole(spark):
    rows = pages("hot.example.org", 3000, lambda i: f"<div>Bar</div><p>{i}</p>") + pages("cold.example.org", 30, lambda i: f"<div>Other</div><p>{i}</p>")
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)
    assert {r.text.isdigit() for r in html_text.extract(frame).collect()} == {True}


def extracted(spark, rows):
    frame = spark.createDataFrame([(i, url, html) for i, (_, url, html) in enumerate(rows)], "page_id long, url string, html string")
    return [r.text for r in html_text.extract(frame.repartition(4)).orderBy("page_id").collect()]


@pytest.mark.parametrize(("html", "want"), [
    ("<body><h1>Head</h1><p>Told again</p></body>", "Head\nTold again"),
    ("<body><div><div>Bare</div><ul><li>a<li>b</ul></div></body>", "Bare\na\nb"),
    ("<article><div><div><p>Deep body</p></div></div></article>", "Deep body"),
    ("<article><h1>Head</h1><div>Bare text</div><table><tr><td>1<td>2</table></article>", "Head\nBare text\n1\n2"),
])
def test_copies_are_no_template(spark, html, want):
    bars = pages("a.example.org", 30, lambda i: f"<div>Bar</div><p>Page {i}</p>")
    copies = pages("a.example.org", 12, lambda i: f"<footer>{i}</footer><div>Bar</div>" * ("<article" not in html) + html)
    assert extracted(spark, bars + copies) == [f"Page {i}" for i in range(30)] + [want] * 12


def test_template_does_not_depend_on_the_size_of_the_host(spark):
    few = pages("a.example.org", 6, lambda i: f"<div>Section menu</div><p>Story {i}</p>")
    rest = pages("a.example.org", 900, lambda i: f"<p>Other {i}</p>")
    assert extracted(spark, few + rest) == [f"Story {i}" for i in range(6)] + [f"Other {i}" for i in range(900)]
