"""HTML to text: odd pages by hand, many well-formed ones against the standard parser."""

import random
from html.parser import HTMLParser

import duckdb
import pytest

from marlstone.functions.html import BLOCKS, fields, html_fields
from marlstone.plans.catalog import QUERIES


@pytest.mark.parametrize("page, text", [
    ("", ""),
    ("plain  words\n here", "plain words here"),
    ("a<p>b<p>c<br>d", "a\nb\nc\nd"),
    ("<a title=\"1 > 0\">x</a>y", "xy"),
    ("<a title='1 > 0' alt=it's>x</a>y", "xy"),
    ("<i \"q>x</i>", "x"),
    ("1 < 2 and 3 <4", "1 < 2 and 3 <4"),
    ("&lt;b&gt; &amp;amp; &#65;&#x42;&copy &nosuch;", "<b> &amp; AB© &nosuch;"),
    ("a<!-- > <p> -->b<!-->c<!-- never closed <p>d", "abc"),
    ("<!DOCTYPE html><?php x ?>a</>b", "ab"),
    ("a<script>if (x < y) '</p>' </SCRIPT >b<style>p{}", "ab"),
    ("a<script>never closed", "a"),
    ("x<p title=\"never closed>y</p>", "x"),
    ("x<p", "x"),
    ("<textarea><b>&lt;</textarea>", "<b><"),
    ("a&nbsp;b", "a\xa0b"),
    ("<DIV>a<SPAN>b</SPAN></DIV>c", "ab\nc"),
])
def test_odd_pages(page, text):
    assert fields(page)["text"] == text


def test_title_and_links():
    out = fields("<title> A &amp; B\n<i> </title><a href=x>1</a><A>2</A><title>other</title><svg><abbr>")
    assert (out["title"], out["links"]) == ("A & B <i>", 2)
    assert fields("<p>none")["title"] is None
    assert fields(None) is None


class Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.mute = [], 0

    def handle_starttag(self, tag, attrs):
        self.mute += tag in ("script", "style")
        self.out.append("\n" if tag in BLOCKS else "")

    def handle_endtag(self, tag):
        self.mute -= tag in ("script", "style")
        self.out.append("\n" if tag in BLOCKS else "")

    def handle_data(self, data):
        if not self.mute:
            self.out.append(" ".join(data.replace("\n", " ").split(" ")))

    def text(self):
        lines = (" ".join(x.split(" ")).split() for x in "".join(self.out).split("\n"))
        return "\n".join(" ".join(x) for x in lines if x)


def _page(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 5)):
        kind = rng.random()
        if kind < 0.45 or depth > 4:
            out.append(rng.choice(["word", " two  words ", "&amp;", "&lt;p&gt;", "a\nb", "é ", "&#8364;", "<!-- c > c -->", "<br>", "<hr/>"]))
        elif kind < 0.55:
            out.append(rng.choice(["<script>var a = '<p>' + 1 < 2;</script>", "<style>p > a {}</style>"]))
        else:
            tag = rng.choice(["p", "div", "b", "span", "li", "td", "h2", "a", "em"])
            mark = rng.choice(["", ' class="a > b"', " id='x' hidden", ' href=/a/b?c=d', '\n title = "&quot;>"'])
            out.append(f"<{tag}{mark}>{_page(rng, depth + 1)}</{tag}>")
    return "".join(out)


def test_well_formed_pages_as_the_standard_parser_reads_them(spark):
    rng = random.Random(7)
    pages = [_page(rng) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(pages)), "i long, html string").repartition(4)
    got = {r["i"]: r["text"] for r in df.select("i", html_fields("html").alias("f")).select("i", "f.text").collect()}
    for i, page in enumerate(pages):
        plain = Plain()
        plain.feed(page)
        plain.close()
        assert got[i] == plain.text(), page


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "x"), ("", "x"), ("<p>a", "x"), ("<p>a", "x"), ("<b>w</b> " * 200_000, "x"), ("<" * 100_000 + "<!--" * 50_000, "x")], "html string, text string")
    out = [r["f"] for r in df.select("text", html_fields("html").alias("f")).collect()]
    assert out[0] is None and out[1]["text"] == "" and out[2] == out[3]
    assert out[4]["text"] == " ".join(["w"] * 200_000) and out[5]["text"] == "<" * 100_000
    assert df.limit(0).select(html_fields("html")).count() == 0


def test_twin_of_cut_entities(spark, tmp_path):
    pages = [(1, "<title>a &amp; b &lt</title><p>x&amp&amp;&quot y &ampamp; &amp;lt;<p>1 &lt2 &copy &middot</p><a href=x>z</a>"), (2, "<p>cut&am"), (3, "")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    twin = duckdb.connect()
    twin.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    query = QUERIES["html_blocks"]
    want = {r[0]: r[1:] for r in twin.sql(f"select page_id, title, text, blocks, links from ({query.oracle})").fetchall()}
    got = {r["page_id"]: (r["title"], r["text"], r["blocks"], r["links"]) for r in query(spark, str(tmp_path)).collect()}
    assert got == want and got[1][:2] == ("a & b <", 'a & b <\nx&&" y &amp; &lt;\n1 <2 © ·\nz')
