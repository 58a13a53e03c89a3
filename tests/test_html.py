"""The HTML scanner against a walk over single characters."""

import random
import re

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import html

WHITE = " \t\n\f\r"
SKIPPED = {"script", "style", "svg", "title"}
BLOCKS = (
    "p figcaption h1 h2 h3 h4 h5 h6 div section article main figure header footer details center summary blockquote "
    "ul ol li table tr td th"
).split()


def tag_at(page, at):
    """(end, closing, name, attributes) of the tag that starts here, or None."""
    j = at + 1
    closing = page[j : j + 1] == "/"
    j += closing
    start = j
    while j < len(page) and page[j].isascii() and page[j].isalnum():
        j += 1
    if j == start:
        return None
    name, found = page[start:j].lower(), []
    while True:
        while j < len(page) and page[j] in WHITE + "/":
            j += 1
        if j >= len(page):
            return None
        if page[j] == ">":
            return j + 1, closing, name, found
        if page[j] == "=":
            j += 1
            continue
        key = ""
        while j < len(page) and page[j] not in WHITE + "=>/":
            key, j = key + page[j], j + 1
        k = j
        while k < len(page) and page[k] in WHITE:
            k += 1
        value = ""
        if page[k : k + 1] == "=":
            j = k + 1
            while j < len(page) and page[j] in WHITE:
                j += 1
            if page[j : j + 1] and page[j] in "\"'":
                close = page.find(page[j], j + 1)
                if close < 0:
                    return None
                value, j = page[j + 1 : close], close + 1
            else:
                while j < len(page) and page[j] not in WHITE + ">":
                    value, j = value + page[j], j + 1
        found.append((key.lower(), value))


def scan(page):
    """Tags and runs of text in page order; what is not shown is left out."""
    at, out = 0, []
    while at < len(page):
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = len(page) if end < 0 else end + 3
        elif page.startswith("<!", at):
            end = page.find(">", at)
            at = len(page) if end < 0 else end + 1
        elif page[at] == "<" and (tag := tag_at(page, at)):
            at, closing, name, found = tag
            if name in SKIPPED and not closing:
                end = page.lower().find("</" + name, at)
                end = page.find(">", end) if end >= 0 else -1
                at = len(page) if end < 0 else end + 1
            else:
                out.append((closing, name, found))
        else:
            end = at + 1
            while end < len(page) and page[end] != "<":
                end += 1
            out.append(page[at:end])
            at = end
    return out


def squeezed(text):
    return re.sub("[ \t\r\n]+", " ", text)


def brute(page):
    text, headings, links, images = "", [], [], []
    heading = link = None
    for part in scan(page):
        if isinstance(part, str):
            text += squeezed(part)
            for open_ in (heading, link):
                if open_:
                    open_[1] += part
            continue
        closing, name, found = part
        found = dict(reversed(found))
        if name in BLOCKS or name in ("br", "hr") and not closing:
            text += "\n"
        if name in BLOCKS or name == "hr":
            heading = None
        if re.fullmatch("h[1-6]", name) and not closing:
            heading = [int(name[1]), ""]
            headings.append(heading)
        if name == "a":
            link = None
            if not closing and "href" in found:
                link = [found["href"], ""]
                links.append(link)
        if name == "img" and not closing and found.get("src"):
            images.append(found["src"])
    text = re.sub(" *\n[ \n]*", "\n", text)
    one = lambda rows: [(a, squeezed(b).strip(" ")) for a, b in rows]
    return text.strip(" \n"), one(headings), one(links), images


PARTS = [
    "<p>", "</p>", "<a href='u'>", "<a href=v title=\"x>y\">", '<a title="<a href=w>" href=z>', "</a>", "<h2 id='>'>", "</h2>", "<b", ">", "<br/>",
    "<!--", "-->", "<!x", "<script>", "</script>", "<style a='</style>'>", "</STYLE >", "<svg", "</svg>", "<title>", "</title", "a", " b ", "\n", '"', "'",
    "=", "/", "<", "< ", "<img src=", "i.png>", "<img alt='s' src='q'>", "<div class=\"a", "<hr>", "<1>", "</", "x=y", " href = 'k' ", "<thead>", "<td>",
]


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(11)
    out = ["".join(rng.choices(PARTS, k=rng.randint(0, 25))) for _ in range(3000)]
    return out + [
        "<p>a</p><script>if(a<!--b){}</script><p>VISIBLE</p>", "<a title='x>y' href='u'>link</a>", "<<!-- -->b>c", "<b title=\"never<br>x",
        "<a href=1>one<a href=2>two", "<h1>t<p>u</p></h1>", "<a data-href=1 x>t</a>", "<p " + "x='>' " * 20_000 + ">end", "<" * 50_000, "",
    ]


def test_scanner_equals_the_walk(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "i int, page string")
    seen = df.select("i", "page", html.drop_invisible(F.col("page")).alias("v"))
    rows = seen.select(
        "i", html.html_text(F.col("page")).alias("text"), html.headings(F.col("v")).alias("headings"),
        html.links(F.col("v")).alias("links"), html.images(F.col("v")).alias("images"), html.link_count(F.col("v")).alias("n"),
    )
    for r in rows.collect():
        got = r.text, [tuple(h) for h in r.headings], [tuple(a) for a in r.links], [m.src for m in r.images]
        assert got == brute(pages[r.i]), pages[r.i][:500]
        assert r.n == len(r.links), pages[r.i][:500]


def test_cells_need_no_close_tag(evaluate):
    page = "<table><tr><th>k<td title='>'>v<tr><td>a <b>b</b></td></tr></table><td>outside"
    rows = evaluate(lambda v: html.table_cells(html.drop_invisible(v)), [page])[0]
    assert [tuple(r) for r in rows] == [(0, 0, True, "k"), (0, 1, False, "v"), (1, 0, False, "a b")]
