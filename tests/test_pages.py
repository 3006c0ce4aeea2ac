"""Nested listing containers against a stack of open elements."""

from html.parser import HTMLParser

from pyspark.sql import functions as F

from deltion.sources import pages


class Containers(HTMLParser):
    """Places of the outermost containers, by the standard parser."""

    def __init__(self, html):
        super().__init__()
        self.stack, self.spans, self.start = [], [], 0
        self.lines = [0]
        for line in html.split("\n"):
            self.lines.append(self.lines[-1] + len(line) + 1)
        self.feed(html)

    def place(self):
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag, attrs):
        classes = dict(attrs).get("class") or ""
        if (tag in pages.CONTAINER_TAGS or any(h in classes for h in pages.CONTAINER_HINTS)) and tag not in pages.VOID_TAGS:
            if not self.stack:
                self.start = self.place()
            self.stack.append(tag)

    def handle_endtag(self, tag):
        if self.stack and self.stack[-1] == tag:
            self.stack.pop()
            if not self.stack:
                self.spans.append((self.start, self.place() + len(tag) + 3))


HTML = [
    "<ul><li>a</li><li><a href='/x'>b</a><ul><li>c</li></ul></li></ul>",
    '<article class="post"><div class="blog-entry"><a href="/n/1">One</a></div><p>t</p></article><div class="views-row">\n<article>deep</article>\n</div><div>out</div>',
    "<li>never closed <article>x</article>", "", "no tags & none <", "<!-- <li>in a comment</li> --><li>real</li>",
    "<li><script>var t = '</li><li>';</script><a href=\"f.pdf\">file</a></li>", "<LI CLASS='Post'>upper</LI><img class=post><li>after</li>",
    '<div class="post"><div>plain</div><a href="/late">late</a></div>', "<article><li></article></li></article>",
]


def test_spans_equal_those_of_a_parser(spark):
    df = spark.createDataFrame(list(enumerate(HTML)), "d int, html string")
    got = {r.d: [(s.first - 1, s.last) for s in r.s] for r in df.select("d", pages.container_spans(F.col("html")).alias("s")).collect()}
    for d, html in enumerate(HTML):
        assert got[d] == [(a, z) for a, z in Containers(html).spans], (html, got[d])


def test_items_of_nested_containers(spark):
    html = '<nav><a href="/x">menu</a></nav><article class="post"><time datetime="2024-01-02"></time><div class="blog"><a href="/n/1">Notice &amp; <b>one</b></a></div><a href="f.pdf">file</a><!-- <a href="/no">no</a> --></article><li>text only</li>'
    df = spark.createDataFrame([(1, "https://x.gr/a/b", html), (2, "https://x.gr/", None)], "d int, url string, html string")
    (item,) = pages.extract_html_listing(df, "html", "url", ["d"]).collect()
    assert (item.title, item.detail_url, item.attachment_urls, item.published_at, item.row_text) == ("Notice & one", "https://x.gr/n/1", ["https://x.gr/a/f.pdf"], "2024-01-02", "Notice & one file")
