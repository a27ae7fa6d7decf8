from __future__ import annotations

import hashlib
import re
from html.parser import HTMLParser
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pytest
from pyspark.sql import functions as F

from siftline.functions import text, urls

PAGES = [
    "<p>a &eacute; b &#39; &#x27; &amp;lt; &notit; &copy 2 &bogus; x</p>",
    "<a title='x>y'>t</a><br/>u<br>v",
    "a < b <b>c</b>",
    "<p>&#128; &#0; &#55296; &#x1F600; &#1;z &#99999999999999;</p>",
    "<HEAD><title>x</title></HEAD>body<STYLE>p{}</STYLE> <!-- c --> d<!doctype html><?xml y?>e",
    "<div>\n\n\n x \xa0</div>",
    "no tags &amp; here \n \n\n x ",
    "<script src='a' />after",
    "<script>var a = '<p>';</script>kept<script>x</SCRIPT >end",
    "<pre>x</pre><pizza>y</pizza><li>1</li><li>2</li>",
    "<table><tr><td>1</td></tr></table><h3>t</h3><blockquote>q</blockquote>",
    "",
]


class _Reference(HTMLParser):
    """The same conversion with the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in text.HIDDEN_TAGS:
            self.hidden += 1
        elif tag in text.BLOCK_TAGS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in text.HIDDEN_TAGS:
            self.hidden = max(0, self.hidden - 1)
        elif tag in text.BLOCK_TAGS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def _expected(value: str) -> str:
    if "<" not in value:
        return re.sub(r"\n\s*\n\s*", "\n\n", value.strip())
    parser = _Reference()
    parser.feed(value)
    parser.close()
    joined = re.sub(r"[ \t\r\f\v]+", " ", "".join(parser.out))
    return re.sub(r"\n\s*\n\s*", "\n\n", joined).strip()


def test_html_to_text_like_the_standard_library(apply):
    assert apply(PAGES, text.html_to_text) == [_expected(p) for p in PAGES]


def test_given_pages_like_the_standard_library(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html", text.html_to_text(F.col("html")).alias("t"))
    assert all(r["t"] == _expected(r["html"]) for r in rows.collect())


def test_long_attribute_does_not_exhaust_the_stack(apply):
    page = '<a title="' + "x>" * 50_000 + '" ' + "data-a=b " * 20_000 + ">t</a>"
    assert apply([page], text.html_to_text) == ["t"]


def test_whitespace(apply):
    assert apply([" \xa0a \t\n b\x1c "], text.collapse_whitespace) == ["a b"]
    assert apply([" a b\x85"], text.strip) == ["a b"]
    assert apply(["a\n \t\n\n  b"], text.collapse_blank_lines) == ["a\n\nb"]
    assert apply(["\n \r\n  first \nsecond", " "], text.first_line) == ["first", None]


URLS = [
    "HTTPS://User:Pw@Jobs.Example.com:80/A/B//?b=2&a=1&UTM_Source=x&c=&d#frag",
    "https://x.com/?q=a+b%20c~*%zz&z=%C3%A9",
    "https://x.com?a=b=c&a=a",
    "  https://x.com/p?x=1&&y=2  ",
    "https://jobs.example.com/jobs?gh_jid=42&utm_source=x",
    "mailto:a@b",
    "not a url",
    "https://x.com/a?=v",
]


def test_canonical_url_like_the_standard_library(apply):
    def expected(url):
        parts = urlsplit(url.strip())
        kept = sorted((k, v) for k, v in parse_qsl(parts.query) if k.lower() not in urls.TRACKING_PARAMS)
        return urlunsplit((parts.scheme.lower(), parts.netloc.lower(), parts.path.rstrip("/") or "/", urlencode(kept), ""))

    assert apply(URLS, urls.canonical_url) == [expected(u) for u in URLS]


def test_unbalanced_host_gives_null(apply):
    assert apply(["https://[::1/x"], urls.canonical_url) == [None]


def test_canonical_url_is_idempotent(apply):
    once = apply(URLS, urls.canonical_url)
    assert apply(once, urls.canonical_url) == once


def test_listing_id_golden(apply):
    variants = [
        "https://jobs.example.com/roles/123",
        "https://JOBS.example.com/roles/123/",
        "https://jobs.example.com/roles/123?utm_campaign=a#b",
    ]
    assert apply(variants, lambda c: urls.listing_id(urls.canonical_url(c))) == ["fd884619d708448f"] * 3


def test_content_hash_ignores_case_and_spacing(spark):

    rows = spark.createDataFrame([("A  Job", None, "x\ny"), ("a job", None, "X y")], "t string, c string, d string")
    got = [r[0] for r in rows.select(text.content_hash(F.col("t"), F.col("c"), F.col("d"))).collect()]
    assert got == [hashlib.sha256(b"a job  x y").hexdigest()[:16]] * 2


@pytest.mark.parametrize("tags, expected", [([" Python", "python", "", "SQL "], ["python", "sql"]), ([], [])])
def test_tags(spark, tags, expected):

    row = spark.createDataFrame([(tags,)], "t array<string>").select(text.normalise_tags(F.col("t")).alias("t")).first()
    assert row["t"] == expected
