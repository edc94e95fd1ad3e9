"""Megabytes of marks, line feeds and open tags end in seconds and leave the JVM alive."""

import time

import pytest

from timeloom.llm import html_extract, license_scan, line_dedup, url_filters

MEGA = 1_000_000
LONG = {
    "line feeds": "\n" * MEGA, "numbers": "1." * MEGA, "marks": ";" * MEGA + "." * MEGA + "!", "blanks": " " * MEGA + "\t" * MEGA, "one line": "word " * (2 * MEGA), "bars": "| ~ # " * MEGA, "one word": "a" * MEGA,
    "blank lines": "\r\n \t\n" * (MEGA // 4), "leaders": "\n ;!;!" * (MEGA // 4),
}
TAGS = {
    "open tags": "<a " * 350_000, "open links": "<link " * 160_000, "a letter run": "<link " + "x" * MEGA, "quotes": '<a "' * 250_000, "link quotes": '<link "' * 140_000, "closing": "</div" * 200_000, "deep": "<div>" * 170_000 + "</div>" * 100,
    "meta": "<meta" + " a" * 500_000, "comments": "<!--" * 250_000, "scripts": "<script>" * 120_000, "equals": "<meta content" + " " * MEGA + ">", "apostrophes": "<base '" * 140_000,
}


def test_licenses(spark):
    word = "Licensed under the MIT License"
    rows = [(n, f"{a}{word}{b}") for n, (a, b) in enumerate([(t, "") for t in LONG.values()] + [(".\n", "\n" + t) for t in LONG.values()])]
    began = time.time()
    got = {r["doc_id"]: r["license"] for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).select("doc_id", "license").collect()}
    assert len(got) == len(rows) and got[len(LONG)] == "MIT" and time.time() - began < 120


def test_aliases(spark):
    head = '<link rel="canonical" href="/c">'
    rows = [(n, f"http://h.org/{n}", head + t) for n, t in enumerate(TAGS.values())] + [(99, "http://h.org/99", '<link rel="canonical" href="/no>' + "x" * MEGA + "</html>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    began = time.time()
    edges = {(r["src"], r["dst"]) for r in url_filters.alias_edges(pages).collect()}
    assert edges == {(f"h.org/{n}", "h.org/c") for n in range(len(TAGS))} and time.time() - began < 120


@pytest.mark.parametrize("kind", TAGS)
def test_pages(kind):
    began = time.time()
    page = html_extract.Page("<article><p>one two three</p></article>" + TAGS[kind])
    html_extract.Elements(page.kinds)
    assert time.time() - began < 20 and "one two three" in page.texts


def test_unclosed_script_is_hidden():
    page = html_extract.Page("<p>one</p><script>var a=1; <p>two</p>")
    assert [t for t in page.texts if t.strip()] == ["one"]
    page = html_extract.Page('<p>one</p><a href="x>two</a><p>three</p>')
    assert [t for t in page.texts if t.strip()] == ["one", "two", "three"]


def test_lines(spark):
    rows = [(n, t) for n, t in enumerate(LONG.values())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    began = time.time()
    assert line_dedup.drop_repeated_lines(df).count() == len(rows) and time.time() - began < 120
