"""The extractor on pages written by hand, and on hostile markup."""

import time

import pytest
from pyspark.sql import functions as F

from lacuna.llm import page_crf
from lacuna.llm.page_blocks import blocks

HAND_WRITTEN = [
    (
        """<!doctype html><html lang="en"><head><title>Bees | The Garden Post</title><link rel=stylesheet href=a.css></head><body>
<header class="top"><a href="/">The Garden Post</a></header><nav><ul><li><a href="/news">News</a></li><li><a href="/tips">Tips</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies to improve your visit.</p><button>Accept</button></div>
<main><article><h1>Why bees visit lavender</h1><p>Bees find lavender by scent and by colour, and they come back every morning while it flowers.</p>
<div class="advert"><p>Buy two pots, get one free!</p></div><p>Gardeners who plant it near beans report better harvests.</p><ul><li>Plant in full sun.</li><li>Water once a week.</li></ul></article></main>
<section class="comments"><h3>Comments</h3><p>Great article, thanks!</p></section><aside class="sidebar"><p>Most read this week</p></aside>
<form><label>Newsletter</label><input type=email><button>Subscribe</button></form><footer>&copy; 2023 The Garden Post</footer></body></html>""",
        [
            "Why bees visit lavender",
            "Bees find lavender by scent and by colour, and they come back every morning while it flowers.",
            "Gardeners who plant it near beans report better harvests.",
            "Plant in full sun.",
            "Water once a week.",
        ],
    ),
    (
        """<html><body><div id="masthead"><h2>Ferrovia oggi</h2></div><div class="menu"><a href=1>Orari</a> <a href=2>Linee</a></div><div class="content"><h1>La nuova linea</h1>
<p>Il treno parte alle sette e arriva prima di mezzogiorno, dopo sei fermate lungo la costa.<p>I biglietti si comprano in stazione&nbsp;o sul treno.</div><div class="related links"><ul><li><a href=3>Altre notizie</a></ul></div><div id="footer"><p>&copy; Ferrovia oggi</p></div>""",
        ["La nuova linea", "Il treno parte alle sette e arriva prima di mezzogiorno, dopo sei fermate lungo la costa.", "I biglietti si comprano in stazione o sul treno."],
    ),
]


@pytest.mark.parametrize("page, lines", HAND_WRITTEN)
def test_hand_written_pages(page, lines):
    assert page_crf.main_text(page, page_crf.trained()).split("\n") == lines


def test_attributes_and_scripts():
    assert [b.text for b in blocks("<p>a</p><p title=don't>kept isn't it</p><p title='a > b' class=\"x > y\">c</p>")] == ["a", "kept isn't it", "c"]
    assert [b.text for b in blocks("<script/>var x=1;</script><p>b</p>")] == ["b"]
    assert [b.text for b in blocks("<p>1 < 2 and 3 > 2 &#0000000065; &#99999999999; </ x <! y")] == ["1 < 2 and 3 > 2 A � </ x <! y"]


HOSTILE = {
    "open tags": "<a" * 100_000,
    "angle brackets": "<" * 1_000_000,
    "declarations": "<!" * 300_000,
    "quotes": "<a ='>' " * 50_000,
    "script ends": "<script>x" + "</script" * 100_000,
    "depth": "<form>" * 50_000 + "<option></option>" * 20_000,
    "long number": "&#" + "9" * 100_000 + ";",
    "spaces": "<p class" + " " * 300_000 + ">",
}


def test_hostile_pages_take_linear_time(spark):
    rows = [(k, name, html) for k, (name, html) in enumerate(HOSTILE.items())]
    begin = time.time()
    out = page_crf.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).withColumn("n", F.length("text")).collect()
    assert [r.page_id for r in out] == list(range(len(rows))) and all(r.n == r.n_chars for r in out)
    assert time.time() - begin < 60
