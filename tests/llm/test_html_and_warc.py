import gzip
import io
import random

import brute
import pytest

from corpusflow.llm import html_text, warc
from corpusflow.session import scratch_path

PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
<div class="cookie-notice">We use cookies</div><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav><div id="wrap">
<div class="content"><h2>Head &amp; line</h2><script>var x="</p>";</script><p>First <b>bold</b>&nbsp;text <a href=x>link</a> with more
words that make it long enough<br>to count<p>Short.<ul><li>item one<li>item two</ul><div class="share">Tweet</div><table><tr><td>a<td>b</table>
<blockquote>Quote &lt;3</blockquote></div><div class="sidebar">Side</div><section id="comments"><article class="comment"><p>a comment that
is rather long, longer than the article itself if need be, with many words in it</p></article></section></div><form><label>x</label></form>
<footer>f</footer>"""


def test_article_only():
    assert html_text.main_blocks(PAGE) == [
        "Head & line", "First bold text link with more words that make it long enough to count", "Short.", "item one", "item two", "a b", "Quote <3",
    ]
    assert html_text.main_blocks("<article><header><h1>T</h1></header><p>x</article><aside>y</aside>") == ["T", "x"]


@pytest.mark.parametrize("part,text", [
    ('<h2>Sources</h2><ul><li><a href="/1">First source</a></li><li><a href="/2">Second source</a></li></ul>', ["Sources", "First source", "Second source"]),
    ("<p>It holds that <math><mi>x</mi><mo>=</mo><mn>1</mn></math> here.</p>", ["It holds that x=1 here."]),
    ('<p class="search-tips">How to search.</p><h2 id="related-work">Related work</h2>', ["How to search.", "Related work"]),
    ('<div class="share">Tweet</div><p class="ad">Buy</p><ul class="social-menu"><li>x</li></ul>', []),
    ("<p><a href=x><b><i><u><em><span>deep link</span></em></u></i></b></a></p>", ["deep link"]),
])
def test_parts_of_an_article(part, text):
    long = "A paragraph of the article that is long enough to be its main part, with many words."
    assert html_text.main_blocks(f"<nav>n</nav><article><p>{long}</p>{part}<p>{long}</p></article><footer>f</footer>") == [long, *text, long]


def test_deep_links_are_link_text():
    menu = "".join(f"<li><b><i><u><em><a href={i}><span><b><i><u><em>entry {i}</em></u></i></b></span></a></em></u></i></b></li>" for i in range(9))
    long = "<p>" + "A paragraph with many words and no link at all. " * 5 + "</p>"
    blocks = html_text.main_blocks(f"<body><ul>{menu}</ul>{long * 3}</body>")
    assert len(blocks) == 3 and not any("entry" in b for b in blocks)


def test_ratios_choose_the_region(monkeypatch):
    """Two containers without names: the one whose lines have much text per tag is the article."""
    import numpy as np

    teasers = "<div>" + "".join(f"<div><b><i><u><span>teaser {i}</span></u></i></b></div>" for i in range(12)) + "</div>"
    article = "<div>" + "".join(f"<p>Paragraph {i} of an article, with a good many words in one line of text. And more.</p>" for i in range(4)) + "</div>"
    blocks = html_text.main_blocks(f"<body>{teasers}{article}{teasers}</body>")
    assert len(blocks) == 4 and all(b.startswith("Paragraph") for b in blocks)
    monkeypatch.setattr(html_text, "smoothed", lambda ratios: np.ones(len(ratios)))
    assert len(html_text.main_blocks(f"<body>{teasers}{article}{teasers}</body>")) == 28


def test_empty_table_of_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extracted(pages).count() == 0


@pytest.mark.parametrize("html,blocks", [("", []), ("plain", ["plain"]), ("<p>a<p>b < c & d</x>", ["a", "b < c & d"]), ("<script>x", []), ("<div>" * 3000 + "deep", ["deep"]), ("<", ["<"])])
def test_odd_markup(html, blocks):
    assert html_text.main_blocks(html) == blocks


def test_pages_of_all_kinds(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "m"), (2, None, None, "m"), (2, None, None, "m"), (3, "u", "<p>" + brute.LONG, "m")], "page_id long, url string, html string, main_text string")
    rows = html_text.extracted(pages)
    assert rows.columns.count("main_text") == 1 and rows.count() == 4
    assert {r["c0"]: len(r["main_text"]) for r in rows.collect()}[3] == len(brute.LONG)


def test_smoothing_keeps_the_mean_of_flat_ratios():
    import numpy as np

    assert html_text.smoothed(np.full(9, 4.0)) == pytest.approx(np.full(9, 4.0))


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8, 13])
def test_loser_tree_merges(k):
    rng = random.Random(k)
    runs = [sorted((rng.randrange(20),) for _ in range(rng.randrange(9))) for _ in range(k)]
    out = list(warc.LoserTree(runs))
    assert [runs[r][i] for r, i in out] == sorted(x for r in runs for x in r) and len(set(out)) == len(out)


def test_archives_come_back(spark):
    tricky = "a\r\n\r\nWARC/1.1\r\n" * 200
    rows = [
        (1, "http://A.com/x\ny", tricky, 5), (2, None, None, None), (3, "http://www.a.com:80/x#f", tricky, 6), (None, "u", "é" * 600, 7),
        (4, "u", "é" * 600, 7), (4, "u", "é" * 600, 7), (5, "u", "small", 9), (6, "u", "small", 9),
    ]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, captured long, position string")
    path = scratch_path(spark, "warc-test")
    warc.write_archives(pages.drop("position"), path, records_per_file=2)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).collect()
    found = [r for f in files for r in warc.records(io.BytesIO(gzip.decompress(bytes(f["content"]))))]
    assert len(found) == len(rows) and sum(h["warc-type"] == "revisit" for h, _ in found) == 2
    history = warc.merged_runs(warc.read_runs(spark, path), rows_per_task=2).orderBy("position").collect()
    assert [r["position"] for r in history] == list(range(len(rows)))
    keys = [(r["url_key"], r["captured"], r["page_id"] is not None, r["page_id"] or 0) for r in history]
    assert keys == sorted(keys)
    by_id = {r["page_id"]: r for r in history}
    assert (by_id[1]["record_type"], by_id[1]["refers_to"], by_id[1]["payload_bytes"]) == ("revisit", 3, len(tricky))
    assert (by_id[None]["record_type"], by_id[None]["refers_to"], by_id[None]["payload_bytes"]) == ("revisit", 4, 1200)
    assert by_id[2]["payload_bytes"] == 0 and by_id[5]["record_type"] == by_id[6]["record_type"] == "response"
    assert warc.capture_history(pages.limit(0)).count() == 0


def test_headline_and_closing_beside_the_body_stay():
    body = ["a paragraph of the body that goes on for quite a while, with enough words to count as text"] * 12
    for closing in ("The end.", "a closing paragraph that is dense enough to count as a line of content itself"):
        page = f"<body><div>Skip this</div><div id=content><h1>Head</h1><div class=body>{''.join(f'<p>{x}</p>' for x in body)}</div><p>{closing}</p></div>"
        assert html_text.main_blocks(page) == ["Head", *body, closing]
