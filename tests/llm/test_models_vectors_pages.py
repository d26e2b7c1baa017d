"""Quality model, exact search, archives, page text and the pipeline."""

import html
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from readsift.llm import html_text, quality, queries, va_file, warc
from readsift.session import stage


def held_out(doc):
    return zlib.crc32(str(doc).encode()) % 5 == 0


def test_quality_on_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op6_pu_quality"](spark, sf_dir).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    kept = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in kept) >= 0.93 * len(kept)


def test_no_label_of_the_held_out_fold_is_read(spark):
    docs = spark.createDataFrame([(i, "good text here. " * (i % 7 + 1) if i % 3 else "### $$$ ### !!") for i in range(200)], "doc_id bigint, text string")
    made = [(i, int(i % 3 > 0)) for i in range(200)]
    turned = [(i, 1 - q if held_out(i) else q) for i, q in made]
    a, b = (quality.train(docs, spark.createDataFrame(rows, "doc_id bigint, quality int")) for rows in (made, turned))
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.cuts, b.cuts)


def test_quality_of_hard_rows(spark):
    rows = [(1, None, 7.0), (1, None, 7.0), (None, "", 7.0), (3, "x" * 200_000, 7.0), (4, "one two", 7.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(3, 1), (4, 1), (4, 0), (None, 1), (1, None)], "doc_id bigint, quality int")
    model = quality.train(docs, labels)
    for m in (model, None):
        found = quality.score(docs, m).collect()
        assert Counter((r.doc_id, r.text) for r in found) == Counter((a, b) for a, b, _ in rows)
        assert all(0 <= r.score <= 1 for r in found)
    assert quality.train(docs.limit(0), labels) is None and quality.train(docs, labels.limit(0)) is None
    assert quality.score(docs.limit(0), None).count() == 0


def test_search_with_ties_bad_vectors_and_few_rows(spark):
    rows = [(0, [0.5, 0.5]), (50, [0.5, 0.5]), (3, [0.5, 0.5]), (4, [0.5, 0.5]), (5, [-1.0, 0.25]), (6, None), (7, [1.0, None]), (8, [float("nan"), 1.0]),
            (9, [float("inf"), 1.0]), (10, []), (None, [1.0, 1.0]), (11, [1.0, 2.0, 3.0]), (100, [1.0, 1.0, 1.0]), (5, [-1.0, 0.25]), (0, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    found = va_file.top_k(df.where("vec_id % 50 = 0"), df, k=3, block_rows=2).collect()
    by = {q: [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 50, 100)}
    assert by[0] == [(3, 32768), (4, 32768), (50, 32768)]
    assert by[50] == [(0, 32768), (0, 32768), (3, 32768)]
    assert by[100] == [(11, 256 * 256 * 6)]
    assert va_file.top_k(df.limit(0), df, 3).count() == 0 and va_file.top_k(df.where("vec_id = 0"), df.limit(0), 3).count() == 0


def test_copies_of_the_queries_are_not_broadcast(spark, monkeypatch):
    rows = [(i, [float((i * 7 + j) % 11) for j in range(4)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    plans, whole = [], va_file.stage
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(va_file, "stage", lambda d, name: plans.append(plan(d)) or whole(d, name))
    found = va_file.top_k(df.where("vec_id % 50 = 0"), df, k=5, block_rows=16)
    copied = [p for p in (*plans, plan(found)) if "explode" in p]
    assert len(copied) == 2 and found.count() == 20
    assert all("SortMergeJoin [dim" in p and "BroadcastHashJoin [dim" not in p for p in copied)


def test_search_over_many_blocks(spark):
    pick = np.random.default_rng(4)
    vectors = pick.normal(0, 0.3, (300, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>")
    whole = np.floor(256 * vectors.astype(np.float64)).astype(np.int64)
    scores = whole @ whole.T
    found = va_file.top_k(df.where("vec_id % 50 = 0"), df, k=5, block_rows=16).collect()
    for q in range(0, 300, 50):
        order = [i for i in np.lexsort((np.arange(300), -scores[q])) if i != q][:5]
        assert [r.vec_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] == order


QUOTED = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.0\r\n"


@pytest.fixture
def tiny_splits(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def test_archives_read_in_splits_with_magic_in_payloads(spark, tiny_splits):
    rows = [(1, "u", "hello"), (2, "u", None), (3, None, ""), (4, "x\r\ny", "hello"), (5, "y", QUOTED), (6, "q", "é" * 900 + QUOTED * 3), (7, "w", "WARC/1.0\r\n"),
            (8, "w", "tail\r\n\r\n"), (None, "n", "hello"), (1, "u", "hello"), (9, "z", "\r\n\r\nWARC/1.0\r\n"), (10, "z", "a\n b\x00c" * 400)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    found = warc.pages(warc.read(spark, warc.archive(pages))).collect()
    expected = Counter()
    for page, _, text in rows:
        raw = (text or "").encode()
        first = min(p for p, _, t in rows if p is not None and (t or "") == (text or ""))
        again = page != first
        expected[str(page) if page else None, "revisit" if again else "response", str(first) if again else None, len(raw), warc.digest(raw), None if again else raw] += 1
    assert Counter(
        (r.id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, bytes(r.payload) if r.payload is not None else None) for r in found
    ) == expected
    assert warc.pages(warc.read(spark, warc.archive(pages.limit(0)))).count() == 0


def test_short_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id bigint, url string, html string")
    kinds = {r.id: r.record_type for r in warc.describe(pages, at_least=3).collect()}
    assert kinds == {"1": "response", "2": "response", "3": "response", "4": "revisit"}


PAGE = (
    '<html><head><title>t</title><script>var a="</p>";</script></head><body class="has sidebar"><header>Top</header><nav><li>Menu</li></nav>'
    '<div class="cookie-notice">Cookies</div><main><article><h1>Title &amp; more</h1><p>One <b>two<p>three&nbsp;four<br>five'
    '<div class="ad-slot">Buy</div><ul><li>six<li>seven</ul><form>Send</form><aside>Side</aside><p>&lt;eight&gt; &am</article><div id="comments">Nice!</div></main>'
    "<footer>Foot</footer></body>"
)


def test_text_of_a_broken_page():
    blocks = ["Title & more", "One two", "three four five", "six", "seven", "<eight> &am"]
    assert html_text.main_text(PAGE, set()) == "\n\n".join(blocks)
    assert html_text.main_text("", set()) == "" == html_text.main_text("<nav>only</nav>", set())
    assert html_text.main_text("no  markup\nat all", set()) == "no markup at all"
    assert html_text.main_text("<div>a</div><div class='sidebar'>b</div>c", set()) == "a\n\nc"


@pytest.mark.parametrize("around", [
    '<div class="layout has-sidebar">', '<div id="content-with-menu">', '<div class="site header-fixed">', '<section class="social-science">',
    '<form id="aspnet">', '<div class="sidebar">',
])
def test_what_holds_the_article_is_no_boilerplate(around):
    assert html_text.main_text(f"<html><body>{around}<nav>n</nav><article><p>Own text</article></body></html>", set()) == "Own text"


def test_names_that_contain_a_mark_stay_inside_the_article():
    own = '<div class="related-work">a</div><p class="notice">b</p><ul class="menu"><li>c</ul><section id="social_science">d</section>'
    gone = '<div class="ad-slot">x</div><div class="related">x</div><div class="share-buttons">x</div><div id="cookie_notice">x</div>'
    teaser = "<aside><article>x</article></aside>"
    assert html_text.main_text(f"<body>{teaser}<article>{own}{gone}</article>{teaser}</body>", set()) == "a\n\nb\n\nc\n\nd"


def test_templates_nest_classes(spark):
    rows = [(i, "http://a.org/x", f"<html><body><ul>{'<li>x</li>' * i}</ul><article><p>{i}</p></article></body></html>") for i in range(1, 5)]
    rows += [(9, "http://b.org/", "<html><body><p>z</p></body></html>"), (10, None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = html_text.templates(stage(html_text.sited(html_text.tokens(pages)))).where("site = 'a.org'").collect()
    frame, items = sorted(found, key=lambda r: -len(r.tokens))
    assert frame.n_low == frame.n_high == 1 and "html>body>article" in frame.tokens and frame.parent is None
    assert items.tokens == ["html>body>ul>li"] and (items.n_low, items.n_high) == (1, 4) and items.parent == frame["class"]


def _site(spark, bodies, host="http://n.org"):
    rows = [(i, f"{host}/{i}", f"<html><body>{body}</body></html>") for i, body in enumerate(bodies)]
    return {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}


def test_template_decides_where_the_markup_says_nothing(spark):
    menu = '<div class="c1"><ul><li>Home</li><li>Products</li></ul></div>'
    story = '<div class="c2"><p>Story {0} begins.</p><h2>Background</h2><p>More of {0}.</p></div>'
    foot = '<div class="c3"><p>All rights reserved.</p></div>'
    found = _site(spark, [menu + story.format(i) + foot for i in range(8)])
    assert found == {i: f"Story {i} begins.\n\nBackground\n\nMore of {i}." for i in range(8)}
    # The open page's item of the menu is marked, equal pages count once, and markup may be flat.
    active = [menu.replace("<li>Home", '<li class="on">Home') if i == 3 else menu for i in range(8)]
    found = _site(spark, [m + story.format(i) + foot for i, m in enumerate(active)] + [menu + story.format(0) + foot] * 20)
    assert found[3].startswith("Story 3") and found[27] == found[0] and found[0].startswith("Story 0")
    found = _site(spark, [f"<p>Home<p>About<p>Text {i}<p>Contents<p>End {i}<p>All rights reserved" for i in range(4)])
    assert found == {i: f"Text {i}\n\nContents\n\nEnd {i}" for i in range(4)}


def test_template_is_not_guessed(spark):
    # Two pages are too few, and of pages that are copies of each other nothing is dropped.
    two = _site(spark, ["<div><p>Same</p></div><div><p>Own a</p></div>", "<div><p>Same</p></div><div><p>Own b</p></div>"])
    assert two == {0: "Same\n\nOwn a", 1: "Same\n\nOwn b"}
    copies = _site(spark, [f"<div data-n={i}><p>One text</p><p>of all pages</p></div>" for i in range(5)])
    assert set(copies.values()) == {"One text\n\nof all pages"}
    # What an article element holds stays, however many pages have it.
    shared = _site(spark, [f"<article><h1>Report</h1><p>Own {i}</p><p>Sources: none</p></article>" for i in range(5)])
    assert shared == {i: f"Report\n\nOwn {i}\n\nSources: none" for i in range(5)}


def test_articles_of_readers_are_not_the_story(spark):
    story = '<div class="c2"><p>The story {0}.</p></div>'
    marked = "".join(f'<article class="comment">Reader {i}</article>' for i in range(3))
    assert html_text.main_text(f"<body>{story.format(1)}{marked}</body>", set()) == "The story 1."
    held = '<div id="comments"><article>Reader</article><article>Reader too</article></div>'
    assert html_text.main_text(f"<body>{story.format(1)}{held}</body>", set()) == "The story 1."
    # Without such names the site tells: some pages have several of these articles, so on none are they the story.
    found = _site(spark, [story.format(i) + "".join(f"<section><article>Voice {i} {j}</article></section>" for j in range(i)) for i in range(5)])
    assert all(text.startswith(f"The story {i}.") for i, text in found.items())


def test_formulas_and_sections_of_the_article_stay():
    body = '<article><p>Let <math><mi>x</mi></math> be.</p><section id="search">How to search</section></article>'
    assert html_text.main_text(f"<body>{body}</body>", set()).split() == "Let x be. How to search".split()


def test_page_rows_are_kept(spark):
    rows = [(1, "http://a.org/", PAGE, "k"), (1, "http://a.org/", PAGE, "k"), (2, None, None, "k"), (None, "", "", "k"), (3, "http://b.org", "<p>x" * 3000, "k")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    found = html_text.extract(pages)
    assert sorted(found.columns) == sorted(pages.columns)
    texts = Counter((r.page_id, r.text) for r in found.collect())
    assert texts == Counter((a, html_text.main_text(c or "", set())) for a, _, c, _ in rows)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_page_query_against_the_article_element(spark, small_dir):
    found = {r.page_id: r for r in queries.QUERIES["op10_template_text"](spark, small_dir).collect()}
    pages = spark.read.parquet(f"{small_dir}/pages.parquet").collect()
    assert len(found) == len(pages)
    for p in pages:
        inner = re.sub(r"</?b>|<br>", " ", re.search(r"<article>(.*?)</article>", p.html, re.S)[1]).replace("  ", " ")
        blocks = (" ".join(html.unescape(b).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        assert found[p.page_id].text == "\n\n".join(b for b in blocks if b)
        assert found[p.page_id].n_chars == len(found[p.page_id].text) and found[p.page_id].url == p.url


def test_pipeline_stages_take_effect(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, small_dir))
        if name != "best-fit packing":
            assert docs.columns == columns
            after = {r.doc_id: r.text for r in docs.collect()}
            assert set(after) <= set(before)
            if name != "substring dedup":
                assert all(after[k] == before[k] for k in after)
            before = after
    sizes = Counter()
    for r in docs.collect():
        sizes[r.sequence_id] += r.length
    assert max(sizes.values()) <= 1024 and {r.doc_id for r in docs.collect()} == set(before)


def test_pipeline_of_hard_rows(spark, small_dir):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "short", None, "s", None), (3, "word " * 30_000, "en", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("_row", F.lit(1)).withColumn("score", F.lit("x"))
    for some in (docs, docs.limit(0)):
        for name, function in corpus_pipeline.STAGES:
            found = function(spark, some, small_dir)
            assert name == "best-fit packing" or found.columns == docs.columns
            assert found.count() <= (some.count() if name != "best-fit packing" else math.inf)
