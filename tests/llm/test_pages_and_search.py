import random

import numpy as np
import pytest
from millrace.llm import html_layouts, html_text, top_k
from millrace.llm.html_text import main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="with-sidebar">
<header><h1>Site name</h1><p>A slogan that is long enough to look like text.</p></header>
<div class="cookie-notice">We use cookies to make this site better for you, please agree.</div>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<main><article><h1>Title &amp; more</h1><p>First   paragraph with <b>bold</b> and <a href="x">a link</a> inside.<br>Second line.<p>Short.</p>
<div class="ad">Buy this wonderful thing now, it is cheap and good.</div><blockquote>A quote &lt;here&gt;.</blockquote><ul><li>One point.</li><li>Two points.</li></ul></article>
<aside><p>Other stories that you may want to read as well today.</p></aside>
<form><label>Name</label><p>Write to us with this form, we are glad to hear from you.</p><button>Send</button></form>
<section id="comments"><h2>Comments</h2><article><p>I think that this is a very good article, thank you for it.</p></article></section></main>
<footer>&copy; 2024 somebody</footer></body></html>"""


def test_layout_names_do_not_hide_the_article():
    page = '<body><div class="layout sidebar-right"><div class="sidebar"><p>Other things to read on this page.</p></div><article><h1>T</h1><p>Some text.</p></article></div></body>'
    assert main_text(page) == "T Some text."


def test_headers_of_pages_and_of_articles():
    page = '<body><div class="page-header"><h1>The site</h1></div><article><header class="entry-header"><h1>The article</h1></header><p>Its text.</p><footer>Filed under news</footer></article></body>'
    assert main_text(page) == "The article Its text."


def test_article_alone():
    assert main_text(PAGE) == "Title & more First paragraph with bold and a link inside. Second line. Short. A quote <here>. One point. Two points."


@pytest.mark.parametrize("page", ["", "   ", "<", "<p", "<p>", "</p></div>", "<script>", "<!-- open", "<a href='", "<div><div><div>", "&", "&#xFFFFFFF;", "<p>" * 3000, "<a " * 60000, "<!" * 60000, "<a '" * 30000, "<b>" * 20000 + "x"])
def test_odd_markup_does_not_fail(page):
    assert isinstance(main_text(page), str)


def test_plain_text_is_kept():
    assert main_text("just a text without any markup at all, and 3 < 4.") == "just a text without any markup at all, and 3 < 4."


@pytest.mark.parametrize("name", ["svg-icon", "video-player", "template-x", "select-box", "object-view", "title-bar", "script-note"])
def test_custom_elements_are_not_taken_for_raw_ones(name):
    assert main_text(f"<article><p>Text before.</p><{name} size=2></{name}><p>Text after.</p></article>") == "Text before. Text after."


@pytest.mark.parametrize("name", ["video", "audio", "object", "canvas", "svg", "select", "template"])
def test_only_closed_elements_are_left_out(name):
    start, end, rest = f"<{name} id=a>", f"</{name}>", "<p>Text after.</p></article>"
    for markup in (start, f"{start}gone{end}", f"{start.upper()}gone{end.upper()}", f"{start}gone{start}gone{end}gone{end}", f"{start}gone{end} {start}"):
        assert main_text(f"<article><p>Text before.</p>{markup}{rest}") == "Text before. Text after.", markup
    page = f"<article><p>Text before.</p>{start}{rest}<article><p>More.</p>{start}gone{end}<p>Last.</p></article>"
    assert main_text(page) == "Text before. Text after. More. Last."
    assert main_text(f"<div><article><p>Text before.</p>{start}{rest}<p>Between the two.</p>{end}</div>") == "Text before. Text after. Between the two."


def test_raw_text_runs_to_its_end_tag_or_the_end():
    assert main_text("<article><p>Text.</p><script>'<p>'</scripts></script x><p>After.</p></article>") == "Text. After."
    assert main_text("<article><p>Text.</p><style>p {} <p>not text") == "Text."
    assert main_text("<article><p>Text.</p><svg viewBox='0 0 1 1'/><p>After.</p><svg><svg/><text>gone</text></svg></article>") == "Text. After."


def test_text_of_formulas_is_kept():
    assert main_text("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p></article>") == "Let x=2 be."


@pytest.mark.parametrize("page", ["<svg>" * 60000, "<svg><p>" * 30000 + "</div>" * 60000, "<script></script " * 60000, "<video></svg>" * 60000])
def test_many_open_elements_take_linear_time(page):
    assert isinstance(main_text(page), str)


def brute(cost, smooth):
    best = None
    for mask in range(1 << len(cost)):
        keep = [bool(mask >> k & 1) for k in range(len(cost))]
        total = sum(-c if k else 0 for c, k in zip(cost, keep, strict=True)) + sum(w for a, b, w in smooth if keep[a] != keep[b])
        best = total if best is None or total < best else best
    return best


def test_cut_is_minimal():
    rng = random.Random(7)
    for _ in range(200):
        n = rng.randrange(1, 9)
        cost = [rng.randrange(-20, 21) for _ in range(n)]
        smooth = [(a, b, rng.randrange(1, 12)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        keep = html_text.cut(cost, smooth)
        total = sum(-c if k else 0 for c, k in zip(cost, keep, strict=True)) + sum(w for a, b, w in smooth if keep[a] != keep[b])
        assert total == brute(cost, smooth)


def test_text_is_that_of_the_cheapest_labelling():
    """Runs of blocks against every labelling of them, and what is written of whole pages."""
    learned = html_text.model()
    for k, (html, _) in enumerate(html_layouts.labelled(40, 9)):
        whole = html_text.blocks(html)
        assert main_text(html) == " ".join(b.text for b, keep in zip(whole, learned.labels(whole), strict=True) if keep)
        found = whole[k % 7 :][:10]
        cost, smooth = learned.costs(found), html_text.edges(found, learned.smooth)
        keep = learned.labels(found)
        total = sum(-c if k else 0 for c, k in zip(cost, keep, strict=True)) + sum(w for a, b, w in smooth if keep[a] != keep[b])
        assert total == brute(cost, smooth)


def test_cut_mends_what_single_blocks_say():
    """On pages that nothing was learned on, the cut changes labels and makes fewer mistakes than the costs alone."""
    learned, single, joint, blocks, changed = html_text.model(), 0, 0, 0, 0
    for html, content in html_layouts.labelled(200, 3):
        found = html_text.blocks(html)
        want, own, cut = [b.text in content for b in found], [c > 0 for c in learned.costs(found)], learned.labels(found)
        single += sum(a != b for a, b in zip(own, want, strict=True))
        joint += sum(a != b for a, b in zip(cut, want, strict=True))
        changed += sum(a != b for a, b in zip(cut, own, strict=True))
        blocks += len(found)
    assert changed > blocks / 100 and joint < single and joint < blocks / 40


def test_extract_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 0), (1, "u", PAGE, 0), (None, None, None, 1), (3, "v", "", 2)], "page_id bigint, url string, html string, text int")
    out = html_text.extract(pages).collect()
    assert len(out) == 4 and all(r.n_chars == len(r.text) for r in out)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_driver_pages_hold_the_article(spark, small):
    for r in html_text.extract(spark.read.parquet(f"{small}/pages.parquet")).collect():
        assert r.n_chars > 0 and "example.net" not in r.text


def expected(rows, k=20, every=20):
    sound = [(n, key, np.floor(64 * np.array(v, float)).astype(np.int64)) for n, (key, v) in enumerate(rows) if key is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, key, q in sound:
        if key % every == 0:
            found = sorted((-int(q @ x), other) for m, other, x in sound if m != n and len(x) == len(q))[:k]
            out += [(key, rank, other, -score) for rank, (score, other) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("n,dim,slab", [(300, 16, 4096), (150, 3, 5), (9, 64, 4096)])
def test_search_equals_brute_force(spark, monkeypatch, n, dim, slab):
    monkeypatch.setattr(top_k, "BLOCK", 64)
    rng = np.random.default_rng(n)
    rows = [(k, (rng.standard_normal(dim) * (1 if k % 3 else 0.05)).round(1).tolist()) for k in range(n)]
    df = spark.createDataFrame([(k, v, 0) for k, v in rows], "vec_id bigint, embedding array<float>, rank int")
    got = sorted(tuple(r) for r in top_k.top_k(df, slab=slab).select("query_id", "rank", "vec_id", "score").collect())
    assert got == expected([(k, np.float32(v)) for k, v in rows])


def test_pruned_search_is_exact(spark, monkeypatch):
    """Vectors of constant segments, where the coarse bounds decide nearly everything."""
    monkeypatch.setattr(top_k, "SPARSE", 1.0)
    rng = np.random.default_rng(5)
    rows = [(k, np.repeat(rng.standard_normal(4), 8).tolist()) for k in range(400)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert sorted(tuple(r) for r in top_k.top_k(df).collect()) == expected(rows)


def test_unsound_rows_take_no_part(spark):
    nan = float("nan")
    rows = [(0, [1.0, 2.0]), (20, None), (40, [1.0, None]), (60, [nan, 1.0]), (None, [1.0, 1.0]), (1, [3.0, 3.0]), (1, [3.0, 3.0]), (0, [1.0, 2.0]), (2, [1.0]), (3, [float("inf"), 0.0]), (5, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert sorted(tuple(r) for r in top_k.top_k(df).collect()) == expected(rows)
    assert top_k.top_k(df.limit(0)).count() == 0


def test_large_numbers_stay_exact(spark):
    rows = [(k, [float(2**24 + k), float(2**24 - k)]) for k in range(30)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert sorted(tuple(r) for r in top_k.top_k(df).collect()) == expected(rows)
