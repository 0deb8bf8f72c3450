import html
import re

import numpy as np
import pytest

from brasstide.llm import page_text

CASES = [
    ("<body><nav>menu <a href=x>a</a></nav><article class='post'><h1>T &amp; t</h1><p>one <b>two</b><p>four<script>var x='</p>'</script></p>"
     "<div class='comments'><p>no</p></div></article><footer>f</footer>", ["T & t", "one two", "four"]),
    ("<main>a&nbsp;b  \n c<aside>x</aside><form>y</form><ul><li>d<li>e</ul></main>", ["a b c", "d", "e"]),
    ("<div class=\"cookie-notice\">c</div><p>plain < text &lt;b&gt;</p><!-- <p>no</p> --><p>&#233;&eacute;&hellip;", ["plain < text <b>", "éé…"]),
    ("<nav><ul><li>never closed<article><p>kept</p></article>", ["kept"]),
    ("<article><p>cut <a href=\"x", ["cut"]),
    ("<div id=sidebar>s</div><div role=navigation>n</div><p class=lead>l", ["l"]),
    ("", []), ("<!-- open", []), ("<script>never closed", []), ("just text", ["just text"]),
    ("<article><p>a<br>b</p><style>p{}</style><table><tr><td>c<td>d</table></article>", ["a b", "c", "d"]),
]


@pytest.mark.parametrize("page, blocks", CASES)
def test_blocks(page, blocks):
    assert page_text.blocks_of(page)[0] == blocks


def test_pages_give_their_articles(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in page_text.extracted(pages).collect()}
    for r in pages.collect():
        inner = re.search("<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        want = "\n".join(b for b in blocks if b)
        assert (got[r.page_id].text, got[r.page_id].n_chars) == (want, len(want))


def test_repeated_runs_of_a_host_go_and_unique_runs_stay(spark):
    line = "all pages of this host say these very same ten words"
    rows = [(1, "http://h.example/1", f"<p>unique one</p><p>{line}</p>"), (2, "http://h.example/2", f"<p>{line} and more</p><p>unique two</p>"),
            (3, "http://other.example/", f"<p>{line}</p>"), (4, "http://h.example/4", f"<article>{line}</article>"),
            (5, "http://c.example/a", f"<p>{line}</p>"), (6, "http://c.example/b", f"<p>{line}</p>"), (7, None, None), (None, "odd", "<p>x</p>"),
            (8, "http://h.example/8", "<p>short shared</p>"), (9, "http://h.example/9", "<p>short shared</p><p>own</p>")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "page_id bigint, url string, html string, stream string")
    got = {r.page_id: r.text for r in page_text.extracted(df).collect()}
    assert got == {1: "unique one", 2: "and more\nunique two", 3: line, 4: line, 5: line, 6: line, 7: "", None: "x", 8: "short shared", 9: "short shared\nown"}


def test_repeats_beside_articles_are_counted(spark):
    foot = "<footer>all rights to these pages are held by the house</footer>"
    rows = [(n, f"http://h.example/{n}", f"<article>own text {n}</article>{foot}") for n in range(3)]
    rows += [(3, "http://h.example/3", "<article>alone</article>"), (4, "http://other.example/", f"<article>a</article>{foot}"),
             (5, "http://c.example/a", f"<article>copy</article>{foot}"), (6, "http://c.example/b", f"<article>copy</article>{foot}")]
    got = page_text.extracted(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {r.page_id: r.n_repeated for r in got} == {0: 10, 1: 10, 2: 10, 3: 0, 4: 0, 5: 0, 6: 0}
    assert {r.page_id: r.text for r in got} == {0: "own text 0", 1: "own text 1", 2: "own text 2", 3: "alone", 4: "a", 5: "copy", 6: "copy"}


@pytest.mark.parametrize("page, blocks", [
    ("<article><h2 id=\"side-effects\">a</h2><section id=\"related-work\"><p>b</section><div id=\"social-history\">c</div>"
     "<section id=\"search\">d</section><section aria-label=\"Social history\">e</section><p class=notice>f</p>"
     "<div class=\"share\">no</div><div class=\"post-comments\">no</div></article>", ["a", "b", "c", "d", "e", "f"]),
    ("<div class=\"content no-sidebar\"><h2 id=search>a</h2><p>b</div><div class=\"right-sidebar\">no</div>", ["a", "b"]),
    ("<div data-role=navigation>a</div><div class='x social'>no</div>", ["a"]),
    ("<article><p class='menu'>a</p><div class=header><h1>b</h1></div><div class='share-price'>c</div><p id=comments>d</p>"
     "<h2 class=comments>e</h2></article>", ["a", "b", "c", "d", "e"])])
def test_names_that_only_contain_a_mark_lose_no_text(page, blocks):
    assert page_text.blocks_of(page)[0] == blocks


@pytest.mark.parametrize("block", [
    "<div id=\"comments\">x</div>", "<section id=comments><p>x</section>", "<div class='reader-comments'><p>x</p></div>",
    "<div class=newsletter-signup>x</div>", "<ul class='related-articles'><li>x</ul>", "<div class='google-ad'>x</div>",
    "<p class=\"advert\">x</p>", "<div id=disqus_thread>x</div>", "<div class='comments-thread'>x</div>"])
def test_comments_and_adverts_go_within_and_beside_articles(block):
    assert page_text.blocks_of(f"<article><p>a</p>{block}<p>b</p></article>")[0] == ["a", "b"]
    assert page_text.blocks_of(f"<p>a</p>{block}<p>b</p>")[0] == ["a", "b"] or "section id" in block


@pytest.mark.parametrize("name", ["header", "menu-item", "footer-widgets", "comments-thread"])
def test_places_outside_of_articles_go(name):
    assert page_text.blocks_of(f"<div class='{name}'>x</div><p>a</p>")[0] == ["a"]


def test_end_tags_without_starts_take_linear_time():
    import time
    page = "<p>a" * 60_000 + "</center>" * 60_000 + "</p>" * 60_000
    start = time.process_time()
    assert len(page_text.blocks_of(page)[0]) == 60_000
    assert time.process_time() - start < 5


def test_quotes_and_near_copies_without_an_article_stay(spark):
    quote = "these are the ten words that some pages quote whole"
    foot = "all rights to these pages are held by the house"
    html = {n: f"<p>page {n}</p><p>{quote if n < 3 else f'own {n}'}</p><p>{foot}</p>" for n in range(1, 7)}
    rows = [(n, f"http://h.example/{n}", h) for n, h in html.items()]
    rows += [(7, "http://two.example/a", f"<p>{quote} a</p>"), (8, "http://two.example/b", f"<p>{quote} b</p>")]
    got = page_text.extracted(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    want = {n: f"page {n}\n{quote if n < 3 else f'own {n}'}" for n in range(1, 7)}
    assert {r.page_id: r.text for r in got} == want | {7: f"{quote} a", 8: f"{quote} b"}


def test_suffix_ranks_sort_suffixes():
    tokens = np.random.default_rng(1).integers(0, 3, 200)
    ranks = page_text.suffix_ranks(tokens, 8)
    key = [tuple(tokens[i:i + 8].tolist()) for i in range(200)]
    for i in range(0, 200, 7):
        assert all((ranks[i] == ranks[j]) == (key[i] == key[j]) and (ranks[i] < ranks[j]) <= (key[i] < key[j]) for j in range(200))


def test_empty_table(spark):
    assert page_text.extracted(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
