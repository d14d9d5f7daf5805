import pytest
from pyspark.sql import functions as F

from pairlens.llm import style_tree
from tests.llm.fixtures import SF


def text_of(html):
    return style_tree.main_text(html, set(), set())


@pytest.mark.parametrize(
    "html, want",
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a<b>b</b>c<br>d</p><p>e", "abc d e"),
        ("<nav>menu</nav><div class='ad'>buy</div><article><h1>T</h1><p>x  y\n z</article><footer>f</footer>", "T x y z"),
        ("<script>var t='</p>';</script><style>p{}</style><p>a</p><!-- <p>no</p> -->", "a"),
        ("<p>a<script>unclosed", "a"),
        ("<p>a<!-- unclosed <p>b", "a"),
        ("<p>a<p>b<p>c", "a b c"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", "a b c d e"),
        ("<main><p>in</p><aside>out</aside><section class='comments'><p>first!</p></section></main><p>after</p>", "in"),
        ("<div id=cookie-notice>ok?</div><div class=post><p>kept</p><form>name<input></form></div>", "kept"),
        ("<header>site</header><article><header><h1>title</h1></header><p>body</p></article>", "title body"),
        ('<p title="a > b">q</p><p title=\'"\'>r', "q r"),
        ("<p>a&nbsp;b&#8211;c&lt;d&gt;</p>", "a b–c<d>"),
        ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
        ("<div hidden>x</div><div style='display: none'>y</div><div role=navigation>z</div><p>k</p>", "k"),
        ("<p>a</p></div></p></article><p>b</p>", "a b"),
        ("<span class='advert'>buy</span><p>own</p>", "own"),
        ("<div class='site-header'>S</div><div class=entry-header>T</div><ol class=commentlist><li>hm</ol><p>own</p>", "T own"),
        ("<title>no</title><head><meta charset=utf-8><p>yes</p>", "yes"),
        ("<figure><img src=x><figcaption>seen</figcaption></figure><p>read", "seen read"),
        ("<adverse><p>a</p></adverse><div class=shadow>b</div><div class=header-image>c</div>", "a b c"),
    ],
)
def test_text_of_a_page(html, want):
    assert text_of(html) == want


@pytest.mark.parametrize(
    "html, want",
    [
        ("<div class='content-sidebar-wrap'><main><p>in</p></main></div>", "in"),
        ("<div class='no-sidebar'><main class=no-sidebar>in</main><p>a much longer text outside</p></div><p>x</p>", "in"),
        ("<div class='overflow-hidden'><article class='post tag-ads'>in</article></div><p>a longer text</p>", "in"),
        ("<div class='site no-sidebar'><div class='has-sidebar'><article><p>in</p></article><div class=sidebar>out out</div></div></div>", "in"),
        ("<div class='overflow-hidden'><p>most of the text</p></div><p>less</p>", "most of the text less"),
        ("<div class='page-widget' id='social-policy'><p>all the text</p></div>", "all the text"),
        ("<div class='site-header-wrap'><article>in</article></div>", "in"),
        ("<div class='has-menu'><div class=menu>Home</div><div hidden>long hidden text</div><p>a longer text</p></div>", "a longer text"),
        ("<div class=sidebar><p>out</p></div><p>the text</p>", "the text"),
        ("<article>the long text in here</article><ol class=commentlist><li><article class=comment>hm</article></ol>", "the long text in here"),
        ("<div hidden><main>out</main></div><aside class=wrap><article>out</article></aside><p>in</p>", "in"),
    ],
)
def test_names_do_not_remove_what_holds_the_main_text(html, want):
    assert text_of(html) == want


def site(spark):
    """Pages without telling names: entropy alone has to find what they share."""
    pages = []
    for i in range(40):
        body = "".join(f"<p>own sentence {i} {k} of this page</p>" for k in range(3 + i % 5))
        pages.append(
            (i, f"http://h.example.org/{i}",
             f"<html><body><div class=x1><p>Home</p><p>Prices</p></div><div class=x2>{body}<p>Press the bell below.</p></div>"
             f"<div class=x3>All of it is ours</div></body></html>")
        )
    pages += [(100 + i, f"http://h.example.org/copy/{i}", "<html><body><div class=x2><p>a much published note</p></div></body></html>") for i in range(60)]
    pages += [(200, "http://single.example.org/", "<div class=x1><p>Home</p></div><div class=x2><p>all there is</p></div>")]
    return spark.createDataFrame(pages, "page_id long, url string, html string")


def test_shared_branches_go_and_copies_stay(spark):
    got = {r.page_id: r.text for r in style_tree.extract(site(spark)).collect()}
    for i in range(40):
        assert got[i] == " ".join(f"own sentence {i} {k} of this page" for k in range(3 + i % 5))
    assert all(got[100 + i] == "a much published note" for i in range(60))
    assert got[200] == "Home all there is"


def test_near_copies_keep_their_article(spark):
    """A third of the pages are variants of one article: a word, a date or a teaser differs."""
    article = [" ".join(f"a{k}x{j}" for j in range(30)) for k in range(5)]
    menu = "<div class=x1><p>Home</p><p>Prices and terms of all that we sell</p></div>"

    def page(i, name, paragraphs):
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        return (i, f"http://n.example.org/{i}", f"<body>{menu}<div class='{name}'>{body}</div></body>")

    own = [[" ".join(f"d{i}x{k}x{j}" for j in range(12)) for k in range(3 + i % 4)] for i in range(200)]
    variants = []
    for i in range(100):
        changed = list(article)
        if i % 3 == 0:
            changed[i % 5] = changed[i % 5].replace(f"x{i % 30} ", f"x{i}new ")
        variants.append(changed + ([f"Printed on day {i}"] if i % 3 == 1 else [f"next teaser t{i} here"] if i % 3 == 2 else []))
    pages = [page(i, "x2", p) for i, p in enumerate(own)] + [page(1000 + i, "x2", p) for i, p in enumerate(variants)]
    pages += [page(2000 + i, "post-123", [*(f"only {p}" for p in article), f"edit {i}"]) for i in range(3)]
    got = {r.page_id: r.text for r in style_tree.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i] == " ".join(p) for i, p in enumerate(own))
    assert all(got[1000 + i] == " ".join(p) for i, p in enumerate(variants))
    assert all(got[2000 + i] == " ".join([*(f"only {p}" for p in article), f"edit {i}"]) for i in range(3))


def test_odd_pages(spark):
    rows = [
        (None, None, None, 1), (1, None, "", 1), (2, "no address", "<p>x", 1), (2, "no address", "<p>x", 1),
        (3, "HTTP://A.example/", "<p>" + "long " * 200_000, 1), (4, "http://b.example", "<" * 50_000, 1),
        (5, "http://b.example", "<div>" * 3000 + "deep", 1), (6, "http://b.example", "<p a=\"" + "x" * 50_000, 1),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = style_tree.extract(pages)
    assert got.columns == ["page_id", "url", "text"]
    texts = [(r.page_id, r.text) for r in got.collect()]
    assert len(texts) == len(rows) and all(t is not None for _, t in texts)
    assert texts.count((2, "x")) == 2 and (5, "deep") in texts
    assert style_tree.extract(pages.limit(0)).count() == 0


def test_pages_of_the_test_data(spark):
    """The template of the test data, read by plain rules."""
    import html
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = re.split(r"</?(?:h1|p)>", article)
        plain = [" ".join(html.unescape(re.sub(r"<[^>]+>", " " if "<br" in b else "", b)).split()) for b in blocks]
        want[r.page_id] = " ".join(b for b in plain if b)
    got = {r.page_id: r.text for r in style_tree.extract(pages).collect()}
    assert got == want
    assert pages.filter(F.col("html").isNull()).isEmpty()
