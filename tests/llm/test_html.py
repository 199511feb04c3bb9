from html.parser import HTMLParser

import numpy as np
import pytest

from tessera.llm import boosting, html_extract, page_maker
from tessera.llm.html_tree import parse


@pytest.fixture(scope="module")
def model():
    return html_extract.fit()


def test_main_text_of_unseen_pages(model):
    made = page_maker.make(300, 4242)
    got = html_extract.extract([s for s, _ in made], model)
    right = sum(t == " ".join(" ".join(b.split()) for b in main) for (_, main), (t, _, _) in zip(made, got, strict=True))
    assert right >= 0.9 * len(made)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>
<div class="cookie-notice"><p>We use cookies.</p></div><div class="ad">Buy this.</div>
<article><h1>Big &amp; small</h1><p><b>First  line<br>goes&nbsp;on<p>Second, with <i>inline</i>text and &lt;b&gt;.</p><script>x("</p>")</script><p>Third one is here, and longer than the rest of them.</p></article>
<aside class="sidebar"><h3>Popular</h3><ul><li><a href="/c">Other</a></ul></aside><section id="comments"><div class="comment"><p>I disagree with all of it.</p></div></section>
<form><label>Mail</label><input name="m"><button>Go</button></form><footer>&copy; nobody</footer></body></html>"""


def test_a_page_with_everything(model):
    assert html_extract.extract([PAGE], model)[0][0] == "Big & small First line goes on Second, with inlinetext and <b>. Third one is here, and longer than the rest of them."


def test_forms_drawings_and_players_say_nothing(model):
    for source, want in (
        ("<p>a <svg><title>t</title><text>icon</text></svg>b</p>", ["a b"]),
        ("<p>a<button>Go</button>b</p>", ["ab"]),
        ("<article><label>Mail</label><input><p>x</p></article>", ["x"]),
        ("<p>a <math><mi>x</mi></math> b <video>No player. <a href='x'>Get it</a></video>c</p>", ["a b c"]),
        ("<div><button><div>Go</div></button>x</div>y", ["x", "y"]),
        ("<div><button>Go</div>y", ["y"]),
        ("<p>a <svg/>b <svg><path/><svg></svg>z</svg>c</p>", ["a b c"]),
        ("<button><script>if(a<b){'</button>'}</script>Go</button>x", ["x"]),
        ("<p>a<label>never closed", ["a"]),
    ):
        assert [t for _, t in parse(source).blocks] == want, source
    tables = "<article><h1>Title of it</h1><p>A first paragraph of some length stands here, with words.</p><table><caption>Cap</caption><tr><th>Sum</th><th>Kind</th></tr><tr><td>1</td><td>one</td></tr></table><dl><dt>Term</dt><dd>Meaning of it.</dd></dl><p>And a last paragraph ends the article here.</p></article>"
    assert html_extract.extract([PAGE[: PAGE.index("<article>")] + tables + PAGE[PAGE.index("</article>") + 10 :]], model)[0][0] == "Title of it A first paragraph of some length stands here, with words. Cap Sum Kind 1 one Term Meaning of it. And a last paragraph ends the article here."


FOREIGN = [
    # a blog
    ("""<html><head><title>Bread - My kitchen</title></head><body class="home single-post"><div id="page"><header id="masthead"><a class="site-title" href="/">My kitchen</a><p class="site-description">Recipes and more</p></header>
    <nav id="site-navigation"><ul class="menu"><li><a href="/">Home</a></li><li><a href="/about">About</a></li></ul></nav><div id="content" class="site-content"><main><article id="post-12" class="post type-post hentry">
    <h1 class="entry-title">How I bake bread</h1><div class="entry-meta"><a href="/2020">May 4</a> by <a href="/ann">Ann</a></div><div class="entry-content"><p>Good bread takes time, and little else. I start in the evening with a wet dough.</p>
    <h2>What you need</h2><ul><li>500 g of flour</li><li>350 g of water</li><li>Salt and yeast</li></ul><p>Mix it all, cover it, and let it rest until the morning. Then fold it four times and bake it hot.</p></div></article>
    <div id="comments" class="comments-area"><h2>2 thoughts on this</h2><ol class="comment-list"><li class="comment"><p>Lovely, thank you so much for sharing!</p></li><li class="comment"><p>Mine came out flat. What did I do wrong?</p></li></ol></div></main>
    <aside id="secondary" class="widget-area"><section class="widget"><h2>Recent posts</h2><ul><li><a href="/1">Soup</a></li><li><a href="/2">Cake</a></li></ul></section></aside></div><footer id="colophon"><div class="site-info">Proudly made at home</div></footer></div></body></html>""",
     "How I bake bread Good bread takes time, and little else. I start in the evening with a wet dough. What you need 500 g of flour 350 g of water Salt and yeast Mix it all, cover it, and let it rest until the morning. Then fold it four times and bake it hot.",
     "Home About Recent Soup Lovely flat Proudly Recipes".split()),
    # news, nothing but divs
    ("""<!doctype html><html><body><div class="topbar"><a href="/login">Sign in</a> <a href="/sub">Subscribe</a></div><div class="cookie-consent">We value your privacy. <button>Accept all</button></div><div class="wrapper"><div class="breadcrumb"><a href="/">News</a> &gt; <a href="/w">World</a></div>
    <div class="story-body"><h1>River floods three towns</h1><div class="share-tools"><a href="#">Share</a><a href="#">Tweet</a></div><div class="text"><p>Heavy rain has flooded three towns along the river, officials said on Monday. Hundreds of people left their homes.</p><div class="advert">Advertisement: buy boots</div><p>The water is expected to fall by Wednesday, the weather service said, but more rain may follow at the weekend.</p><p>&quot;We have seen nothing like it in forty years,&quot; said the mayor.</p></div></div>
    <div class="related-stories"><h3>More on this</h3><ul><li><a href="/a">How floods form</a></li><li><a href="/b">Dam under pressure</a></li></ul></div></div><div class="newsletter"><form action="/n"><label>Get our letter</label><input type="email"><button>Sign up</button></form></div><div class="footer">Terms | Privacy | Contact</div></body></html>""",
     'River floods three towns Heavy rain has flooded three towns along the river, officials said on Monday. Hundreds of people left their homes. The water is expected to fall by Wednesday, the weather service said, but more rain may follow at the weekend. "We have seen nothing like it in forty years," said the mayor.',
     "Subscribe privacy Tweet boots Dam Terms letter".split()),
    # a manual
    ("""<!DOCTYPE html><html><head><title>connect()</title></head><body><div class="navbar"><ul><li><a href="/">Docs</a><li><a href="/api">API</a></ul></div><div class="container"><div class="sidebar"><ul><li><a href="/open">open</a><li><a href="/close">close</a><li><a href="/read">read</a></ul></div><main class="documentation"><h1>connect</h1><p>Opens a connection to a server and returns a handle, which must be closed in the end.</p>
    <h2>Parameters</h2><dl><dt>host</dt><dd>The name or address of the server.</dd><dt>port</dt><dd>A number, 80 if it isn't given.</dd></dl><table><caption>Errors</caption><thead><tr><th>Code</th><th>Meaning</th></tr></thead><tbody><tr><td>1</td><td>No such host</td></tr><tr><td>2</td><td>Refused by the server</td></tr></tbody></table><p>The call blocks until the connection stands, or the time is over.</p></main></div><footer><p>Last built in March. Edit this page.</p></footer></body></html>""",
     "connect Opens a connection to a server and returns a handle, which must be closed in the end. Parameters host The name or address of the server. port A number, 80 if it isn't given. Errors Code Meaning 1 No such host 2 Refused by the server The call blocks until the connection stands, or the time is over.",
     "Docs API close Edit".split()),
]


@pytest.mark.parametrize("k", range(len(FOREIGN)))
def test_pages_of_other_hands(model, k):
    """Written without the generator: most of the article's words, and none of the words around it."""
    source, want, around = FOREIGN[k]
    got = html_extract.extract([source], model)[0][0]
    words, kept = want.split(), set(got.split())
    assert sum(w in kept for w in words) >= 0.95 * len(words), got
    assert not [w for w in around if w in kept and w not in words], got


class _Article(HTMLParser):
    """All text within article elements, by the standard library."""

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.open, self.out = 0, []
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.open += tag == "article"
        if tag in ("p", "h1", "br"):
            self.out.append(" ")

    def handle_endtag(self, tag):
        self.open -= tag == "article"
        if tag in ("p", "h1"):
            self.out.append(" ")

    def handle_data(self, data):
        if self.open:
            self.out.append(data)


def test_the_pages_table(spark, model):
    """Its pages have their main text in an article element, and nothing else there; the training pages know nothing of that."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = html_extract.extract_pages(pages, model).collect()
    want = {r.page_id: " ".join("".join(_Article(r.html or "").out).split()) for r in pages.collect()}
    assert len(rows) == len(want)
    assert sum(r.text == want[r.page_id] for r in rows) >= 0.99 * len(rows)


def test_parser_on_broken_markup():
    for source in ("", "<", "<p", "a < b > c", "<p>x<p>y", "</div></p>x", "<a href='<p>'>t</a>", "<!-- open", "<script>never closed <p>x", '<p title="a>b>c">t', "<div " + "x" * 5000, "<ul><li>a<li>b</ul>c", "<table><tr><td>a<td>b<tr><td>c</table>"):
        page = parse(source)
        assert len(page.tags) == len(page.parents) == len(page.ends)
        assert all(page.parents[i] < i < page.ends[i] <= page.ends[page.parents[i]] for i in range(1, len(page.tags)))
    assert [t for _, t in parse("<p>x<p>y</p>z<br>w").blocks] == ["x", "y", "z w"]
    assert [t for _, t in parse("<ul><li>a<li>b</ul>c").blocks] == ["a", "b", "c"]
    assert [t for _, t in parse("<p>a<b>b</b>c &amp;amp; <!-- x -->d").blocks] == ["abc &amp; d"]


def test_decoding_never_contradicts_itself(model):
    rng = np.random.default_rng(0)
    for source, _ in page_maker.make(40, 11):
        page = parse(source)
        margin = rng.normal(size=len(page.tags))
        keep = html_extract.decode(page, margin)
        assert all(keep[page.parents[i]] for i in range(1, len(keep)) if keep[i])
    page = parse("<div><p>a</p><p>b</p></div><div><p>c</p></div>")  # nodes 1..3, 4..5
    n = len(page.tags)
    margin = np.array([0.3, -1, 2.0, -0.5, -1, 0.4])
    best = max(sum(margin[i] for i in range(1, n) if s >> i & 1) for s in range(0, 1 << n, 2) if all(page.parents[i] == 0 or s >> page.parents[i] & 1 for i in range(1, n) if s >> i & 1))
    keep = html_extract.decode(page, margin)
    assert abs(margin[1:][keep[1:]].sum() - best) < 1e-12


def test_boosted_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    forest = boosting.fit(x[:1500], y[:1500], trees=30)
    assert ((forest.margin(x[1500:]) > 0) == (y[1500:] > 0)).mean() > 0.95
    assert len(forest.margin(x[:0])) == 0


def test_odd_rows(spark, model):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "plain text"), (4, "u", PAGE), (4, "u", PAGE), (None, "u", "<p>x y</p>"), (5, "u", "<article><p>" + "long words " * 50_000 + "</p></article>")]
    df = spark.createDataFrame([(*r, "t", 3) for r in rows], "page_id long, url string, html string, text string, n_chars long")
    got = html_extract.extract_pages(df, model).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text for r in got if r.page_id in (1, 2, 3)} == {1: "", 2: "", 3: "plain text"}
    assert next(r for r in got if r.page_id == 5).n_chars == 50_000 * 11 - 1
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string"), model).collect() == []


def test_raw_elements_end_at_their_end_tag(model):
    for raw in [*page_maker._SCRIPTS, "<script>x = '<a href=\"</script>", "<title>a <b</title>", "<textarea><!-- </textarea\n>", "<iframe><i</iframe>", "<script></scripts><p>no</p></SCRIPT/>"]:
        assert [t for _, t in parse(f"<p>a</p>{raw}<article><p>Text</p></article>").blocks] == ["a", "Text"], raw
        page = PAGE.replace("<body>", "<body>" + raw).replace("<article>", raw + "<article>")
        assert html_extract.extract([page], model)[0][0] == html_extract.extract([PAGE], model)[0][0], raw
    assert [t for _, t in parse("<p>a</p><script>i<n;</scripts><p>b</p>").blocks] == ["a"]
    assert any("i<n;i++" in source for source, _ in page_maker.make(100, 3))
