import time

from tomeworks.llm import extract


ARTICLE = "<h1>Title</h1><p>Hello <b>wor</b>ld &amp; more&nbsp;text &#233;,\n it is   long.<p>Second <a href=x>link</a> words here.<br>Next line"
WANT = "Title Hello world & more text é, it is long. Second link words here. Next line"
NOISE = ("<header><div class=logo>Site</div></header><nav><ul><li><a href='/'>Home</a></ul></nav><div class='cookie-notice'>We use cookies here</div>"
         "<div class=sidebar><p>A long side text that says a lot about nothing at all</p></div><div class=ad2>Buy now</div>")


def page(before="", inside="", after="", wrap="<div class='post-12 entry'>{}</div>"):
    return f"<html><head><title>T</title><style>p{{}}</style><script>if (a<b) '</p>'</script></head><body>{before}{wrap.format(ARTICLE + inside)}{after}</body></html>"


def text_of(html):
    return extract.extract(html, extract.candidate(html)[0])


def test_noise_is_left_out():
    tail = "<form><p>Subscribe to our letter</p></form><footer>&copy; all rights</footer>"
    inner = "<div id=comments><p>First! What a nice article, I liked every word of it</p></div><aside>More</aside><!-- <p>no</p> -->"
    for wrap in ("<div class='post-12 entry'>{}</div>", "<article>{}</article>", "<main><section>{}</section></main>", "{}", "<table><tr><td>{}</td></tr></table>"):
        assert text_of(page(NOISE, inner, tail, wrap)) == WANT, wrap


def test_nothing_of_an_article_is_lost():
    body = "Body text that is long. " * 40
    rows = [f"<p>{body}</p>"]
    for inner, want in (
        (f"<h1>HEADLINE</h1><p>Lead text.</p><div class='body'>{rows[0]}</div>", f"HEADLINE Lead text. {body}"),
        (f"<h1>T</h1><section class='legal-analysis'><p>Law.</p></section>{rows[0]}<section class='share-prices'>Up.</section>", f"T Law. {body} Up."),
        (f"<h1>T</h1>{rows[0]}<p id='side-effects'>Sleep.</p><h2 class='discussion'>Why</h2><p class='related-work'>As before.</p>", f"T {body} Sleep. Why As before."),
        (f"<h1>T</h1>{rows[0]}<h2>References</h2><ul><li><a href=1>First source</a></li><li><a href=2>Second source</a></li></ul>", f"T {body} References First source Second source"),
        (f"<h1>T</h1><section><section class='deep'>{rows[0]}</section><section class='other'><p>More</p></section></section>", f"T {body} More"),
    ):
        want = " ".join(want.split())
        for wrap in ("<article>{}</article>", "<main>{}</main>", "<main><article class='a b'>{}</article><div class=related-posts><p>Other</p></div></main>"):
            html = f"<html><body>{NOISE}{wrap.format(inner)}<div class='site-footer'>All rights</div></body></html>"
            assert text_of(html) == want, (wrap, inner[:60])
    boxes = ("<div class='share-buttons'>Share</div><div class='comments-area'><p>First!</p></div><div class='ad-slot'>Buy</div><div id='disqus_thread'>x</div>"
             "<ul class='related-posts'><li>Other</li></ul><section class='newsletter-signup'>Join</section><div class='notice'>Old browser</div>")
    assert text_of(f"<body><article><h1>T</h1>{rows[0]}{boxes}</article></body>") == " ".join(f"T {body}".split())


def test_headings_beside_the_text_belong_to_it():
    body = "Body text that is long. " * 40
    page = f"<body><div class='wrap'><div class='post'><h1>HEADLINE</h1><p>Lead text.</p><div class='body'><p>{body}</p></div></div><div class='left-sidebar'><p>Aside</p></div></div></body>"
    assert text_of(page) == " ".join(f"HEADLINE Lead text. {body}".split())


def test_open_elements_do_not_slow_down_a_page():
    start = time.perf_counter()
    assert len(text_of("<article>" + "<span>word " * 50_000).split()) == 50_000
    assert len(text_of("<article><b>" + "<td><span>word </b>" * 20_000).split()) == 20_000
    assert len(text_of("<article><p>" + "<ul><i>word " * 20_000).split()) == 20_000
    assert time.perf_counter() - start < 5


def test_broken_pages():
    assert text_of("") == "" and text_of(None) == "" and text_of("<nav>x</nav><script>y") == ""
    assert text_of(page()[:-17]) == WANT
    assert text_of("just text & more") == "just text & more"
    assert text_of("<p>a</b></i></div>b<p>c<") .startswith("ab c")
    assert text_of("<div>" * 30_000 + "<p>deep text" + "</div></x>" * 30_000) == "deep text"
    assert len(text_of(page(inside="<p>word</p>" * 20_000)).split()) == len(WANT.split()) + 20_000


def test_hosts_agree_on_a_path(spark):
    """A page whose side box is longer than its article follows the other pages of its host."""
    box = "<div class=box><p>" + "long text of a box " * 30 + "</p></div>"
    rows = [(i, f"http://h.example/{i}", page()) for i in range(6)] + [
        (10, "https://user@H.example:80/x", page(after=box)), (11, "http://other.example/", "<div class=only><p>own words</p></div>"),
        (12, None, None), (13, "no url", page()), (13, "no url", page())]
    df = spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text, r.n_chars) for r in extract.main_text(df).collect()]
    want = [(i, WANT, len(WANT)) for i in [*range(6), 10, 13, 13]] + [(11, "own words", 9), (12, "", 0)]
    assert sorted(got) == sorted(want)
    assert extract.main_text(df.limit(0)).count() == 0


def test_whole_articles_of_the_test_pages(spark):
    import re
    from html import unescape

    from tomeworks.llm.queries import QUERIES

    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    for r in QUERIES["op7_html_extract"](spark, "/root/testdata/sf0.01").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", pages[r.page_id], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == " ".join(b for b in blocks if b) and r.n_chars == len(r.text)
