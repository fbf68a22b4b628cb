import re

import pytest

from chainlake.llm import html_text as h

SENTENCE = "This sentence of the article is long enough to stand out from the menus around it."


def page(body):
    return f"<html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


NOISE = ('<nav><ul><li><a href="/a">Home page</a></li><li><a href="/b">News</a></li></ul></nav>'
         '<div class="ad">Buy this very good thing now, it is cheap and it is long enough to be text.</div>')
TAIL = ('<aside>Read more of our other stories in the side bar of this page</aside><form><label>Your mail address please'
        '</label></form><div id="comments"><p>I am a reader and I have a lot to say about this article, really.</p></div>'
        '<div class="cookie-notice">We use cookies for everything that we do.</div><footer>&copy; 2020 me</footer>')


@pytest.mark.parametrize("open_, close", [("<article>", "</article>"), ("<main>", "</main>"), ('<div id="content">', "</div>")])
def test_article_without_the_rest(open_, close):
    article = f"<h1>A title of it</h1><p>{SENTENCE}</p><p>Short.</p><script>var x = '</p>';</script><p>{SENTENCE} &amp;  more\n text</p>"
    got = h.main_text(page(NOISE + open_ + article + close + TAIL))
    assert got == f"A title of it {SENTENCE} Short. {SENTENCE} & more text"


def test_markup_inside_and_unclosed_tags():
    html = page("<article><p>One <b>bold<br>line<p>two &lt;b&gt; &#233;<div class='ad'>x y z</div><!-- no --></article>")
    assert h.main_text(html) == "One bold line two <b> é"


@pytest.mark.parametrize("html", ["", "   ", "<", "<p", "<!-- open", "<script>x", "</p></div>", "<nav>only menu</nav>"])
def test_nothing(html):
    assert h.main_text(html) in ("", "<", "<p")


def test_plain_text_and_depth():
    assert h.main_text("just a text") == "just a text"
    assert h.main_text("<div>" * 3000 + "deep text in here" + "</div>" * 3000) == "deep text in here"


def brute_generated(html):
    """The generated pages hold their text in one article."""
    inner = re.search(r"<article>(.*)</article>", html, re.S)[1]
    import html as entities
    return " ".join(" ".join(entities.unescape(re.sub(r"<[^>]*>", "", part)).split())
                    for part in re.split(r"</?(?:p|h1|br)>", inner) if re.sub(r"<[^>]*>", "", part).strip())


def test_query_on_all_pages(spark):
    from chainlake.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op3_html_text"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == brute_generated(pages[r.page_id]) and r.n_chars == len(r.text)


def test_hard_cases(spark):
    rows = [(1, "u", None, "x"), (None, None, page(f"<article><p>{SENTENCE}</p></article>"), "x"), (2, "u", "", "x"),
            (2, "u", "", "x"), (3, "u", page("<article>" + f"<p>{SENTENCE}</p>" * 20_000 + "</article>"), "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in h.extract(df).collect()}
    assert got[1].text == got[2].text == "" and got[None].text == SENTENCE and got[3].n_chars == 20_000 * (len(SENTENCE) + 1) - 1
    assert h.extract(df).count() == 5 and h.extract(df.limit(0)).count() == 0


LONG = " ".join([SENTENCE] * 8)


@pytest.mark.parametrize("body, want", [
    (f"<div id=content><h1>Title</h1><div class=entry><p>{LONG}</p><p>{LONG}</p></div></div>", f"Title {LONG} {LONG}"),
    (f"<div><h1>Title</h1><div class=meta>x</div><div><div><p>{LONG}</p><p>{LONG}</p></div></div></div>", f"Title {LONG} {LONG}"),
    *[(f"<div><p>Before it.</p>{a}{LONG}{LONG}{LONG}{b}<p>After it.</p></div>", f"Before it. {LONG}{LONG}{LONG} After it.")
      for a, b in [("<ol><li>", "</ol>"), ("<pre>", "</pre>"), ("<blockquote>", "</blockquote>")]],
    (f"<div><p>Before it.</p><table><tr><td>{LONG}<td>{LONG}<tr><td>{LONG}<td>{LONG}</table><p>After it.</p></div>",
     f"Before it. {LONG} {LONG} {LONG} {LONG} After it."),
    (f"<p>{SENTENCE}</p><div><p>{LONG}</p><p>{LONG}</p></div><p>{SENTENCE}</p>", f"{SENTENCE} {LONG} {LONG} {SENTENCE}")])
def test_siblings_of_the_longest_block(body, want):
    assert h.main_text(page(NOISE + body + TAIL)) == want


@pytest.mark.parametrize("name", ["content no-sidebar", "has-sidebar", "content-sidebar", "layout sidebar right"])
@pytest.mark.parametrize("open_, close", [("", ""), ("<article>", "</article>"), ("<main>", "</main>")])
def test_wrappers_with_a_boilerplate_name(name, open_, close):
    side = "<div class='sidebar'><p>Other stories that you may want to read.</p></div>"
    body = f"<div class='{name}'>{open_}<h1>Title</h1><p>{LONG}</p><p>{SENTENCE}</p>{close}{side}</div>"
    assert h.main_text(page(NOISE + body + TAIL)) == f"Title {LONG} {SENTENCE}"


def test_long_discussions_stay_out():
    talk = "<div id='comments'>" + f"<article class='comment'><p>{LONG}</p></article>" * 3 + "</div>"
    assert h.main_text(page(f"<article><p>{LONG}</p></article>{talk}")) == LONG
    assert h.main_text(page(f"<div><p>{LONG}</p><p>{SENTENCE}</p></div>{talk}")) == f"{LONG} {SENTENCE}"


PARAGRAPHS = "".join(f"<p>{SENTENCE} {k}</p>" for k in range(4))
TEXT = " ".join(f"{SENTENCE} {k}" for k in range(4))
NO_ARTICLE = [
    (f"<div>Home News Sport</div><div>{PARAGRAPHS}</div><div>All rights reserved 2020</div>", TEXT),
    (f"<ul><li><a href=a>Home</a><li><a href=b>News</a></ul><div><h1>Title</h1>{PARAGRAPHS}</div><table><tr><td>1<td>2</table>",
     f"Title {TEXT}"),
    (f"<div><ul><li><a href=a>Home</a><li><a href=b>News</a></ul>{PARAGRAPHS}<p>The end.</p></div>", f"{TEXT} The end."),
    (f"<div><div>{PARAGRAPHS}<div>Short</div>{PARAGRAPHS}</div></div><div>Contact us</div>", f"{TEXT} Short {TEXT}"),
    (f"<table><tr><td>Menu<td>{PARAGRAPHS}</table>", TEXT),
    (f"<form><div>Log in</div><div>{PARAGRAPHS}</div></form>", TEXT),
    (f"<form><input><article>{PARAGRAPHS}</article></form>", TEXT)]


@pytest.mark.parametrize("body, want", NO_ARTICLE)
def test_menus_without_names(body, want):
    assert h.main_text(page(body)) == want


def test_clusters_decide(monkeypatch):
    """With one cluster for all lines, menus and footers without names would stay."""
    monkeypatch.setattr(h, "threshold", lambda x: -1.0)
    assert sum(h.main_text(page(body)) != want for body, want in NO_ARTICLE) >= 4


def test_forum_posts_and_topics():
    posts = "".join(f"<div class=post><div>user{k}</div><p>{LONG}</p></div>" for k in range(3))
    got = h.main_text(page(f"<div>Board index</div><div id=thread>{posts}</div><div>Powered by x</div>"))
    assert got.count(SENTENCE) == 24 and "Board" not in got and "Powered" not in got
    named = f"<p class='social-science'>{SENTENCE}</p><section id='related-work'><p>{SENTENCE}</p></section>" \
            f"<section id='copyright'><p>{SENTENCE}</p></section><math>a = b</math>"
    assert h.main_text(page(f"<article>{named}<div class='ad-box'>{SENTENCE}</div></article>")) == f"{SENTENCE} {SENTENCE} {SENTENCE} a = b"


@pytest.mark.parametrize("part", ["<a ", "<b>", "<div>", "</b>", "<div></p>", "<td>", "<b><td></td>", "<header>", "<header><i>", "<!--", "<", "</",
                                  "<p class='ad'>", "&", "<a href='", "<!", "<?", "<li><b>", "x<p>"])
def test_malformed_pages_take_linear_time(part):
    import time
    start = time.perf_counter()
    h.main_text("<table><tr><td><div>" + part * 30_000)
    assert time.perf_counter() - start < 12
