from html.parser import HTMLParser

import pytest

from tallyweave.llm import mainpath as M

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style></head><body class="has-comments">
<header><h1>Site</h1></header><nav><ul><li><a href="/a>b">menu</a></ul></nav>
<div id="cookie-notice"><p>We use cookies</p></div><div class="wrap"><div class="content post-17">
<h1>Head &lt;line&gt;</h1><p>First <b>bold</b>
 text&nbsp;here<br>after<p>Second&copy; para<script>x="</p>"</script> end<ul><li>one<li>two</ul>
<table><tr><td>c1<td>c2</table><div class="ad">Buy</div><form><p>mail</p><button>go</button></form>
<!-- gone --> tail 1 < 2 text</div><aside>side</aside></div>
<section id="comments"><div class="comment"><p>Reader one</p></div></section><footer>&copy; me</footer>"""
WANT = "Head <line>\nFirst bold text here after\nSecond© para end\none\ntwo\nc1\nc2\ntail 1 < 2 text"


class Article(HTMLParser):
    """Blocks inside <article>."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks, self.now = False, [], []

    def cut(self):
        text = " ".join("".join(self.now).split())
        if text:
            self.blocks.append(text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside = True
        if tag in ("p", "h1", "article"):
            self.cut()

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.cut()
        if tag == "article":
            self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.now.append(data)


def test_parts_that_are_not_the_article():
    assert M.extract(PAGE, None) == WANT
    page = M.parse(PAGE)
    assert page.paths[M.best_container(page)[0]] == "html>body.has-comments>div.wrap>div.content.post-0"


@pytest.mark.parametrize("name", ["related-work", "share-price", "has-sidebar", "social-security", "search-results-explained", "navigationSystem", "menu-of-the-day"])
def test_names_that_only_hold_a_word_stay(name):
    body = f"<div class='wrap'><div class='text'><p>{'first part of the article ' * 9}</p><section class='{name}'><p>second part</p></section></div></div>"
    for html in (f"<article>{body}</article>", body):
        assert M.extract(html, None).endswith("\nsecond part")


@pytest.mark.parametrize("name", ["related-posts", "share-buttons", "sidebar", "siteNav", "cookie_notice", "ad-slot-3", "comments", "post-comments", "site-header", "newsletter-box"])
def test_names_of_what_is_not_the_article_go(name):
    html = f"<body><div><p>{'first part of the article ' * 9}</p><div class='{name}'><p>second part</p></div></div></body>"
    assert M.extract(html, None) == ("first part of the article " * 9).strip()


def test_pages_of_links():
    assert M.extract("<body><ul><li><a href='/'>Home</a><li><a href='/u'>About us</a></ul></body>", None) == ""
    assert M.extract("<body><a href='/'>Home</a><article><a href='/x'>The whole story</a></article></body>", None) == "The whole story"


def test_heading_and_intro_beside_the_entry():
    entry = "<p>" + "the entry of the day " * 20 + "</p>"
    page = f"<body><div class='post'><h1>Heading</h1><p>Intro of some words</p><div class='entry'>{entry}</div></div><div class='misc'><p>other</p></div></body>"
    assert M.extract(page, None) == "Heading\nIntro of some words\n" + ("the entry of the day " * 20).strip()
    linked = f"<body><div class='post'><ul><li><a href='/'>One link</a></ul><div class='entry'>{entry}</div></div></body>"
    assert M.extract(linked, None) == ("the entry of the day " * 20).strip()


def test_very_long_page():
    text = "word " * 400_000
    assert M.extract(f"<body><nav>menu</nav><div><p>{text}</p></div></body>", None) == text.strip()


@pytest.mark.parametrize("html", ["", "<", "<p", "<p class='", "<!--", "<script>x", "</p></div>", "&", "<a b=\"c>d", "<li><li></ul><td>", "\x00<p>\x00", "<p>" * 3000 + "x"])
def test_odd_pages(html):
    text = M.extract(html, "html>body>article")
    assert isinstance(text, str)


def test_consensus_beats_a_page_of_its_own(spark):
    def page(body, extra):
        return f"<html><body><div class='story'><p>{body}</p></div><div class='misc'><p>{extra}</p></div></body></html>"

    rows = [(i, "http://h.org/x", page("long story text " * 20, "short")) for i in range(5)]
    rows += [(9, "https://H.org:80/y", page("brief", "a longer piece of other text " * 10)), (None, None, None), (9, "http://h.org/x", ""), (10, "odd", "<p>alone</p>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as path")
    for limit in (M.BROADCAST_HOSTS, 0):
        got = M.main_text(frame, limit).collect()
        assert sorted((r.text, r.n_chars) for r in got) == sorted([(("long story text " * 20).strip(), 319)] * 5 + [("brief", 5), ("", 0), ("", 0), ("alone", 5)])
    assert M.main_text(frame.limit(0)).count() == 0


def test_query_matches_another_parser(spark, sf_dir):
    from tallyweave.llm.queries import QUERIES

    want = {}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        p = Article()
        p.feed(r.html or "")
        p.close()
        p.cut()
        want[r.page_id] = "\n".join(p.blocks)
    got = {r.page_id: r.text for r in QUERIES["op10_main_text"](spark, sf_dir).collect()}
    assert got == want


@pytest.mark.parametrize("name", "commentlist user-comments reader-comments fb-comments wp-block-latest-comments adsbygoogle gpt-ad ad_300x250 topnav subnav cookieconsent userComments sidebarAds".split())
def test_names_that_join_words_go(name):
    body = f"<div class='wrap'><div class='text'><p>{'first part of the article ' * 9}</p><div class='{name}'><p>second part</p></div></div></div>"
    for html in (f"<article>{body}</article>", body):
        assert "second" not in M.extract(html, None)


@pytest.mark.parametrize("name", "heading loading advice address navigator commentary formula formation threads shared canvas adage subject listing toplist byline textbox".split())
def test_names_that_begin_like_a_word_stay(name):
    body = f"<div class='wrap'><div class='text'><p>{'first part of the article ' * 9}</p><div class='{name}'><p>second part</p></div></div></div>"
    assert M.extract(body, None).endswith("\nsecond part")
