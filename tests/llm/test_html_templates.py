"""Main text on templates of several kinds: what must stay, what must go, and the hosts' votes by brute force."""

import collections

import pytest

from matchlake.llm.html_extract import Page, host_of, main_texts, winning_paths
from pyspark.sql import functions as F

SAID = ["A title of some words", "First paragraph, of some length and words.", "Second paragraph, of some length and words too."]
WANT = "\n\n".join(SAID)
INNER = f"<h1>{SAID[0]}</h1><p>{SAID[1]}</p><p>{SAID[2]}</p>"
ARTICLE = f"<article>{INNER}%s</article>"


@pytest.mark.parametrize("name", ["layout-with-sidebar", "social-science-article", "search-results-page", "page login-enabled", "has-comments", "widget", "noAds", "main-ad-free-area"])
@pytest.mark.parametrize("inside", [ARTICLE % "", INNER, f"<main>{INNER}</main>"])
def test_article_in_a_container_of_any_name(name, inside):
    page = f'<html><body><nav>a b c</nav><div class="{name}">{inside}</div><div class="ad">buy things now, it is cheap and good</div></body></html>'
    assert Page(page).text(None) == WANT


@pytest.mark.parametrize("name", ["ad-300x250", "adsbygoogle", "google-ad", "div-gpt-ad-1", "user-comments", "comment-thread", "cookie-message", "newsletter-signup-prompt", "main-menu-de", "author-box related-stories", "sidebarLeft", "share-buttons"])
def test_left_out_of_an_article_by_name(name):
    junk = f'<div class="{name}"><p>Something else, that is no part of it</p></div>'
    assert Page("<body>" + ARTICLE % junk).text(None) == WANT == Page("<body>" + ARTICLE % junk.replace("class", "id")).text(None)


@pytest.mark.parametrize("junk", ['<div style="color:red; display:none">hid</div>', '<p>x</p>'.replace("<p>", '<p style="visibility:hidden">'), "<div hidden>hid</div>", '<aside>hid</aside>', '<div role="navigation">hid</div>', '<form>Name <input></form>', '<div aria-hidden="true">hid</div>'])
def test_left_out_of_an_article_by_tag_role_or_style(junk):
    assert Page("<body>" + ARTICLE % junk).text(None) == WANT


TEMPLATES = {
    "one form around the page": "<body><form id=aspnet>" + ARTICLE % "" + "<input></form>",
    "title beside the container": f"<body><div><h1>{SAID[0]}</h1></div><div class='content'><p>{SAID[1]}</p><p>{SAID[2]}</p></div>",
    "long comments in a section": "<body>" + ARTICLE % "" + '<section class="comments">' + "<p>a long comment, with words</p>" * 50 + "</section>",
    "long comments in a page": f"<body><div class='page'><div class='post'>{INNER}</div><div id='comments'><div class='comment'><p>" + "a long comment, with words " * 50 + "</p></div></div></div>",
    "table layout": f"<body><table><tr><td class='menu'><a href=a>a</a> <a href=b>b</a></td><td>{INNER}</td></tr></table>",
    "blog theme": f"<body class='single-post'><div id='page' class='site'><header id='masthead'><h1>Site</h1></header><div id='content' class='site-content'><main id='main'><article id='post-9'><header class='entry-header'><h1 class='entry-title'>{SAID[0]}</h1></header><div class='entry-content'><p>{SAID[1]}</p><p>{SAID[2]}</p></div><footer>filed under x</footer></article></main></div><aside id='secondary' class='widget-area'><p>about, me, and, more, words, here</p></aside></div>",
    "hidden span": f"<body><article><h1>{SAID[0]}</h1><p>{SAID[1]}<span style='display:none'> not seen</span></p><p>{SAID[2]}</p></article>",
    "old markup": f"<BODY><CENTER><H1>{SAID[0]}</H1></CENTER><P>{SAID[1]}<P>{SAID[2]}",
}


@pytest.mark.parametrize("name", TEMPLATES)
def test_templates(name):
    assert Page(TEMPLATES[name]).text(None) == WANT


def test_nothing_but_parts_that_go():
    for page in ('<div class="cookie-notice">We use cookies, and more cookies, here and there</div>', '<nav>menu of many things, and so on</nav>', '<div class="comments"><p>a long comment, with words, and words</p></div>', ""):
        assert Page(page).text(None) == ""


def test_votes_by_brute_force(spark):
    """The winning path of a host is the one most of its pages vote for, and pages are read at it."""
    pages = [(k, f"http://h{k % 3}.x/{k}", page) for k, page in enumerate([*TEMPLATES.values()] * 4)]
    votes = collections.defaultdict(collections.Counter)
    for _, url, source in pages:
        page = Page(source)
        at, score = page.best()
        if at:
            votes[url.split("/")[2]][page.path(at)] += 1
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    won = {r.host: r.path for r in winning_paths(frame).collect()}
    assert set(won) == set(votes) and all(votes[h][p] == max(votes[h].values()) for h, p in won.items())
    for r in main_texts(frame).collect():
        assert r.text == Page(pages[r.page_id][2]).text(won[f"h{r.page_id % 3}.x"]) and r.n_chars == len(r.text)
    assert frame.select(host_of(F.col("url"))).distinct().count() == 3
