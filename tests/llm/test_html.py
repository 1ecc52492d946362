"""Operator 8 on templates whose article is known by construction."""

import itertools
import time

import pytest

from splitframe.llm import html_text

say = lambda n, w="word": " ".join([w] * n)
ARTICLE = f"<h1>Head</h1><p>{say(40)}</p><p>{say(30)}</p>"
TEXT = f"Head\n{say(40)}\n{say(30)}"
NAV = f"<nav><ul><li><a href=x>{say(3, 'menu')}</a></li></ul></nav>"
FOOT = f"<footer>{say(8, 'foot')}</footer>"
#: What fitting gives on pages with a menu, adverts, an article and a footer.
LEARNED = {"<a": -8.6, "<article": 6.9, "<b": 7.5, "<br": 7.5, "<div": -6.9, "<p": 9.2, "<h1": 6.9, "<li": -8.6, "<ul": -6.9, "a": -8.6, "article": 12.9, "b": 11.2, "div": -9.0, "div.ad": -9.0, "footer": -9.3, "h1": 9.1, "li": -8.6, "nav": -8.7, "p": 12.8, "ul": -8.6}
PAGES = {
    "names of the body": f'<body class="has-sidebar">{NAV}<article>{ARTICLE}</article>{FOOT}</body>',
    "names of the body, no article": f'<body class="has-sidebar no-js menu">{NAV}<div class=x>{ARTICLE}</div>{FOOT}</body>',
    "negated names": f'<body>{NAV}<div class="content no-sidebar">{ARTICLE}</div>{FOOT}</body>',
    "id of main": f'<body>{NAV}<main id="login-guide">{ARTICLE}</main>{FOOT}</body>',
    "id of main is furniture": f'<body>{NAV}<main id="menu">{ARTICLE}</main>{FOOT}</body>',
    "form around all": f"<body><form action=x>{NAV}<div>{ARTICLE}</div>{FOOT}</form></body>",
    "form around the article": f"<body><form action=x>{NAV}<article>{ARTICLE}</article>{FOOT}</form></body>",
    "header of the article": f'<article><div class="article-header"><h1>Head</h1></div><p>{say(40)}</p><p>{say(30)}</p></article>',
    "share price": f'<article><h1>Head</h1><p class="share-price">{say(40)}</p><p>{say(30)}</p></article>',
    "sidebar around the article": f'<body><div class="sidebar">{NAV}<article>{ARTICLE}</article></div>{FOOT}</body>',
    "long comments": f'<body><div class=post>{ARTICLE}</div><div id=comments>{say(500, "reader")}</div></body>',
    "comments are articles": f'<body><main>{ARTICLE}<section class=comments><article class=comment>{say(300, "reader")}</article></section></main></body>',
    "comment beside the article": f'<body><article>{ARTICLE}</article><article class="comment">{say(300, "reader")}</article></body>',
    "tables": f"<body>{NAV}<table><tr><td class=menu>{say(10, 'menu')}</td><td>{ARTICLE}</td></tr></table>{FOOT}</body>",
    "long aside": f'<body><article><h1>Head</h1><p>{say(40)}</p><aside>{say(90, "side")}</aside><p>{say(30)}</p></article></body>',
    "search in the header": f'<body><header>{say(5, "logo")}<form>{say(3, "search")}</form></header><div id=page><div id=main>{ARTICLE}</div><div id=sidebar-right>{say(50, "side")}</div></div></body>',
    "links in the article": f"<body><article><h1>Head</h1><p>{say(40)}</p><ul><li><a>{say(30)}</a></li></ul></article></body>",
    "list without an article": f"<body>{NAV}<div class=body><h1>Head</h1><p>{say(40)}</p><ul><li>{say(30)}</li></ul></div></body>",
    "notice": f'<body><div class="cookie-notice">{say(60, "cookie")}</div><div id="app">{ARTICLE}</div></body>',
    "adverts": f'<body><article><h1>Head</h1><p>{say(40)}</p><div class="ad-container">{say(60, "buy")}</div><p>{say(30)}</p></article><div class="related-posts widget">{say(30, "other")}</div></body>',
}


@pytest.mark.parametrize("weights", [LEARNED, {}], ids=["learned", "none"])
@pytest.mark.parametrize("page", PAGES)
def test_whole_articles(page, weights):
    assert html_text.article(PAGES[page], weights) == TEXT


BODIES = ["", ' class="home blog logged-in has-header-image"', ' class="single-post with-sidebar notice-hidden"', ' id="login"', ' class="page menu-open no-comments"']
HOLDERS = [
    '<div class="site"><div class="entry-content post-body">{}</div></div>', '<div id="wrapper"><section class="story-text">{}</section></div>', '<main class="site-main">{}</main>',
    '<article class="post type-post hentry ad-free">{}</article>', '<form id="aspnetForm"><div class="layout-with-sidebar">{}</div></form>', '<div role="main" class="mw-body no-toolbar">{}</div>',
    '<div class="container"><div class="row"><div class="col-md-8">{}</div></div></div>', '<section class="popup-free modal-off">{}</section>', '<div class="td-post-content comments-closed"><div>{}</div></div>', '<main class="widget-less"><article>{}</article></main>',
]
AROUND = [
    (f'<header class="site-header">{say(6, "logo")}</header><div class="main-navigation">{say(14, "menu")}</div>', f'<div class="widget-area"><div class="widget">{say(20, "widget")}</div></div><div class="comment-list">{say(90, "reader")}</div><div class="site-footer">{say(12, "foot")}</div>'),
    (f'<ul id="nav"><li><a>{say(9, "menu")}</a></li></ul><div id="cookie-banner">{say(25, "cookie")}</div>', f'<div class="social-share">{say(5, "share")}</div><aside>{say(40, "side")}</aside><div id="footer">{say(15, "foot")}</div>'),
]


@pytest.mark.parametrize("weights", [LEARNED, {}], ids=["learned", "none"])
def test_templates_of_other_names(weights):
    """A hundred pages by bodies, holders and furniture with names that no labelled page has."""
    for body, holder, (before, after) in itertools.product(BODIES, HOLDERS, AROUND):
        page = f"<html><head><title>no</title></head><body{body}>{before}{holder.format(ARTICLE)}{after}</body></html>"
        assert html_text.article(page, weights) == TEXT, page


def test_labelled_pages_tell_names_apart(spark):
    """Boxes that labelled pages have outside of their articles are furniture, even if their name usually means content."""
    pages = [(k, f'<body><div class="teaser">{say(30, "teaser")}</div><div class="story">{say(30, "more")}</div><article><p>{say(20)}</p><div class="zzz">{say(30)}</div></article></body>') for k in range(40)]
    learned = html_text.fit(spark.createDataFrame(pages, "page_id long, html string"))
    page = '<body><div class="teaser">{}</div><section><p>{}</p><div class="zzz">{}</div></section><div class="story">{}</div></body>'.format(say(9, "teaser"), say(20), say(9), say(50, "more"))
    assert html_text.article(page, learned) == f"{say(20)}\n{say(9)}"
    assert html_text.article(page, {}).split("\n") == [say(9, "teaser"), say(20), say(9), say(50, "more")]


@pytest.mark.parametrize("make", [lambda n: "<p><div>" + "<b>" * n + "<p>x</p>" * n, lambda n: "<a b=\"'>" * n, lambda n: "<div class='menu'>x" * n, lambda n: "<article>x<p>" * n + "</p></article>" * n], ids=["inline", "quotes", "furniture", "articles"])
def test_time_doubles_at_most(make):
    def took(n):
        began = time.process_time()
        html_text.article(make(n), LEARNED)
        html_text.label_counts(make(n))
        return time.process_time() - began

    took(500)
    assert took(8000) < 3 * took(4000) + 0.2
