"""Furniture is known by whole attributes and names; article text with such words in slugs and values stays."""

import pytest

from tessera.llm import html_text

LINKS = "".join(f'<li><a href="/{i}">Entry {i}</a></li>' for i in range(8))


@pytest.mark.parametrize("page", ["<body><article><p>First words.</p>{}</article></body>", "<body><div><p>First words.</p>{}</div></body>"])
@pytest.mark.parametrize(
    "part",
    [
        '<h2 id="discussion">Kept text</h2>', '<section id="discussion"><p>Kept text</p></section>', '<section id="related-work"><p>Kept text</p></section>', '<div class="social-history"><p>Kept text</p></div>',
        '<section id="notice-period"><h3 id="search">Kept text</h3></section>', '<p id="side-effects">Kept text</p>', '<div id=search-methods><p>Kept text</p></div>', '<p title="the hidden valley">Kept text</p>',
        '<p><a title="Hidden Figures" href="/hidden/x">Kept text</a></p>', '<p aria-hidden="false">Kept text</p>', "<p data-class='ad' data-id=sidebar>Kept text</p>", '<p title="class=ad hidden">Kept text</p>', '<h2 id="comments">Kept text</h2>',
    ],
)
def test_article_text_stays(page, part):
    assert html_text.main_text(page.format(part)) == "First words. Kept text"


@pytest.mark.parametrize("part", ['<p hidden>x</p>', '<p HIDDEN="">x</p>', '<p class="a hidden-x" hidden=until-found>x</p>', '<div class="b cookie-bar">x</div>', "<div id=sidebar-left>x</div>", f'<div class="related-posts"><ul>{LINKS}</ul></div>', f'<div id="social"><ul>{LINKS}</ul></div>', '<div class="social-share-widget">x</div>', '<div role="search">x</div>', "<div class=ad>x</div>"])
def test_furniture_goes(part):
    assert html_text.main_text(f"<body><article><p>First words.</p>{part}</article></body>") == "First words."
