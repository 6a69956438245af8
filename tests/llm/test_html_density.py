"""Densities against their definition, and that they decide."""

import html
import math
import re
from xml.etree import ElementTree

import pyarrow.parquet as pq
import pytest

from tessera.llm import html_text

PAGES = "/root/testdata/sf0.01/pages.parquet"


def sources():
    return pq.read_table(PAGES).column("html").to_pylist()


def article(source):
    inner = re.search(r"<article>(.*?)</article>", source, re.DOTALL)[1]
    flat = re.sub(r"<(/?)(\w+)[^>]*>", lambda m: "" if m[2] in ("b", "i", "a", "em") else " ", inner)
    return " ".join(html.unescape(flat).split())


def by_definition(node, page):
    """Density of an element: (C / T) log_B((C T) / (LC LT)), with B = ln(C LC / (C - LC) + page C + e)."""
    size = lambda x: len("".join("".join(x.itertext()).split()))
    c, t = size(node), len(list(node.iter())) - 1
    links = [x for x in node.iter("a") if x is not node]
    lc, lt = (c, t) if node.tag == "a" else (sum(map(size, links)), len(links))
    base = math.log(c * lc / max(1, c - lc) + page * c + math.e)
    if not c or base <= 1 + 1e-9:
        return c / max(1, t)
    return c / max(1, t) * math.log(c * max(1, t) / (max(1, lc) * max(1, lt)), base)


def test_densities_equal_their_definition(monkeypatch):
    seen = []
    real = html_text.densities
    monkeypatch.setattr(html_text, "densities", lambda *a: seen.append(real(*a)) or seen[-1])
    long, menu = "Words of a paragraph that are many. " * 5, "<ul>" + '<li><a href="/">An entry</a></li>' * 6 + "</ul>"
    for page in (f"<body><div><h1>Title</h1><p>{long}</p><p>{long}<a href='x'>a link</a></p></div><div>{menu}</div></body>", f"<body><div><p>{long}</p><p><b>{long}</b><br/>x</p></div></body>"):
        root = ElementTree.fromstring(page)
        size = lambda x: len("".join("".join(x.itertext()).split()))
        share = sum(map(size, root.iter("a"))) / size(root)
        html_text.main_text(page)
        assert seen[-1][1:] == pytest.approx([by_definition(x, share) for x in root.iter()])


def test_articles_of_any_tag():
    for s in sources():
        for tag in ("article", "div", "section"):
            assert html_text.main_text(s.replace("<article>", f"<{tag}>").replace("</article>", f"</{tag}>")) == article(s)
        bare = s.replace("<article>", "").replace("</article>", "")
        wrapped = re.sub(r"<article>(<h1>.*?</h1>)(.*?)</article>", r"<div id=page>\1<div>\2</div></div>", s, flags=re.DOTALL)
        assert html_text.main_text(bare) == html_text.main_text(wrapped) == article(s)


def test_densities_decide(monkeypatch):
    """Nameless furniture, which no name list knows."""
    entries = "".join(f"<div><a href='/{i}'>Entry {i}</a> of it</div>" for i in range(9))
    pages = [re.sub(r"<article>(.*?)</article>", rf"<div>{entries}</div><div>\1</div>", s, flags=re.DOTALL) for s in sources()]
    wanted = [article(s) for s in sources()]
    right = sum(html_text.main_text(p) == w for p, w in zip(pages, wanted, strict=True))
    assert right > 0.9 * len(pages)
    monkeypatch.setattr(html_text, "densities", lambda chars, *_: [0.0] * len(chars))
    assert not any(html_text.main_text(p) == w for p, w in zip(pages, wanted, strict=True))


def test_a_class_that_says_notice_alone():
    body = "<body><div><p>The first words of it.</p>{}</div></body>"
    for part in ("<div class='notice'>We use cookies.</div>", "<p class=site-notice>Read this.</p>", "<div class='share-buttons'>Tell others</div>"):
        assert html_text.main_text(body.format(part)) == "The first words of it."


def test_missing_ends_take_no_square():
    assert html_text.main_text("<p>a</p>" + "<![CDATA[ x > " * 200_000).startswith("a")
    assert html_text.main_text("<p>a</p><![CDATA[ x > ]]>b") == "a b"
