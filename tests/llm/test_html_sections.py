"""Articles over several containers, on pages without <article> or <main>."""

from tessera.llm import html_text

PARAGRAPH = "Some words of an article that are as long as in any other of its paragraphs, and no link."
MENU = "<ul>" + "".join(f'<li><a href="/{i}">Entry {i}</a></li>' for i in range(8)) + "</ul>"


def p(n):
    return f"<p>{PARAGRAPH}</p>" * n


def text(*parts):
    return " ".join(PARAGRAPH if x is p else x for x in parts)


def test_sibling_containers_with_a_heading():
    page = f"<html><head><title>x</title></head><body>{MENU}<div id=c><h1>The title</h1><div>{p(6)}</div><div>{p(3)}</div></div></body></html>"
    assert html_text.main_text(page) == text("The title", *[p] * 9)


def test_sections_right_under_the_body():
    page = f"<body>{MENU}<h1>The title</h1><section><h2>One</h2>{p(2)}</section><p>Short.</p><section><h2>Two</h2>{p(5)}</section><div><div><h2>Three</h2>{p(2)}</div></div>{MENU}</body>"
    assert html_text.main_text(page) == text("The title", "One", p, p, "Short.", "Two", *[p] * 5, "Three", p, p)


def test_menus_next_to_one_container_stay_out():
    page = f"<body><div>{MENU}</div><div><h1>The title</h1>{p(4)}</div><div>{MENU}</div></body>"
    assert html_text.main_text(page) == text("The title", *[p] * 4)
