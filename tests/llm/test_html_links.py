"""Lists of links within an article are part of it; menus of the page aren't."""

import pytest

from skerry.llm import html_text

PROSE = "".join(f"<p>This is sentence {k} of the story, with a comma, some more words, and an end that is far away.</p>" for k in range(6))
LINKS = "".join(f"<li><a href='/{k}'>A reference with a title {k}</a></li>" for k in range(4))
ROWS = "".join(f"<tr><td><a href='/{k}'>A titled work {k}</a></td></tr>" for k in range(4))


@pytest.mark.parametrize("page", ["<body><article>{}</article></body>", "<body><main>{}</main></body>", "<body><div id='story'>{}</div></body>"])
def test_an_articles_links_are_kept(page):
    got = html_text.extract(page.format(PROSE + f"<ol>{LINKS}</ol><table>{ROWS}</table>" + PROSE))
    assert all(f"A reference with a title {k}" in got and f"A titled work {k}" in got for k in range(4)) and "sentence 5" in got


def test_menus_are_dropped():
    for page in (f"<body><ul>{LINKS}</ul>{PROSE}</body>", f"<body><article>{PROSE}<ul class='nav'>{LINKS}</ul></article></body>", f"<body><ul>{LINKS}</ul><article>{PROSE}</article></body>"):
        got = html_text.extract(page)
        assert "sentence 5" in got and "A reference" not in got


@pytest.mark.parametrize("name", ["content no-sidebar", "post has-comments", "layout with-sidebar", "entry ad-free"])
def test_layout_names_do_not_drop_an_article(name):
    body = "<p>Main text, that is long enough to count for something.</p><p>More of the main text.</p>"
    assert html_text.extract(f'<body><div class="{name}">{body}</div></body>') == "Main text, that is long enough to count for something.\nMore of the main text."


BODY = "<p>Main text, that is long enough to count for something.</p><p>More of the main text.</p>"
TEXT = "Main text, that is long enough to count for something.\nMore of the main text."


@pytest.mark.parametrize("page", ['<div class="main social">{}</div>', '<form id="page">{}<input><button>Send</button></form>', '<div class="layout-with-sidebar"><div>{}</div><div class="sidebar"><p>Other news of the day.</p></div></div>'])
def test_an_element_that_holds_the_article_stays(page):
    assert html_text.extract(f"<body>{page.format(BODY)}</body>") == TEXT


@pytest.mark.parametrize("aside", ['<div class="comments body">{}</div>', '<div class="sidebar">{}</div>', "<form>Write to us<p>Your words, which are many, go here.</p></form>"])
def test_longer_asides_are_still_left_out(aside):
    talk = "<p>What a reader has to say, at some length, about all of it.</p>" * 9
    assert html_text.extract(f"<body><div id='story'>{BODY}</div>{aside.format(talk)}</body>") == TEXT
