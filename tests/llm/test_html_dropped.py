"""Wrappers that only name a sidebar, hold the word hidden or are a form around the page keep its content."""

import pytest

from tallyframe.llm.html_text import Page


def text(html):
    return "\n".join(t for t, _ in Page(f"<html><body>{html}</body></html>").main())


STORY = "<h1>Head</h1><p>The story.</p>"


@pytest.mark.parametrize("html", [
    f'<div class="content-sidebar-wrap"><main>{STORY}</main></div><p>x</p>',
    f'<div class="has-sidebar content"><article>{STORY}</article></div>',
    f'<div id="page-with-sidebar">{STORY}</div>',
    f'<div class="sidebar"><main>{STORY}</main><div class="ad">buy</div></div>',
    f'<div class="widget"><article>{STORY}</article></div><div>(c)</div>',
    f'<article data-title="The hidden cost of x" data-a=hidden>{STORY}</article>',
    f'<article class="post comments-open">{STORY}</article>',
    f'<form id="all"><input name="q"><main>{STORY}</main><footer>f</footer></form>',
    f'<form id="all"><div class="nav">menu</div><select><option>1</select>{STORY}</form><footer>f</footer>',
    f'<div class="widget"><form><div role="main">{STORY}</div></form></div>',
])
def test_content_stays(html):
    assert text(html) == "Head\nThe story."


@pytest.mark.parametrize("html", [
    '<div class="site-footer">x</div>', '<div class="box sidebar">x</div>', '<div id="widget-12">x</div>',
    '<div class="cookie-notice">x</div>', "<form><p>x</p></form>", "<div hidden>x</div>", "<div HIDDEN=''><main>x</main></div>",
    '<aside><article>x</article></aside>', '<div class="related"><article>x</article></div>',
    '<div class="comments"><article class="comment-body">x</article></div>', '<article class="comment">x</article>',
])
def test_no_content_goes(html):
    assert text(f"{html}<article>{STORY}</article>{html}") == "Head\nThe story."
    assert text(f"{html}{STORY}{html}") == "Head\nThe story."
