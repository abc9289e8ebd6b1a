"""Articles inside elements whose tag or class word marks what is never the article."""

import pytest

from octofold.llm import html_text

W = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore."
TEXT = f"<h1>Title</h1><p>{W}</p><p>{W} {W}</p><p>{W} {W} {W}</p><div class=ad><p>{W}</p></div>"
NAV, FOOT = "<nav><a href=1>Home</a><a href=2>More</a></nav>", "<footer><p>(c) me</p></footer>"
NOTES = f"<div class=comments><article class=comment><p>{W}</p></article><article class=comment><p>{W}</p></article></div>"
PAGES = {
    "form": f"<form>{NAV}<article>{TEXT}</article>{FOOT}</form>",
    "form without article": f"<form>{NAV}<div>{TEXT}</div>{FOOT}</form>",
    "class of a wrapper": f"{NAV}<div class='layout has-sidebar'><main>{TEXT}</main><div class=sidebar><p>{W}</p></div></div>{FOOT}",
    "id of a wrapper inside main": f"{NAV}<main><div id='content-sidebar-wrap'><article>{TEXT}</article>{NOTES}</div></main>",
    "class of the container": f"{NAV}<div class='post no-comments'>{TEXT}</div>{FOOT}",
    "two wrappers": f"<form>{NAV}<div class='layout has-sidebar'><article>{TEXT}</article></div></form>",
    "reader comments stay out": f"{NAV}<article>{TEXT}</article>{NOTES}{FOOT}",
}


@pytest.mark.parametrize("name", PAGES)
def test_wrapped_articles(name):
    got = html_text.TreeModel({}).text(f"<html><body>{PAGES[name]}</body></html>")
    assert got.split("\n") == ["Title", W, f"{W} {W}", f"{W} {W} {W}"]
