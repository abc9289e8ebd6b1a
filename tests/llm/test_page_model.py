"""The tree model decides: pages without tags or class words that mark anything, and hostile pages."""

import time
from collections import Counter

import pytest
from helpers import save

from octofold.llm import html_text

WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt".split()


def sentence(k, n=12):
    return " ".join(WORDS[(k + 3 * i) % len(WORDS)] for i in range(n)).capitalize() + "."


def links(k):
    return "".join(f"<li><a href={i}>{WORDS[(k + i) % len(WORDS)]}</a></li>" for i in range(5))


def labelled(k):
    paragraphs = "".join(f"<p>{sentence(k + i, 8 + 5 * i)}</p>" for i in range(4))
    return f"<html><body><div class=qx><ul>{links(k)}</ul></div><article><h2>{sentence(k, 3)}</h2>{paragraphs}</article><div class=zz>{sentence(k, 5)}</div></body></html>"


@pytest.fixture(scope="module")
def learnt():
    counts = Counter()
    for k in range(60):
        counts.update(html_text.Page(labelled(k)).cases())
    return html_text.TreeModel(counts)


BARE = f"<div><ul>{links(3)}</ul></div><div><h2>A title</h2><p>{sentence(1, 20)}</p><p>{sentence(2, 30)}</p><p>{sentence(4, 18)}</p></div><div class=zz>{sentence(5, 5)}</div>"


def test_pages_without_marks(learnt):
    """No article, no word of the built-in lists: links, lengths, and the learnt class word decide."""
    want = ["A title", sentence(1, 20), sentence(2, 30), sentence(4, 18)]
    assert learnt.text(f"<html><body>{BARE}</body></html>").split("\n") == want
    bare = f"<html><body><ul>{links(1)}</ul><p>{sentence(1, 20)}</p><p>{sentence(2, 30)}</p></body></html>"
    assert learnt.text(bare).split("\n") == [sentence(1, 20), sentence(2, 30)]


def test_what_was_learnt_changes_the_result(learnt):
    """Without counts, and with labels turned round, the same pages give other texts."""
    page = f"<html><body>{BARE}</body></html>"
    inside = f"<html><body><article><p>{sentence(1, 20)}</p><div class=zz>{sentence(5, 5)}</div></article></body></html>"
    assert learnt.text(inside) == sentence(1, 20) != html_text.TreeModel({}).text(inside)
    swap = {html_text.CONTENT: html_text.BESIDE, html_text.BESIDE: html_text.CONTENT, html_text.AROUND: html_text.AROUND}
    counts = Counter()
    for k in range(60):
        for kind, value, label in html_text.Page(labelled(k)).cases():
            counts[kind, str(swap[int(value)]) if kind.startswith("edge") else value, swap[label]] += 1
    assert html_text.TreeModel(counts).text(page) != learnt.text(page)


def test_negatives_have_text_features(learnt):
    """What is beside the article shows short, linked text in the counts, not only class words."""
    content, beside = (learnt.seen["text", "short, most links, no sentence"][i] for i in (html_text.CONTENT, html_text.BESIDE))
    assert beside > 2 * content
    assert learnt.seen["word", "zz"][html_text.BESIDE] == 1.0 > learnt.seen["word", "zz"][html_text.CONTENT]


def test_inline_elements_and_formulas():
    text = "<article><p>one <span class=ad>buy</span> <math><mi>x</mi></math> two</p></article>"
    assert html_text.TreeModel({}).text(text) == "one x two"


@pytest.mark.parametrize("mark", ['style="overflow:hidden"', 'aria-hidden="false"', 'title="The hidden gem"', 'data-id="ads"', 'data-grid="comments"', "data-class=sidebar", 'onclick="menu(\'footer\')"', 'alt=\'class="ad"\'', 'data-role = "navigation"', "nohidden", 'x="hidden"'])
def test_only_class_id_and_role_mark(learnt, mark):
    """Words of other attributes' names and values say nothing, with or without a model."""
    body = "".join(f"<p>{sentence(k, 14)}</p>" for k in range(8))
    want = "\n".join(["A heading here", *[sentence(k, 14) for k in range(8)]])
    for model in (learnt, html_text.TreeModel({})):
        assert model.text(f"<html><body><div {mark}><h1>A heading here</h1>{body}</div></body></html>") == want
        inside = f"<div class=article><p {mark}>{sentence(1, 14)}</p><p>{sentence(2, 14)}</p></div>"
        assert model.text(f"<html><body>{inside}</body></html>") == f"{sentence(1, 14)}\n{sentence(2, 14)}"


@pytest.mark.parametrize("mark", ["hidden", "hidden=''", 'class="ad box"', "id = sidebar", "ROLE='navigation'", 'data-a="1" class=menu', "title='x' hidden"])
def test_marks_still_work(learnt, mark):
    page = f"<html><body><article><p>{sentence(1, 14)}</p><div {mark}><p>{sentence(3, 14)}</p></div></article></body></html>"
    assert learnt.text(page) == html_text.TreeModel({}).text(page) == sentence(1, 14)


def test_query_learns_from_its_pages(spark, tmp_path):
    """The registered query on pages with an article, and on pages whose only sign is a class word
    that those never have inside: the learnt model leaves it out, the unlearnt one does not."""
    body = lambda k: "".join(f"<p>{sentence(k + i, 12 + 5 * i)}</p>" for i in range(4))
    told = [f"<html><body><div class=kasten>{sentence(k, 9)}</div><article><h2>{sentence(k, 3)}</h2>{body(k)}</article></body></html>" for k in range(80)]
    bare = f"<html><body><div><h2>A title</h2><p>{sentence(5, 30)}</p><p>{sentence(6, 20)}</p></div><div class=kasten>{sentence(1, 11)}</div></body></html>"
    want = f"A title\n{sentence(5, 30)}\n{sentence(6, 20)}"
    pages = [*told, bare]
    folder = save(tmp_path, pages={"page_id": list(range(81)), "url": ["u"] * 81, "html": pages})
    got = {r.page_id: r.text for r in html_text.op2_html_text(spark, folder).collect()}
    assert got[80] == want != html_text.TreeModel({}).text(bare)
    assert all(got[k].split("\n") == [sentence(k, 3), *(sentence(k + i, 12 + 5 * i) for i in range(4))] for k in range(80))


HOSTILE = {
    "tags that never end": "<a " * 330_000,
    "deep classes": "<div class=x>" * 77_000,
    "open pictures": "<svg>" * 200_000,
    "open inline elements": "<div>" + "<b class=x>" * 50_000 + "</i>" * 50_000,
    "cells": "<td><table>" + "<div>" * 60_000 + "<td></td>" * 60_000,
    "quoted ends": '<a ">" ' * 140_000,
    "only signs": "<" * 1_000_000,
    "spans before blocks": "<p>" + "<span class=x>" * 40_000 + "<div></div>" * 40_000,
    "comments": "<!--" * 250_000,
    "scripts that never end": "<script>" + "</script " * 100_000,
    "scripts that end late": "<script>" + "</script " * 50_000 + ">" + "<script>" + "</script " * 50_000,
    "styles without sign": "<style>" * 60_000 + "</style" * 60_000,
    "attributes": "<div " + "a = " * 200_000 + "><p>x</p></div>",
    "open quotes": "<div " + "a=\"b c='" * 60_000 + ">",
    "references": "&" * 1_000_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_linear_time(learnt, name):
    half, whole = HOSTILE[name][: len(HOSTILE[name]) // 2], HOSTILE[name]
    took = []
    for source in (half, whole):
        began = time.process_time()
        learnt.text(source)
        took.append(time.process_time() - began)
    assert took[1] < max(1.0, 4 * took[0]) and took[1] < 10
