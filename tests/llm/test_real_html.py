"""Tags of real pages that the laid-out pages lack: no text after or inside them is lost."""

import time

import pytest

from pickwise.llm.html_blocks import blocks


@pytest.mark.parametrize(("source", "want"), [
    ('<p><a><svg></a>a</p><p>b', ["a", "b"]),
    ('<p>a</p><svg class="i"/><p>b</p>', ["a", "b"]),
    ("<p>a</p><video-player></video-player><p>b</p><select-box></select-box><p>c<title-bar>d</title-bar>e", ["a", "b", "c", "d", "e"]),
    ("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be.</p>", ["Let x=1 be."]),
    ("<p title=it's>a</p><p>b's</p>", ["a", "b's"]),
    ("<p don't>a</p><p>b's</p>", ["a", "b's"]),
    ("<p title=\"a>b\" class='c>d' id = \"e>\">a</p>", ["a"]),
    ("<p>a <svg viewBox='0'><title/><style/><path d=''><g></svg> b</p><div>c</div>d", ["a b", "c", "d"]),
    ("<svg><title>no</title><text>Figure</text></svg><p>b", ["Figure", "b"]),
    ("<p>a<svg><path><p>b<p>c</p>", ["a", "b", "c"]),
    ("<svg><foreignObject><div>a</div><p>b</p></foreignObject></svg><p>c", ["a", "b", "c"]),
    ("<noscript><p>a</p></noscript><video src=x><p>b</video><object>c</object><select><option>d<option>e</select><canvas>f", ["a", "b", "c", "d", "e", "f"]),
    ("<template><p>no<template>no</template>no</template><p>a", ["a"]),
    ("<script>'</scripts>'</script ><p>a<textarea>no</TEXTAREA>b", ["ab"]),
])
def test_no_text_is_lost(source, want):
    assert [b.text for b in blocks(source)] == want


def test_odd_quotes_take_no_way_back():
    start = time.process_time()
    for page in ("<a x=\"b\" " * 500, "<a x='" * 500, "<svg>" * 2000 + "<p>a"):
        blocks(page)
    assert time.process_time() - start < 30


def test_a_page_without_ends_of_tags_is_read_in_one_pass():
    start = time.process_time()
    assert len(blocks("<p>a</p>" + "<b it's \"" * 100_000)) == 2
    assert [b.text for b in blocks("<p>a</p> b <!-- c <b")] == ["a", "b"]
    assert time.process_time() - start < 2
