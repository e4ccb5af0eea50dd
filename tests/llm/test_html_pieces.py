"""Declared pieces inside lines, stray ends, and pages of many open tags."""

import time

import pytest

from doclint.llm.html_text import main_text

FILL = "<p>" + "Plain sentences fill the page so that it has a body. " * 3 + "</p>"


@pytest.mark.parametrize("line,want", [
    ("<p>text <span class='advert'>BUYNOW</span> <button>SHAREBTN</button> <noscript>NOSCR</noscript></p>", "text"),
    ("<p>one <span class='ad'>x</span>two</p>", "one two"),
    ("<div>LOSTTEXT is here <span class='comments'><div>x</div></span></div>", "LOSTTEXT is here"),
    ("<div>before <form><p>name</p></form> after</div>", "before\nafter"),
    ("<p>a<br>b <select><option>no</select> c</p>", "a b c"),
    ("<p>first <span class='ad'>x</p><p>second</p>", "first\nsecond"),
    ("<p>first <span class='ad'>x<p>second</p>", "first\nsecond"),
    ("<p>first <span class='ad'><div>x</div> y</span> rest</p>", "first rest"),
    ("<p><b>bold</i> still</b> text</p>", "bold still text"),
    ("<ul><li>one<li>two <span class='notice'>!</span></ul>", "one\ntwo"),
    ("<p><span class='advert'>only</span></p>", ""),
    ("<p>x</div></div></section> y</p>", "x\ny"),
])
def test_declared_pieces_are_dropped_and_text_is_not(line, want):
    text = main_text(f"<body><article>{FILL}{line}{FILL}</article></body>")
    fill = "Plain sentences fill the page so that it has a body. " * 3
    assert text.split("\n") == [fill.strip(), *([want] if want and "\n" not in want else want.split("\n") if want else []), fill.strip()]


def test_text_outside_articles_with_inline_boilerplate():
    page = f"<body><div id='menu'><a>x</a></div><div>{FILL}<p>Kept words <em class='share-box share'>Tweet</em> and more of the same sentence here.</p>{FILL}</div></body>"
    assert "Kept words and more of the same sentence here." in main_text(page) and "Tweet" not in main_text(page)


@pytest.mark.parametrize("page", [
    "<b>" * 120_000 + "</i>" * 120_000 + "end", "<b>" * 80_000 + "<article>" + "<i>" * 80_000 + "</b>" * 80_000 + "end",
    "<div>" * 150_000 + "x", "<p><span>" * 80_000 + "</p>" * 80_000 + "x", "</div>" * 150_000 + "x",
])
def test_a_page_of_open_tags_takes_linear_time(page):
    started = time.process_time()
    main_text(page)
    assert time.process_time() - started < 4
