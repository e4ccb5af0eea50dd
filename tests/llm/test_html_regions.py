"""The clusters choose the regions of a page, articles or not."""

from doclint.llm.html_text import main_text

PARAGRAPHS = [f"Paragraph {i} of the story is long enough to be told from cards by its share of text alone. " * 3 for i in range(6)]
STORY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)


def test_text_beside_teaser_articles_is_kept():
    card = "<article><h3><a href=x><b>Card</b></a></h3><p><a href=x><i>Go</i></a></p></article>"
    text = main_text(f"<html><body><div>{STORY}</div>{card * 8}</body></html>")
    assert text.split("\n")[:6] == [p.strip() for p in PARAGRAPHS]
    assert text.count("Card") < 2


def test_a_title_is_no_line_of_the_body():
    assert main_text(f"<html><head><title>{PARAGRAPHS[0]}</title></head><body><article>{STORY}</article></body></html>").count("Paragraph 0") == 3


def test_names_of_several_words_inside_an_article_are_content():
    page = '<article><h2 id="comments">Comments on it</h2>{0}<div id="how-to-share-files"><p>Shared files.</p></div><div class="comments"><p>first!</p></div><div class="social share"><p>likes</p></div></article>'
    text = main_text(page.format(STORY))
    assert "Comments on it" in text and "Shared files." in text
    assert "first!" not in text and "likes" not in text
