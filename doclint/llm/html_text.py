"""Main text of web pages by text-to-tag ratio.

The standard library's parser streams each page once. Block elements cut the page into lines; every line has its text and
the number of tags met since the line before, hence a text-to-tag ratio. Ratios are smoothed along the page by a Gaussian
kernel, and a threshold (a share of their standard deviation) clusters lines into content and the rest. Lines in what the
markup declares as menu, advert, form, comment and the like are never content; inside an article, headings and names of
several words that are not all words of that list declare nothing. Every line of the content cluster is kept, inside and
outside articles. An article or main element with at least half of its characters in such lines is a content region and
kept whole; a page without any content line gives its articles.

Defined results: a null or empty page, or one without content, gives an empty text. Repeated rows are handled one by one.
Other columns of the input are neither read nor returned, so their names cannot clash. Broken markup never fails: the
parser is lenient, and an unclosed element ends with the element that holds it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
SKIPPED = frozenset(
    "head script style noscript template svg math iframe object canvas audio video select textarea button nav footer aside form "
    "menu dialog".split()
)
CONTENT = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose open twin ends where the next begins.
ENDS_TWIN = frozenset("p li dt dd option tr td th".split())
#: Words of class, id and role values that declare a part that is not the article.
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|promotion|nav|navbar|navigation|"
    r"menu|menubar|breadcrumb|breadcrumbs|sidebar|side|widget|related|share|sharing|social|comment|comments|reply|replies|disqus|"
    r"footer|header|masthead|cookie|cookies|consent|notice|notices|alert|popup|modal|newsletter|subscribe|signup|login|search|"
    r"pagination|pager|copyright|legal|disclaimer|skip|toolbar|complementary|contentinfo|dialog|form)(?:$|[\s_-])",
    re.I,
)
NAME_WORDS = re.compile(r"[_-]+")
WHITE = re.compile(r"\s+")
SIGMA = 1.0
THRESHOLD = 0.5


def declares(tag: str, name: str, value: str, inside: bool) -> bool:
    """Whether a class, id or role value names boilerplate; ``inside`` an article, only whole names count, and not on headings."""
    if not BOILERPLATE.search(value):
        return False
    if not inside or name == "role":
        return True
    return tag not in HEADINGS and any(all(BOILERPLATE.search(w) for w in NAME_WORDS.split(v.strip("_-"))) for v in value.split())


class Lines(HTMLParser):
    """Collects ``(text, tags, region)`` per line; region is -1 in declared boilerplate, the article's number from 1, else 0.

    Every piece of text has the region of the element it stands in: a declared piece inside a line is left out of it, and
    the line keeps the region of the others. A line of declared pieces alone is one of region -1.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int]] = []
        self.stack: list[tuple[str, int]] = [("", 0)]
        self.places: dict[str, list[int]] = {}  # where elements of each name stand in the stack
        self.holders: list[int] = [0]  # where articles stand in it
        self.blocks: list[int] = [0]  # where block elements stand in it
        self.parts: list[tuple[str, int]] = []
        self.tags = 0
        self.articles = 0

    def end_line(self) -> None:
        if self.parts:
            region = max(r for _, r in self.parts)
            text = WHITE.sub(" ", "".join(t for t, r in self.parts if r >= 0 or region < 0)).strip(" ")
            if not text and region >= 0:  # nothing but white space beside declared pieces
                region, text = -1, WHITE.sub(" ", "".join(t for t, _ in self.parts)).strip(" ")
            self.parts.clear()
            if text:
                self.lines.append((text, self.tags, region))
                self.tags = 0

    def open(self, tag: str, region: int) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in CONTENT:
            self.holders.append(len(self.stack))
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, region))

    def cut_stack(self, place: int) -> None:
        """End the element at a place, and all it holds."""
        for tag, _ in self.stack[place:]:
            self.places[tag].pop()
        del self.stack[place:]
        for places in (self.holders, self.blocks):
            while places[-1] >= place > 0:
                places.pop()

    def break_line(self) -> None:
        """A block ends the line, unless it lies in a declared element that stands inside the line."""
        if self.stack[-1][1] >= 0 or all(r < 0 for _, r in self.parts):
            self.end_line()

    def close(self) -> None:
        super().close()
        self.end_line()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in VOID:
            if tag == "br" or tag == "hr":
                self.parts.append((" ", self.stack[-1][1]))
            if tag == "hr":
                self.break_line()
            return
        if tag in BLOCK:
            if tag in ENDS_TWIN and self.stack[self.blocks[-1]][0] == tag:
                self.cut_stack(self.blocks[-1])
            self.break_line()
        declared = self.stack[-1][1]
        if declared >= 0:
            if tag in SKIPPED:
                declared = -1
            elif tag in CONTENT:
                if declared == 0:
                    self.articles += 1
                    declared = self.articles
            elif tag == "header" and declared == 0:
                declared = -1
            if declared >= 0 and tag not in ("main", "body", "html"):
                for name, value in attrs:
                    if value and (name == "class" or name == "id" or name == "role") and declares(tag, name, value, declared > 0):
                        declared = -1
                    elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                        declared = -1
        self.open(tag, declared)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("p", "div"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        places = self.places.get(tag)
        # a stray end inside an article does not end it, nor does a paragraph's end the blocks in it
        if places and (places[-1] >= self.holders[-1] or tag in CONTENT or tag == "body" or tag == "html") and (tag != "p" or places[-1] == self.blocks[-1]):
            self.cut_stack(places[-1])
        if tag in BLOCK or tag == "head":
            self.break_line()

    def handle_data(self, data: str) -> None:
        if self.stack[-1][0] not in ("script", "style"):
            self.parts.append((data, self.stack[-1][1]))


def smoothed(ratios: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing; the kernel is cut at three sigma and renormalised at the ends."""
    reach = math.ceil(3 * sigma)
    kernel = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(ratios)):
        low, high = max(0, i - reach), min(len(ratios), i + reach + 1)
        weights = kernel[low - i + reach : high - i + reach]
        out.append(sum(w * r for w, r in zip(weights, ratios[low:high], strict=True)) / sum(weights))
    return out


def main_text(html: str | None) -> str:
    """The content lines of one page, joined by line feeds."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    lines = parser.lines
    ratios = smoothed([len(text) / max(1, tags) for text, tags, _ in lines])
    mean = sum(ratios) / max(1, len(ratios))
    deviation = math.sqrt(sum((r - mean) ** 2 for r in ratios) / max(1, len(ratios)))
    threshold = min(mean, THRESHOLD * deviation)
    content = [region >= 0 and r >= threshold for (_, _, region), r in zip(lines, ratios, strict=True)]
    if not any(content):
        return "\n".join(text for text, _, region in lines if region > 0)
    weight: dict[int, int] = {}
    for (text, _, region), on in zip(lines, content, strict=True):
        weight[region] = weight.get(region, 0) + (len(text) if on else -len(text))
    return "\n".join(text for (text, _, region), on in zip(lines, content, strict=True) if on or (region > 0 and weight[region] >= 0))


def extract(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """``page_id, url, text`` for every page; pages are independent, so nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array((main_text(x.as_py()) for x in b.column(2)), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), texts], ["page_id", "url", "text"])

    chosen = pages.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    kind = chosen.schema["page_id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"page_id {kind}, url string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
