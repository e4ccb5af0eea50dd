"""WordprocessingML parts to text and layout signals (L1-L4).

Input is ``doc_parts(doc_id, part_no, part_name, xml)``: unpacked parts of a document package.
A part is read inside its row: its tokens pass through one state machine that carries the fallback
depth, the run depth, whether text is shown, and the layout counts.  Text and layout come from that
one pass without any shuffle; a package costs one, of its parts' results.  Where fallbacks are not
nested, and runs not deeper than in text boxes, as in most parts, the machine has so few states that patterns
over the whole part do its work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.folds import fold_in_blocks
from ..functions.text import let, normalize_text

# Part names and markup
BODY_PART = r"^word/document\d*\.xml$"
HEADER_FOOTER_PART = r"^word/(?:header|footer)\d*\.xml$"
MEDIA_PART = r"^word/media/[^/]+$"
CONTENT_TYPES = "[Content_Types].xml"
NAMES = r"mc:Fallback|w:(?:r|t|tab|noBreakHyphen|br|cr|p|tc|tbl|txbxContent|cols)"
# group 1: the tags that count, and text; other tags and a lone "<" match without it
TOKEN = rf"(</?(?:{NAMES})(?![\w:.-])[^<>]*>|[^<]+)|<[^<>]*>|<"
WIDE_COLUMNS = r'(?<![A-Za-z0-9_])w:num="(\d{1,3})"'
ENTITY = r"&(?:#x[0-9a-fA-F]{1,6}|#[0-9]{1,7}|lt|gt|amp|quot|apos);"


def decode_entities(text: Column, apart: str = "") -> Column:
    """L2: named and numeric entities, decoded in one pass; invalid code points vanish, and so does the mark ``apart`` between pieces."""
    def code_point(name: Column) -> Column:
        hexed = name.startswith("#x")
        code = F.when(hexed, F.conv(F.substring(name, 3, 8), 16, 10)).otherwise(F.substring(name, 2, 8)).cast("bigint")
        valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(valid, char).otherwise("")

    def value(entity: Column) -> Column:
        name = F.substring(entity, 2, F.length(entity) - 2)
        return (
            F.when(name == "lt", "<").when(name == "gt", ">").when(name == "amp", "&")
            .when(name == "quot", '"').when(name == "apos", "'").otherwise(code_point(name))
        )

    def build(t: Column) -> Column:
        plain = F.transform(F.split(t, ENTITY), joined) if apart else F.split(t, ENTITY)
        coded = F.transform(F.regexp_extract_all(t, F.lit(ENTITY), F.lit(0)), value)
        woven = F.zip_with(plain, coded, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
        return F.array_join(woven, "")

    joined = lambda t: F.replace(t, F.lit(apart), F.lit("")) if apart else t
    return let(text, lambda t: F.when(F.contains(t, F.lit("&")), build(t)).otherwise(joined(t)))


def read_part(xml: Column) -> Column:
    """L1 and L3: ``struct<text, tables, text_boxes, columns>`` of one part."""
    return let(without_fallbacks(xml), lambda m: let(
        F.struct(m["flat"].alias("flat"), _marked(m["seen"]).alias("marked"), m["seen"].alias("seen")),
        lambda r: F.when(r["flat"] & ~_nested(r["marked"], RUN_ON, RUN_OFF), F.struct(
            _shown_text(r["marked"]).alias("text"), F.regexp_count(r["seen"], F.lit(_tag("<w:tbl"))).alias("tables"),
            F.regexp_count(r["seen"], F.lit(_tag("<w:txbxContent"))).alias("text_boxes"),
            F.exists(F.regexp_extract_all(r["seen"], F.lit(_tag("<w:cols")), F.lit(0)), _wide).alias("columns"),
        )).otherwise(folded_part(xml)),
    ))


# ---- parts without nesting: tags become marks of one character -----------------------------
APART, TEXT_ON, TEXT_OFF, RUN_ON, RUN_OFF, TAB, HYPHEN, BREAK, LINE, CELL, SKIP_ON, SKIP_OFF = "\x01\x02\x03\x04\x05\x06\x07\x08\x0e\x0f\x10\x11"
MARKS = r"\x01-\x08\x0e-\x11"


def _tag(start: str, end: str = ">") -> str:
    return rf"{start}(?![\w:.-])[^<>]*{end}"


def _nested(marks: Column, on: str, off: str) -> Column:
    """Whether something opens again before it is closed; what closes without being open counts for nothing."""
    return F.contains(F.regexp_replace(marks, f"[^{on}{off}]+", ""), F.lit(on + on))


def without_fallbacks(xml: Column) -> Column:
    """``struct<flat, seen>``: the part's counting tags and text outside fallbacks; ``flat`` unless fallbacks are nested or marks occur."""
    named = F.regexp_replace(xml, rf"<(?!/?(?:{NAMES})(?![\w:.-])[^<>]*>)(?:[^<>]*>)?", APART)

    def drop(t: Column) -> Column:
        for pattern, mark in ((_tag("</?mc:Fallback", "/>"), APART), (_tag("</mc:Fallback"), SKIP_OFF), (_tag("<mc:Fallback"), SKIP_ON)):
            t = F.regexp_replace(t, pattern, mark)
        return let(t, lambda m: F.struct(
            (~_nested(m, SKIP_ON, SKIP_OFF)).alias("flat"),
            F.regexp_replace(m, f"{SKIP_ON}[^{SKIP_OFF}]*+{SKIP_OFF}?|{SKIP_OFF}", APART).alias("seen"),
        ))

    kept = let(named, lambda t: F.when(F.contains(t, F.lit("mc:Fallback")), drop(t)).otherwise(F.struct(F.lit(True).alias("flat"), t.alias("seen"))))
    return F.when(~xml.rlike(f"[{MARKS}]"), kept).otherwise(F.struct(F.lit(False).alias("flat"), F.lit("").alias("seen")))


def _marked(seen: Column) -> Column:
    for pattern, mark in (
        (rf"{_tag('</w:t')}|{_tag('<w:t', '/>')}", TEXT_OFF), (_tag("<w:t"), TEXT_ON),
        (_tag("</?w:r", "/>"), APART), (_tag("</w:r"), RUN_OFF), (_tag("<w:r"), RUN_ON),
        (_tag("<w:tab"), TAB), (_tag("<w:noBreakHyphen"), HYPHEN), (_tag("<w:(?:br|cr)"), BREAK),
        (rf"{_tag('</w:p')}|{_tag('<w:p', '/>')}", LINE), (_tag("</w:tc"), CELL), ("<[^<>]*>", APART),
    ):
        seen = F.regexp_replace(seen, pattern, mark)
    return let(seen, lambda m: F.when(_nested(m, RUN_ON, RUN_OFF), _outer_runs(_outer_runs(m))).otherwise(m))


def _outer_runs(marks: Column) -> Column:
    """Without the runs that open and close, with no other run between, inside an open one, as those of text boxes do."""
    rest = f"[^{RUN_ON}{RUN_OFF}]*+"
    return F.regexp_replace(marks, rf"((?:{RUN_ON}|(?!\A)\G){rest}){RUN_ON}({rest}){RUN_OFF}", "$1$2")


def _shown_text(marked: Column) -> Column:
    """The text: marks that count inside runs only, and text that is shown inside text tags only, are dropped elsewhere."""
    inside = TAB + HYPHEN + BREAK
    t = F.regexp_replace(marked, f"((?:{RUN_OFF}|\\G)[^{RUN_ON}{RUN_OFF}{inside}]*+)[{inside}]", f"$1{APART}")
    t = F.regexp_replace(t, f"((?:{TEXT_OFF}|\\G)[{MARKS}&&[^{TEXT_ON}{TEXT_OFF}]]*+)[^{MARKS}]++", "$1")
    t = F.translate(t, inside + LINE + CELL + TEXT_ON + TEXT_OFF + RUN_ON + RUN_OFF, "\t-\n\n\t" + APART * 4)
    return decode_entities(t, APART)


def _wide(token: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(token, WIDE_COLUMNS, 1), F.lit("")).cast("int"), F.lit(1)) > 1


# ---- any part: a state machine over its tokens ----------------------------------------------
def folded_part(xml: Column) -> Column:
    """:func:`read_part` for parts nested in any way."""

    def step(state: Column, token: Column) -> Column:
        is_tag = token.startswith("<")
        name = F.when(is_tag, F.regexp_extract(token, rf"^</?({NAMES})(?![\w:.-])", 1))
        closing, self_closing = token.startswith("</"), token.endswith("/>")
        facts = F.struct(name.alias("name"), closing.alias("closing"), self_closing.alias("single"), (is_tag & ~closing).alias("opens"))
        return let(facts, lambda f: F.struct(_next(state, f, token).alias("state"), _shown(state, f, token).alias("out")))

    begin = F.struct(
        F.lit(0).alias("fallback"), F.lit(0).alias("run"), F.lit(False).alias("in_text"),
        F.lit(0).alias("tables"), F.lit(0).alias("boxes"), F.lit(False).alias("columns"),
    )
    tokens = F.filter(F.regexp_extract_all(xml, F.lit(TOKEN), F.lit(1)), lambda t: t != "")
    return let(fold_in_blocks(tokens, begin, "array<string>", step), lambda r: F.struct(
        F.array_join(r["out"], "").alias("text"), r["state"]["tables"].alias("tables"),
        r["state"]["boxes"].alias("text_boxes"), r["state"]["columns"].alias("columns"),
    ))


def _depth(before: Column, f: Column) -> Column:
    """One deeper or, never below zero, one up."""
    return F.when(f["closing"], F.greatest(before - 1, F.lit(0))).otherwise(before + 1)


def _next(state: Column, f: Column, token: Column) -> Column:
    """The state after a token; inside a fallback only fallback tags count."""
    name, seen = f["name"], state["fallback"] == 0
    moved = F.struct(
        F.when((name == "mc:Fallback") & ~f["single"], _depth(state["fallback"], f)).otherwise(state["fallback"]).alias("fallback"),
        F.when(seen & (name == "w:r") & ~f["single"], _depth(state["run"], f)).otherwise(state["run"]).alias("run"),
        F.when(seen & (name == "w:t"), f["opens"] & ~f["single"]).otherwise(state["in_text"]).alias("in_text"),
        (state["tables"] + F.when(seen & f["opens"] & (name == "w:tbl"), 1).otherwise(0)).alias("tables"),
        (state["boxes"] + F.when(seen & f["opens"] & (name == "w:txbxContent"), 1).otherwise(0)).alias("boxes"),
        F.when(seen & f["opens"] & (name == "w:cols"), state["columns"] | _wide(token)).otherwise(state["columns"]).alias("columns"),
    )
    return F.when(name.isNull(), state).otherwise(moved)


def _shown(state: Column, f: Column, token: Column) -> Column:
    """What a token adds to the text: no or one string."""
    name, in_run = f["name"], f["opens"] & (state["run"] > 0)
    out = (
        F.when(state["fallback"] > 0, F.lit(None).cast("string"))
        .when(name.isNull(), F.when(state["in_text"], decode_entities(token)))
        .when((name == "w:tab") & in_run, "\t")
        .when((name == "w:noBreakHyphen") & in_run, "-")
        .when(name.isin("w:br", "w:cr") & in_run, "\n")
        .when((name == "w:p") & (f["closing"] | f["single"]), "\n")
        .when((name == "w:tc") & f["closing"], "\t")
    )
    return F.array_compact(F.array(out))


def part_text(parts: DataFrame) -> DataFrame:
    """L1: ``(doc_id, part_no, text)`` of every part; no shuffle."""
    return parts.select("doc_id", "part_no", read_part(F.col("xml"))["text"].alias("text"))


def part_layout(parts: DataFrame) -> DataFrame:
    """L3: ``(doc_id, part_no, tables, text_boxes, columns)`` from opening tags outside fallbacks; no shuffle."""
    return parts.select("doc_id", "part_no", read_part(F.col("xml")).alias("p")).select(
        "doc_id", "part_no", F.col("p.tables").cast("bigint").alias("tables"), F.col("p.text_boxes").cast("bigint").alias("text_boxes"), "p.columns",
    )


def part_role() -> Column:
    """L4: ``body``, ``margin``, ``media`` or ``types`` by the part's name, else NULL."""
    name = F.col("part_name")
    return (
        F.when(name.rlike(BODY_PART), "body").when(name.rlike(HEADER_FOOTER_PART), "margin")
        .when(name.rlike(MEDIA_PART), "media").when(name == CONTENT_TYPES, "types")
    )


def package_documents(parts: DataFrame) -> DataFrame:
    """L1-L4: one row per package in the document schema, ``error_code`` set when it is unusable.

    Parts are read in their rows first; one aggregation puts a package together.  Its first body part counts.
    """
    read = parts.select("doc_id", "part_no", part_role().alias("role"), "xml").filter("role IS NOT NULL")
    read = read.select("doc_id", "part_no", "role", F.when(F.col("role").isin("body", "margin"), read_part(F.col("xml"))).alias("p"))
    is_role = lambda role: F.col("role") == role
    margins = F.array_sort(F.collect_list(F.when(is_role("margin"), F.struct("part_no", F.col("p.text").alias("text")))))
    packed = read.groupBy("doc_id").agg(
        F.bool_or(is_role("types")).alias("has_types"), F.count_if(is_role("media")).cast("int").alias("images"),
        F.min(F.when(is_role("body"), F.struct("part_no", F.col("p.text").alias("text"), F.col("p.tables").alias("tables"), F.col("p.text_boxes").alias("text_boxes"), F.col("p.columns").alias("columns")))).alias("body"),
        margins.alias("margins"),
    )
    bad = ~F.col("has_types") | F.col("body").isNull()
    return packed.select(
        "doc_id",
        F.when(~bad, F.col("body.text")).alias("text"),
        F.when(~bad, normalize_text(F.array_join(F.transform("margins", lambda m: m["text"]), "\n"))).alias("header_footer_text"),
        F.struct(
            F.coalesce("body.tables", F.lit(0)).alias("tables"), F.coalesce("body.text_boxes", F.lit(0)).alias("text_boxes"),
            "images", F.coalesce("body.columns", F.lit(False)).alias("columns"), F.lit(None).cast("int").alias("page_count"),
        ).alias("layout"),
        F.lit(False).alias("truncated"),
        F.when(bad, "invalid_docx").alias("error_code"),
    )
