"""Package markup against a plain reading of token lists, and the shape of its plans."""

import random
import re

from pyspark.sql import functions as F

from doclint.functions.folds import BLOCK
from doclint.operators import markup as mk

PIECES = [
    "<w:r>", "</w:r>", "<w:r/>", "<w:t>", "</w:t>", "<w:t/>", '<w:t xml:space="preserve">', "<w:tab/>", "<w:tabs>", "<w:br/>", "</w:br>", "<w:cr/>", "<w:noBreakHyphen/>",
    "<w:p>", "</w:p>", "<w:p/>", "<w:tc>", "</w:tc>", "<w:tbl>", "</w:tbl>", "<w:txbxContent>", '<w:cols w:num="2"/>', '<w:cols w:num="1"/>', '<w:cols xw:num="4"/>', "<w:cols>",
    "<mc:Fallback>", "<mc:Fallback>", "</mc:Fallback>", "</mc:Fallback>", "<mc:Fallback/>", "<mc:FallbackX>", "<!-- w:t -->", "<?x?>", "<>", "<", ">", "a", "b &amp; c", "&#65;", "&am", "p;", "\n",
]


def plain(xml):
    """Text, tables, boxes, columns."""
    out, fallback, run, shown, tables, boxes, columns = [], 0, 0, False, 0, 0, False
    known = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}
    for token in re.findall(r"<[^<>]*>|[^<]+|<", xml):
        if not token.startswith("<"):
            if shown and not fallback:
                out.append(re.sub(r"&(#\d{1,7}|lt|gt|amp|quot|apos);", lambda m: known.get(m[1]) or chr(int(m[1][1:])), token))
            continue
        found = re.match(r"</?([\w:.-]+)", token)
        name, closing, single = found[1] if found else "", token.startswith("</"), token.endswith("/>")
        if name == "mc:Fallback" and not single:
            fallback = max(0, fallback - 1) if closing else fallback + 1
        elif not fallback:
            if name == "w:r" and not single:
                run = max(0, run - 1) if closing else run + 1
            elif name == "w:t":
                shown = not closing and not single
            elif name == "w:p" and (closing or single):
                out.append("\n")
            elif name == "w:tc" and closing:
                out.append("\t")
            elif run and not closing:
                out.append({"w:tab": "\t", "w:noBreakHyphen": "-", "w:br": "\n", "w:cr": "\n"}.get(name, ""))
            if not closing:
                tables += name == "w:tbl"
                boxes += name == "w:txbxContent"
                columns |= name == "w:cols" and bool(re.search(r'\bw:num="([2-9])"', token)) and "xw:num" not in token
    return "".join(out), tables, boxes, columns


def test_parts_equal_a_plain_reading(spark):
    rng = random.Random(2)
    xmls = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["", "plain", "".join(rng.choice(PIECES) for _ in range(6 * BLOCK))]
    rows = spark.createDataFrame(list(enumerate(xmls)), "doc_id long, xml string").select("doc_id", mk.read_part(F.col("xml")).alias("p")).collect()
    assert {r.doc_id: tuple(r.p) for r in rows} == {i: plain(x) for i, x in enumerate(xmls)}


def test_a_package_costs_one_shuffle(spark):
    parts = [
        (1, 0, "[Content_Types].xml", "<Types/>"), (1, 1, "word/document.xml", "<w:p><w:r><w:t>body</w:t></w:r></w:p><w:tbl>"), (1, 2, "word/document9.xml", "<w:t>later"),
        (1, 5, "word/footer1.xml", "<w:t>foot"), (1, 3, "word/header2.xml", "<w:t>head"), (1, 4, "word/media/a.png", None), (2, 1, "word/document.xml", "<w:t>x"), (3, 0, "[Content_Types].xml", ""),
        (4, 0, "[Content_Types].xml", ""), (4, 1, "word/document.xml", None), (None, 1, "word/document.xml", "<w:t>x"),
    ]
    docs = mk.package_documents(spark.createDataFrame(parts, "doc_id long, part_no int, part_name string, xml string"))
    plan = docs._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: r for r in docs.collect()}
    assert (got[1].text, got[1].header_footer_text, got[1].layout.images, got[1].layout.tables, got[1].error_code) == ("body\n", "head\nfoot", 1, 1, None)
    assert [got[k].error_code for k in (2, 3, 4, None)] == ["invalid_docx", "invalid_docx", None, "invalid_docx"]
    assert not got[4].text
    assert plan.count("Exchange") == 1 and "Window" not in plan
    assert "Exchange" not in mk.part_text(spark.createDataFrame(parts, "doc_id long, part_no int, part_name string, xml string"))._jdf.queryExecution().executedPlan().toString()
