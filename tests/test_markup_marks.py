"""Parts without nesting are read by patterns; they give what the state machine gives."""

import random

from pyspark.sql import functions as F

from doclint.operators import markup as mk

PIECES = [
    "<w:t>", "</w:t>", "<w:t/>", "<w:t xml:space='preserve'>", "</w:t/>", "<w:r>", "</w:r>", "<w:r/>", "<w:r a='1'>", "<w:tab/>", "<w:tab>", "</w:tab>", "<w:br/>", "<w:cr>",
    "</w:br>", "<w:noBreakHyphen/>", "<w:p>", "</w:p>", "<w:p/>", "<w:tc>", "</w:tc>", "<w:tbl>", "<w:tbl/>", "</w:tbl>", "<w:txbxContent>", '<w:cols w:num="2"/>', '<w:cols w:num="1" w:num="3"/>',
    '<w:cols xw:num="3"/>', '<w:cols w:num="003">', "</w:cols>", "<w:tabs>", "<w:r:x>", "<x>", "<", "<w:t", ">", "&am", "p;", "&amp;", "&#1;", "&#x2;", "&lt", ";", "a", " b\n", "-", "\t", "é", "",
]
FALLBACK = ["<mc:Fallback>", "</mc:Fallback>", "<mc:Fallback/>", "<mc:Fallback a='b'>", "</mc:Fallback/>"]


BOX = "<w:r><w:tab/><w:r><w:t>a</w:t><w:br/><w:r><w:tab/></w:r></w:r><w:r><w:br/></w:r><w:tab/></w:r><w:br/></w:r><w:br/><w:r><w:r></w:r><w:tab/></w:r><w:tab/>"


def test_marks_give_what_the_state_machine_gives(spark):
    rng = random.Random(5)
    texts = ["", "<", "plain", "\x02<w:t>a</w:t>", "<w:r><w:t>a</w:t><w:tab/></w:r><w:br/>", None]
    texts.append(BOX)
    for i in range(1500):
        pieces = PIECES + FALLBACK * (i % 3) + ["<w:r>", "</w:r>", "<w:t>", "</w:t>"] * 3
        texts.append("".join(rng.choice(pieces) for _ in range(rng.choice((3, 8, 20, 60)))))
        inner = "".join(f"<w:r>{rng.choice(PIECES[:5])}{rng.choice(PIECES[9:])}{rng.choice(PIECES[-15:])}</w:t>{rng.choice(PIECES[9:])}</w:r>{rng.choice(PIECES[9:])}" for _ in range(8))
        texts.append(inner + rng.choice(("", f"<mc:Fallback>{inner}</mc:Fallback>{inner}", f"</mc:Fallback>{inner}<mc:Fallback>{inner}")))
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, xml string").repartition(8)
    flat = lambda m: m["flat"] & ~mk._nested(mk._marked(m["seen"]), mk.RUN_ON, mk.RUN_OFF)
    both = rows.select("i", "xml", mk.read_part(F.col("xml")).alias("a"), mk.folded_part(F.col("xml")).alias("b"), flat(mk.without_fallbacks(F.col("xml"))).alias("flat")).collect()
    assert [(r.xml, r.a, r.b) for r in both if r.a != r.b] == []
    assert next(r.flat for r in both if r.xml == BOX)
    assert 1500 < sum(bool(r.flat) for r in both) < len(both) - 200


def test_long_parts_are_read_in_step_with_their_length(spark):
    ends, tabs = "</w:r>" * 100_000, "<w:tab/>" * 100_000
    rows = spark.createDataFrame([(1, ends + tabs), (2, "</w:t>" * 100_000 + "x"), (3, "<w:r><w:t>a" + "b</w:t><w:br/></w:r><w:r><w:t>" * 50_000), (4, "<w:cols " + "a" * 300_000)], "i long, xml string")
    got = {r.i: r.t for r in rows.select("i", mk.read_part(F.col("xml"))["text"].alias("t")).collect()}
    assert got == {1: "", 2: "", 3: "a" + "b\n" * 50_000, 4: ""}
