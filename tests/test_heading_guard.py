"""Only lines with the words of a heading are read as headings; the guard passes over no heading."""

import random

from pyspark.sql import functions as F

from doclint.functions.lexicon import DEFAULT
from doclint.operators import sections as se


def read(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", se.heading_lines(F.col("t")).alias("h"))
    return [r.h for r in sorted(rows.collect(), key=lambda r: r.i)]


def test_guard_passes_over_no_heading(spark, monkeypatch):
    rng = random.Random(7)
    phrases = [p for listed in DEFAULT.section_synonyms.values() for p in listed] + list(DEFAULT.nonstandard_headings)
    ends = ["", "", ":", " ", "• ", "2", "2. ", "l ", "Ô ", " & ", "/", " and ", " e ", "ß", "x", " of mine", "é", "–", ", Python", " "]
    odd = lambda p: p.replace(" ", rng.choice((" ", "  ", "\t", " ", " 　")))
    line = lambda: rng.choice(ends) + odd(rng.choice(phrases)).title() + rng.choice(ends) + rng.choice(("", "", odd(rng.choice(phrases)))) + rng.choice(ends)
    texts = ["\n".join(line() for _ in range(5)) for _ in range(800)] + ["Led the work of 12 people\nSKILLS: Python", ""]
    guarded = read(spark, texts)
    monkeypatch.setattr(se, "heading_phrases", lambda lexicon: "")
    assert sum(map(len, guarded)) > 1000 and guarded == read(spark, texts)


def test_body_lines_meet_no_heading_pattern(spark):
    lines = ["• Led migration of 12 systems", "Managed releases", "skillset and toolset", "Retrabalho de projetosx"]
    r = spark.range(1).select(*(F.lit(t.lower()).rlike(se.heading_phrases(DEFAULT)).alias(f"l{i}") for i, t in enumerate(lines))).first()
    assert not any(r)
