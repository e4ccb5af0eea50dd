"""Patterns only meet the texts that hold what they look for; no guard passes over a text that would change."""

import random
import re
import sys
import unicodedata

from pyspark.sql import functions as F

from doclint.functions import compat
from doclint.functions import fixed_values as fv
from doclint.functions import text as tx
from doclint.operators import content as cn

PLAIN = "Jane Doe – “São Paulo”\n• Led 12 people’s work\n■ Área de dados…"


def test_guards_see_every_character_that_changes(spark):
    chars = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    rows = spark.createDataFrame([(c,) for c in chars], "c string").repartition(8).select(
        "c", F.col("c").rlike(compat._changing()).alias("composed"), F.col("c").rlike(tx.FOLDABLE).alias("folded"),
        F.col("c").rlike(tx.UNSAFE_OR_WIDE).alias("cleaned"), F.regexp_replace(tx.strip_unsafe(F.col("c")), fv.WIDE_SPACES, " ").alias("clean"),
    ).collect()
    tables = compat.tables()
    touched = {*tables["one"][0], *tables["several"], *tables["followers"]}
    marked = set(tx._fold_table()[0])
    assert len(rows) == len(chars)
    assert not [r.c for r in rows if r.c in touched and not r.composed]
    assert not [r.c for r in rows if (r.c in marked or unicodedata.category(r.c)[0] == "M") and not r.folded]
    assert not [r.c for r in rows if (r.clean != r.c) != r.cleaned]


def test_common_signs_and_letters_are_not_composed(spark):
    r = spark.range(1).select(F.lit(PLAIN.replace("…", "")).rlike(compat._changing()).alias("c"), F.lit("• a – b ■ c").rlike(tx.FOLDABLE).alias("f")).first()
    assert (r.c, r.f) == (False, False)


def test_cleaning_equals_the_unguarded_patterns(spark):
    rng = random.Random(3)
    pieces = ["a", "b'S", "c\u2019s", "'", "\u2019", "-", " ", " ", "\t", "\n", "\n", "\r", "\r\n", "\u00a0", "\u1680", "\u2028", "\u2029", "\u3000", "\u200b", "\ufeff", "\x07", ".net", "x/y", "ci/cd", "\u00e9", "\u2022"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(3000)]

    def cleaned(t):
        t = re.sub(fv.WIDE_SPACES.replace("\\x{", "\\u").replace("}", ""), " ", re.sub(fv.UNSAFE_CHARS.replace("\\x{", "\\u").replace("}", ""), "", re.sub("\r\n?", "\n", t)))
        t = re.sub("(?m)^ +| +$", "", re.sub(" [ \t]+|\t[ \t]*", " ", t))
        rare = "\u1680\u2028\u2029"
        if re.search(f"[{rare}]", t):
            t = re.sub(rf"(?<![^\n])[ {rare}]+|[ {rare}]+(?![^\n])", "", t)
        return re.sub("\n{3,}", "\n\n", t).strip(tx.ALL_SPACES)

    def padded(t):
        t = re.sub(r"\.net(?<![a-z0-9]\.net)(?![a-z0-9])", "dotnet", t)
        return re.findall(fv.TOKEN_PATTERN, re.sub(r"['’]s(?![A-Za-z0-9_])|[-'’]", " ", t))

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(8).select(
        "i", tx._clean_lines(F.col("t")).alias("c"), tx.padded_from_folded(F.lower("t")).alias("p")
    ).collect()
    assert not [(texts[r.i], r.c) for r in rows if r.c != cleaned(texts[r.i])][:3]
    low = [(r, texts[r.i].lower()) for r in rows if "/" not in texts[r.i]]
    assert not [(t, r.p) for r, t in low if r.p != " " + " ".join(padded(t)) + " "][:3]


def test_stray_glyphs_are_counted_in_one_pass(spark):
    rng = random.Random(5)
    pieces = ["a", " ", "\n", "\u00ef", "\u00a7", "\u2022", "|", "\ue000", "\uf8ff", "\ufffd", "\U0001f600", "\u00d3", "\u00f4", "(", "#", "\uffff", "\t"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + ["\u00ef \U0001f600 \u00a7 a\u00a7 \u00a7\n\u00a7"]

    def stray(t):
        lone = re.findall(r"(?<![^ \n])[^A-Za-z0-9 \n](?![^ \n])", t)
        return sum(not ("\ue000" <= c <= "\uf8ff" or c == "\ufffd" or ord(c) > 0xFFFF or c in fv.LONE_GLYPHS_ALLOWED) for c in lone)

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", cn.count_matches(F.col("t"), cn.STRAY_GLYPH).alias("n")).collect()
    assert not [(texts[r.i], r.n) for r in rows if r.n != stray(texts[r.i])][:3]
