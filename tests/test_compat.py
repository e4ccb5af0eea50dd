"""Compatibility composition against the character database, character by character and in sequences."""

import random
import sys
import unicodedata

from pyspark.sql import functions as F

from doclint.functions.compat import compose_compat


def composed(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(8).select("i", compose_compat(F.col("t")).alias("c")).collect()
    return [r.c for r in sorted(rows, key=lambda r: r.i)]


def wrong(texts, got):
    return [(t.encode("unicode_escape"), g.encode("unicode_escape")) for t, g in zip(texts, got, strict=True) if g != unicodedata.normalize("NFKC", t)][:5]


def test_every_assigned_character(spark):
    chars = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    # single characters, packed into lines with a neutral neighbour on both sides
    lines = [".".join(chars[i : i + 40]) for i in range(0, len(chars), 40)]
    assert not wrong(lines, composed(spark, lines))
    alone = [c for c in chars if unicodedata.normalize("NFKC", c) != c][::7]
    assert not wrong(alone, composed(spark, alone))


def test_sequences(spark):
    rng = random.Random(1)
    marks = [chr(c) for c in range(0x300, sys.maxunicode) if unicodedata.combining(chr(c))]
    bases = [*"aeoAEx .\n", "é", "ễ", "ﬁ", "Å", "½", "ﷺ", "각", "가", "ᄀ", "ᅡ", "ᆨ", "ে", "া", "ෙ", "ා", "̈́", "が", "か", "ｶ", "ﾞ", "龜", "𝒜"]
    pieces = [*bases, *(chr(0x300 + i) for i in range(40)), *rng.sample(marks, 60)]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    texts += ["e" + "́" * 2000, "̣́" * 600, "", "plain"]
    assert not wrong(texts, composed(spark, texts))


def test_null_stays_null(spark):
    assert spark.range(1).select(compose_compat(F.lit(None).cast("string")).alias("c")).first().c is None
