"""Exact-case labels in one scan, against a pattern per label with look-behinds of any length."""

import random
import re
from dataclasses import replace

import regex
from pyspark.sql import functions as F

from doclint.functions import fixed_values as fv
from doclint.functions.lexicon import DEFAULT, Skill, tokenize_entry
from doclint.operators import keywords as kw

START = f"^[ \\t{re.escape(fv.LABEL_LINE_START)}]*"


def plain(text, lexicon):
    blocked, out = set(lexicon.blocked_next), []
    for s in (s for s in lexicon.skills if s.exact_case):
        label = re.escape(s.label)
        if s.before is not None:
            pattern = f"(?<={s.before.replace('*+', '*')}){label}(?={s.after})"
        else:
            pattern = rf"(?<![\w.#+-])(?:(?<![.!?]\s{{1,3}})(?<!{START}){label}|(?<={START}){label}(?=\s*[,/|;]))(?![\w#+-])"
        for m in regex.finditer(pattern, text, regex.M | regex.A):
            following = tokenize_entry(text[m.end() : m.end() + 40])
            if not following or (s.label, following[0]) not in blocked:
                out.append(s.label)
    return sorted(out)


PIECES = ["Go", "C", "Excel", "Spring", "Boot", "Express", "Swift", "R", "Vue", "x", "team", "boot", "sharp", ",", ", ", "/", "; ", "| ", "(", ")", ":", ". ", "! ", "?\n", " ", " ", " ", "\n", "\n", "- ", "• ", "•", "\t", "-", "+", "#", "_"]


def test_one_scan_finds_what_single_patterns_find(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    texts += [" " * 900 + "Go, C", "•" * 700 + " Go beyond", "x," + " " * 60 + "C" + " " * 60 + ",", "-" * 500 + "Go, x"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in frame.select("t", kw.label_hits(F.col("t")).alias("h")).collect():
        assert sorted(r.h) == plain(r.t, DEFAULT), repr(r.t)


def test_a_skill_brings_its_own_pattern(spark):
    own = Skill("R", exact_case=True, before=r"(?:^|[\[;])[ ]*+", after=r"[ ]*(?:[\];]|$)")
    lexicon = replace(DEFAULT, skills=[*(s for s in DEFAULT.skills if s.label != "R"), own])
    text = f"Python [R] and R, then ;{' ' * 300}R{' ' * 300};\nR\nMr. R here [ R; Go"
    assert sorted(spark.range(1).select(kw.label_hits(F.lit(text), lexicon).alias("h")).first().h) == plain(text, lexicon)
    assert plain(text, lexicon).count("R") == 4


def test_no_labels_at_all(spark):
    lexicon = replace(DEFAULT, skills=[Skill("Python")])
    assert spark.range(1).select(kw.label_hits(F.lit("Go, C"), lexicon).alias("h")).first().h == []


def test_long_runs_of_marks_take_linear_time(spark):
    import time

    text = "• " * 200_000 + "Go, " + "\n" * 100_000 + " Go" * 1000
    started = time.time()
    spark.range(1).select(kw.label_hits(F.lit(text)).alias("h")).collect()
    assert time.time() - started < 20
