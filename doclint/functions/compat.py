"""Compatibility composition (NFKC) as native column expressions.

All tables are derived from the character database when first used.  Three steps, each only for texts it concerns:
characters with one compatible character are translated, those with several are woven in, and where marks follow a
character the small sequence is decomposed, ordered and composed again.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .folds import fold_in_blocks
from .rows import let

PAIR, KEY = "\x01", "\x02"
# The arithmetic of composed syllables
LEAD, VOWEL, TAIL, SYLLABLE, VOWELS, TAILS = 0x1100, 0x1161, 0x11A7, 0xAC00, 21, 28


def _characters():
    for code in range(0x80, sys.maxunicode + 1):
        if not 0xD800 <= code <= 0xDFFF:
            yield chr(code)


def _ranges(chars) -> str:
    """A pattern class of many characters."""
    out, run = [], []
    for code in sorted(map(ord, chars)) + [-1]:
        if run and code != run[-1] + 1:
            out.append(f"\\x{{{run[0]:X}}}-\\x{{{run[-1]:X}}}")
            run = []
        run.append(code)
    return "[\\x{80}-\\x{10FFFF}&&[" + "".join(out) + "]]"  # plain characters fail the first part at once


def _has(text: Column, chars: str) -> Column:
    """Whether any of many characters occurs: a look into a hash table for each character, where a class tries its ranges in turn."""
    return F.length(F.translate(text, chars, "")) < F.length(text)


def _table(entries: dict[str, str]) -> Column:
    """A constant map; the optimizer evaluates it once."""
    return F.str_to_map(F.lit(PAIR.join(k + KEY + v for k, v in entries.items())), F.lit(PAIR), F.lit(KEY))


@cache
def tables() -> dict:
    one, several, whole, pairs, ranks = {}, {}, {}, {}, {}
    for ch in _characters():
        compatible = unicodedata.normalize("NFKC", ch)
        if compatible != ch:
            (one if len(compatible) == 1 else several)[ch] = compatible
        canonical = unicodedata.decomposition(ch)
        if canonical and not canonical.startswith("<"):
            parts = "".join(chr(int(x, 16)) for x in canonical.split())
            if len(parts) == 2 and unicodedata.normalize("NFC", parts) == ch:
                pairs[parts] = ch
            if compatible == ch:
                whole[ch] = unicodedata.normalize("NFD", ch)
        if unicodedata.combining(ch):
            ranks[ch] = str(unicodedata.combining(ch))
    followers = {p[1] for p in pairs} | set(ranks) | {chr(VOWEL + i) for i in range(VOWELS)} | {chr(TAIL + i) for i in range(1, TAILS)}
    return {"one": ("".join(one), "".join(one.values())), "several": several, "whole": whole, "pairs": pairs, "ranks": ranks, "followers": "".join(sorted(followers))}


def _weave(text: Column, pattern: str, value) -> Column:
    """The text with every match replaced by ``value(match)``."""
    plain = F.split(text, pattern)
    changed = F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), value)
    return F.array_join(F.zip_with(plain, changed, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def _expand(text: Column, pattern: str, table: Column) -> Column:
    """The text with characters of a class replaced by their longer forms: one pass for each that occurs, however often."""
    only = F.regexp_replace(F.array_join(F.regexp_extract_all(text, F.lit(f"({pattern})\\1*"), F.lit(1)), ""), r"(?s)(.)\1+", "$1")
    met = F.array_distinct(F.filter(F.split(only, ""), lambda c: c != ""))
    return F.aggregate(met, text, lambda t, c: F.replace(t, c, F.try_element_at(table, c)))


def _char(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("bigint")), 8, "0")), "UTF-32")


def _joined(first: Column, second: Column) -> Column:
    """The composed character of two, or NULL."""
    a, b = F.ascii(first), F.ascii(second)
    lead = a.between(LEAD, LEAD + 18) & b.between(VOWEL, VOWEL + VOWELS - 1)
    tail = a.between(SYLLABLE, SYLLABLE + 11171) & ((a - SYLLABLE) % TAILS == 0) & b.between(TAIL + 1, TAIL + TAILS - 1)
    return (
        F.when(lead, _char(((a - LEAD) * VOWELS + b - VOWEL) * TAILS + SYLLABLE)).when(tail, _char(a + b - TAIL))
        .otherwise(F.try_element_at(_table(tables()["pairs"]), F.concat(first, second)))
    )


def _compose(sequence: Column) -> Column:
    """A character and what follows it, decomposed, put into canonical order and composed."""
    letters = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    apart = F.flatten(F.transform(letters(sequence), lambda c: letters(F.coalesce(F.try_element_at(_table(tables()["whole"]), c), c))))
    ranked = F.transform(apart, lambda c, i: F.struct(F.coalesce(F.try_element_at(_table(tables()["ranks"]), c).cast("int"), F.lit(0)).alias("rank"), i.alias("i"), c.alias("c")))

    def grouped(group: Column, x: Column) -> Column:
        return let(group + F.when(x["rank"] == 0, 1).otherwise(0), lambda g: F.struct(
            g.alias("state"), F.array(F.struct(g.alias("group"), x["rank"].alias("rank"), x["i"].alias("i"), x["c"].alias("c"))).alias("out")
        ))

    in_order = F.array_sort(fold_in_blocks(ranked, F.lit(0), "array<struct<group:int,rank:int,i:int,c:string>>", grouped)["out"])

    def step(state: Column, x: Column) -> Column:
        free = F.when(x["rank"] == 0, state["waiting"] == "").otherwise((state["waiting"] == "") | (state["last"] < x["rank"]))
        joined = F.when(free & (state["starter"] != ""), _joined(state["starter"], x["c"]))
        new = lambda starter, waiting, last: F.struct(starter.alias("starter"), waiting.alias("waiting"), last.alias("last"))
        none = F.array().cast("array<string>")
        return let(joined, lambda j: F.struct(
            F.when(j.isNotNull(), new(j, state["waiting"], state["last"])).when(x["rank"] == 0, new(x["c"], F.lit(""), F.lit(0)))
            .otherwise(new(state["starter"], F.concat(state["waiting"], x["c"]), x["rank"])).alias("state"),
            F.when(j.isNull() & (x["rank"] == 0), F.array(F.concat(state["starter"], state["waiting"]))).otherwise(none).alias("out"),
        ))

    begin = F.struct(F.lit("").alias("starter"), F.lit("").alias("waiting"), F.lit(0).alias("last"))
    return let(fold_in_blocks(in_order, begin, "array<string>", step), lambda r: F.concat(F.array_join(r["out"], ""), r["state"]["starter"], r["state"]["waiting"]))


@cache
def _changing() -> str:
    """A class with every character that composition may change: all but ASCII and the longer runs of characters that it keeps."""
    t = tables()
    touched = {*t["one"][0], *t["several"], *t["followers"]}
    runs, start = [], 0x80
    for code in range(0x80, 0xD800):
        if chr(code) in touched:
            runs.append((start, code - 1))
            start = code + 1
    longest = sorted(r for r in runs if r[1] - r[0] >= (3 if r[0] < 0x250 or 0x2010 <= r[0] < 0x2030 else 100))
    return "[\\x{80}-\\x{10FFFF}&&[^" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in longest) + "]]"  # as in _ranges


def compose_compat(text: Column) -> Column:
    """NFKC; rows that hold nothing it changes skip it."""
    t = tables()
    long_forms, followers = "".join(t["several"]), _ranges(t["followers"])

    def steps(s: Column) -> Column:
        simple = F.translate(s, *t["one"])
        wide = let(simple, lambda x: F.when(_has(x, long_forms), _expand(x, _ranges(t["several"]), _table(t["several"]))).otherwise(x))
        return let(wide, lambda x: F.when(_has(x, t["followers"]), _weave(x, f"(?s).?{followers}+", _compose)).otherwise(x))

    return F.when(text.rlike(_changing()), steps(text)).otherwise(text)
