"""Content features of a document (A1-A9, A12, T7) as in-row expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.lexicon import DEFAULT, Lexicon, escape_regex, sql_text, trie_regex
from ..functions.text import (
    LINE_ENDS, SPACE_CLASS, WORD_END, bullet_body, count_matches, count_tokens, let, one_of, padded_tokens,
    starts_with_bullet, stem_array, trim_all,
)

# Line patterns
METRIC = rf"(?i)\d\s?(?:%|x{WORD_END}|k{WORD_END}|\+)|[$€£]\s?\d|r\$\s?\d"
LEAD_LABEL = rf"^\p{{L}}{{2,20}}(?:[{SPACE_CLASS}]\p{{L}}{{2,20}})?:[{SPACE_CLASS}]+"
NUMBER_TOKEN = rf" (?!{fv.YEAR_TOKEN} )[0-9]{{2,}} "
GARBLED = r"[\x{E000}-\x{F8FF}\x{FFFD}]|\(cid:\d{1,5}\)"
# classes are written as what they hold: a pattern tries a class of exceptions far more slowly
_INK = r"[\x00-\x09\x0B-\x1F!-\x{10FFFF}]"
_GLYPH = r"\x00-\x09\x0B-\x1F!-/:-@\[-`{-\x{DFFF}\x{F900}-\x{FFFC}\x{FFFE}\x{FFFF}"
STRAY_GLYPH = rf"(?<!{_INK})[{_GLYPH}&&[^{escape_regex(fv.LONE_GLYPHS_ALLOWED)}]](?!{_INK})"
# Share of work bullets expected to hold a number / open with a verb, and minimums
QUANTIFIED_SHARE, QUANTIFIED_MIN = 0.3, 3
VERB_SHARE, VERB_MIN = 0.6, 5


def line_features(text: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """Per non-blank line: ``struct<bullet, long, quantified, verb>`` (``verb`` NULL if no opener)."""
    bodies = F.transform(
        F.filter(F.transform(F.split(text, "\n"), trim_all), lambda l: l != ""),
        lambda l: F.struct(
            starts_with_bullet(l).alias("bullet"),
            bullet_body(l).alias("body"),
        ),
    )
    tokens = F.transform(
        bodies,
        lambda b: F.struct(
            b["bullet"].alias("bullet"),
            b["body"].rlike("[0-9]").alias("digits"),
            b["body"].alias("body"),
            padded_tokens(b["body"]).alias("p"),
            F.when(F.contains(b["body"], F.lit(":")) & b["body"].rlike(LEAD_LABEL), let(F.regexp_replace(b["body"], LEAD_LABEL, ""), padded_tokens)).alias("unlabelled"),
        ),
    )

    def opener(x: Column) -> Column:
        word = F.regexp_extract(F.coalesce(x["unlabelled"], x["p"]), r"^ (?:co )?+([^ ]+)(?: [^ ]++){2,}+ $", 1)
        return let(word, lambda w: F.when(one_of(w, lexicon.action_verbs), w))

    return F.transform(
        tokens,
        lambda x: F.struct(
            x["bullet"].alias("bullet"),
            (x["bullet"] & (count_tokens(x["p"]) > fv.MAX_BULLET_WORDS)).alias("long"),
            (
                x["digits"] & (count_tokens(x["p"]) >= 4) & (x["p"].rlike(NUMBER_TOKEN) | x["body"].rlike(METRIC))
            ).alias("quantified"),
            opener(x).alias("verb"),
        ),
    )


def _count_if(items: Column, test) -> Column:
    return F.size(F.filter(items, test))


def top_verb(verbs: Column) -> Column:
    """A3: most used opener by stem; label first seen; ties go to the earliest."""
    def pick(v: Column) -> Column:
        return F.array_max(
            F.transform(
                F.array_distinct(v["stems"]),
                lambda s: F.struct(
                    F.size(F.filter(v["stems"], lambda t: t == s)).alias("count"),
                    (-F.array_position(v["stems"], s)).alias("order"),
                    F.get(v["verbs"], (F.array_position(v["stems"], s) - 1).cast("int")).alias("verb"),
                ),
            )
        )

    return let(verbs, lambda vs: let(F.struct(vs.alias("verbs"), stem_array(vs).alias("stems")), pick))


def weak_phrases(padded: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """``array<struct<phrase, count>>``, most frequent first, then list order."""
    rows = lexicon.weak_rows
    scan = trie_regex([key for key, _, _ in rows])
    table = F.expr(
        "array(" + ", ".join(
            f"named_struct('key', {sql_text(key)}, 'rank', {rank}, 'phrase', {sql_text(phrase)})" for key, phrase, rank in rows
        ) + ")"
    )

    def ranked(source: Column, count) -> Column:
        counted = F.transform(
            table,
            lambda r: F.struct((-count(source, r)).alias("neg"), r["rank"].alias("rank"), r["phrase"].alias("phrase")),
        )
        return F.array_sort(F.filter(counted, lambda x: x["neg"] < 0))

    if lexicon.weak_disjoint:
        hits = F.regexp_extract_all(padded, F.lit(f" ({scan})(?= )"), F.lit(1))
        found = let(hits, lambda hs: F.when(F.size(hs) > 0, ranked(hs, lambda h, r: _count_if(h, lambda x: x == r["key"]))))
    else:
        # every phrase is counted by itself, on the documents that hold any
        single = lambda t, r: F.regexp_count(t, F.concat(F.lit(" "), r["key"], F.lit("(?= )")))
        found = F.when(padded.rlike(f" {scan} "), ranked(padded, single))
    none = F.array().cast("array<struct<neg:int,rank:int,phrase:string>>")
    return F.transform(
        F.coalesce(found, none), lambda x: F.struct(x["phrase"].alias("phrase"), (-x["neg"]).alias("count"))
    )


def content_struct(text: Column, padded: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """T7 and A1-A8 of one document."""
    def summarise(ls: Column) -> Column:
        verbs = F.transform(F.filter(ls, lambda l: l["verb"].isNotNull()), lambda l: l["verb"])
        return F.struct(
            F.size(ls).alias("lines"),
            _count_if(ls, lambda l: l["bullet"]).alias("bullets"),
            _count_if(ls, lambda l: l["quantified"]).alias("quantified"),
            F.size(verbs).alias("action_verbs"),
            _count_if(ls, lambda l: l["long"]).alias("long_bullets"),
            top_verb(verbs).alias("top_verb"),
        )

    return let(line_features(text, lexicon), summarise)


def count_years(padded: Column) -> Column:
    """A4."""
    return count_matches(padded, f" {fv.YEAR_TOKEN}(?= )")


def count_first_person(padded: Column) -> Column:
    """A5."""
    return count_matches(padded, f" (?:{'|'.join(fv.FIRST_PERSON)})(?= )")


def count_garbled(text: Column) -> Column:
    """Characters without a text mapping plus stray lone glyphs."""
    spaced = F.when(text.rlike(LINE_ENDS), F.regexp_replace(text, LINE_ENDS, " ")).otherwise(text)
    return count_matches(text, GARBLED) + count_matches(spaced, STRAY_GLYPH)


def adaptive_target(work_bullets: Column, share: float, minimum: int) -> Column:
    """A12."""
    return F.greatest(F.lit(minimum), F.ceil(work_bullets * F.lit(share)).cast("int"))
