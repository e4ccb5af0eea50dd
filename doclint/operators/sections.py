"""Section headings, spans and credit (S1-S8), computed inside the document row.

A document is one row, so the whole block stays a narrow projection:
no line leaves its row and nothing is shuffled.  Lines that can be headings are few; all
nested work runs on those.  Facts about all lines are kept as one character per line
(:func:`line_codes`), which turns "is there text between two lines" into a substring test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.dates import DATE_RANGE
from ..functions.lexicon import DEFAULT, Lexicon, trie_regex
from ..functions.text import (
    ALL_SPACES, LINE_ENDS, SPACE_CLASS, WORD_END, WORD_START, fold, let, once, one_of, starts_with_bullet, trim_all,
)

HAS_TEXT = r"[\p{L}\p{N}]"
_JOINERS = rf"\s*(?:&|/|,|\+|{WORD_START}and{WORD_END}|{WORD_START}e{WORD_END})\s*"
_SPAN = "struct<section:string,start:int,stop:int,has_text:boolean,inline:boolean>"


def heading_key(text: Column) -> Column:
    """Folded heading candidate without numbering, icons and trailing punctuation, or NULL."""
    def build(t: Column) -> Column:
        k = F.regexp_replace(fold(t), "^[^a-z]+", "")
        k = F.rtrim(k, F.lit(ALL_SPACES + ":.-–—|"))
        k = F.regexp_replace(k, r"\s+", " ")
        return let(
            let(k, lambda v: F.when(v.rlike(LINE_ENDS), F.regexp_replace(v, rf"[{SPACE_CLASS}]+", " ")).otherwise(v)),
            lambda key: F.when((key != "") & ~key.rlike("(?: [^ ]*){5}"), key),
        )

    return let(trim_all(text), lambda t: F.when(F.length(t).between(1, 48), build(t)))


def _section_of_phrase(phrase: Column, lexicon: Lexicon) -> Column:
    out = F.lit(None).cast("string")
    for section in reversed(fv.SECTIONS):
        out = F.when(one_of(phrase, lexicon.section_synonyms[section]), section).otherwise(out)
    return out


def sections_of(key: Column, exact_only: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """Sections named by a heading key (empty array if none)."""
    joined = key.rlike("[&/,+]|and|(?<![a-z0-9_])e(?![a-z0-9_])")
    parts = F.when(joined, F.filter(F.split(key, _JOINERS), lambda p: p != "")).otherwise(F.array(key))
    compound = let(
        parts,
        lambda ps: F.when(
            F.size(ps) > 1,  # "education & certifications" names both sections
            F.array_distinct(F.array_compact(F.transform(ps, lambda p: _section_of_phrase(p, lexicon)))),
        ).otherwise(F.array().cast("array<string>")),
    )
    single = F.lit(None).cast("string")
    for section in reversed(fv.SECTIONS):
        hit = key.rlike(rf"^(?:{trie_regex(lexicon.section_synonyms[section])})(?: [^ ]+){{0,2}}$") & (
            ~exact_only | one_of(key, lexicon.section_synonyms[section])
        )
        single = F.when(hit, section).otherwise(single)
    return let(
        compound, lambda c: F.when(F.size(c) > 0, c).otherwise(F.array_compact(F.array(single)))
    )


def heading_phrases(lexicon: Lexicon) -> str:
    """A pattern for the folded lines that may name a section: each holds one of the phrases as whole words, however spaced."""
    phrases = [p for listed in lexicon.section_synonyms.values() for p in listed] + list(lexicon.nonstandard_headings)
    return rf"(?<![a-z])(?:{trie_regex(phrases).replace(' ', '[^a-z]+')})(?![a-z])"


def heading_lines(text: Column, lexicon: Lexicon = DEFAULT, folded: Column | None = None) -> Column:
    """Array of heading lines in line order; ``folded`` is the folded text where the caller has it.

    ``struct<line, sections, inline, decorated, heading, suggestion>``; ``suggestion`` is set on
    creative headings (which have no sections).
    """
    both = F.arrays_zip(F.split(text, "\n").alias("t"), F.split(let(text, fold) if folded is None else folded, "\n").alias("f"))
    lines = F.transform(both, lambda z, i: F.struct(i.alias("line"), trim_all(z["t"]).alias("t"), z["f"].alias("f")))
    # cheap tests first: short line, or a colon early enough, and the words of a heading; few lines pass
    likely = F.filter(
        lines, lambda x: ((F.length(x["t"]) <= 48) | F.instr(x["t"], ":").between(2, 41)) & x["f"].rlike(heading_phrases(lexicon)) & x["t"].rlike(r"\p{L}")
    )
    nonstandard = [heading for heading in lexicon.nonstandard_headings]
    # no reading without one of these phrases can match, so most lines stop here
    any_heading = trie_regex([p for phrases in lexicon.section_synonyms.values() for p in phrases])

    def suggestion(key: Column) -> Column:
        out = F.lit(None).cast("string")
        for section in fv.SECTIONS:
            words = [h for h in nonstandard if lexicon.nonstandard_headings[h] == section]
            if words:
                out = F.when(one_of(key, words), section).otherwise(out)
        return out

    keyed = F.transform(
        likely,
        lambda x: F.struct(
            x["line"].alias("line"),
            x["t"].alias("t"),
            starts_with_bullet(x["t"]).alias("bullet"),
            heading_key(x["t"]).alias("whole"),
            F.when(
                F.instr(x["t"], ":").between(2, 41), heading_key(F.substring_index(x["t"], ":", 1))
            ).alias("head"),
            F.regexp_extract(x["t"], r"^[^:]*(:.*)$", 1).rlike(HAS_TEXT).alias("has_tail"),
        ),
    )

    def attempts(x: Column) -> Column:
        """The four readings of a line, in the order they are tried."""
        glyph = lambda k: F.nullif(F.regexp_extract(k, r"^\S (.+)$", 1), F.lit(""))
        rows = F.array(
            F.struct(x["whole"].alias("key"), F.lit(False).alias("decorated"), F.lit(False).alias("inline")),
            F.struct(glyph(x["whole"]).alias("key"), F.lit(True).alias("decorated"), F.lit(False).alias("inline")),
            F.struct(x["head"].alias("key"), F.lit(False).alias("decorated"), x["has_tail"].alias("inline")),
            F.struct(glyph(x["head"]).alias("key"), F.lit(True).alias("decorated"), x["has_tail"].alias("inline")),
        )
        tried = F.transform(
            F.filter(rows, lambda r: r["key"].rlike(any_heading)),
            lambda r: F.struct(
                sections_of(r["key"], x["bullet"], lexicon).alias("sections"),
                r["decorated"].alias("decorated"),
                r["inline"].alias("inline"),
            ),
        )
        return F.get(F.filter(tried, lambda r: F.size(r["sections"]) > 0), F.lit(0))

    matched = F.transform(
        keyed,
        lambda x: let(
            F.struct(x.alias("x"), attempts(x).alias("hit")),
            lambda m: F.struct(
                m["x"]["line"].alias("line"), m["x"]["t"].alias("heading"), m["hit"].alias("hit"),
                F.when(m["hit"].isNull(), suggestion(m["x"]["whole"])).alias("hint"),
            ),
        ),
    )
    return F.transform(
        F.filter(matched, lambda m: m["hit"].isNotNull() | m["hint"].isNotNull()),
        lambda m: F.struct(
            m["line"].alias("line"),
            F.coalesce(m["hit"]["sections"], F.array().cast("array<string>")).alias("sections"),
            F.coalesce(m["hit"]["inline"], F.lit(False)).alias("inline"),
            F.coalesce(m["hit"]["decorated"], F.lit(False)).alias("decorated"),
            m["heading"].alias("heading"),
            m["hint"].alias("suggestion"),
        ),
    )


def line_codes(text: Column, folded: Column) -> Column:
    """One character per line: bit 1 = has text, bit 2 = bullet, bit 3 = states a period."""
    flags = F.transform(
        F.arrays_zip(F.split(text, "\n").alias("l"), F.split(folded, "\n").alias("f")),
        lambda z: (
            F.when(z["l"].rlike(HAS_TEXT), 1).otherwise(0)
            + F.when(starts_with_bullet(F.ltrim(z["l"], F.lit(ALL_SPACES))), 2).otherwise(0)
            + F.when((F.contains(z["f"], F.lit("19")) | F.contains(z["f"], F.lit("20"))) & z["f"].rlike(DATE_RANGE), 4).otherwise(0)
        ),
    )
    return F.array_join(F.transform(flags, lambda n: n.cast("string")), "")


def _spans(headings: Column, codes: Column) -> Column:
    """One span per section on a heading; ``stop`` is exclusive."""
    blocks = F.filter(headings, lambda h: ~h["inline"])

    def block_spans(bs: Column) -> Column:
        follow = F.slice(F.transform(bs, lambda b: b["line"]), F.lit(2), F.size(bs))
        paired = F.arrays_zip(bs.alias("b"), follow.alias("next"))
        carried = F.zip_with(
            paired,
            F.array_repeat(codes, F.size(bs)),
            lambda p, c: F.struct(p["b"].alias("b"), F.coalesce(p["next"], F.length(c)).alias("stop"), c.alias("codes")),
        )
        return F.flatten(
            F.transform(
                F.filter(carried, lambda c: F.size(c["b"]["sections"]) > 0),
                lambda c: let(
                    F.substring(c["codes"], c["b"]["line"] + 2, c["stop"] - c["b"]["line"] - 1).rlike("[1357]"),
                    lambda has: F.transform(
                        c["b"]["sections"],
                        lambda s: F.struct(
                            s.alias("section"),
                            (c["b"]["line"] + 1).cast("int").alias("start"),
                            c["stop"].cast("int").alias("stop"),
                            has.alias("has_text"),
                            F.lit(False).alias("inline"),
                        ),
                    ),
                ),
            )
        )

    inline = F.flatten(
        F.transform(
            F.filter(headings, lambda h: h["inline"]),
            lambda h: F.transform(
                h["sections"],
                lambda s: F.struct(
                    s.alias("section"),
                    h["line"].cast("int").alias("start"),
                    (h["line"] + 1).cast("int").alias("stop"),
                    F.lit(True).alias("has_text"),
                    F.lit(True).alias("inline"),
                ),
            ),
        )
    )
    return F.concat(let(blocks, block_spans).cast(f"array<{_SPAN}>"), inline.cast(f"array<{_SPAN}>"))


def _in_enum_order(present: Column) -> Column:
    return F.filter(F.array(*[F.lit(s) for s in fv.SECTIONS]), lambda s: F.array_contains(present, s))


def section_report(text: Column, folded: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """S3-S6 as one struct.

    ``found``, ``decorated`` (heading, section), ``nonstandard`` (heading, suggestion), ``empty``,
    ``spans``, ``work_bullets`` (NULL without a work span), ``dated_spans`` (NULL without an
    experience span), ``has_experience``.
    """
    base = F.struct(
        heading_lines(text, lexicon, folded).alias("headings"), line_codes(text, folded).alias("codes")
    )

    def with_spans(b: Column) -> Column:
        return F.struct(b["headings"].alias("headings"), b["codes"].alias("codes"), _spans(b["headings"], b["codes"]).alias("spans"))

    def count_in(spans: Column, codes: Column, sections: tuple[str, ...], digits: str) -> Column:
        chosen = F.filter(spans, lambda s: s["section"].isin(*sections))
        counts = F.zip_with(
            chosen,
            F.array_repeat(codes, F.size(chosen)),
            lambda s, c: F.regexp_count(F.substring(c, s["start"] + 1, s["stop"] - s["start"]), F.lit(f"[{digits}]")),
        )
        return F.when(
            F.exists(spans, lambda s: s["section"].isin(*sections)),
            F.aggregate(counts, F.lit(0), lambda a, n: a + n),
        )

    def finish(r: Column) -> Column:
        plain = F.flatten(F.transform(F.filter(r["headings"], lambda h: ~h["decorated"]), lambda h: h["sections"]))
        with_text = F.transform(F.filter(r["spans"], lambda s: s["has_text"]), lambda s: s["section"])
        all_spans = F.transform(r["spans"], lambda s: s["section"])
        glyphed = F.flatten(
            F.transform(
                F.filter(r["headings"], lambda h: h["decorated"]),
                lambda h: F.transform(h["sections"], lambda s: F.struct(h["heading"].alias("heading"), s.alias("section"))),
            )
        )
        creative = F.transform(
            F.filter(r["headings"], lambda h: h["suggestion"].isNotNull()),
            lambda h: F.struct(h["heading"].alias("heading"), h["suggestion"].alias("suggestion")),
        )

        def first_per(items: Column, name: str, known: Column) -> Column:
            """First item per section, in line order, without sections found plainly."""
            firsts = [
                F.get(F.filter(F.transform(items, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda y: y["x"][name] == s), F.lit(0))
                for s in fv.SECTIONS
            ]
            ordered = F.array_sort(F.array_compact(F.array(*firsts)))
            kept = F.zip_with(
                ordered, F.array_repeat(known, F.size(ordered)), lambda y, k: F.when(~F.array_contains(k, y["x"][name]), y["x"])
            )
            return F.when(F.size(items) > 0, F.array_compact(kept)).otherwise(items)

        return F.struct(
            _in_enum_order(plain).alias("found"),
            let(F.struct(glyphed.alias("g"), plain.alias("p")), lambda v: first_per(v["g"], "section", v["p"])).alias("decorated"),
            let(F.struct(creative.alias("g"), plain.alias("p")), lambda v: first_per(v["g"], "suggestion", v["p"])).alias("nonstandard"),
            _in_enum_order(F.array_except(all_spans, with_text)).alias("empty"),
            r["spans"].alias("spans"),
            r["headings"].alias("headings"),
            count_in(r["spans"], r["codes"], ("experience", "projects"), "2367").alias("work_bullets"),
            count_in(r["spans"], r["codes"], ("experience",), "4567").alias("dated_lines"),
            F.regexp_count(r["codes"], F.lit("[4567]")).alias("all_dated_lines"),
        )

    return let(let(base, with_spans), finish)


def with_sections(docs: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Adds ``folded`` and ``sec`` to normalized documents."""
    folded = docs.withColumn("folded", once(fold(F.col("text"))))
    return folded.withColumn("sec", once(section_report(F.col("text"), F.col("folded"), lexicon)))


def credit(sec: Column, section: str) -> Column:
    """0 if empty, 1 if found, 0.5 if only behind a glyph."""
    return (
        F.when(F.array_contains(sec["empty"], section), 0.0)
        .when(F.array_contains(sec["found"], section), 1.0)
        .when(F.exists(sec["decorated"], lambda d: d["section"] == section), 0.5)
        .otherwise(0.0)
    )


def section_score(sec: Column) -> Column:
    """Weighted credit before clamping."""
    # Points per section
    points = {"experience": 30.0, "education": 20.0, "skills": 25.0, "summary": 15.0}
    total = F.lit(0.0)
    for section, value in points.items():
        total = total + F.lit(value) * credit(sec, section)
    extra = F.greatest(credit(sec, "projects"), credit(sec, "certifications"), credit(sec, "languages"))
    return total + F.lit(10.0) * extra


def section_label_sql(section: str, lang: str) -> str:
    """S8 as SQL text: heading in the document's language, the section id when it is unknown."""
    arms = " ".join(
        f"WHEN {lang} = '{code}' AND {section} = '{sid}' THEN '{labels[sid]}'"
        for code, labels in fv.SECTION_LABELS.items()
        for sid in fv.SECTIONS
    )
    return f"CASE {arms} ELSE {section} END"


def section_label(section: str, lang: str) -> Column:
    """S8 for two column names."""
    return F.expr(section_label_sql(section, lang))
