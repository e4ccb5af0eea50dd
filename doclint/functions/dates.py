"""Month strings and date-range wording as column expressions (dates stay STRING by design)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv
from .text import WORD_START, fold, let, trim_all

# A period stated on one line, on folded text ("2019 - 2024", "mar 2021 – present")
_YEAR = r"(?:19[5-9]\d|20[0-4]\d)"
_SP = r"[^\S\n]"
_MONTH_BEFORE = rf"(?:[a-z]{{3,9}}\.?{_SP}(?:de{_SP})?|\d{{1,2}}[/.])?"
_OPEN_END = "present|current|now|today|atual|hoje|presente|o momento|momento"
DATE_RANGE = (
    rf"(?:{_YEAR}{_SP}?(?:[-–—]|{_SP}(?:to|a|ate){_SP}){_SP}?(?:{_MONTH_BEFORE}{_YEAR}|{_OPEN_END})"
    rf"|{WORD_START}(?:since|desde){_SP}{_MONTH_BEFORE}{_YEAR})"
)


def count_date_range_lines(folded: Column) -> Column:
    """Number of lines that state a period."""
    return F.regexp_count(folded, F.lit(rf"(?md)^[^\n]*?{DATE_RANGE}[^\n]*$"))


def is_date_like(segment: Column) -> Column:
    """The text is nothing but a date ("Jan 2020 – Present")."""
    prefixes = "|".join(fv.MONTH_PREFIXES)
    ongoing = "|".join(fv.ONGOING_WORDS)
    sep = r"[\s/.,–—-]"
    word = rf"(?:\d{{1,4}}|{ongoing}|(?=[^\s/.,–—-]{{1,9}}(?:{sep}|$))(?:{prefixes})[^\s/.,–—-]*)"
    return (F.length(segment) <= 40) & let(
        segment, lambda s: fold(s).rlike(rf"^{sep}*{word}(?:{sep}+{word})*{sep}*$")
    )


def _month_number(name: Column) -> Column:
    """Month number of a folded EN/PT name, NULL when unknown."""
    table = ", ".join(f"'{month}', {number}" for month, number in fv.MONTH_NAMES.items())
    return F.try_element_at(F.expr(f"map({table})"), name)


def normalize_month(value: Column) -> Column:
    """``YYYY-MM``, ``YYYY`` or the empty string."""
    iso = r"^(\d{4})-(\d{1,2})(?:-\d{1,2})?$"
    numeric = r"^(\d{1,2})\s*[/.-]\s*(\d{4})$"
    named = r"^([a-z]{3,9})\.?\s*(?:de\s+|/\s*)?(\d{4})$"
    plain = r"^(\d{4})$"

    def parse(s: Column) -> Column:
        part = lambda p, g: F.regexp_extract(s, p, g)
        year = (
            F.when(s.rlike(iso), part(iso, 1))
            .when(s.rlike(numeric), part(numeric, 2))
            .when(s.rlike(named), part(named, 2))
            .when(s.rlike(plain), part(plain, 1))
        ).cast("int")
        month = (
            F.when(s.rlike(iso), part(iso, 2).cast("int"))
            .when(s.rlike(numeric), part(numeric, 1).cast("int"))
            .when(s.rlike(named), F.coalesce(_month_number(part(named, 1)), F.lit(0)))
        )
        return let(
            F.struct(year.alias("y"), month.alias("m")),
            lambda v: F.when(v["y"].isNull() | ~v["y"].between(1950, 2099), "")
            .when(v["m"].isNull(), v["y"].cast("string"))
            .when(v["m"].between(1, 12), F.concat(v["y"].cast("string"), F.lit("-"), F.lpad(v["m"].cast("string"), 2, "0")))
            .otherwise(""),
        )

    return let(let(trim_all(value), fold), parse)


def format_month(value: Column, lang: Column) -> Column:
    """``Mar 2021`` (en), ``03/2021`` (pt), a bare year as is."""
    def show(m: Column) -> Column:
        year, month = F.left(m, F.lit(4)), F.substring(m, 6, 2)
        name = F.get(F.array(*[F.lit(n) for n in fv.MONTHS_EN]), month.cast("int") - 1)
        return (
            F.when(F.length(m) != 7, m)
            .when(lang == "pt", F.concat(month, F.lit("/"), year))
            .otherwise(F.concat(name, F.lit(" "), year))
        )

    return let(normalize_month(value), show)


def format_range(start: Column, end: Column, current: Column, lang: Column) -> Column:
    """``from – to``; an open end is Present / Atual."""
    ongoing = F.when(lang == "pt", fv.SECTION_LABELS["pt"]["present"]).otherwise(fv.SECTION_LABELS["en"]["present"])
    pair = F.struct(
        format_month(start, lang).alias("a"),
        F.when(current, ongoing).otherwise(format_month(end, lang)).alias("b"),
    )
    return let(
        pair,
        lambda v: F.when((v["a"] != "") & (v["b"] != ""), F.concat(v["a"], F.lit(" – "), v["b"]))
        .when(v["a"] != "", v["a"])
        .otherwise(v["b"]),
    )
