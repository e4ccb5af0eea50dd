"""Contact, privacy and URL predicates as column expressions.

Patterns run over whole documents with one JVM regex each.  Line caps are applied by cutting
every long line first (:func:`capped_lines`), so a pattern never sees more than the cap and
the patterns below exclude line feeds where they allow white space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv
from .text import SPACE_CLASS, WORD_END, WORD_START, let, strip_unsafe, trim_all

# Contact patterns
EMAIL = r"(?i)^[a-z0-9._%+-]{1,64}@[a-z0-9-]{1,63}(?:\.[a-z0-9-]{1,63}){0,8}\.[a-z]{2,24}$"
STRICT_EMAIL = r"^[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}$"
INLINE_SPACE = r"[^\S\n]"
PHONE_CANDIDATE = r"\+?\(?\d[\d\x20\t\f\x0B().-]{6,18}\d"
TAX_ID = r"^\d{3}\.\d{3}\.\d{3}-\d{2}$|^\d{2}\.\d{3}\.\d{3}/?\d{4}-\d{2}$"
MONTH_RANGE = r"^\d{1,2}[./]\d{4}\s*[-–]\s*\d{1,2}[./]\d{4}$"
ONLY_YEARS = r"^(?:\D*(?<!\d)(?:19|20)\d{2}(?!\d))+\D*$"
URL_CUT = r"(?i)^(?:https?://)?(?:www\.)?[a-z0-9-]{1,63}(?:\.[a-z0-9-]{1,63}){1,8}/\S{0,200}[-_]$"
PROFILE_CUT = r"(?i)linkedin\.com/(?:in|pub)/$"
OPENERS = "^[<(\\[{\"'`]+"
CLOSERS = "(?<![>)\\]}\"'`,;:.!?])[>)\\]}\"'`,;:.!?]++$"  # tried only where a run of them begins


def words_with(text: Column, core: str) -> Column:
    """White-space delimited words that hold ``core`` (a pattern)."""
    words = F.regexp_extract_all(text, F.lit(rf"(?<!\S)\S*{core}\S*"), F.lit(0))
    split = F.flatten(F.transform(words, lambda w: F.split(w, f"[{SPACE_CLASS}]+")))
    return F.filter(split, lambda w: w != "")


def clean_word(word: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(word, OPENERS, ""), CLOSERS, "")
    return F.regexp_replace(bare, "(?i)^mailto:", "")


def has_email(text: Column) -> Column:
    """Documents without an at-sign skip the word scan."""
    found = F.exists(words_with(text, "@"), lambda w: clean_word(w).rlike(EMAIL))
    return F.when(F.contains(text, F.lit("@")), found).otherwise(F.lit(False))


def is_phone(candidate: Column) -> Column:
    """C2 predicate for one candidate."""
    digits = F.length(F.regexp_replace(candidate, r"\D", ""))
    return (
        digits.between(8, 15)
        & ~candidate.rlike(TAX_ID)
        & ~candidate.rlike(MONTH_RANGE)
        & ~candidate.rlike(ONLY_YEARS)
        & (candidate.startswith("+") | candidate.rlike(r"\(\d{2,4}\)") | (digits >= 10))
    )


def phone_candidates(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PHONE_CANDIDATE), F.lit(0))


def has_phone(text: Column) -> Column:
    """C2 on a whole document."""
    return F.exists(phone_candidates(text), lambda c: is_phone(F.trim(c)))


def linkedin_state(text: Column) -> Column:
    """``url``, ``label`` or ``none``; only documents that can hold the name are split."""
    spelled = "(?i:" + r"[^a-z\s]*".join("linkedin") + ")"
    words = F.transform(words_with(text, spelled), lambda w: F.lower(clean_word(w)))
    state = let(
        words,
        lambda ws: F.when(
            F.exists(ws, lambda w: F.contains(w, F.lit("linkedin.com/in/")) | F.contains(w, F.lit("linkedin.com/pub/"))),
            "url",
        )
        .when(F.exists(ws, lambda w: F.regexp_replace(w, "[^a-z]", "") == "linkedin"), "label")
        .otherwise("none"),
    )
    return F.when(text.rlike(spelled), state).otherwise(F.lit("none"))


def broken_url(text: Column) -> Column:
    """C4: first link that a line break cuts in two, or NULL."""
    candidates = F.regexp_extract_all(
        text, F.lit(r"(?<![^ \n])([^ \n]+[-_/]) *\n(?= *[A-Za-z0-9])"), F.lit(1)
    )
    found = F.get(
        F.filter(
            F.transform(candidates, lambda c: F.regexp_replace(c, OPENERS, "")),
            lambda c: (F.length(c) >= 6) & (c.rlike(URL_CUT) | c.rlike(PROFILE_CUT)),
        ),
        F.lit(0),
    )
    return F.when(text.rlike("[-_/] *\n"), found)


def personal_kinds(folded: Column) -> Column:
    """Kinds of personal data on folded lines, in fixed order."""
    # Per kind, (literals of which one must occur, pattern)
    word = lambda w: f"{w}{WORD_END}"
    rules = {
        "taxId": [((), r"\d{3}\.\d{3}\.\d{3}-\d{2}(?<!\d\d{3}\.\d{3}\.\d{3}-\d{2})(?!\d)"), (("cpf",), f"{WORD_START}{word('cpf')}")],
        "idCard": [(("rg",), rf"{WORD_START}rg{WORD_END}[^a-z0-9\n]{{0,6}}\d")],
        "birthDate": [
            (
                ("nasc", "birth", "dob"),
                f"{WORD_START}{word('(?:data de nascimento|nascimento|nascid[oa] em|date of birth|birth date|birthdate|dob)')}",
            )
        ],
        "age": [
            (("idade", "age"), rf"{WORD_START}(?:idade|age){INLINE_SPACE}?:{INLINE_SPACE}?\d{{2}}{WORD_END}"),
            (
                ("anos", "years old"),
                rf"(?md)(?:^{INLINE_SPACE}*|[|,;·•–—-]{INLINE_SPACE}?)\d{{2}} (?:anos|years old)(?:{INLINE_SPACE}*$|{INLINE_SPACE}?[|,;·•–—-])",
            ),
        ],
        "maritalStatus": [
            (("estado civil", "marital status"), f"{WORD_START}{word('(?:estado civil|marital status)')}"),
            (
                ("solteir", "casad", "divorciad", "viuv"),
                rf"(?md)^(?=[^\n]{{0,{fv.MAX_STATUS_LINE_CHARS}}}$)[^\n]*{WORD_START}(?:solteir[oa]|casad[oa]|divorciad[oa]|viuv[oa]){WORD_END}",
            ),
        ],
    }
    hits = []
    for kind in fv.PERSONAL_KINDS:
        test = F.lit(False)
        for literals, pattern in rules[kind]:
            hit = folded.rlike(pattern)
            if literals:
                present = F.lit(False)
                for literal in literals:
                    present = present | F.contains(folded, F.lit(literal))
                hit = present & hit
            test = test | hit
        hits.append(F.when(test, F.lit(kind)))
    return F.array_compact(F.array(*hits))


def contact_struct(text: Column) -> Column:
    """C1-C3 of one text as ``struct<email, phone, linkedin>`` (NULL text gives NULL)."""
    return F.when(
        text.isNotNull(),
        let(
            text,
            lambda t: F.struct(
                has_email(t).alias("email"),
                has_phone(t).alias("phone"),
                linkedin_state(t).alias("linkedin"),
            ),
        ),
    )


# ---- C7-C9 ------------------------------------------------------------------------------
def is_valid_email(value: Column) -> Column:
    """Strict address check used for structured records."""
    return (F.length(value) <= fv.FIELD_LIMITS["email"]) & value.rlike(STRICT_EMAIL)


def safe_url(value: Column) -> Column:
    """Canonical http(s) link without credentials, or NULL."""
    def build(s: Column) -> Column:
        u = F.when(s.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), s).otherwise(F.concat(F.lit("https://"), s))
        return let(u, _canonical)

    def _canonical(u: Column) -> Column:
        scheme = F.lower(F.regexp_extract(u, r"(?i)^([a-z][a-z0-9+.-]*):", 1))
        rest = F.regexp_replace(F.regexp_replace(u, r"(?i)^[a-z][a-z0-9+.-]*:[/\\]*", ""), r"[\t\n]", "")
        authority = F.regexp_extract(rest, r"^([^/?#\\]*)", 1)
        tail = F.regexp_extract(rest, r"(?s)^[^/?#\\]*(.*)$", 1)
        host = F.lower(F.regexp_replace(authority, r":\d*$", ""))
        port = F.regexp_extract(authority, r":(\d+)$", 1)
        default_port = F.when(scheme == "http", "80").otherwise("443")
        shown_port = F.when((port == "") | (port == default_port), "").otherwise(F.concat(F.lit(":"), port))
        path = F.when(tail == "", "/").when(tail.rlike(r"^[?#]"), F.concat(F.lit("/"), tail)).otherwise(
            F.replace(tail, F.lit(" "), F.lit("%20"))
        )
        ok = (
            scheme.isin("http", "https")
            & ~F.contains(authority, F.lit("@"))
            & F.contains(host, F.lit("."))
            & host.rlike(r"^[^\s<>\[\]^|%\x00-\x20:]+$")
        )
        return F.when(ok, F.concat(scheme, F.lit("://"), host, shown_port, path))

    cleaned = trim_all(strip_unsafe(value))
    return let(cleaned, lambda s: F.when(s != "", build(s)))


def display_url(href: Column) -> Column:
    """Link without protocol and one trailing slash."""
    return F.regexp_replace(F.regexp_replace(href, "^https?://", ""), "/$", "")


