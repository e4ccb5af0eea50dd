"""Text normalisation, folding, tokenising and stemming as column expressions.

Conventions used by all column helpers of the package:

* a *padded* string is ``" tok1 tok2 ... "``: tokens joined by single spaces with a space on
  both sides, so whole-token patterns can be matched with one JVM regex over the document;
* ``let(expr, fn)`` evaluates ``expr`` once and hands it to ``fn`` (lambda bodies would
  otherwise repeat the expression for every use).
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import cache, reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv
from .compat import compose_compat
from .lexicon import DEFAULT, Lexicon, escape_regex, trie_regex
from .rows import let

# White space in the Unicode sense (the \s of Java patterns is ASCII only).
SPACE_CLASS = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
# The same characters for trimming, which only looks at both ends.
ALL_SPACES = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
LINE_ENDS = r"[\x{1680}\x{2028}\x{2029}]"  # rare spaces that survive normalisation inside a line
WORD_END = r"(?![A-Za-z0-9_])"
WORD_START = r"(?<![A-Za-z0-9_])"
UNSAFE_OR_WIDE = fv.UNSAFE_CHARS[:-1] + fv.WIDE_SPACES[1:]
# what folding may change; dashes, quotes, bullets and shapes have no marks and no case
FOLDABLE = r"[\x{80}-\x{200F}\x{2028}-\x{259F}\x{2600}-\x{10FFFF}]"


def one_of(value: Column, words: list[str]) -> Column:
    """Membership in a fixed word list, as one anchored pattern over the words' shared prefixes."""
    return value.rlike(f"^(?:{trie_regex(words)})$")


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def once(expr: Column) -> Column:
    """A costly expression the optimizer must not copy.

    A filter on a derived column is pushed below the projection by copying the column's whole
    expression into it, over and over for nested ones.  Expressions that count as nondeterministic
    stay where they are; the guard is always true. A random number will not do: the optimizer replaces
    its comparison with a bound by true.
    """
    return F.when(F.spark_partition_id() >= 0, expr)


def trim_all(text: Column) -> Column:
    """Trim every kind of white space, not only U+0020."""
    return F.btrim(text, F.lit(ALL_SPACES))


# ---- T1, T2 -----------------------------------------------------------------------------
def strip_unsafe(text: Column) -> Column:
    """Drop control characters, zero-width marks and bidi overrides."""
    return F.regexp_replace(text, fv.UNSAFE_CHARS, "")


def _where(text: Column, test: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """``change(text)`` for texts that pass a test cheaper than the change; the others stay as they are."""
    return let(text, lambda t: F.when(test(t), change(t)).otherwise(t))


def _holds(text: Column, *pieces: str) -> Column:
    """Whether any of a few fixed strings occurs."""
    return reduce(or_, (F.contains(text, F.lit(p)) for p in pieces))


def _clean_lines(text: Column) -> Column:
    """Every pattern only meets the texts that hold what it looks for."""
    s = _where(text, lambda t: _holds(t, "\r"), lambda t: F.regexp_replace(t, "\r\n?", "\n"))
    s = _where(s, lambda t: t.rlike(UNSAFE_OR_WIDE), lambda t: F.regexp_replace(strip_unsafe(t), fv.WIDE_SPACES, " "))
    s = _where(s, lambda t: _holds(t, "  ", "\t"), lambda t: F.regexp_replace(t, " [ \t]+|\t[ \t]*", " "))  # single spaces are left alone
    # trim each line; (?d) makes the line feed the only line end
    rare = rf"(?<![^\n])[ {LINE_ENDS[1:]}+|[ {LINE_ENDS[1:]}+(?![^\n])"
    s = _where(s, lambda t: t.startswith(" ") | t.endswith(" ") | _holds(t, "\n ", " \n"), lambda t: F.regexp_replace(t, r"(?md)^ +| +$", ""))
    s = _where(s, lambda t: _holds(t, "\u1680", "\u2028", "\u2029"), lambda t: F.regexp_replace(t, rare, ""))
    s = _where(s, lambda t: _holds(t, "\n\n\n"), lambda t: F.regexp_replace(t, "\n{3,}", "\n\n"))
    return trim_all(s)


def normalize_text(text: Column) -> Column:
    """Cleaned, line-oriented text, whole."""
    return _clean_lines(compose_compat(F.coalesce(text, F.lit(""))))


def normalize_struct(text: Column, long_chars: int = fv.LONG_TEXT_CHARS) -> Column:
    """T1 with its flag: ``struct<text, truncated>``.  The text stays whole; the flag only reports a length past ``long_chars``."""
    return let(normalize_text(text), lambda c: F.struct(c.alias("text"), (F.length(c) > long_chars).alias("truncated")))


# ---- T3 ---------------------------------------------------------------------------------
@cache
def _fold_table() -> tuple[str, str]:
    """Characters that decompose to one base character plus marks, and those bases."""
    source, target = [], []
    for code in range(0xC0, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF or 0xF900 <= code <= 0xFAFF or 0x2F800 <= code <= 0x2FA1F:
            continue
        ch = chr(code)
        decomposed = unicodedata.normalize("NFD", ch)
        if decomposed == ch:
            continue
        base = [c for c in decomposed if not unicodedata.category(c).startswith("M")]
        if len(base) == 1 and base[0] != ch:
            source.append(ch)
            target.append(base[0])
    return "".join(source), "".join(target)


def fold(text: Column) -> Column:
    """Strip diacritics and lower-case.  Pass a plain column: it is used three times."""
    source, target = _fold_table()
    stripped = F.lower(F.regexp_replace(F.translate(text, source, target), r"\p{M}+", ""))
    return F.when(text.rlike(FOLDABLE), stripped).otherwise(F.lower(text))


# ---- T4 ---------------------------------------------------------------------------------
def _split_slashes(padded: Column) -> Column:
    """Split "a/b" tokens except the fixed compounds, on the padded string."""
    keep = "|".join(escape_regex(c) for c in fv.SLASH_COMPOUNDS)
    s = F.regexp_replace(padded, rf"(?<= )(?=(?:{keep}) )([a-z0-9]+)/", "$1\u0001")
    s = F.regexp_replace(s, r"\.*/", " ")
    s = F.regexp_replace(s, " {2,}", " ")
    return F.replace(s, F.lit("\u0001"), F.lit("/"))


def padded_from_folded(folded: Column) -> Column:
    s = _where(folded, lambda t: _holds(t, ".net"), lambda t: F.regexp_replace(t, r"\.net(?<![a-z0-9]\.net)(?![a-z0-9])", "dotnet"))
    # other quotes and hyphens are part of no token
    s = _where(s, lambda t: _holds(t, "'s", "’s"), lambda t: F.regexp_replace(t, rf"['’]s{WORD_END}", " "))
    words = F.array_join(F.regexp_extract_all(s, F.lit(fv.TOKEN_PATTERN), F.lit(0)), " ")
    return _where(F.concat(F.lit(" "), words, F.lit(" ")), lambda p: _holds(p, "/"), _split_slashes)


def padded_tokens(text: Column) -> Column:
    """T4 as a padded string.  An empty document gives two spaces and no token."""
    return padded_from_folded(fold(text))


def tokens_of(padded: Column) -> Column:
    """Token array of a padded string."""
    return F.filter(F.split(F.trim(padded), " "), lambda t: t != "")


def tokenize(text: Column) -> Column:
    """T4: token array."""
    return tokens_of(padded_tokens(text))


def count_tokens(padded: Column) -> Column:
    """Number of tokens of a padded string (spaces minus one; zero when blank)."""
    spaces = F.length(padded) - F.length(F.replace(padded, F.lit(" "), F.lit("")))
    return F.when(F.trim(padded) == "", F.lit(0)).otherwise(spaces - 1)


# ---- T5 ---------------------------------------------------------------------------------
def _drop(token: Column, n: int) -> Column:
    return F.left(token, F.length(token) - n)


def _plural_to_singular(t: Column) -> Column:
    n = F.length(t)
    singular = (
        F.when(F.substring(t, -3, 3).isin("oes", "aes"), F.concat(_drop(t, 3), F.lit("ao")))
        .when(t.endswith("ais"), F.concat(_drop(t, 3), F.lit("al")))
        .when(t.endswith("eis") & (n > 5), F.concat(_drop(t, 3), F.lit("el")))
        .when(t.endswith("ies") & (n > 4), F.concat(_drop(t, 3), F.lit("y")))
        .when(t.rlike("(?:ss|sh|ch|x|z)es$") | (t.endswith("res") & (n > 5)), _drop(t, 2))
        .when(~F.substring(t, -2, 2).isin("ss", "us", "is"), _drop(t, 1))
        .otherwise(t)
    )
    return F.when(t.endswith("s") & (n > 3) & ~t.rlike("[^a-z]"), singular).otherwise(t)


def _verb_to_root(t: Column) -> Column:
    n = F.length(t)
    return (
        F.when(t.endswith("ing") & (n >= 7) & ~t.rlike("[^a-z]"), _drop(t, 3))
        .when(t.endswith("ed") & (n >= 6) & ~t.rlike("[^a-z]"), _drop(t, 2))
        .otherwise(t)
    )


def _final_e(t: Column) -> Column:
    return F.when(t.endswith("e") & (F.length(t) > 4) & ~t.rlike("[^a-z]"), _drop(t, 1)).otherwise(t)


def stem_array(tokens: Column) -> Column:
    """T5 over a token array: three passes, so no step is evaluated twice per token."""
    return F.transform(F.transform(F.transform(tokens, _plural_to_singular), _verb_to_root), _final_e)


def stem(token: Column) -> Column:
    """T5 for one token."""
    return F.get(stem_array(F.array(token)), F.lit(0))


# ---- T6 ---------------------------------------------------------------------------------
def count_phrase(padded: Column, phrase: str) -> Column:
    """Whole-token phrase count; neighbouring hits may share the space between them."""
    if not phrase:
        return F.lit(0)
    return count_matches(padded, f" {escape_regex(phrase)}(?= )")


# ---- T8 ---------------------------------------------------------------------------------
BULLET_CLASS = "[" + escape_regex(fv.BULLET_GLYPHS) + "]"


def starts_with_bullet(line: Column) -> Column:
    """First character is a bullet glyph; ``line`` is already trimmed."""
    return (line != "") & (F.instr(F.lit(fv.BULLET_GLYPHS), F.left(line, F.lit(1))) > 0)


def is_bullet(line: Column) -> Column:
    """T8."""
    return let(trim_all(line), starts_with_bullet)


def bullet_body(line: Column) -> Column:
    """Trimmed line without its bullet."""
    return F.when(starts_with_bullet(line), F.ltrim(F.substr(line, F.lit(2)), F.lit(ALL_SPACES))).otherwise(line)


# ---- T9 ---------------------------------------------------------------------------------
def language_from_parts(sample: Column, padded_sample: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """T9 from the text and its padded tokens."""
    skip = set(lexicon.ambiguous_stopwords)
    en_words = trie_regex([w for w in lexicon.stopwords_en if w not in skip])
    pt_words = trie_regex([w for w in lexicon.stopwords_pt if w not in skip])
    en = count_matches(padded_sample, f" {en_words}(?= )")
    pt = count_matches(padded_sample, f" {pt_words}(?= )") + F.least(
        F.lit(20), count_matches(sample, "[ãõçÃÕÇ]")
    )
    return let(
        F.struct(en.alias("en"), pt.alias("pt")),
        lambda n: F.when(n["en"] + n["pt"] < 5, "unknown")
        .when(n["pt"] > n["en"] * F.lit(1.2), "pt")
        .when(n["en"] > n["pt"] * F.lit(1.2), "en")
        .otherwise("unknown"),
    )


def detect_language(text: Column, padded: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """T9 on the whole text."""
    return language_from_parts(text, padded, lexicon)
