"""Lexicon: word lists and the small tables derived from them.

A :class:`Lexicon` bundles every replaceable list.  Derived artefacts (alias tokens, scan
patterns, blocked follow-up words) are computed once on the driver from lists of fixed size
and reach the executors as literals in the plan or as small dimension tables.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from . import fixed_values as fv


def fold_word(text: str) -> str:
    """Python twin of the folding column function, for lexicon entries only."""
    decomposed = unicodedata.normalize("NFD", text)
    return "".join(c for c in decomposed if not unicodedata.category(c).startswith("M")).lower()


#: Marks a label that opens a sentence while labels are scanned; no text holds it, as control characters go first.
OPENER = "\x01"
INSIDE_TOKEN = "abcdefghijklmnopqrstuvwxyz0123456789+#./"


def tokenize_entry(text: str) -> list[str]:
    """The tokens of a lexicon entry, as the tokenizer's column function gives them (a test keeps both equal).

    Words are cut at every character that no token holds; a word then loses what a token may not begin or end with.
    """
    # a possessive ending goes with its apostrophe, any other apostrophe is a gap
    pieces = fold_word(text).replace("’", "'").split("'")
    kept = [pieces[0], *(p[1:] if p == "s" or (p[:1] == "s" and not (p[1].isascii() and (p[1].isalnum() or p[1] == "_"))) else " " + p for p in pieces[1:])]
    words = "".join(c if c in INSIDE_TOKEN else " " for c in "".join(kept)).split()
    out: list[str] = []
    for word in words:
        if word == ".net" or (word.startswith(".net") and not word[4].isalnum()):
            word = "dotnet" + word[4:]
        token = word.lstrip("+#./").rstrip("./")
        parts = [token] if token in fv.SLASH_COMPOUNDS else [part.rstrip(".") for part in token.split("/")]
        out += filter(None, parts)
    return out


def escape_regex(text: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}/#-])", r"\\\1", text).replace(r"\/", "/").replace(r"\#", "#")


def sql_text(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def trie_regex(words: list[str]) -> str:
    """One pattern matching any of ``words``, longest first at every position.

    Words share prefixes, and the optional tails are greedy, so the regex engine reads each
    position once instead of trying hundreds of alternatives.
    """
    root: dict = {}
    for word in words:
        node = root
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = {}

    def render(node: dict) -> str:
        branches = [escape_regex(ch) + render(child) for ch, child in sorted(node.items()) if ch != ""]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 and "" not in node else "(?:" + "|".join(branches) + ")"
        return body + "?" if "" in node else body

    return render(root)


@dataclass(frozen=True)
class Skill:
    """A skill; its bare label is matched in its own spelling only if ``exact_case`` is set.

    ``before`` and ``after`` are patterns of what has to surround the bare label, for labels whose casing is not enough.
    ``before`` is read, not looked back at, so it may be of any length.
    """

    label: str
    aliases: tuple[str, ...] = ()
    exact_case: bool = False
    soft: bool = False
    before: str | None = None
    after: str | None = None

    @property
    def skill_id(self) -> str:
        return self.label.lower()

    @property
    def scan_aliases(self) -> tuple[str, ...]:
        """Phrases matched on folded tokens; an exact-case label is not an alias of itself."""
        return self.aliases if self.exact_case else (self.label, *self.aliases)


def default_skills() -> list[Skill]:
    return [
        Skill(label, aliases, label in fv.EXACT_CASE_SKILLS, label in fv.SOFT_SKILLS, *fv.LABEL_SURROUNDINGS.get(label, ()))
        for label, aliases in fv.SKILL_ALIASES.items()
    ]


@dataclass(frozen=True, eq=False)
class Lexicon:
    """All replaceable lists.  Pass a customised instance to any operator."""

    stopwords_en: list[str] = field(default_factory=lambda: list(fv.STOPWORDS_EN))
    stopwords_pt: list[str] = field(default_factory=lambda: list(fv.STOPWORDS_PT))
    ambiguous_stopwords: list[str] = field(default_factory=lambda: list(fv.LANGUAGE_AMBIGUOUS))
    job_noise: list[str] = field(default_factory=lambda: list(fv.JOB_NOISE))
    action_verbs: list[str] = field(default_factory=lambda: list(fv.ACTION_VERBS))
    weak_phrases: list[str] = field(default_factory=lambda: list(fv.WEAK_PHRASES))
    section_synonyms: dict[str, list[str]] = field(default_factory=lambda: dict(fv.SECTION_SYNONYMS))
    nonstandard_headings: dict[str, str] = field(default_factory=lambda: dict(fv.NONSTANDARD_HEADINGS))
    skills: list[Skill] = field(default_factory=default_skills)

    # ---- skills ----------------------------------------------------------------------
    @cached_property
    def alias_rows(self) -> list[tuple[str, str, int]]:
        """(alias tokens joined by a space, skill label, n_tokens); first skill wins an alias."""
        rows: dict[str, tuple[str, str, int]] = {}
        for skill in self.skills:
            for alias in skill.scan_aliases:
                tokens = tokenize_entry(alias)
                if tokens:
                    rows.setdefault(" ".join(tokens), (" ".join(tokens), skill.label, len(tokens)))
        return list(rows.values())

    @cached_property
    def alias_pattern(self) -> str:
        return trie_regex([row[0] for row in self.alias_rows])

    @cached_property
    def exact_case_labels(self) -> list[str]:
        return [s.label for s in self.skills if s.exact_case]

    @cached_property
    def label_scan(self) -> tuple[str, str, str]:
        """Three patterns: a line's start before a bare label that is no list item; all labels with what follows in group 1;
        the label at the start of that group, in its own group 1.

        The first finds sentence openers; the scan reads from the left, so a line's start is met before its label is.
        """
        usual = [s.label for s in self.skills if s.exact_case and s.before is None and s.after is None]
        own = [s for s in self.skills if s.exact_case and s.label not in usual]
        longest = lambda labels: "|".join(escape_regex(w) for w in sorted(labels, key=len, reverse=True)) or "(?!)"
        begin = rf"^[ \t{escape_regex(fv.LABEL_LINE_START)}]*+"
        label = rf"(?:{longest(usual)})(?![\w#+-])"
        opener = rf"(?m)({begin})(?={label})(?!{label}\s*[,/|;])"
        leads = [rf"(?:{begin}|(?<![.!?]\s{{1,3}}))(?<![\w.#+{OPENER}-])(?={label})"]
        leads += [rf"{s.before or ''}(?={escape_regex(s.label)}{s.after or ''})" for s in own]
        every = longest([*usual, *(s.label for s in own)])
        first = rf"(?:{label}|{longest([s.label for s in own])})"
        return opener, rf"(?m)(?:{'|'.join(leads)})(?=({first}[\s\S]{{0,40}})){first}", rf"^({every})(?![\w#+-])"

    @cached_property
    def ambiguous_tokens(self) -> list[str]:
        return [t for label in self.exact_case_labels for t in tokenize_entry(label)]

    @cached_property
    def blocked_next(self) -> list[tuple[str, str]]:
        """(label, next token): the pair opens a longer alias of another skill, so the bare label does not count."""
        second: dict[str, set[tuple[str, str]]] = {}
        for phrase, skill, n in self.alias_rows:
            if n > 1:
                head, follower = phrase.split(" ")[:2]
                second.setdefault(head, set()).add((follower, skill))
        heads = {label: tokenize_entry(label)[0] for label in self.exact_case_labels}
        return sorted({(label, follower) for label, head in heads.items() for follower, skill in second.get(head, ()) if skill != label})

    @cached_property
    def weak_rows(self) -> list[tuple[str, str, int]]:
        """(tokens, phrase as displayed, list rank)."""
        return [(" ".join(tokenize_entry(p)), p, rank) for rank, p in enumerate(self.weak_phrases)]

    @cached_property
    def weak_disjoint(self) -> bool:
        """True if no two phrases can overlap in a text, so one scan counts them all."""
        phrases = [row[0].split() for row in self.weak_rows]
        for i, a in enumerate(phrases):
            for j, b in enumerate(phrases):
                if i == j:
                    continue
                inside = any(b[k : k + len(a)] == a for k in range(len(b) - len(a) + 1))
                chained = any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + 1))
                if inside or chained:
                    return False
        return True

    # ---- dimension tables ------------------------------------------------------------
    def alias_dim(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.alias_rows, "alias STRING, skill STRING, n_tokens INT")

    def skill_dim(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(s.label, s.soft, s.exact_case) for s in self.skills], "skill STRING, soft BOOLEAN, exact_case BOOLEAN"
        )


DEFAULT = Lexicon()
