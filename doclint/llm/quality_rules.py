"""Quality rules as a bitmask ledger, in native column functions.

:func:`ledger` evaluates every rule once per document and stores the measurements and one failure bit per rule.
:func:`apply_policy` judges a ledger by a versioned policy (a mask of the rules that reject), and :func:`ablations`
tells for each rule what leaving it out would change, from counts per distinct mask only. Neither reads a text again.

Defined results: a null or empty text has no words, so every measurement is 0 and only ``few_words`` fails. Repeated rows
are judged alike, one by one. A null doc_id stays null. Other columns are neither read nor returned. Windows are compared by
a 64-bit hash within one text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table, text_of

WORD_GAP = r"[\x20\x09-\x0D]+"
WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_marks")


@dataclass(frozen=True)
class Rule:
    """``failed`` maps the measurements, by name, to a condition; ``sql`` says the same. The bit is the place in RULES."""

    name: str
    failed: Callable[[dict[str, Column]], Column]
    sql: str


#: New rules go to the end: a bit keeps its meaning for ever.
RULES = (
    Rule("few_words", lambda m: m["n_words"] < 10, "n_words < 10"),
    Rule("repeated_words", lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"], "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", lambda m: 10 * m["n_symbols"] > 3 * m["n_words"], "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", lambda m: 2 * m["n_dup_lines"] > m["n_lines"], "2 * n_dup_lines > n_lines"),
    Rule("short_words", lambda m: m["word_chars"] < 2 * m["n_words"], "word_chars < 2 * n_words"),
    Rule("long_words", lambda m: m["word_chars"] > 25 * m["n_words"], "word_chars > 25 * n_words"),
    Rule("capitals", lambda m: (m["n_letters"] >= 20) & (2 * m["n_upper"] > m["n_letters"]), "n_letters >= 20 AND 2 * n_upper > n_letters"),
    Rule("exclamations", lambda m: (m["n_words"] >= 10) & (10 * m["n_marks"] > 3 * m["n_words"]), "n_words >= 10 AND 10 * n_marks > 3 * n_words"),
)
BASE = ("few_words", "repeated_words")
#: Versions stay as they are once used; a change is a new version.
POLICIES = {
    "base-1": BASE,
    "prose-1": (*BASE, "symbols", "duplicate_lines"),
    "prose-2": tuple(r.name for r in RULES),
}
CURRENT = "prose-2"


def mask(names) -> int:
    places = {r.name: i for i, r in enumerate(RULES)}
    return sum(1 << places[n] for n in set(names))


def _repeated(words: Column) -> Column:
    """Words inside windows of five that occur twice or more in the array."""
    at = lambda w, i, j: F.get(w, i + F.lit(j))
    hashes = lambda w: F.transform(
        F.sequence(F.lit(0), F.size(w) - F.lit(WINDOW)), lambda i: F.xxhash64(*(at(w, i, j) for j in range(WINDOW)))
    )

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, i, j: F.coalesce(F.get(s, i + F.lit(j))["h"] == F.get(s, i)["h"], F.lit(False))
        places = let(ordered, lambda s: F.transform(F.filter(s, lambda x, i: same(s, i, -1) | same(s, i, 1)), lambda x: x["i"]))
        # a window adds five words, or as many as lie before the next one
        return let(
            F.array_sort(places),
            lambda p: F.aggregate(
                F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + F.lit(1)) - x, F.lit(WINDOW)), F.lit(WINDOW))),
                F.lit(0).cast("long"), lambda a, x: a + x,
            ),
        )

    zero = F.lit(0).cast("long")
    return F.when(F.size(words) < WINDOW, zero).otherwise(
        let(hashes(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), zero).otherwise(covered(h)))
    )


def _measured(text: Column) -> Column:
    left = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("long")
    without = lambda chars: F.length(F.translate(text, chars, "")).cast("long")
    length = F.length(text).cast("long")
    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        without(" \t\n\x0b\x0c\r").alias("word_chars"),
        (length - without("#*$%&|<>")).alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeated(w).alias("n_repeat_words"),
        (length - left("[A-Z]+")).alias("n_upper"),
        (length - left("[A-Za-z]+")).alias("n_letters"),
        (length - without("!")).alias("n_marks"),
    ))


def _bits(m: dict[str, Column]) -> Column:
    """The failure bits of one row of measurements."""
    return sum((F.when(r.failed(m), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(RULES)), F.lit(0).cast("long"))


def ledger(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, the measurements and ``fail_bits``; one row per document, no shuffle."""
    m = docs.select(F.col(key).alias("doc_id"), _measured(text_of(text)).alias("m"))
    flat = m.select("doc_id", *(F.col(f"m.{c}").alias(c) for c in MEASURES))
    return flat.withColumn("fail_bits", _bits({c: F.col(c) for c in MEASURES}))


def verdict(bits: Column, policy: str = CURRENT) -> Column:
    return bits.bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def apply_policy(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with ``kept`` and the policy's name."""
    return entries.withColumns({"policy": F.lit(policy), "kept": verdict(F.col("fail_bits"), policy)})


def ablations(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For every rule of the policy: documents it fails, and documents that only it rejects. Counts per mask come first."""
    used = mask(POLICIES[policy])
    counts = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(used).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(RULES) if used >> i & 1))
    each = counts.select("bits", "n", F.explode(rules).alias("r"))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
    )


def keep_good(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The documents a policy keeps, with all their columns: one narrow filter."""
    return docs.filter(verdict(let(_measured(text_of()), lambda m: _bits({c: m[c] for c in MEASURES})), policy))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_policy(ledger(table(spark, sf_dir, "documents")))
    base = F.col("fail_bits").bitwiseAND(F.lit(mask(BASE)).cast("long")) != 0
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        (~base & F.col("kept")).alias("kept"), "fail_bits",
    )


def oracle_sql() -> str:
    bits = " + ".join(f"CASE WHEN {r.sql} THEN {1 << i} ELSE 0 END" for i, r in enumerate(RULES))
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), worded AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM docs
), windows AS (
  SELECT r, i, list_aggregate(w[i : i + 4], 'string_agg', ' ') AS run
  FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM worded WHERE len(w) >= 5)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, run) AS c FROM windows) WHERE c > 1
), repeats AS (
  SELECT r, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twice) GROUP BY r
), measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words,
         (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_upper,
         (length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')))::BIGINT AS n_letters,
         (length(t) - length(regexp_replace(t, '!', '', 'g')))::BIGINT AS n_marks
  FROM worded LEFT JOIN repeats USING (r)
), judged AS (
  SELECT *, ({bits})::BIGINT AS fail_bits FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {mask(BASE)}) <> 0 AS base_failed,
       (fail_bits & {mask(BASE)}) = 0 AND (fail_bits & {mask(POLICIES[CURRENT])}) = 0 AS kept, fail_bits
FROM judged"""
