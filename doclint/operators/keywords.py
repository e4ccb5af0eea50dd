"""Job keywords and their match against documents.

Both sides are indexed once, in one row each: a job ad becomes at most 32 weighted keywords, a document
the hashes of its terms with their counts.  A pair meets both rows and is matched inside its own row, so
no row per keyword is ever shuffled.  Windows run within one ad.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.lexicon import DEFAULT, OPENER, Lexicon, escape_regex
from ..functions.text import WORD_END, WORD_START, count_tokens, fold, let, once, one_of, padded_tokens, stem_array, tokenize, trim_all

COVERED = "\u0001"
# Keyword arithmetic
SKILL_BASE, SOFT_BASE = 3.0, 1.5
REQUIRED_FACTOR, OPTIONAL_FACTOR = 1.2, 0.8
BIGRAM_FACTOR = 1.5
MAX_TERM_WEIGHT = 4.0
STUFFING_COUNT, STUFFING_SHARE, STUFFING_PENALTY, STUFFING_CAP = 10, 0.03, 10, 30
SHORT_JOB_TOKENS = 40
#: Copies of an ad's packed keywords; its pairs are dealt over them.
PAIRS_PER_COPY = 1 << 16


# ---- K1 ---------------------------------------------------------------------------------
def own_line_weight(line: Column) -> Column:
    """Weight a line sets as a heading, NULL if it is none."""
    def build(key: Column) -> Column:
        out = F.lit(None).cast("double")
        for weight, phrases in reversed(fv.JOB_LINE_HEADINGS):
            words = "|".join(
                ".".join(escape_regex(part) for part in p.strip().split(".")) for p in phrases.split(";")
            )
            out = F.when(key.rlike(f"{WORD_START}(?:{words}){WORD_END}"), F.lit(weight)).otherwise(out)
        return F.when(F.length(key) <= 60, out)

    return let(trim_all(let(line, fold)), build)


def job_lines(jobs: DataFrame) -> DataFrame:
    """K1: ``(job_id, line_no, line, weight)`` with weights filled forward from headings."""
    lines = jobs.select("job_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn(
        "own", own_line_weight(F.col("line"))
    )
    filled = F.last("own", ignorenulls=True).over(Window.partitionBy("job_id").orderBy("line_no"))
    return lines.withColumn("weight", F.coalesce(filled, F.lit(1.0))).drop("own")


# ---- K3-K5 ------------------------------------------------------------------------------
def alias_hits(padded: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """K3: aliases found leftmost-longest without overlap, in text order."""
    return F.regexp_extract_all(padded, F.lit(f"(?<= )({lexicon.alias_pattern})(?= )"), F.lit(1))


def mask_aliases(padded: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """K3: padded string with every recognised alias replaced by one marker token."""
    return F.regexp_replace(padded, f"(?<= )(?:{lexicon.alias_pattern})(?= )", COVERED)


def label_hits(text: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """K4/K5: exact-case labels that are no sentence opener and do not start a longer skill, in one scan for all of them."""
    opener, scan, own = lexicon.label_scan
    if not lexicon.exact_case_labels:
        return F.array().cast("array<string>")
    marked = F.regexp_replace(text, opener, f"$1{OPENER}")
    context = F.regexp_extract_all(marked, F.lit(scan), F.lit(1))
    blocked = [f"{label} {following}" for label, following in lexicon.blocked_next]

    def split_context(c: Column) -> Column:
        return let(
            F.regexp_extract(c, own, 1),
            lambda l: F.struct(
                l.alias("label"),
                F.get(let(F.substring(c, F.length(l) + 1, F.lit(40)), tokenize), F.lit(0)).alias("next"),
            ),
        )

    kept = F.filter(
        F.transform(context, split_context),
        lambda h: h["next"].isNull() | ~one_of(F.concat_ws(" ", h["label"], h["next"]), blocked),
    )
    return F.transform(kept, lambda h: h["label"])


def _with_skill(hits: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Replace ``alias`` by ``skill``.  Spark broadcasts the alias table while its size allows that; a lexicon may be larger."""
    dim = lexicon.alias_dim(hits.sparkSession).select("alias", "skill")
    return hits.join(dim, "alias").drop("alias")


def skill_counts(rows: DataFrame, keys: list[str], lexicon: Lexicon = DEFAULT) -> DataFrame:
    """K3-K6: ``(keys..., skill, n)`` from rows that carry ``text`` and ``padded``.

    The scan scope is the row: whole documents for résumés, single lines for ads.
    """
    by_alias = _with_skill(
        rows.select(*keys, once(alias_hits(F.col("padded"), lexicon)).alias("hits")).select(*keys, F.explode("hits").alias("alias")), lexicon
    )
    by_label = rows.select(*keys, once(label_hits(F.col("text"), lexicon)).alias("hits")).select(*keys, F.explode("hits").alias("skill"))
    return by_alias.unionByName(by_label).groupBy(*keys, "skill").agg(F.count("*").alias("n"))


# ---- K7 ---------------------------------------------------------------------------------
def weighted_job_lines(jobs: DataFrame) -> DataFrame:
    """Lines that count (weight above 0) with their padded tokens."""
    return (
        job_lines(jobs)
        .filter("weight > 0")
        .withColumn("padded", padded_tokens(F.col("line")))
        .withColumnRenamed("line", "text")
    )


def job_skills(lines: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """K7: ``(job_id, skill, n, max_weight, weight)``."""
    per_line = skill_counts(lines, ["job_id", "line_no", "weight"], lexicon)
    stats = per_line.groupBy("job_id", "skill").agg(F.sum("n").alias("n"), F.max("weight").alias("max_weight"))
    softs = [s.label for s in lexicon.skills if s.soft]
    base = F.when(F.col("skill").isin(softs), SOFT_BASE).otherwise(SKILL_BASE)
    factor = (
        F.when(F.col("max_weight") >= 1.5, REQUIRED_FACTOR).when(F.col("max_weight") < 1, OPTIONAL_FACTOR).otherwise(1.0)
    )
    return stats.withColumn("weight", base * factor + F.least(F.col("n") - 1, F.lit(3)) * F.lit(0.5))


# ---- K8, K9 -----------------------------------------------------------------------------
def _usable(token: Column, lexicon: Lexicon) -> Column:
    excluded = sorted(
        set(lexicon.stopwords_en) | set(lexicon.stopwords_pt) | set(lexicon.job_noise) | set(lexicon.ambiguous_tokens)
    )
    return (
        (token != COVERED) & (F.length(token) >= 3) & ~token.rlike(r"^\d+(?:[.,]\d+)?$") & ~one_of(token, excluded)
    )


def job_term_mentions(lines: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """K8: one row per mention ``(job_id, key, display, n_stems, line_no, pos, w)``."""
    tokens = lines.withColumn("toks", F.filter(F.split(F.trim(mask_aliases(F.col("padded"), lexicon)), " "), lambda t: t != ""))
    tagged = tokens.withColumn(
        "tagged",
        F.zip_with(
            "toks",
            stem_array(F.col("toks")),
            lambda t, s: F.struct(t.alias("t"), s.alias("s"), _usable(t, lexicon).alias("ok")),
        ),
    )
    neighbours = F.arrays_zip(F.col("tagged").alias("a"), F.slice("tagged", F.lit(2), F.size("tagged")).alias("b"))
    pairs = tagged.select("job_id", "line_no", "weight", F.posexplode(neighbours).alias("pos", "z")).filter("z.a.ok")
    mention = lambda key, display, n, w: F.struct(
        key.alias("key"), display.alias("display"), F.lit(n).alias("n_stems"), w.alias("w")
    )
    single = mention(F.col("z.a.s"), F.col("z.a.t"), 1, F.col("weight"))
    double = F.when(
        F.col("z.b.ok"),
        mention(
            F.concat_ws(" ", "z.a.s", "z.b.s"), F.concat_ws(" ", "z.a.t", "z.b.t"), 2, F.col("weight") * BIGRAM_FACTOR
        ),
    )
    return pairs.select(
        "job_id", "line_no", "pos", F.explode(F.array_compact(F.array(single, double))).alias("m")
    ).select("job_id", "line_no", "pos", "m.*")


def job_terms(lines: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """K8/K9: kept terms ``(job_id, key, term, n_stems, n, max_weight, weight)``.

    Weights are multiples of 1/8, so their sums are exact in any order.
    """
    by_surface = job_term_mentions(lines, lexicon).groupBy("job_id", "key", "n_stems", "display").agg(
        F.count("*").alias("n"), F.sum("w").alias("score"), F.max("w").alias("max_weight"),
        F.min(F.struct("line_no", "pos")).alias("first"),
    )
    by_key = by_surface.groupBy("job_id", "key", "n_stems").agg(
        F.min(F.struct((-F.col("n")).alias("neg"), "first", "display"))["display"].alias("term"),
        F.sum("n").alias("n"), F.sum("score").alias("score"), F.max("max_weight").alias("max_weight"),
    )
    return by_key.filter(
        "n >= 2 OR (max_weight >= 1.5 AND n_stems = 1 AND length(key) >= 4)"
    ).withColumn("weight", F.least("score", F.lit(MAX_TERM_WEIGHT)))


# ---- K10, K11 ---------------------------------------------------------------------------
def job_keywords(jobs: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """``(job_id, rank, kind, term, key, weight, milli)``; at most 32 rows per ad.

    ``kind`` is ``skill``, ``term1`` or ``term2``; ``key`` joins to :func:`document_terms`.
    ``milli`` is the weight in thousandths, exact for summing.
    """
    lines = weighted_job_lines(jobs)
    by_weight = Window.partitionBy("job_id").orderBy(F.desc("weight"), F.collate("term", "UNICODE"))
    skills = (
        job_skills(lines, lexicon)
        .select("job_id", F.lit("skill").alias("kind"), F.col("skill").alias("term"), F.col("skill").alias("key"), "weight")
        .withColumn("pos", F.row_number().over(by_weight))
        .filter(F.col("pos") <= fv.MAX_SKILLS)
    )
    terms = job_terms(lines, lexicon).select("job_id", "n_stems", "term", "key", "weight")
    in_kind = Window.partitionBy("job_id", "n_stems").orderBy(F.desc("weight"), F.collate("term", "UNICODE"))
    ranked = terms.withColumn("pos", F.row_number().over(in_kind))
    per_job = Window.partitionBy("job_id")
    chosen_stems = F.flatten(
        F.collect_list(
            F.when((F.col("n_stems") == 2) & (F.col("pos") <= fv.MAX_BIGRAMS), F.split("key", " "))
        ).over(per_job)
    )
    kept = ranked.withColumn("chosen", chosen_stems).filter(
        ((F.col("n_stems") == 2) & (F.col("pos") <= fv.MAX_BIGRAMS))
        | ((F.col("n_stems") == 1) & ~F.array_contains("chosen", F.col("key")))
    )
    term_order = Window.partitionBy("job_id").orderBy(F.desc("n_stems"), "pos")
    top_terms = (
        kept.withColumn("pos", F.row_number().over(term_order))
        .filter(F.col("pos") <= fv.MAX_TERMS)
        .select("job_id", F.concat(F.lit("term"), F.col("n_stems")).alias("kind"), "term", "key", "weight", "pos")
    )
    both = skills.withColumn("kind_pos", F.col("pos")).drop("pos").unionByName(
        top_terms.withColumn("kind_pos", F.col("pos") + 1000).drop("pos")
    )
    return (
        both.withColumn("rank", F.row_number().over(Window.partitionBy("job_id").orderBy("kind_pos")))
        .withColumn("milli", F.round(F.col("weight") * 1000).cast("bigint"))
        .select("job_id", "rank", "kind", "term", "key", "weight", "milli")
    )


# ---- K12 --------------------------------------------------------------------------------
def document_terms(docs: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """``(doc_id, kind, key, n)`` from normalized documents with ``text`` and ``padded``."""
    base = docs.select("doc_id", "text", "padded")
    counted = (
        base.select("doc_id", once(_stems(F.col("padded"))).alias("stems"))
        .select("doc_id", F.explode(_stem_terms(F.col("stems"), lambda kind, k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))).alias("t"))
        .groupBy("doc_id", "t.kind", "t.key").agg(F.count("*").alias("n"))
    )
    skills = skill_counts(base, ["doc_id"], lexicon).select(
        "doc_id", F.lit("skill").alias("kind"), F.col("skill").alias("key"), "n"
    )
    return counted.unionByName(skills)


def _stems(padded: Column) -> Column:
    return stem_array(F.filter(F.split(F.trim(padded), " "), lambda t: t != ""))


def _stem_terms(stems: Column, build) -> Column:
    """Every mention of a stem and of two stems side by side, as ``build(kind, key)``."""
    follow = F.zip_with(
        stems, F.slice(stems, F.lit(2), F.size(stems)), lambda a, b: F.when(a != b, F.concat_ws(" ", a, b))
    )
    # a stem repeated side by side counts non-overlapping pairs only
    doubled = F.transform(
        F.regexp_extract_all(
            F.concat(F.lit(" "), F.array_join(stems, " "), F.lit(" ")), F.lit(r" ([^ ]+) \1(?= )"), F.lit(1)
        ),
        lambda s: F.concat_ws(" ", s, s),
    )
    term = lambda arr, kind: F.transform(arr, lambda k: build(kind, k))
    return F.concat(term(stems, "term1"), term(F.array_compact(follow), "term2"), term(doubled, "term2"))


def term_id(kind: str | Column, key: Column) -> Column:
    """64 bits for a term; they only decide inside one pair."""
    return F.xxhash64(F.lit(kind) if isinstance(kind, str) else kind, key)


def _skill_of(alias: Column, lexicon: Lexicon) -> Column:
    """The skill of an alias: a table for each first character, so a lookup passes few aliases."""
    tables: dict[str, list[str]] = {}
    for a, skill, *_ in lexicon.alias_rows:
        tables.setdefault(a[0], []).extend((a, skill))
    parts = F.create_map(*(x for first, pairs in tables.items() for x in (F.lit(first), F.create_map(*map(F.lit, pairs)))))
    return F.try_element_at(F.try_element_at(parts, F.left(alias, F.lit(1))), alias)


def with_term_index(docs: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """K12 inside the row: adds ``term_ids``, hashes of the document's terms in order, and ``term_ns``, their counts.

    Equal hashes stand side by side once sorted; a term starts where a hash differs from the one before.
    """
    skills = F.concat(F.transform(alias_hits(F.col("padded"), lexicon), lambda a: _skill_of(a, lexicon)), label_hits(F.col("text"), lexicon))
    mentions = F.concat(_stem_terms(F.col("_stems"), term_id), F.transform(skills, lambda k: term_id("skill", k)))
    starts = F.filter(
        F.transform("_all", lambda x, i: F.when((i == 0) | (x != F.get("_all", i - 1)), i)), lambda i: i.isNotNull()
    )
    ends = F.concat(F.slice("_starts", F.lit(2), F.greatest(F.size("_starts"), F.lit(1))), F.array(F.size("_all")))
    return (
        docs.withColumn("_stems", once(_stems(F.col("padded"))))
        .withColumn("_all", once(F.sort_array(mentions)))
        .withColumn("_starts", once(starts))
        .withColumn("term_ids", once(F.array_distinct("_all")))
        .withColumn("term_ns", once(F.when(F.size("_all") == 0, F.array().cast("array<int>")).otherwise(F.zip_with("_starts", ends, lambda a, b: b - a))))
        .drop("_stems", "_all", "_starts")
    )


def with_often(indexed: DataFrame) -> DataFrame:
    """Adds ``term_often``, the hashes of the terms a document with ``words`` repeats so often that an ad's keyword is stuffed."""
    places = F.filter(
        F.transform("term_ns", lambda n, i: F.when((n >= STUFFING_COUNT) & (n / F.greatest(F.col("words"), F.lit(1)) > STUFFING_SHARE), i)),
        lambda i: i.isNotNull(),
    )
    return indexed.withColumn("term_often", once(F.transform(places, lambda i: F.get("term_ids", i))))


# ---- K13-K16 ----------------------------------------------------------------------------
def crowded_ads(pairs: DataFrame, per_copy: int = PAIRS_PER_COPY) -> DataFrame:
    """``(job_id, copies)`` of ads with more than ``per_copy`` pairs; counts are added up in the tasks first."""
    copies = F.ceil(F.count("*") / per_copy).cast("int")
    return pairs.groupBy("job_id").agg(copies.alias("copies")).filter("copies > 1")


def deal_pairs(pairs: DataFrame, crowded: DataFrame) -> DataFrame:
    """Pairs with the ``copy`` of their ad they meet: 0, or one of as many as the ad is crowded."""
    dealt = pairs.join(crowded, "job_id", "left")
    return dealt.withColumn("copy", F.when(F.col("copies").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("copies"))).cast("int")).drop("copies")


def copy_ads(ads: DataFrame, crowded: DataFrame) -> DataFrame:
    """Rows of ads, once for each copy that :func:`deal_pairs` sends pairs to."""
    known = ads.join(crowded, "job_id", "left")
    return known.withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")


def pack_keywords(keywords: DataFrame) -> DataFrame:
    """One row per ad, its keywords as parallel lists in display order, so a reader's columns are all that travels."""
    packed = keywords.groupBy("job_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("neg"), "rank", "kind", "term", "key", "weight", "milli"))).alias("kws"),
        F.sum("milli").alias("kw_total"),
    )
    return packed.select(
        "job_id", F.transform("kws", lambda k: term_id(k["kind"], k["key"])).alias("kw_ids"), F.col("kws.kind").alias("kw_kinds"),
        F.col("kws.term").alias("kw_terms"), F.col("kws.weight").alias("kw_weights"), F.col("kws.rank").alias("kw_ranks"),
        F.col("kws.milli").cast("array<int>").alias("kw_millis"), "kw_total",
    )


def pairs_with_ads(pairs: DataFrame, ads: DataFrame, per_copy: int = PAIRS_PER_COPY) -> DataFrame:
    """``pairs``, each listed once, with their ad's columns (NULL for an unknown ad).

    A crowded ad travels in copies, one for each ``per_copy`` of its pairs, so these are spread over that many tasks.
    """
    crowded = crowded_ads(pairs, per_copy)
    return deal_pairs(pairs, crowded).join(copy_ads(ads, crowded), ["job_id", "copy"], "left").drop("copy")


def matched(rows: DataFrame) -> DataFrame:
    """K13/K14 inside the row: adds ``kw_found``, the hashes of the ad's keywords that the document holds, and ``kw_stuffed``,
    the hashes of those it is stuffed with.

    Rows carry ``words``, the document's ``term_ids``, ``term_ns`` and ``term_often`` and the ad's ``kw_*`` lists.
    """
    known = F.col("words") >= fv.MIN_READABLE_WORDS
    return rows.withColumn("kw_found", once(F.when(known, F.array_intersect("term_ids", "kw_ids")))).withColumn(
        "kw_stuffed", once(F.when(known, F.array_intersect("term_often", "kw_ids")))
    )


def _count_of(term: Column) -> Column:
    return F.coalesce(F.get("term_ns", (F.array_position("term_ids", term) - 1).cast("int")), F.lit(0))


def hits_of(matches: DataFrame) -> DataFrame:
    """One row per (document, job, keyword) with its count and flags, from :func:`matched` rows.

    The lists are taken apart first: what is looked up for a keyword is then compiled, which it is not inside a lambda.
    """
    items = F.when(F.col("kw_found").isNotNull(), F.arrays_zip(
        F.col("kw_ids").alias("id"), F.col("kw_ranks").alias("rank"), F.col("kw_kinds").alias("kind"), F.col("kw_terms").alias("term"),
        F.col("kw_weights").alias("weight"), F.col("kw_millis").alias("milli"),
    ))
    rows = matches.select("doc_id", "job_id", "kw_found", "kw_stuffed", "term_ids", "term_ns", F.inline(items))
    found = F.array_contains("kw_found", F.col("id"))
    return rows.select(
        "doc_id", "job_id", "rank", "kind", "term", "weight", F.col("milli").cast("bigint").alias("milli"),
        F.when(found, _count_of(F.col("id"))).otherwise(0).cast("bigint").alias("n"),
        found.alias("matched"), F.array_contains("kw_stuffed", F.col("id")).alias("stuffed"),
    )


def stuffed_hits(matches: DataFrame) -> DataFrame:
    """The rows of :func:`hits_of` that are stuffed, without making the others."""
    terms = F.transform("kw_stuffed", lambda k: F.struct(
        F.get("kw_terms", (F.array_position("kw_ids", k) - 1).cast("int")).alias("term"), _count_of(k).cast("bigint").alias("n")
    ))
    return matches.select("doc_id", "job_id", F.inline(terms))


def match_scores(matches: DataFrame) -> DataFrame:
    """Adds the lists in display order and the keyword score to :func:`matched` rows; NULL without keywords."""
    known = F.col("kw_found").isNotNull()
    at = lambda name, k: F.get(name, (F.array_position("kw_ids", k) - 1).cast("int"))
    shown = lambda ids: F.when(known, F.transform(ids, lambda k: at("kw_terms", k)))
    hit = F.aggregate(F.array_except("kw_found", "kw_stuffed"), F.lit(0).cast("bigint"), lambda a, k: a + at("kw_millis", k))
    in_rank = F.array_sort(F.transform("kw_stuffed", lambda k: F.struct(
        at("kw_ranks", k).alias("rank"), at("kw_terms", k).alias("term"), _count_of(k).cast("bigint").alias("n")
    )))
    stuffed = F.transform(in_rank, lambda s: F.struct(s["term"].alias("term"), s["n"].alias("n")))
    raw = F.when(F.col("total_milli") == 0, 0.0).otherwise(F.col("hit_milli") / F.col("total_milli") * 100)
    penalty = F.least(F.col("n_stuffed") * STUFFING_PENALTY, F.lit(STUFFING_CAP))
    score = F.greatest(F.lit(0), F.floor(raw - penalty + 0.5)).cast("int")
    size = lambda name: F.size(name).cast("bigint")
    return (
        matches.withColumns({
            "n_keywords": F.when(known, size("kw_ids")),
            "n_matched": F.when(known, size("kw_found")),
            "n_stuffed": F.when(known, size("kw_stuffed")),
            "total_milli": F.when(known, F.col("kw_total")),
            "hit_milli": F.when(known, hit),
            "matched": shown(F.array_intersect("kw_ids", "kw_found")),
            "missing": shown(F.array_except("kw_ids", "kw_found")),
            "stuffed": F.when(known, stuffed),
        })
        .withColumn("n_missing", F.col("n_keywords") - F.col("n_matched"))
        .withColumn("keyword_score", F.when(known, score))
    )


def job_summary(jobs: DataFrame, language: Column) -> DataFrame:
    """K16 inputs: ``(job_id, job_words, job_lang)`` for non-empty ads."""
    return (
        jobs.filter(F.col("text") != "")
        .withColumn("padded", padded_tokens(F.col("text")))
        .select("job_id", count_tokens(F.col("padded")).alias("job_words"), language.alias("job_lang"))
    )
