"""Batch plans: documents (and job ads) in, features, scores and findings out.

Everything about one document is a narrow projection over its row, and so is the match of a pair; the
only shuffles are the joins of pairs with ads and then with documents.  Documents without an ad meet no
pair in the second one, so no exchange carries a missing ad.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.contact import broken_url, contact_struct, personal_kinds
from ..functions.lexicon import DEFAULT, Lexicon
from ..functions.text import count_tokens, detect_language, fold, let, normalize_struct, normalize_text, once, padded_tokens
from ..operators import keywords as kw
from ..operators import scoring as sc
from ..operators.content import content_struct, count_first_person, count_garbled, count_years, weak_phrases
from ..operators.sections import section_report

TERM_INDEX = ("term_ids", "term_ns", "term_often")
LAYOUT = "struct<tables:int,text_boxes:int,images:int,columns:boolean,page_count:int>"


def _or_default(df: DataFrame, name: str, value: Column) -> Column:
    return F.coalesce(F.col(name), value) if name in df.columns else value


def complete_documents(docs: DataFrame) -> DataFrame:
    """Fill the optional input columns: header/footer text, layout signals, truncation flag."""
    empty_layout = F.struct(
        F.lit(0).alias("tables"), F.lit(0).alias("text_boxes"), F.lit(0).alias("images"),
        F.lit(False).alias("columns"), F.lit(None).cast("int").alias("page_count"),
    ).cast(LAYOUT)
    return docs.select(
        "doc_id",
        F.coalesce("text", F.lit("")).alias("text"),
        (F.col("header_footer_text") if "header_footer_text" in docs.columns else F.lit(None).cast("string")).alias(
            "header_footer_text"
        ),
        _or_default(docs, "layout", empty_layout).alias("layout"),
        _or_default(docs, "truncated", F.lit(False)).alias("truncated"),
    )


def normalize_documents(docs: DataFrame) -> DataFrame:
    """T1 on every document (O2: what a parser reads)."""
    return (
        complete_documents(docs)
        .withColumn("norm", once(normalize_struct(F.col("text"))))
        .withColumn("text", F.col("norm.text"))
        .drop("norm")
    )


def with_tokens(normalized: DataFrame) -> DataFrame:
    return normalized.withColumn("padded", once(padded_tokens(F.col("text"))))


def _feature_columns(lexicon: Lexicon) -> tuple[Column, ...]:
    """Feature expressions over ``text``, ``padded``, ``folded``, ``words``."""
    ready = F.col("words") >= fv.MIN_READABLE_WORDS
    only = lambda expr: F.when(ready, expr)
    return (
        once(content_struct(F.col("text"), F.col("padded"), lexicon)).alias("content"),
        once(detect_language(F.col("text"), F.col("padded"), lexicon)).alias("lang"),
        only(count_years(F.col("padded"))).alias("years"),
        only(count_first_person(F.col("padded"))).alias("first_person"),
        once(only(count_garbled(F.col("text")))).alias("garbled"),
        once(only(weak_phrases(F.col("padded"), lexicon))).alias("weak"),
        once(only(contact_struct(F.col("text")))).alias("contact"),
        once(only(contact_struct(F.nullif("header_footer_text", F.lit(""))))).alias("hf"),
        once(only(broken_url(F.col("text")))).alias("broken_url"),
        once(only(personal_kinds(F.col("folded")))).alias("personal"),
        once(only(section_report(F.col("text"), F.col("folded"), lexicon))).alias("sec"),
    )


def document_features(normalized: DataFrame, lexicon: Lexicon = DEFAULT, keywords: bool = False) -> DataFrame:
    """One feature row per normalized document (T7, T9, C*, S*, A*), with its term index for ``keywords``; no shuffle.

    Documents under ten words skip everything but the word count (F1).
    """
    base = with_tokens(normalized) if "padded" not in normalized.columns else normalized
    staged = (
        base.withColumn("words", count_tokens(F.col("padded")))
        .withColumn("folded", once(fold(F.col("text"))))
    )
    if keywords:
        staged = kw.with_often(kw.with_term_index(staged, lexicon))
    qt, vt = sc.targets()
    return (
        staged.select(
            "doc_id", "words", "layout", "truncated", *(c for c in TERM_INDEX if keywords),
            *_feature_columns(lexicon),
        )
        .select("*", "contact.*")
        .drop("contact")
        .withColumn("weak_total", F.aggregate("weak", F.lit(0), lambda a, w: a + w["count"]))
        .withColumn("quantified_target", qt)
        .withColumn("verb_target", vt)
    )


def score_documents(features: DataFrame) -> DataFrame:
    """F1-F5, F8 without a job, F6 document findings: one row per document, no shuffle."""
    ready = sc.readable()
    scored = features.select(
        "doc_id", "words", F.col("content.lines").alias("lines"), F.col("content.bullets").alias("bullets"), "lang",
        F.when(ready, sc.clamp(sc.parse_points())).otherwise(0).alias("parseability_score"),
        F.when(ready, sc.clamp(sc.section_points())).alias("sections_score"),
        F.when(ready, sc.clamp(sc.contact_points())).alias("contact_score"),
        F.when(ready, sc.clamp(sc.content_points())).alias("content_score"),
        once(sc.document_findings()).alias("findings"), *(c for c in TERM_INDEX if c in features.columns),
    )
    return scored.withColumn(
        "base_score", F.when(ready, sc.total_points(F.lit(None).cast("int"))).otherwise(0)
    )


def unpaired_results(scored: DataFrame) -> DataFrame:
    """Results of documents without any ad."""
    return scored.select(
        "doc_id", F.lit(None).cast("bigint").alias("job_id"), F.col("base_score").alias("score"),
        "parseability_score", "sections_score", "contact_score", "content_score",
        F.lit(None).cast("int").alias("keywords_score"), "lang", F.lit(None).cast("string").alias("job_lang"),
        "words", "lines", "bullets", sc.sort_findings(F.col("findings")).alias("findings"),
        F.lit(None).cast("array<string>").alias("matched"), F.lit(None).cast("array<string>").alias("missing"),
    )


@dataclass
class Analysis:
    """Result tables of :func:`analyze`."""

    results: DataFrame       # one row per (doc_id, job_id); job_id NULL without a pair
    keyword_hits: DataFrame  # one row per (doc_id, job_id, keyword)
    job_keywords: DataFrame
    documents: DataFrame     # one scored row per document

    def findings(self) -> DataFrame:
        """``(doc_id, job_id, pos, id, severity, category, params)``."""
        return self.results.select(
            "doc_id", "job_id", F.posexplode_outer("findings").alias("pos", "f")
        ).select("doc_id", "job_id", "pos", "f.id", "f.severity", "f.category", "f.params")


def analyze(
    docs: DataFrame,
    jobs: DataFrame | None = None,
    pairs: DataFrame | None = None,
    lexicon: Lexicon = DEFAULT,
    cut=lambda df, name: df,
    shape=lambda finding: finding,
    parameters: bool = True,
) -> Analysis:
    """Full analysis of documents, optionally against job ads.

    ``cut(df, name)`` may persist an intermediate table (see :mod:`doclint.sources.sinks`); by
    default the plan stays lazy.  ``shape(finding)`` is what the results of pairs list of a finding; a document's findings are
    sorted and shaped once, however many ads it meets.  Without ``parameters`` the findings of pairs carry none.
    """
    normalized = cut(with_tokens(normalize_documents(docs)), "documents_normalized")
    paired = jobs is not None and pairs is not None
    scored = cut(score_documents(document_features(normalized, lexicon, keywords=paired)), "documents_scored")
    if not paired:
        results = cut(unpaired_results(scored), "results")
        return Analysis(results, None, None, scored)

    ads = jobs.select("job_id", normalize_text(F.col("text")).alias("text"))
    job_kw = cut(kw.job_keywords(ads, lexicon), "job_keywords")
    job_info = kw.job_summary(ads, detect_language(F.col("text"), F.col("padded"), lexicon))
    wanted_pairs = cut(pairs.select("doc_id", "job_id").dropna().distinct(), "pairs")
    # small rows first: pairs meet their ad; documents with their findings come last, each once, with or without a pair
    met = kw.pairs_with_ads(wanted_pairs, job_info.join(kw.pack_keywords(job_kw), "job_id", "left"))
    hits = cut(kw.hits_of(kw.matched(scored.select("doc_id", "words", *TERM_INDEX).join(met, "doc_id"))), "keyword_hits")
    own = once(let(sc.sort_findings(F.col("findings")), lambda f: sc.by_severity(f, shape)))
    listed = scored.withColumn("own", own).drop("findings")
    rows = kw.match_scores(kw.matched(listed.join(met, "doc_id", "left"))).withColumn("_added", once(sc.pair_findings(parameters)))
    results = rows.select(
        "doc_id", "job_id",
        F.when(sc.readable(), sc.total_points(F.col("keyword_score"))).otherwise(0).alias("score"),
        "parseability_score", "sections_score", "contact_score", "content_score",
        F.col("keyword_score").alias("keywords_score"), "lang", "job_lang", "words", "lines", "bullets",
        sc.merged_findings(F.col("own"), sc.by_severity(F.col("_added"), shape)).alias("findings"),
        "matched", "missing",
    )
    return Analysis(cut(results, "results"), hits, job_kw, scored)
