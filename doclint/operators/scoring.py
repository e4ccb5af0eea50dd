"""Category scores, totals and findings (F1-F11) as expressions over one feature row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from .content import QUANTIFIED_MIN, QUANTIFIED_SHARE, VERB_MIN, VERB_SHARE, adaptive_target
from .keywords import SHORT_JOB_TOKENS
from .sections import section_label_sql, section_score

FINDING = "struct<ord:int,sub:int,id:string,severity:string,category:string,params:map<string,string>>"
c = F.col


def js_round(x: Column) -> Column:
    """Half up for every sign: floor(x + 0.5)."""
    return F.floor(x + F.lit(0.5))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), js_round(x.cast("double")))).cast("int")


def readable() -> Column:
    """F1."""
    return c("words") >= fv.MIN_READABLE_WORDS


def hidden_contact() -> Column:
    """E-mail or phone only in the page header / footer."""
    return (c("hf.email") & ~c("email")) | (c("hf.phone") & ~c("phone"))


def _hf(field: str) -> Column:
    return F.coalesce(c(f"hf.{field}"), F.lit(False))


def parse_points() -> Column:
    """F2."""
    zero = F.lit(0)
    off = (
        F.when(c("words") < 150, 15).when(c("words") > 1300, 10).otherwise(0)
        + F.when(c("garbled") >= 3, F.least(F.lit(25), c("garbled") + 5)).otherwise(zero)
        + F.when(c("layout.tables") > 1, 15).when(c("layout.tables") > 0, 10).otherwise(0)
        + F.when(c("layout.text_boxes") > 0, 15).otherwise(0)
        + F.when(c("layout.columns"), 20).otherwise(0)
        + F.when(c("layout.page_count") > 2, 10).otherwise(0)
        + F.when(hidden_contact(), 10).otherwise(0)
    )
    return F.lit(100) - off


def contact_points() -> Column:
    """F3."""
    return (
        F.when(c("email"), 45).when(_hf("email"), 20).otherwise(0)
        + F.when(c("phone"), 30).when(_hf("phone"), 15).otherwise(0)
        + F.when(c("linkedin") == "url", 25).when(c("linkedin") == "label", 10).otherwise(0)
        - F.when(c("broken_url").isNotNull(), 10).otherwise(0)
    )


def section_points() -> Column:
    """F4."""
    return section_score(c("sec"))


def targets() -> tuple[Column, Column]:
    """A12 for the feature row."""
    work = F.coalesce(c("sec.work_bullets"), c("content.bullets"))
    return adaptive_target(work, QUANTIFIED_SHARE, QUANTIFIED_MIN), adaptive_target(work, VERB_SHARE, VERB_MIN)


def dated_lines() -> Column:
    """Lines with a period in the experience spans, or in the whole text without one."""
    return F.coalesce(c("sec.dated_lines"), c("sec.all_dated_lines"))


def content_points() -> Column:
    """F5; the order of additions is part of the result."""
    one = F.lit(1.0)
    return (
        F.least(c("content.quantified") / c("quantified_target"), one) * 35
        + F.least(c("content.action_verbs") / c("verb_target"), one) * 25
        + F.when(c("content.bullets") >= 3, 15).otherwise(0)
        + F.when(dated_lines() > 0, 25).when(c("years") >= 2, 10).otherwise(0)
        - F.when((c("lang") == "en") & (c("first_person") >= 4), 10).otherwise(0)
        - F.when(c("weak_total") >= 3, 5).otherwise(0)
    )


def total_points(keyword: Column) -> Column:
    """F8: weighted total over clamped categories; ``keyword`` is NULL without job keywords."""
    def weighted(weights: dict[str, float], with_keywords: bool) -> Column:
        total = F.lit(0.0)
        for name in ("parseability", "sections", "contact", "content"):
            total = total + c(f"{name}_score") * F.lit(weights[name])
        return total + keyword * F.lit(weights["keywords"]) if with_keywords else total

    return clamp(
        F.when(keyword.isNull(), weighted(fv.WEIGHTS_WITHOUT_JOB, False)).otherwise(
            weighted(fv.WEIGHTS_WITH_JOB, True)
        )
    )


def band(score: Column) -> Column:
    """F10."""
    return F.when(score >= 85, "excellent").when(score >= 70, "good").when(score >= 50, "fair").otherwise("poor")


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in fv.SEVERITIES]), severity)


# ---- F6 ---------------------------------------------------------------------------------
NO_FINDINGS = f"CAST(array() AS array<{FINDING}>)"


def finding(order: int, id_: str, severity: str, category: str, sub: str = "0", **params: str) -> str:
    """One finding as SQL text; ``id_``/``severity`` are literals unless they start with ``(``."""
    text = lambda v: v if v.startswith("(") else f"'{v}'"
    entries = ", ".join(f"'{name}', CAST({value} AS STRING)" for name, value in params.items())
    mapped = f"map({entries})" if entries else "CAST(map() AS map<string,string>)"
    return (
        f"named_struct('ord', {order}, 'sub', CAST({sub} AS INT), 'id', {text(id_)}, 'severity', {text(severity)}, "
        f"'category', '{category}', 'params', {mapped})"
    )


def _bare(order: int, id_: str, severity: str, category: str, sub: str = "0", **_: str) -> str:
    return finding(order, id_, severity, category, sub)


def _when(*arms: tuple[str, str], otherwise: str = "NULL") -> str:
    body = " ".join(f"WHEN {test} THEN {item}" for test, item in arms)
    return f"CASE {body} ELSE {otherwise} END"


def _pack(items: list[str]) -> str:
    return f"array_compact(array({', '.join(items)}))"


def document_findings() -> Column:
    """F6 for everything that does not depend on a job ad, in emission order."""
    p, k, s, t = "parseability", "contact", "sections", "content"
    hidden = "((hf.email AND NOT email) OR (hf.phone AND NOT phone))"
    parse = _pack([
        finding(2, "text.readable", "pass", p, words="words"),
        _when(("words < 150", finding(3, "text.short", "warning", p, words="words"))),
        _when(("words > 1300", finding(4, "text.long", "warning", p, words="words"))),
        _when(("garbled >= 3", finding(5, "text.garbled", "warning", p, count="garbled"))),
        _when(("truncated", finding(6, "text.truncated", "info", p))),
        _when(("layout.tables > 0", finding(7, "layout.tables", "warning", p, count="layout.tables"))),
        _when(("layout.text_boxes > 0", finding(8, "layout.textBoxes", "warning", p, count="layout.text_boxes"))),
        _when(("layout.columns", finding(9, "layout.columns", "warning", p))),
        _when(("layout.images > 0", finding(10, "layout.images", "info", p, count="layout.images"))),
        _when(("layout.page_count > 2", finding(11, "layout.pages", "warning", p, count="layout.page_count"))),
        _when(
            ("email", finding(12, "contact.email", "pass", k)),
            ("NOT coalesce(hf.email, false)", finding(12, "contact.emailMissing", "critical", k)),
        ),
        _when(
            ("phone", finding(13, "contact.phone", "pass", k)),
            ("NOT coalesce(hf.phone, false)", finding(13, "contact.phoneMissing", "warning", k)),
        ),
        _when((hidden, finding(14, "layout.headerFooterContact", "warning", p))),
        _when(
            ("linkedin = 'url'", finding(15, "contact.linkedin", "pass", k)),
            ("linkedin = 'label'", finding(15, "contact.linkedinHidden", "info", k)),
            otherwise=finding(15, "contact.linkedinMissing", "info", k),
        ),
        _when(("broken_url IS NOT NULL", finding(16, "contact.brokenUrl", "warning", k, url="broken_url"))),
        _when(("size(personal) > 0", finding(17, "contact.personalData", "warning", k, items="array_join(personal, ',')"))),
        _when((
            "size(array_except(sec.found, sec.empty)) > 0",
            finding(18, "sections.found", "pass", s, sections="array_join(array_except(sec.found, sec.empty), ',')"),
        )),
    ])
    empties = f"transform(sec.empty, (x, i) -> {finding(19, 'sections.empty', 'warning', s, sub='i', section='x')})"
    glyphs = (
        "transform(sec.decorated, (x, i) -> "
        + finding(20, "sections.decorated", "warning", s, sub="i", heading="x.heading", section="x.section") + ")"
    )
    absent = lambda sid: (
        f"(NOT array_contains(sec.empty, '{sid}') AND NOT array_contains(sec.found, '{sid}') "
        f"AND NOT exists(sec.decorated, d -> d.section = '{sid}'))"
    )
    missing = _pack(
        [
            _when((absent(sid), finding(21, "sections.missing", "warning", s, sub=str(i), section=f"'{sid}'")))
            for i, sid in enumerate(("experience", "education", "skills"))
        ]
        + [_when((absent("summary"), finding(22, "sections.summaryMissing", "info", s)))]
    )
    creative = (
        "transform(sec.nonstandard, (x, i) -> "
        + finding(
            23, "sections.nonstandard", "info", s, sub="i", heading="x.heading",
            suggestion=section_label_sql("x.suggestion", "lang"),
        ) + ")"
    )
    q, v, b, qt, vt = "content.quantified", "content.action_verbs", "content.bullets", "quantified_target", "verb_target"
    phrases = "array_join(transform(weak, w -> concat('“', w.phrase, '”')), ', ')"
    content = _pack([
        _when(
            (f"{q} >= {qt}", finding(24, "content.quantified", "pass", t, count=q)),
            otherwise=finding(24, "content.quantifiedLow", "warning", t, count=q, target=qt),
        ),
        _when(
            (f"{v} >= {vt}", finding(25, "content.actionVerbs", "pass", t, count=v)),
            otherwise=finding(25, "content.actionVerbsLow", "info", t, count=v, target=vt),
        ),
        _when(
            (f"{b} >= 3", finding(26, "content.bullets", "pass", t, count=b)),
            otherwise=finding(26, "content.bulletsMissing", "info", t),
        ),
        _when(
            ("coalesce(sec.dated_lines, sec.all_dated_lines) > 0", "NULL"),
            ("years >= 2", finding(27, "content.dateRangesMissing", "warning", t)),
            otherwise=finding(27, "content.datesMissing", "warning", t),
        ),
        _when(("lang = 'en' AND first_person >= 4", finding(28, "content.pronouns", "info", t, count="first_person"))),
        _when(("weak_total > 0", finding(29, "content.weakPhrases", "info", t, count="weak_total", phrases=phrases))),
        _when((
            "content.long_bullets > 0",
            finding(30, "content.longBullets", "info", t, count="content.long_bullets", max=str(fv.MAX_BULLET_WORDS)),
        )),
        _when((
            "content.top_verb.count >= 4",
            finding(31, "content.repeatedVerb", "info", t, verb="content.top_verb.verb", count="content.top_verb.count"),
        )),
    ])
    unreadable = f"array({finding(1, 'text.empty', 'critical', p)})"
    return F.expr(
        f"CASE WHEN words >= {fv.MIN_READABLE_WORDS} THEN concat({parse}, {empties}, {glyphs}, {missing}, {creative}, {content}) "
        f"ELSE {unreadable} END"
    )


def pair_findings(parameters: bool = True) -> Column:
    """F6/F7 for one (document, job) row: expects job and match columns (NULL when absent).

    Without ``parameters`` these stay empty, and the keywords' terms are not read.
    """
    k = "keywords"
    make = finding if parameters else _bare
    level = "(CASE WHEN keyword_score >= 70 THEN 'pass' WHEN keyword_score >= 45 THEN 'warning' ELSE 'critical' END)"
    head = _pack([
        _when((f"job_words < {SHORT_JOB_TOKENS}", make(32, "keywords.jobShort", "info", k, words="job_words"))),
        _when((
            "job_lang <> 'unknown' AND lang <> 'unknown' AND job_lang <> lang",
            make(33, "language.mismatch", "warning", k, resume="lang", job="job_lang"),
        )),
        _when((
            "keyword_score IS NOT NULL",
            make(34, "keywords.match", level, k, matched="n_matched", total="n_keywords", percent="keyword_score"),
        )),
        _when((
            "n_missing > 0",
            make(
                35, "keywords.missing", "(CASE WHEN keyword_score >= 70 THEN 'info' ELSE 'warning' END)", k,
                terms="array_join(missing, ', ')",
            ),
        )),
    ])
    stuffed = (
        f"transform({'stuffed' if parameters else 'kw_stuffed'}, (x, i) -> "
        + make(36, "keywords.stuffing", "warning", k, sub="i", term="x.term", count="x.n") + ")"
    )
    return F.expr(
        f"CASE WHEN words >= {fv.MIN_READABLE_WORDS} THEN concat({head}, coalesce({stuffed}, {NO_FINDINGS})) ELSE {NO_FINDINGS} END"
    )


def sort_findings(findings: Column) -> Column:
    """stable by severity, emission order inside one severity."""
    keyed = F.transform(
        findings,
        lambda f: F.struct(
            severity_rank(f["severity"]).cast("int").alias("s"), f["ord"].alias("ord"), f["sub"].alias("sub"),
            f["id"].alias("id"), f["severity"].alias("severity"), f["category"].alias("category"),
            F.map_keys(f["params"]).alias("k"), F.map_values(f["params"]).alias("v"),
        ),
    )
    return F.transform(
        F.array_sort(keyed),
        lambda x: F.struct(
            x["ord"].alias("ord"), x["sub"].alias("sub"), x["id"].alias("id"), x["severity"].alias("severity"),
            x["category"].alias("category"), F.map_from_arrays(x["k"], x["v"]).alias("params"),
        ),
    )


def by_severity(sorted_findings: Column, shape) -> Column:
    """Sorted findings as one list for each severity, each finding as ``shape`` makes it."""
    of = lambda s: F.transform(F.filter(sorted_findings, lambda f: f["severity"] == s), lambda f: shape(f))
    return F.array(*(of(s) for s in fv.SEVERITIES))


def merged_findings(own: Column, added: Column) -> Column:
    """F9 for a pair: of each severity the document's findings, then those of the pair, which all come later."""
    return F.concat(*(F.get(lists, F.lit(i)) for i in range(len(fv.SEVERITIES)) for lists in (own, added)))


def params_text(params: Column) -> Column:
    """Parameters as ``k=v`` pairs sorted by key, joined by ``;`` (for flat outputs)."""
    def listed(p: Column) -> Column:
        entries = F.array_sort(F.map_entries(p))
        return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")

    # most findings have no parameter or one: nothing to sort
    first = lambda part: F.get(part(params), F.lit(0))
    single = F.coalesce(F.concat(first(F.map_keys), F.lit("="), first(F.map_values)), F.lit(""))
    return F.when(F.size(params) == 0, "").when(F.size(params) == 1, single).otherwise(listed(params))


def issues(findings: Column) -> Column:
    """everything that is not a pass."""
    return F.filter(findings, lambda f: f["severity"] != "pass")


def passed(findings: Column) -> Column:
    return F.filter(findings, lambda f: f["severity"] == "pass")
