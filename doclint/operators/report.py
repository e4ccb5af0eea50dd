"""Localised messages and Markdown reports.

Message templates are a map literal of the closed set of finding ids: a finding is rendered inside its
row, and a report is put together from the row's own findings, without any join or shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import let
from .messages import LABELS, MESSAGES
from .scoring import band


def _lookup(texts: dict[str, str], key: Column) -> Column:
    """The text of a key, NULL for an unknown one."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in texts.items() for x in pair)), key)


def _label(kind: str, locale: str, value: Column) -> Column:
    """A localised value; unknown values are shown as they are."""
    return F.coalesce(_lookup(LABELS[locale][kind], value), value)


def _localised(name: Column, value: Column, locale: str) -> Column:
    each = lambda kind: F.array_join(F.transform(F.split(value, ","), lambda x: _label(kind, locale, x)), ", ")
    return (
        F.when(name == "sections", each("sections")).when(name == "items", each("personal"))
        .when(name.isin("section", "suggestion"), _label("sections", locale, value))
        .when(name.isin("resume", "job"), _label("languages", locale, value)).otherwise(value)
    )


def message(finding_id: Column, params: Column, locale: str = "en", templates: dict[str, str] | None = None) -> Column:
    """one pass over the template's placeholders; values are never expanded again, missing ones are empty."""

    def weave(s: Column) -> Column:
        def value(name: Column) -> Column:
            return F.coalesce(_localised(name, F.try_element_at(s["params"], name), locale), F.lit(""))

        plain, names = F.split(s["template"], r"\{\w+\}"), F.regexp_extract_all(s["template"], F.lit(r"\{(\w+)\}"), F.lit(1))
        return F.array_join(F.zip_with(plain, F.transform(names, value), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    template = _lookup(templates or MESSAGES[locale], finding_id)
    return let(F.struct(template.alias("template"), params.alias("params")), lambda s: F.when(s["template"].isNotNull(), weave(s)))


def rendered_findings(findings: DataFrame, locale: str = "en") -> DataFrame:
    """adds ``message`` to ``(…, id, params)`` rows."""
    return findings.withColumn("message", message(F.col("id"), F.col("params"), locale))


def finding_line(locale: str = "en"):
    """What a report lists of a finding, ``struct<passed, line>``: a ``shape`` for :func:`doclint.plans.analyze.analyze`."""
    def shape(f: Column) -> Column:
        line = F.concat(F.lit("- ["), _label("severity", locale, f["severity"]), F.lit("] "), message(f["id"], f["params"], locale))
        return F.struct((f["severity"] == "pass").alias("passed"), line.alias("line"))

    return shape


def markdown_reports(results: DataFrame, locale: str = "en") -> DataFrame:
    """``(doc_id, job_id, markdown)`` from analysis results; a narrow projection."""
    return written_reports(results.withColumn("findings", F.transform("findings", lambda f: finding_line(locale)(f))), locale)


def written_reports(results: DataFrame, locale: str = "en") -> DataFrame:
    """F13 from results whose findings have been through :func:`finding_line`."""
    t = LABELS[locale]
    r = t["report"]
    listed = lambda passed: F.transform(F.filter("findings", lambda f: f["passed"] == passed), lambda f: f["line"])
    full = results.withColumns({"issues": listed(F.lit(False)), "passes": listed(F.lit(True)), "band": band(F.col("score"))})
    with_job = F.col("keywords_score").isNotNull()

    def weight(name: str) -> Column:
        a, b = round(fv.WEIGHTS_WITH_JOB[name] * 100), round(fv.WEIGHTS_WITHOUT_JOB[name] * 100)
        usual = F.when(with_job, str(a)).otherwise(str(b))
        return F.when(F.col("sections_score").isNull(), "100").otherwise(usual) if name == "parseability" else usual

    categories = [
        F.when(
            F.col(f"{name}_score").isNotNull(),
            F.concat(F.lit(f"- {t['categories'][name]}: "), F.col(f"{name}_score").cast("string"), F.lit(f"/100 ({r['weight']} "), weight(name), F.lit("%)")),
        )
        for name in fv.CATEGORIES
    ]
    title = F.concat(
        F.lit(f"# {r['title']}: "), F.col("score").cast("string"), F.lit("/100 ("),
        _label("bands", locale, F.col("band")), F.lit(")"),
    )
    stats = F.concat(
        _label("languages", locale, F.col("lang")), F.lit(" · "), F.col("words").cast("string"), F.lit(f" {r['words']} · {r['note']}")
    )
    none = F.array().cast("array<string>")
    block = lambda head, items: F.when(F.size(items) > 0, F.concat(F.array(F.lit(""), head, F.lit("")), items)).otherwise(none)
    terms = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise("–")
    counted = lambda label, c: F.concat(F.lit(f"- {label} ("), F.size(c).cast("string"), F.lit("): "), terms(F.col(c)))
    n_passed = F.concat(F.lit(r["passed"].split("{count}")[0]), F.size("passes").cast("string"), F.lit(r["passed"].split("{count}")[1]))
    keywords = F.when(
        with_job,
        F.array(F.lit(""), F.lit(f"## {r['keywords']}"), F.lit(""), counted(r["missing"], "missing"), counted(r["matched"], "matched")),
    ).otherwise(none)
    out = F.concat(
        F.array(title, F.lit(""), stats, F.lit("")), F.array_compact(F.array(*categories)),
        block(F.lit(f"## {r['issues']}"), F.col("issues")), block(F.concat(F.lit("## "), n_passed), F.col("passes")), keywords,
    )
    return full.select(
        "doc_id", "job_id", F.concat(F.array_join(out, "\n"), F.lit("\n")).alias("markdown")
    )
