"""Structured résumés: validation, import, rendering, export.

Raw JSON text is parsed once into VARIANT.  The native layout and the community layout are both
read into one raw struct (strict reading leaves NULL where a value is missing or of the wrong
type); one finishing step then cuts, cleans and validates it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.contact import display_url, safe_url
from ..functions.dates import format_month, format_range, normalize_month
from ..functions.text import let, once, strip_unsafe, trim_all

LISTS = fv.LIST_LIMITS
# Text limit per field of each list item (None marks a month string)
ITEMS = {
    "work": {"company": "medium", "position": "medium", "location": "medium", "startDate": None, "endDate": None},
    "education": {"institution": "long", "area": "long", "studyType": "medium", "startDate": None, "endDate": None},
    "skills": {"name": "short"},
    "projects": {"name": "medium", "description": "description", "url": "url"},
    "certificates": {"name": "long", "issuer": "medium", "date": None, "url": "url"},
    "languages": {"language": "short", "fluency": "short"},
}
STRING_LISTS = {
    "work": ("highlights", "highlight", "highlights"),
    "skills": ("keywords", "short", "skillKeywords"),
    "projects": ("highlights", "highlight", "projectHighlights"),
}
BASICS = {"name": "medium", "label": "medium", "email": "email", "phone": "phone", "location": "medium", "url": "url", "summary": "summary"}


# ---- reading variants -------------------------------------------------------------------
def _at(x: Column, key: str) -> Column:
    return F.try_variant_get(x, f"$.{key}", "variant")


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _is_object(v: Column) -> Column:
    return _kind(v).startswith("OBJECT")


def _array(x: Column, key: str) -> Column:
    return F.when(_kind(_at(x, key)).startswith("ARRAY"), F.try_variant_get(x, f"$.{key}", "array<variant>"))


def _string(v: Column) -> Column:
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _loose(v: Column) -> Column:
    """Strings and numbers as text, everything else empty."""
    return F.when(_kind(v).rlike("^(?:STRING|BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get(v, "$", "string")).otherwise("")


def _nullish(a: Column, b: Column) -> Column:
    return F.when(_kind(a) == "VOID", _loose(b)).otherwise(_loose(a))


def _strict_items(v: Column, name: str) -> Column:
    def item(x: Column) -> Column:
        fields = [_string(_at(x, f)).alias(f) for f in ITEMS[name]]
        if name == "work":
            fields.append(F.when(_kind(_at(x, "current")) == "BOOLEAN", F.try_variant_get(x, "$.current", "boolean")).alias("current"))
        if name in STRING_LISTS:
            key = STRING_LISTS[name][0]
            fields.append(F.transform(_array(x, key), _string).alias(key))
        return F.struct(*fields)

    return F.transform(_array(v, name), item)


def _loose_items(v: Column, name: str) -> Column:
    def item(x: Column) -> Column:
        read = {f: _loose(_at(x, f)) for f in ITEMS[name]}
        if name == "work":
            read["company"] = _nullish(_at(x, "name"), _at(x, "company"))
        fields = [read[f].alias(f) for f in ITEMS[name]]
        if name == "work":
            end = _at(x, "endDate")
            fields.append(
                F.when(_kind(end) == "STRING", F.try_variant_get(end, "$", "string") == "")
                .when(_kind(end) == "BOOLEAN", ~F.try_variant_get(end, "$", "boolean"))
                .when(_kind(end).rlike("^(?:BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get(end, "$", "double") == 0)
                .otherwise(_kind(end) == "VOID").alias("current")
            )
        if name in STRING_LISTS:
            key = STRING_LISTS[name][0]
            listed = F.filter(F.transform(_array(x, key), _loose), lambda s: s != "")
            listed = F.coalesce(listed, F.array().cast("array<string>"))
            if name == "work":
                summary = _loose(_at(x, "summary"))
                listed = let(
                    listed,
                    lambda hs: F.when(F.size(hs) > 0, hs).when(summary != "", F.array(summary)).otherwise(F.array().cast("array<string>")),
                )
            fields.append(listed.alias(key))
        return F.struct(*fields)

    return F.transform(F.filter(F.coalesce(_array(v, name), F.array().cast("array<variant>")), _is_object), item)


def _profiles(v: Column, loose: bool) -> Column:
    read = (lambda x, f: _loose(_at(x, f))) if loose else (lambda x, f: _string(_at(x, f)))
    items = _array(v, "profiles")
    if loose:
        items = F.filter(F.coalesce(items, F.array().cast("array<variant>")), _is_object)
    return F.transform(items, lambda x: F.struct(read(x, "network").alias("network"), read(x, "url").alias("url")))


def _native(v: Column) -> Column:
    basics, meta = _at(v, "basics"), _at(v, "meta")
    return F.struct(
        _string(_at(meta, "language")).alias("language"), _string(_at(meta, "template")).alias("template"),
        F.struct(*[_string(_at(basics, f)).alias(f) for f in BASICS], _profiles(basics, False).alias("profiles")).alias("basics"),
        *[_strict_items(v, name).alias(name) for name in ITEMS],
    )


def _community(v: Column, lang: Column) -> Column:
    basics = _at(v, "basics")
    place = _at(basics, "location")
    located = F.array_join(
        F.filter(F.array(*[_loose(_at(place, k)) for k in ("city", "region", "countryCode")]), lambda s: s != ""), ", "
    )
    read = {f: _loose(_at(basics, f)) for f in BASICS}
    read["location"] = located
    read["url"] = _nullish(_at(basics, "url"), _at(basics, "website"))
    return F.struct(
        lang.alias("language"), F.lit("classic").alias("template"),
        F.struct(*[read[f].alias(f) for f in BASICS], _profiles(basics, True).alias("profiles")).alias("basics"),
        *[_loose_items(v, name).alias(name) for name in ITEMS],
    )


# ---- R1 finishing -----------------------------------------------------------------------
def _clean(text: Column) -> Column:
    return trim_all(strip_unsafe(text))


def _finish(raw: Column) -> Column:
    def item(name: str):
        def build(x: Column) -> Column:
            fields = [
                (normalize_month(x[f]) if kind is None else _clean(x[f])).alias(f)
                for f, kind in ITEMS[name].items()
            ]
            if name == "work":
                fields.append(x["current"].alias("current"))
            if name in STRING_LISTS:
                key = STRING_LISTS[name][0]
                fields.append(F.transform(x[key], _single(_clean)).alias(key))
            return F.struct(*fields)

        return build

    basics = raw["basics"]
    return F.struct(
        F.lit(fv.RESUME_VERSION).alias("version"),
        F.struct(raw["language"].alias("language"), raw["template"].alias("template")).alias("meta"),
        F.struct(
            *[_clean(basics[f]).alias(f) for f in BASICS],
            F.transform(
                basics["profiles"],
                lambda p: F.struct(_clean(p["network"]).alias("network"), _clean(p["url"]).alias("url")),
            ).alias("profiles"),
        ).alias("basics"),
        *[F.transform(raw[name], item(name)).alias(name) for name in ITEMS],
    )


def _valid(raw: Column, native: Column) -> Column:
    """Native records also keep to the list lengths of their schema."""
    ok = raw["language"].isin("en", "pt") & raw["template"].isin("classic", "modern")
    basics = raw["basics"]
    for f in BASICS:
        ok = ok & basics[f].isNotNull()
    ok = ok & (~native | (F.size(basics["profiles"]) <= LISTS["profiles"]))
    ok = ok & ~F.exists(basics["profiles"], lambda p: p["network"].isNull() | p["url"].isNull())
    for name, fields in ITEMS.items():
        def broken(x: Column, name=name, fields=fields) -> Column:
            bad = F.lit(False)
            for f in fields:
                bad = bad | x[f].isNull()
            if name == "work":
                bad = bad | x["current"].isNull()
            if name in STRING_LISTS:
                key, _, cap = STRING_LISTS[name]
                bad = bad | x[key].isNull() | (native & (F.size(x[key]) > LISTS[cap])) | F.exists(x[key], lambda s: s.isNull())
            return bad

        check = lambda x, b=broken: b(x)
        ok = ok & (~native | (F.size(raw[name]) <= LISTS[name])) & ~F.exists(raw[name], _single(check))
    return F.coalesce(ok, F.lit(False))


def _single(fn):
    """A one-argument lambda, so the index variant of the function is not picked."""
    return lambda x: fn(x)


def import_resumes(raw: DataFrame, max_chars: int | None = None, native_only: bool = False, keep_raw: bool = False) -> DataFrame:
    """``(doc_id, resume, error_code)`` from ``(doc_id, raw, lang)``.

    ``error_code`` is ``invalid_json`` or ``invalid_schema``, or ``too_large`` where the caller sets
    ``max_chars``; ``resume`` is NULL then.  ``keep_raw`` adds the record itself.
    """
    raw.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")  # the last of repeated keys counts
    sized = raw.withColumn("big", F.length("raw") > max_chars if max_chars is not None else F.lit(False))
    parsed = sized.withColumn("v", once(F.try_parse_json(F.when(~F.col("big"), F.col("raw")))))
    v = F.col("v")
    version = F.when(_kind(_at(v, "version")).rlike("^(?:BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get(v, "$.version", "double"))
    community = F.lit(False) if native_only else _is_object(_at(v, "basics"))
    layout = F.when(~_is_object(v), "none").when(version == fv.RESUME_VERSION, "native").when(community, "community").otherwise("none")
    read = parsed.withColumn("layout", layout).withColumn(
        "raw_resume",
        once(F.when(F.col("layout") == "native", _native(v)).when(F.col("layout") == "community", _community(v, F.col("lang")))),
    )
    checked = read.withColumn("ok", once(F.coalesce(_valid(F.col("raw_resume"), F.col("layout") == "native"), F.lit(False))))
    return checked.select(
        "doc_id",
        once(F.when(F.col("ok"), _finish(F.col("raw_resume")))).alias("resume"),
        F.when(F.col("big"), "too_large").when(v.isNull(), "invalid_json").when(~F.col("ok"), "invalid_schema").alias("error_code"),
        *(["raw"] if keep_raw else []),
    )


def valid_resumes(imported: DataFrame) -> DataFrame:
    """``(doc_id, resume)`` of the accepted records.

    A generator drops the others: a plain filter would make the optimizer derive constraints
    through every expression of the import.
    """
    kept = F.when(F.col("error_code").isNull(), F.array("resume"))
    return imported.select("doc_id", F.explode(kept).alias("resume"))


def rejected_resumes(imported: DataFrame) -> DataFrame:
    """``(doc_id, error_code)`` of the other records, by a generator for the same reason."""
    code = F.when(F.col("error_code").isNotNull(), F.array("error_code"))
    return imported.select("doc_id", F.explode(code).alias("error_code"))


def set_aside(stored: DataFrame) -> DataFrame:
    """``(doc_id, status, backup)``; unreadable stored records are kept whole."""
    known = stored.withColumn("raw", F.coalesce("raw", F.lit("")))
    read = import_resumes(known, native_only=True, keep_raw=True)
    status = F.when(F.col("raw") == "", "empty").when(F.col("error_code").isNull(), "ok").otherwise("unreadable")
    return read.select("doc_id", status.alias("status"), F.when(status == "unreadable", F.col("raw")).alias("backup"))


def has_content(resume: Column) -> Column:
    """R7."""
    lists = F.lit(False)
    for name in ("work", "education", "skills", "projects"):
        lists = lists | (F.size(resume[name]) > 0)
    return (F.trim(resume["basics"]["name"]) != "") | (F.trim(resume["basics"]["summary"]) != "") | lists


def export_json(resume: Column) -> Column:
    """R6."""
    return F.to_json(resume, {"ignoreNullFields": "false"})


# ---- R5 ---------------------------------------------------------------------------------
def _present(*parts: Column) -> Column:
    return F.filter(F.array(*parts), lambda p: p.isNotNull() & (F.trim(p) != ""))


def _bullets(items: Column) -> Column:
    return F.transform(F.filter(items, lambda s: F.trim(s) != ""), lambda s: F.concat(F.lit("• "), s))


def render_resumes(resumes: DataFrame) -> DataFrame:
    """Adds ``text``, plain text in template order without empty sections, to ``(…, resume)`` rows.

    Three projections: dates and links, the lines of each section, the whole text.  Each works on
    columns of the one before, which keeps the expressions shallow.
    """
    r = F.col("resume")
    lang = r["meta"]["language"]
    both = lambda items, fn: F.zip_with(items, F.array_repeat(lang, F.size(items)), fn)
    pieces = resumes.withColumns({
        "_work_dates": once(both(r["work"], lambda w, l: format_range(w["startDate"], w["endDate"], w["current"], l))),
        "_edu_dates": once(both(r["education"], lambda e, l: format_range(e["startDate"], e["endDate"], F.lit(False), l))),
        "_cert_dates": once(both(r["certificates"], lambda c, l: format_month(c["date"], l))),
        "_links": once(F.transform(
            F.concat(F.array(r["basics"]["url"]), F.transform(r["basics"]["profiles"], lambda p: p["url"])), lambda u: display_url(safe_url(u))
        )),
        "_project_links": once(F.transform(r["projects"], lambda p: display_url(safe_url(p["url"])))),
    })
    joined = lambda sep, *parts: F.array_join(_present(*parts), sep)
    solid = lambda items: F.filter(items, lambda s: s != "")
    basics = r["basics"]
    work = F.zip_with(r["work"], "_work_dates", lambda w, d: F.concat(
        F.array(joined(" — ", w["position"], w["company"]), joined(" | ", w["location"], d)), _bullets(w["highlights"])
    ))
    education = F.zip_with(r["education"], "_edu_dates", lambda e, d: F.array(
        joined(", ", e["studyType"], e["area"]), joined(" | ", e["institution"], d)
    ))
    skills = F.transform(
        F.filter(r["skills"], lambda s: (s["name"] != "") | (F.size(s["keywords"]) > 0)),
        lambda s: F.concat(
            F.when(s["name"] != "", F.concat(s["name"], F.lit(": "))).otherwise(""),
            F.array_join(F.filter(s["keywords"], lambda k: F.trim(k) != ""), ", "),
        ),
    )
    projects = F.zip_with(r["projects"], "_project_links", lambda p, u: F.concat(
        F.array(joined(" | ", p["name"], u)), _present(p["description"]), _bullets(p["highlights"])
    ))
    certificates = F.zip_with(r["certificates"], "_cert_dates", lambda c, d: joined(" | ", c["name"], c["issuer"], d))
    languages = F.transform(r["languages"], lambda l: joined(" — ", l["language"], l["fluency"]))
    contact = F.concat(_present(basics["email"], basics["phone"], basics["location"]), F.array_compact("_links"))
    blocks = {
        "summary": _present(basics["summary"]), "experience": solid(F.flatten(work)), "education": solid(F.flatten(education)),
        "skills": skills, "projects": solid(F.flatten(projects)), "certifications": solid(certificates), "languages": solid(languages),
    }
    sectioned = pieces.withColumns(
        {"_contact": once(F.array_join(contact, " | "))} | {f"_{sid}": once(lines) for sid, lines in blocks.items()}
    )

    def section(sid: str) -> Column:
        title = F.when(lang == "pt", fv.SECTION_LABELS["pt"][sid]).otherwise(fv.SECTION_LABELS["en"][sid])
        none = F.array().cast("array<string>")
        return F.when(F.size(f"_{sid}") > 0, F.concat(F.array(F.lit(""), title), F.col(f"_{sid}"))).otherwise(none)

    out = F.concat(_present(basics["name"], basics["label"], F.col("_contact")), *[section(sid) for sid in blocks])
    return sectioned.select(*resumes.columns, trim_all(F.array_join(out, "\n")).alias("text"))
