import pytest
from pyspark.sql import functions as F

from doclint.functions import fixed_values as fv
from doclint.operators import keywords as kw
from doclint.operators.messages import MESSAGES
from doclint.plans.analyze import analyze, normalize_documents

BASE = """Ana Example
ana@example.com | +55 11 91234-5678 | linkedin.com/in/ana
Summary
Engineer who ships reliable data products for large teams in retail and finance.
Experience
Engineer, Acme, Mar 2019 – Present
• Led migration of 12 services and cut cost by 30%
• Built pipelines with Python and Kafka for 40 users
• Reduced latency by 25% across the platform
• Designed a queue that handles 900 events
• Launched 3 dashboards for the sales team
Education
BSc Statistics, 2015
Skills
Python, Go, React Native, SQL Server"""
VARIANTS = {
    1: BASE,
    2: BASE.replace("BSc Statistics, 2015\n", ""),
    3: BASE.replace(", Mar 2019 – Present", ""),
    4: BASE.replace("linkedin.com/in/ana", "linkedin.com/in/ana-\nexample"),
    5: "only a few words here",
    6: BASE + "\n" + "Python " * 30,
}
JOB = "Requirements\nPython, Go, React Native and Kafka\nRetail planning and retail planning tools\nBenefits\nHealth insurance and Scala lessons"


@pytest.fixture(scope="module")
def results(spark):
    docs = spark.createDataFrame(list(VARIANTS.items()), "doc_id BIGINT, text STRING")
    jobs = spark.createDataFrame([(7, JOB)], "job_id BIGINT, text STRING")
    pairs = spark.createDataFrame([(k, 7) for k in (1, 5, 6)], "doc_id BIGINT, job_id BIGINT")
    return {r.doc_id: r for r in analyze(docs, jobs, pairs).results.collect()}


def ids(row):
    return [f.id for f in row.findings]


def test_deltas(results):
    base = results[1]
    assert results[2].sections_score == base.sections_score - 20 and "sections.empty" in ids(results[2])
    assert "content.datesMissing" in ids(results[3]) or "content.dateRangesMissing" in ids(results[3])
    assert results[4].contact_score == base.contact_score - 10 and "contact.brokenUrl" in ids(results[4])


def test_unreadable(results):
    row = results[5]
    assert row.score == 0 and ids(row) == ["text.empty"] and row.content_score is None and row.keywords_score is None


def test_keywords(results):
    row = results[1]
    assert {"Python", "Kafka", "Go", "React Native"} <= set(row.matched) and "Scala" not in row.matched + row.missing
    assert "keywords.stuffing" in ids(results[6]) and results[6].keywords_score <= row.keywords_score


def test_invariants(results):
    order = {s: i for i, s in enumerate(fv.SEVERITIES)}
    for row in results.values():
        assert 0 <= row.score <= 100 and set(ids(row)) <= set(fv.FINDING_IDS)
        ranks = [order[f.severity] for f in row.findings]
        assert ranks == sorted(ranks)


def test_line_weights(spark):
    text = "Intro\nRequirements\nx\nNice to have\ny\nBenefits\nz\nResponsibilities\nw"
    jobs = spark.createDataFrame([(1, text)], "job_id BIGINT, text STRING")
    got = [r.weight for r in kw.job_lines(jobs).orderBy("line_no").collect()]
    assert got == [1, 1.5, 1.5, 0.75, 0.75, 0, 0, 1, 1]


def test_exact_case_labels(spark):
    text = "Python, Go, Rust\nGo beyond the plan\n• Spark, Kafka\nSpring Boot and Spring\nC/C++, Series C round"
    got = spark.range(1).select(kw.label_hits(F.lit(text)).alias("h")).first().h
    assert sorted(got) == ["C", "Go", "Spark", "Spring"]


def test_catalogue():
    assert set(MESSAGES["en"]) == set(MESSAGES["pt"]) == set(fv.FINDING_IDS) and len(fv.FINDING_IDS) == 44


def test_both_locales_have_the_same_placeholders():
    import re

    names = lambda text: sorted(re.findall(r"\{(\w+)\}", text))
    for key in fv.FINDING_IDS:
        assert names(MESSAGES["en"][key]) == names(MESSAGES["pt"][key]), key


def test_messages_are_rendered_once_and_as_plain_text(spark):
    from doclint.operators import report as rp

    rows = [("x", {"a": "$& {b}", "b": "__proto__"}), ("x", {"a": "1"}), ("y", {}), (None, None)]
    frame = spark.createDataFrame(rows, "id string, params map<string,string>")
    shown = frame.select(rp.message(F.col("id"), F.col("params"), "en", {"x": "{a}-{b}-{a}", "z": ""}).alias("m"))
    assert [r.m for r in shown.collect()] == ["$& {b}-__proto__-$& {b}", "1--1", None, None]


def test_reports_are_a_narrow_projection(spark):
    from doclint.operators import report as rp

    docs = spark.createDataFrame(list(VARIANTS.items()), "doc_id BIGINT, text STRING")
    results = spark.createDataFrame(analyze(docs).results.collect(), analyze(docs).results.schema)
    reports = rp.markdown_reports(results, "pt")
    assert "Exchange" not in reports._jdf.queryExecution().executedPlan().toString()
    assert all(r.markdown.startswith("# ") for r in reports.collect()) and reports.count() == len(VARIANTS)


def test_partition_invariance(spark):
    docs = spark.createDataFrame(list(VARIANTS.items()), "doc_id BIGINT, text STRING")
    runs = [sorted((r.doc_id, r.score) for r in analyze(docs.repartition(n)).results.collect()) for n in (1, 7)]
    assert runs[0] == runs[1]


def test_labels_of_any_shape(spark):
    from dataclasses import replace

    from doclint.functions.lexicon import DEFAULT, Skill

    lexicon = replace(DEFAULT, skills=[*DEFAULT.skills, Skill("dbx", exact_case=True), Skill("Power Query", exact_case=True)])
    text = "we use dbx daily and Power Query too, but not dbxs or Dbx"
    assert spark.range(1).select(kw.label_hits(F.lit(text), lexicon).alias("h")).first().h == ["dbx", "Power Query"]


def test_a_pair_listed_twice_counts_once(spark):
    docs = spark.createDataFrame([(1, "Skills\nPython, Docker and SQL\nworked with Python and Docker for ten years at several places")], "doc_id long, text string")
    jobs = spark.createDataFrame([(7, "Requirements:\n- Python, Docker, Kafka\n- reporting pipelines and reporting pipelines")], "job_id long, text string")
    once = analyze(docs, jobs, spark.createDataFrame([(1, 7)], "doc_id long, job_id long")).results.collect()
    twice = analyze(docs, jobs, spark.createDataFrame([(1, 7), (1, 7)], "doc_id long, job_id long")).results.collect()
    assert once == twice and len(once) == 1


def test_nothing_is_cut(spark):
    long_line = "x" * 500 + " write to someone@example.com or call (415) 555-0100 " + "y " * 40_000
    r = normalize_documents(spark.createDataFrame([(1, long_line)], "doc_id long, text string")).first()
    assert len(r.text) == len(long_line.strip())


def test_the_last_of_repeated_json_keys_counts(spark):
    from doclint.operators import resume as rs

    raw = '{"basics": {"name": "First", "name": "Second"}, "work": [], "work": []}'
    r = rs.import_resumes(spark.createDataFrame([(1, raw, "en")], "doc_id long, raw string, lang string")).first()
    assert r.error_code is None and r.resume.basics.name == "Second"


@pytest.mark.parametrize("text", [
    "a" * 100_000 + "@" + "b." * 50_000 + " " + "1 " * 50_000,
    "a." * 20_000 + "1" * 10_000 + "\n" + "•x " * 5_000,
    "a@" + ")" * 60_000 + "x",
])
def test_hostile_texts_are_read_whole_in_bounded_time(spark, text):
    import time

    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    started = time.time()
    assert analyze(docs).results.count() == 1 and normalize_documents(docs).first().text == text.strip()
    analyze(docs).results.collect()
    assert time.time() - started < 60
