"""Findings of a document are sorted and shaped once; corpus reports make no row per finding or keyword of a pair."""

from pyspark.sql import functions as F
from test_pair_plans import tables  # noqa: F401

from doclint.operators import keywords as kw
from doclint.operators import scoring as sc
from doclint.plans import analyze as an
from doclint.plans import corpus as cp

KIND = lambda f: F.struct(f["id"].alias("id"), f["severity"].alias("severity"))


def rows(df):
    return sorted(map(str, df.collect()))


def test_shaped_findings_are_those_of_the_results(tables):  # noqa: F811
    whole = an.analyze(*tables)
    bare = an.analyze(*tables, shape=KIND, parameters=False)
    listed = whole.results.select("doc_id", "job_id", F.transform("findings", lambda f: KIND(f)).alias("findings"))
    assert rows(bare.results.select("doc_id", "job_id", "findings")) == rows(listed)
    again = whole.results.filter(F.to_json(sc.sort_findings(F.col("findings"))) != F.to_json("findings"))
    assert again.count() == 0
    assert rows(cp.prevalence_of_results(bare.results)) == rows(cp.finding_prevalence(whole.findings()))


def test_terms_do_not_travel_where_nobody_reads_them(tables):  # noqa: F811
    bare = an.analyze(*tables, shape=KIND, parameters=False).results.select("doc_id", "job_id", "findings")
    assert "kw_terms" not in bare._jdf.queryExecution().optimizedPlan().toString()


def test_the_skill_gap_is_counted_from_found_keywords(tables):  # noqa: F811
    docs, jobs, pairs = tables
    normalized = an.with_tokens(an.normalize_documents(docs)).withColumn("words", an.count_tokens(F.col("padded")))
    indexed = kw.with_often(kw.with_term_index(normalized)).select("doc_id", "words", *an.TERM_INDEX)
    listed = kw.job_keywords(jobs.select("job_id", an.normalize_text(F.col("text")).alias("text")))
    met = kw.pairs_with_ads(pairs.dropna().distinct(), kw.pack_keywords(listed))
    matches = kw.matched(indexed.join(met, "doc_id")).filter("kw_found IS NOT NULL")
    got = cp.skill_gap_of_matches(matches, listed)
    assert rows(got) == rows(cp.skill_gap(kw.hits_of(matches)).select(*got.columns)) and got.count() > 0
