"""Pairs of crowded ads are dealt over tasks, and outputs read one computation."""

import pytest
from pyspark.sql import functions as F

from doclint.operators import keywords as kw
from doclint.plans.analyze import analyze
from doclint.sources import sinks

DOCS = [(i, f"Skills\nPython, Docker and SQL\nworked with Python and Docker for {i + 2} years at several places in Lisbon") for i in range(60)] + [(60, "short"), (None, "nobody knows whose text this is but it has more than ten words")]
JOBS = [(7, "Requirements:\n- Python, Docker, Kafka\n- reporting pipelines and reporting pipelines"), (8, "Requirements\nGo, Rust and Kubernetes for the platform")]
PAIRS = [(i, 7) for i in range(40)] + [(i, 8) for i in range(5)] + [(1, 7), (2, None), (None, 7), (3, 99), (777, 7)]


@pytest.fixture(scope="module")
def tables(spark):
    return (
        spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(JOBS, "job_id long, text string"),
        spark.createDataFrame(PAIRS, "doc_id long, job_id long"),
    )


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_crowded_ad_is_dealt_over_copies(spark, tables):
    pairs = tables[2].dropna().distinct()
    crowded = kw.crowded_ads(pairs, 5)
    assert {r.job_id: r.copies for r in crowded.collect()} == {7: 9}
    dealt = kw.deal_pairs(pairs, crowded)
    sizes = {(r.job_id, r.copy): r["count"] for r in dealt.groupBy("job_id", "copy").count().collect()}
    assert len([k for k in sizes if k[0] == 7]) >= 6 and max(sizes.values()) <= 12
    met = dealt.join(kw.copy_ads(tables[1], crowded), ["job_id", "copy"])
    assert sorted((r.doc_id, r.job_id) for r in met.collect()) == sorted((r.doc_id, r.job_id) for r in pairs.filter("job_id <> 99").collect())


def test_documents_without_an_ad_come_once(tables):
    results = {(r.doc_id, r.job_id): r for r in analyze(*tables).results.collect()}
    paired = {(i, 7) for i in range(40)} | {(i, 8) for i in range(5)} | {(3, 99)}
    assert set(results) == paired | {(i, None) for i in range(40, 61)} | {(None, None)}
    assert results[3, 99].keywords_score is None and results[1, 7].keywords_score > results[1, 8].keywords_score
    assert results[50, None].matched is None and results[60, None].score == 0


def test_outputs_come_from_one_computation(spark, tables, tmp_path):
    with sinks.StageTables(spark, 4) as stages:
        lazy = analyze(*tables)
        done = analyze(*tables, cut=stages.cut)
        for output in (done.results.drop("findings"), done.findings(), done.keyword_hits):
            assert plan(output).count("Scan parquet") == 1 and "Exchange" not in plan(output) and "ExistingRDD" not in plan(output)
        by_doc = done.results.join(done.documents.select("doc_id", F.col("words").alias("w")).hint("merge"), "doc_id")
        assert "Exchange" not in plan(by_doc)  # both stages are bucketed by document
        assert sorted(done.results.drop("findings").collect(), key=str) == sorted(lazy.results.drop("findings").collect(), key=str)
        names = list(stages.names)
    assert names and not any(spark.catalog.tableExists(n) for n in names)
    sinks.run_analysis(*tables, str(tmp_path))
    for name, want in (("scores", lazy.results.drop("findings")), ("findings", lazy.findings()), ("keyword_hits", lazy.keyword_hits)):
        assert sorted(spark.read.parquet(f"{tmp_path}/{name}").collect(), key=str) == sorted(want.collect(), key=str)
