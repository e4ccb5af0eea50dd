"""Picking the rejected records copies nothing of the import."""

from doclint.operators.resume import import_resumes, rejected_resumes
from doclint.sources import sinks


def _imported(spark):
    rows = [(1, "{bad", "en"), (2, "[1]", "en"), (3, '{"basics": {"name": "Ann"}}', "en")]
    return import_resumes(spark.createDataFrame(rows, "doc_id long, raw string, lang string"))


def test_a_record_is_parsed_once(spark):
    plan = rejected_resumes(_imported(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") == 1


def test_rejected_records_are_written(spark, tmp_path):
    sinks.write_resumes(_imported(spark), str(tmp_path))
    rows = spark.read.parquet(f"{tmp_path}/resumes_rejected").collect()
    assert sorted((r.doc_id, r.error_code) for r in rows) == [(1, "invalid_json"), (2, "invalid_schema")]
    assert [r.doc_id for r in spark.read.json(f"{tmp_path}/resumes").collect()] == [3]
