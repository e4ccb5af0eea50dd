"""Files on disk, pasted texts, and the stream over landed files."""

import os

import pytest
from pyspark.sql import functions as F

from doclint.plans.analyze import analyze
from doclint.sources import files as fl
from doclint.streaming.incremental import IncrementalAnalysis
from test_analysis import VARIANTS

FILES = {
    "a.txt": b"plain text", "empty.txt": b"", "sub/no +%41.md": b"", "big.md": b"x" * 500, "sub/b +%41.md": "café".encode("cp1252"), "c.pdf": b"junk %PDF-1.4", "d.docx": b"%PDF-1.4",
    "e.docx": b"PK\x03\x04zip", "f.doc": bytes.fromhex("D0CF11E0A1B11AE1"), "g.xyz": b"?", "h.txt": b"nul\x00", "i.txt": b"\x80\x99\x9f\x81",
}
CODES = {
    "empty.txt": "empty_file", "sub/no +%41.md": "empty_file", "big.md": "too_large", "d.docx": "extension_mismatch", "f.doc": "legacy_doc", "g.xyz": "unsupported_type",
}


def test_a_scan_of_files(spark, tmp_path):
    for name, content in FILES.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_bytes(content)
    found = fl.scan(spark, str(tmp_path), max_bytes=400)
    rows = {r.path.split(f"{tmp_path}/")[1]: r for r in found.collect()}
    assert set(rows) == set(FILES) and {k: r.error_code for k, r in rows.items() if r.error_code} == CODES
    assert {k: r.format for k, r in rows.items() if r.format} == {"a.txt": "txt", "sub/b +%41.md": "txt", "c.pdf": "pdf", "e.docx": "docx", "h.txt": "txt", "i.txt": "txt"}
    assert rows["big.md"].content is None and rows["empty.txt"].content is None
    texts = {r.path.split(f"{tmp_path}/")[1]: (r.text, r.error_code) for r in fl.text_documents(found).collect()}
    assert texts["sub/b +%41.md"] == ("café", None) and texts["h.txt"] == (None, "invalid_text") and texts["i.txt"] == ("€™Ÿ", None)
    plan = fl.read_files(spark, str(tmp_path), 400)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,400)" in plan and "GreaterThan(length,400)" in plan


def test_blank_texts_are_refused(spark):
    rows = [(1, "x"), (2, ""), (3, None), (4, " \t\n  ﻿"), (5, " y")]
    codes = {r.doc_id: r.error_code for r in fl.pasted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert codes == {1: None, 2: "empty_text", 3: "empty_text", 4: "empty_text", 5: None}


@pytest.fixture
def job(tmp_path):
    return IncrementalAnalysis(str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))


def land(spark, job, ids):
    rows = [(i, VARIANTS[i]) for i in ids]
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING").coalesce(1).write.mode("append").parquet(job.source)


def scores(frame):
    return sorted((r.doc_id, r.score) for r in frame.collect())


def test_restart_and_replay_leave_every_document_once(spark, job):
    docs = spark.createDataFrame(list(VARIANTS.items()), "doc_id BIGINT, text STRING")
    want = scores(analyze(docs).results)
    land(spark, job, [1, 2, 3])
    job.start(spark).awaitTermination()
    assert scores(job.results(spark)) == [w for w in want if w[0] <= 3]
    land(spark, job, [4, 5, 6])
    job.start(spark).awaitTermination()
    assert scores(job.results(spark)) == want
    # a driver lost after the write and before the commit: the same batch comes again
    commits = os.path.join(job.checkpoint, "commits")
    for name in os.listdir(commits):
        if name.lstrip(".").startswith("1"):
            os.remove(os.path.join(commits, name))
    job.start(spark).awaitTermination()
    assert scores(job.results(spark)) == want
    assert job.results(spark).select("batch_id").distinct().count() == 2
    job.start(spark).awaitTermination()  # nothing new
    assert scores(job.results(spark)) == want


def test_one_file_a_batch(spark, job):
    for i in (1, 2, 3):
        land(spark, job, [i])
    job.start(spark, max_files=1).awaitTermination()
    assert job.results(spark).groupBy("batch_id").agg(F.count("*").alias("n")).filter("n = 1").count() == 3
