"""Queries that write an output or an input and read it back: sinks (O1-O5, R6), the file scan (I1), the stream."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from doclint.operators.resume import rejected_resumes
from doclint.operators.scoring import band
from doclint.sources import files as fl
from doclint.sources import sinks
from doclint.streaming import incremental as inc

from . import catalog_records as records
from . import fixtures as fx
from .catalog import ORACLES, QUERIES, big, documents, pair, pair_inputs, query


NL = "chr(10)"


def _folder(spark) -> str:
    """A new folder in the shared one; a local session without any uses a temporary folder."""
    base = sinks.shared_folder(spark)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="doclint-")
    return f"{base.rstrip('/')}/sink-{uuid.uuid4().hex}"


def _written(spark, d) -> str:
    """The folder of an analysis of all pairs: computed once, read by every output."""
    folder = _folder(spark)
    sinks.run_analysis(*pair_inputs(spark, d), folder)
    return folder


@query("sink_scores", ORACLES["total_score"])
def _(spark, d):
    return spark.read.parquet(f"{_written(spark, d)}/scores").select("doc_id", "job_id", *big("score", "keywords_score"), "lang", "job_lang")


@query("sink_findings", ORACLES["findings_sorted"])
def _(spark, d):
    rows = sinks.flat_findings(spark.read.parquet(f"{_written(spark, d)}/findings"))
    return rows.select("doc_id", "job_id", F.col("pos").cast("bigint").alias("pos"), "id", "severity", "category", "params")


@query("sink_keyword_hits", pair("SELECT doc_id, job_id, term, CAST(n AS BIGINT) AS n, matched, stuffed FROM hits"))
def _(spark, d):
    return spark.read.parquet(f"{_written(spark, d)}/keyword_hits").select("doc_id", "job_id", "term", *big("n"), "matched", "stuffed")


@query("sink_documents", ORACLES["normalize_text"])
def _(spark, d):
    folder = _folder(spark)
    sinks.write_documents(documents(spark, d), folder)
    return spark.read.parquet(f"{folder}/documents_normalized")


@query("sink_reports", ORACLES["markdown_report_en"])
def _(spark, d):
    folder = _folder(spark)
    sinks.write_reports(QUERIES["markdown_report_en"](spark, d), folder)
    return spark.read.parquet(f"{folder}/reports")


@query("sink_resumes", ORACLES["resume_import"])
def _(spark, d):
    """Exported records are read as JSON again and must equal what was imported."""
    folder, imported = _folder(spark), records._imported(spark, d)
    sinks.write_resumes(imported, folder)
    read = spark.read.schema(imported.select("doc_id", "resume").schema).json(f"{folder}/resumes").withColumn("error_code", F.lit(None).cast("string"))
    rejected = spark.read.parquet(f"{folder}/resumes_rejected")
    return records._flat(read.unionByName(rejected, allowMissingColumns=True))


@query("sink_quarantine", f"SELECT doc_id, error_code FROM ({ORACLES['resume_import']}) r WHERE error_code IS NOT NULL")
def _(spark, d):
    folder = _folder(spark)
    sinks.write_quarantine(rejected_resumes(records._imported(spark, d)), folder)
    return spark.read.parquet(f"{folder}/quarantine")


# ---- scans of written files -----------------------------------------------------------------
MOST_BYTES = 900
_AD_FILE = f"(SELECT job_id, text || {NL} AS content FROM ({fx.SYNTH_JOBS}) j) f"


@query("file_scan", f"""SELECT job_id, CAST(octet_length(encode(content)) AS BIGINT) AS length, CASE WHEN octet_length(encode(content)) <= {MOST_BYTES} THEN 'txt' END AS format,
    CASE WHEN octet_length(encode(content)) > {MOST_BYTES} THEN 'too_large' END AS error_code, CASE WHEN octet_length(encode(content)) <= {MOST_BYTES} THEN content END AS text FROM {_AD_FILE}""")
def _(spark, d):
    """Every ad is written as a text file of its own; the scan admits, classifies and decodes the files."""
    folder = f"{_folder(spark)}/ads"
    ads = fx.spark_view(spark, d, "synth_jobs").select("job_id", "text")
    ads.repartition(fx.tasks(spark), "job_id").write.partitionBy("job_id").text(folder)
    files = fl.scan(spark, folder, MOST_BYTES)
    job = F.regexp_extract("path", r"/job_id=(\d+)/", 1).cast("bigint")
    return files.select(job.alias("job_id"), "length", "format", "error_code", fl.decode_text(F.col("content")).alias("text"))


_PASTED = """SELECT doc_id, CASE doc_id % 11 WHEN 0 THEN concat(' ', chr(9), chr(10), '\u00a0\u3000', chr(13)) WHEN 1 THEN '' WHEN 2 THEN concat(chr(10), '\ufeff', text, ' ') ELSE text END AS text FROM documents"""


@query("pasted_texts", f"SELECT doc_id, CASE WHEN doc_id % 11 < 2 THEN 'empty_text' END AS error_code, CAST(length(text) AS BIGINT) AS n_chars FROM ({_PASTED}) p")
def _(spark, d):
    fx.spark_view(spark, d, "documents").createOrReplaceTempView("documents")
    return fl.pasted(spark.sql(_PASTED)).select("doc_id", "error_code", F.length("text").cast("bigint").alias("n_chars"))


# ---- stream ---------------------------------------------------------------------------------
class _Redelivered(inc.IncrementalAnalysis):
    """Its first micro-batch comes twice, as after a driver that was lost before it could commit."""

    def score(self, batch, batch_id):
        for _ in range(2 if batch_id == 0 else 1):
            super().score(batch, batch_id)


@query("incremental_scores", ORACLES["base_score"])
def _(spark, d):
    """Documents land in two deliveries, each read in several micro-batches; for the second one the query starts again from
    its checkpoint."""
    folder = _folder(spark)
    job = _Redelivered(f"{folder}/landed", f"{folder}/scores", f"{folder}/checkpoint", schema=inc.FULL_SCHEMA)
    docs = fx.resume_documents(spark, d).select("doc_id", "text", "header_footer_text", "layout", "truncated")
    for delivery in (0, 1):
        docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == delivery).repartition(4).write.mode("append").parquet(job.source)
        job.start(spark, max_files=2).awaitTermination()
    return job.results(spark).select("doc_id", F.col("score").cast("bigint").alias("score"), band(F.col("score")).alias("band"))
