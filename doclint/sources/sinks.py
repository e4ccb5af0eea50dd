"""Outputs of the analysis (O1-O5) and the shared folder used to cut long plans."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.resume import rejected_resumes, valid_resumes
from ..operators.scoring import params_text
from ..plans.analyze import analyze

#: Stages that the analysis makes by a join on ``doc_id``.
JOINED_BY_DOCUMENT = ("results", "keyword_hits")
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"


def shared_folder(spark: SparkSession) -> str | None:
    """Folder the cluster names in ``spark.checkpoint.dir``, None where it is unset."""
    return spark.conf.get("spark.checkpoint.dir", None)


def table_cut(spark: SparkSession, folder: str | None = None):
    """A ``cut`` for :func:`doclint.plans.analyze.analyze` that writes each stage once as a table.

    Stages land in the shared folder, so a lost executor only repeats its own tasks and later
    stages read columns instead of recomputing documents.  Without any folder the plan stays lazy.
    """
    base = folder or shared_folder(spark)
    if base is None:
        return lambda df, name: df
    run = f"{base.rstrip('/')}/doclint-{uuid.uuid4().hex}"

    def cut(df: DataFrame, name: str) -> DataFrame:
        path = f"{run}/{name}"
        df.write.mode("errorifexists").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return cut


class StageTables:
    """A ``cut`` that writes stages as tables, and the tables' entries in the catalog while it is open.

    A stage with documents is bucketed and sorted by ``doc_id``: whatever joins or groups it by document afterwards reads
    it without another shuffle.  Files land in the shared folder; a local session without one uses the warehouse.

    The wide stages of pairs come out of a join by document, so their tasks hold whole buckets: they are written as they
    come, neither shuffled nor sorted again, with one open file for each bucket of a task.

        with StageTables(spark) as stages:
            write_analysis(analyze(docs, jobs, pairs, cut=stages.cut), folder)
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None) -> None:
        self.spark, self.run = spark, f"doclint_{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.names: list[str] = []

    def __enter__(self) -> StageTables:
        return self

    def __exit__(self, *_) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names.clear()

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        table = f"{self.run}_{name}"
        writer = df.write.format("parquet")
        if name in JOINED_BY_DOCUMENT:
            writer = writer.bucketBy(self.buckets, "doc_id")
        elif "doc_id" in df.columns:
            # one task writes one bucket, so a bucket is one file
            writer = df.repartition(self.buckets, "doc_id").write.format("parquet").bucketBy(self.buckets, "doc_id").sortBy("doc_id")
        base = shared_folder(self.spark)
        if base is not None:
            writer = writer.option("path", f"{base.rstrip('/')}/{table}")
        self.names.append(table)
        with self._open_files(self.buckets if name in JOINED_BY_DOCUMENT else None):
            writer.saveAsTable(table)
        return self.spark.table(table)

    @contextmanager
    def _open_files(self, most: int | None):
        """Lets a task write ``most`` files side by side instead of sorting its rows by file first."""
        before = self.spark.conf.get(OPEN_FILES)
        self.spark.conf.set(OPEN_FILES, before if most is None else str(most))
        try:
            yield
        finally:
            self.spark.conf.set(OPEN_FILES, before)


def write_analysis(analysis, folder: str, mode: str = "overwrite") -> None:
    """O1: scores, findings and keyword hits as tables.

    Each output reads ``analysis.results`` or ``analysis.keyword_hits``; made with :class:`StageTables` these are written
    stages, so one computation feeds them all.
    """
    analysis.results.drop("findings").write.mode(mode).parquet(f"{folder}/scores")
    analysis.findings().write.mode(mode).parquet(f"{folder}/findings")
    if analysis.keyword_hits is not None:
        analysis.keyword_hits.write.mode(mode).parquet(f"{folder}/keyword_hits")


def run_analysis(docs: DataFrame, jobs: DataFrame | None, pairs: DataFrame | None, folder: str, **options) -> None:
    """O1 from the inputs: documents, ads and pairs are stages, each computed once; the outputs of pairs are written from these.

    Pairs are matched for each output again, inside their rows: that takes less than writing their wide stages and reading them.
    """
    with StageTables(docs.sparkSession) as stages:
        cut = lambda df, name: df if name in JOINED_BY_DOCUMENT else stages.cut(df, name)
        write_analysis(analyze(docs, jobs, pairs, cut=cut, **options), folder)


def write_documents(normalized: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """O2: the text a parser reads."""
    normalized.select("doc_id", "text").write.mode(mode).parquet(f"{folder}/documents_normalized")


def write_reports(reports: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """O3: Markdown reports; those of one document stand side by side and share most lines, which zstd finds."""
    reports.write.mode(mode).option("compression", "zstd").parquet(f"{folder}/reports")


def write_resumes(imported: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Valid records as JSON lines, the rest as a quarantine table."""
    valid_resumes(imported).write.mode(mode).json(f"{folder}/resumes")
    rejected_resumes(imported).write.mode(mode).parquet(f"{folder}/resumes_rejected")


def write_quarantine(bad: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """``(doc_id, error_code)``."""
    bad.write.mode(mode).parquet(f"{folder}/quarantine")


def flat_findings(findings: DataFrame) -> DataFrame:
    """Findings with parameters as sorted ``k=v`` text."""
    return findings.withColumn("params", params_text(F.col("params")))
