"""Incremental analysis of newly landed documents.

Line and keyword logic needs no state across files, so every micro-batch runs the batch plan.  A micro-batch owns one
partition of the target and overwrites it, so a batch that is delivered again after a lost driver, or a query that starts
again from its checkpoint, leaves every document once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.lexicon import DEFAULT, Lexicon
from ..plans.analyze import LAYOUT, analyze
from ..sources.files import spread

SCHEMA = "doc_id BIGINT, text STRING"
FULL_SCHEMA = f"{SCHEMA}, header_footer_text STRING, layout {LAYOUT}, truncated BOOLEAN"
BATCH = "batch_id"


@dataclass(frozen=True)
class IncrementalAnalysis:
    """Scores of the documents in the Parquet files that land in ``source``, as a table partitioned by micro-batch."""

    source: str
    target: str
    checkpoint: str
    lexicon: Lexicon = DEFAULT
    schema: str = SCHEMA

    def score(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch; the same id gives the same partition, however often it comes.

        A batch of few files has few row groups; it is dealt out, as its analysis is heavy for its bytes.
        """
        rows = analyze(spread(batch), lexicon=self.lexicon).results
        rows.drop("matched", "missing").write.mode("overwrite").parquet(f"{self.target}/{BATCH}={batch_id}")

    def start(self, spark: SparkSession, max_files: int | None = None) -> StreamingQuery:
        """Take everything that landed since the last run, ``max_files`` a micro-batch if given, then stop."""
        reader = spark.readStream.schema(self.schema)
        if max_files is not None:
            reader = reader.option("maxFilesPerTrigger", max_files)
        stream = reader.parquet(self.source)
        return stream.writeStream.foreachBatch(self.score).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()

    def results(self, spark: SparkSession) -> DataFrame:
        return spark.read.option("basePath", self.target).parquet(self.target)


def lint_new_documents(
    spark: SparkSession, source: str, target: str, checkpoint: str, lexicon: Lexicon = DEFAULT, schema: str = SCHEMA
) -> StreamingQuery:
    """Score parquet documents that appeared in ``source`` since the last run; returns the query."""
    return IncrementalAnalysis(source, target, checkpoint, lexicon, schema).start(spark)
