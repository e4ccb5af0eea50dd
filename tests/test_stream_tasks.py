"""A micro-batch of few files is dealt out over all tasks."""

import os

from test_sources_and_stream import VARIANTS, analyze, job, scores  # noqa: F401


def test_a_batch_of_one_file_uses_every_task(spark, job):  # noqa: F811
    from doclint.sources.files import tasks

    rows = [(i, VARIANTS[1 + i % 6]) for i in range(64)]
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING").coalesce(1).write.parquet(job.source)
    seen = []
    write = type(job).score

    class Watched(type(job)):
        def score(self, batch, batch_id):
            write(self, batch, batch_id)
            target = f"{self.target}/batch_id={batch_id}"
            seen.append(len([f for f in os.listdir(target) if f.endswith(".parquet")]))

    Watched(job.source, job.target, job.checkpoint).start(spark).awaitTermination()
    assert seen and seen[0] > 1 and seen[0] <= tasks(spark)
    assert scores(job.results(spark)) == scores(analyze(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).results)
