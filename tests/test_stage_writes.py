"""Wide stages of pairs are written as they come out of their join by document."""

from test_pair_plans import tables  # noqa: F401

from doclint.plans.analyze import analyze
from doclint.sources import sinks


def test_wide_stages_are_not_shuffled_again(spark, tables, monkeypatch):  # noqa: F811
    shuffled = []
    repartition = type(tables[0]).repartition

    def watched(self, *args):
        shuffled.append("findings" in self.columns and "job_id" in self.columns or "stuffed" in self.columns)
        return repartition(self, *args)

    monkeypatch.setattr(type(tables[0]), "repartition", watched)
    before = spark.conf.get(sinks.OPEN_FILES)
    with sinks.StageTables(spark, 4) as stages:
        analyze(*tables, cut=stages.cut)
    assert shuffled and not any(shuffled) and spark.conf.get(sinks.OPEN_FILES) == before
