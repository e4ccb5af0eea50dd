"""Corpus reports over analysis results: ranking, scorecard, prevalence, skill gap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..operators.keywords import term_id
from ..operators.scoring import band


def rank_candidates(results: DataFrame, k: int = 10) -> DataFrame:
    """Best ``k`` documents per ad.

    The limit on ``row_number`` is applied before the shuffle as well, so an ad with a large share
    of all pairs sends at most ``k`` rows per task.
    """
    order = Window.partitionBy("job_id").orderBy(F.desc("score"), "doc_id")
    ranked = results.filter("job_id IS NOT NULL").select("job_id", "doc_id", "score")
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def scorecard(results: DataFrame) -> DataFrame:
    """Rows with a score and mean score by language, band and category, with subtotals.

    Categories are the five scores and the total.  ``level`` tells subtotals apart: the bits of ``lang``, ``band`` and
    ``category``, set where the row is over all of them.
    """
    points = [*(F.col(f"{c}_score").alias(c) for c in fv.CATEGORIES), F.col("score").alias("total")]
    named = results.select("lang", band(F.col("score")).alias("band"), *points).unpivot(["lang", "band"], [*fv.CATEGORIES, "total"], "category", "points")
    sets = [["lang", "band", "category"], ["lang", "category"], ["band", "category"], ["category"]]
    return named.groupingSets([[F.col(c) for c in s] for s in sets], "lang", "band", "category").agg(
        F.count("points").alias("n"), F.round(F.avg("points"), 6).alias("mean_score"), F.grouping_id().alias("level")
    )


def finding_prevalence(findings: DataFrame) -> DataFrame:
    """Documents that carry each finding, and their share of all documents."""
    by_id = findings.groupingSets([[F.col("id"), F.col("severity")], []], "id", "severity").agg(
        F.count_distinct("doc_id").alias("documents"), F.grouping_id().alias("level")
    )
    # one row per finding id and severity, both closed sets
    every = F.max(F.when(F.col("level") > 0, F.col("documents"))).over(Window.partitionBy(F.lit(0)))
    shared = by_id.withColumn("share", F.round(F.col("documents") / every, 6))
    return shared.filter("level = 0").drop("level")


def prevalence_of_results(results: DataFrame) -> DataFrame:
    """E3 from results whose findings are ``struct<id, severity>``: each list is taken apart once for all ads that give it.

    The lists of a document are grouped where the join by document left them; no row per finding of a pair is made.
    """
    lists = results.groupBy("doc_id", "findings").agg(F.lit(1).alias("one"))
    return finding_prevalence(lists.select("doc_id", F.inline("findings")).distinct())


def skill_gap_of_matches(matches: DataFrame, keywords: DataFrame) -> DataFrame:
    """E3 as :func:`skill_gap` has it, from matched pairs: keywords that were found are counted by ad, and the rest is the gap."""
    known = matches.select("job_id", "kw_found").filter("kw_found IS NOT NULL")
    met = known.select("job_id", F.explode(F.concat(F.array(F.lit(None).cast("bigint")), "kw_found")).alias("id"))
    counts = met.groupBy("job_id", "id").agg(F.count("*").alias("n"))
    listed = keywords.select("job_id", "kind", "term", term_id(F.col("kind"), F.col("key")).alias("id"))
    documents = counts.filter("id IS NULL").select("job_id", F.col("n").alias("documents"))
    rows = listed.join(documents, "job_id").join(counts.filter("id IS NOT NULL"), ["job_id", "id"], "left")
    lacking = F.col("documents") - F.coalesce("n", F.lit(0))
    return rows.select("job_id", "kind", "term", "documents", lacking.alias("lacking"), F.round(lacking / F.col("documents"), 6).alias("share"))


def skill_gap(hits: DataFrame) -> DataFrame:
    """Per ad and keyword, how many of its documents lack it, and their share."""
    lacking = F.count_if(~F.col("matched"))
    return hits.groupBy("job_id", "kind", "term").agg(
        F.count("*").alias("documents"), lacking.alias("lacking"), F.round(lacking / F.count("*"), 6).alias("share")
    )
