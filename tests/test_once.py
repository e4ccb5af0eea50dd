"""Costly columns are computed once: filters on them are not pushed down as copies."""

from pyspark.sql import functions as F

from doclint.functions.text import once
from oracles.catalog import QUERIES


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_filter_on_a_marked_column_does_not_copy_it(spark):
    df = spark.range(3).select(once(F.sha2(F.col("id").cast("string"), 256)).alias("x")).filter("x > ''")
    assert optimized(df).count("sha2(") == 1


def test_section_rows_read_the_text_once(spark):
    plan = optimized(QUERIES["section_spans"](spark, "/root/testdata/sf0.001"))
    assert plan.count("Only eight words are in this short text") == 1
