"""Pairs are matched inside their row: no row per keyword is shuffled, and a document's text is read once."""

import re

from pyspark.sql import functions as F
from test_pair_plans import DOCS, plan, tables  # noqa: F401

from doclint.operators import keywords as kw
from doclint.plans import analyze as an


def test_no_row_per_keyword_is_shuffled(tables):  # noqa: F811
    done = an.analyze(*tables)
    for frame in (done.results, done.keyword_hits):
        assert not re.search(r"Exchange hashpartitioning\(doc_id#\d+L, (?:kind|key)#", plan(frame))


def test_the_index_of_a_document_counts_its_terms(spark):
    rows = [*DOCS[:3], (70, ""), (71, "data data data data sets data data"), (72, "GitHub Actions, Go, C++ and React Native; Spring Boot, k8s")]
    docs = an.with_tokens(an.normalize_documents(spark.createDataFrame(rows, "doc_id long, text string")))
    want = {(r.doc_id, r.id): r.n for r in kw.document_terms(docs).select("doc_id", kw.term_id(F.col("kind"), F.col("key")).alias("id"), "n").collect()}
    got = {}
    for r in kw.with_term_index(docs).collect():
        assert len(r.term_ids) == len(r.term_ns) == len(set(r.term_ids))
        got |= {(r.doc_id, i): n for i, n in zip(r.term_ids, r.term_ns)}
    assert got == want
