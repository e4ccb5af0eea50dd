import os

import pytest
from check_oracles import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "normalize_text", "tokenize", "garbled", "section_spans", "label_hits", "job_keywords_topk", "total_score", "docx_text",
    "page_lines", "resume_import", "normalize_month", "file_formats",
]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
@pytest.mark.parametrize("name", SAMPLE)
def test_same_result(spark, name):
    assert compare(spark, connect(SF), SF, entry.queries()[name], entry.oracle_sql()[name]) is None
