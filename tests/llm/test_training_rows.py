"""A labelled document teaches once, however many rows it has."""

import numpy as np

from doclint.llm import quality_model


def test_repeated_rows_of_a_label_teach_once(spark):
    docs = [(i, f"{'good fine' if i % 2 else 'bad poor'} words {i}") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    train = lambda rows: quality_model.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert np.array_equal(train(docs), train(docs + [docs[6]] * 500 + [(7, "zebra")] * 20))
