"""A text without words is placed by what the model learned."""

import pytest
from test_operators import prose

from tessella.llm import classifier


def test_null_text_is_not_good_where_short_junk_is_bad(spark):
    rows = [(i, prose(i, 150) if i % 2 else "junk") for i in range(120)] + [(1000, None), (1001, ""), (1002, " \n ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    found = {r["doc_id"]: r for r in classifier.classify(docs, classifier.train(docs, labels)).collect()}
    assert [found[i]["predicted"] for i in (1, 2, 1000, 1001, 1002)] == [1, 0, 0, 0, 0]
    assert found[1000]["score"] == pytest.approx(found[1001]["score"])
