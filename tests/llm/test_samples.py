import pandas as pd

from tidemill.llm.samples import labelled


def test_one_row_for_each_id(spark):
    """A labelled id on very many rows brings one row to the driver; null ids bring none; extra columns stay."""
    docs = spark.range(100_000).selectExpr("cast(7 as long) AS doc_id", "concat('text ', id % 50) AS text", "id AS extra")
    docs = docs.unionByName(spark.createDataFrame([(8, None, 1), (None, "x", 2), (9, "not chosen", 3)], "doc_id long, text string, extra long"))
    got = labelled(docs, pd.DataFrame({"doc_id": [7, 8], "label": [1, 0]})).collect()
    assert sorted((r.doc_id, r.label) for r in got) == [(7, 1), (8, 0)]
    assert {"doc_id", "label", "text", "extra"} == set(got[0].asDict())
