"""The classifier's training rows are bounded whatever the ids, and its loss and scores equal a plain form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from daybook.llm import quality
from daybook.llm.queries import table


def counted(monkeypatch):
    """The number of rows that each fit takes its positives from."""
    seen, real = [], quality._unpack

    def unpack(column):
        out = real(column)
        if column.__class__.__name__ == "ChunkedArray":
            seen.append(len(out))
        return out

    monkeypatch.setattr(quality, "_unpack", unpack)
    return seen


@pytest.mark.parametrize("most", [2, 50])
def test_an_id_of_very_many_rows_brings_no_more_than_the_bound(spark, monkeypatch, most):
    seen = counted(monkeypatch)
    monkeypatch.setattr(quality, "STEPS", 1)
    monkeypatch.setattr(quality, "PRIOR_STEPS", 1)
    ids = [i for i in range(400) if __import__("zlib").crc32(str(i).encode()) % 5][:100]
    docs = spark.range(5000).select(F.lit(ids[0]).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")).unionByName(spark.createDataFrame([(i, f"other {i}") for i in ids], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, 1) for i in ids], "doc_id long, quality int")
    quality.train(spark, docs, labels, max_labelled=most)
    assert seen and seen[0] <= most


def test_the_rows_taken_do_not_depend_on_their_order(spark, sf, monkeypatch):
    monkeypatch.setattr(quality, "STEPS", 2)
    monkeypatch.setattr(quality, "PRIOR_STEPS", 2)
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    models = [quality.train(spark, d, labels, max_labelled=10) for d in (docs, docs.orderBy(F.desc("doc_id")).repartition(3))]
    x = np.stack([quality.features(t) for t in ("Some plain text. And more of it.", "", "$$$ %%% ###")])
    assert np.allclose(models[0].score(x), models[1].score(x), atol=1e-4)
