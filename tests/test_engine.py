import os

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import SMALL
from lontar.engine import Engine

pytestmark = pytest.mark.skipif(not os.path.exists(SMALL), reason="no test tables here")


def test_engine(spark):
    e = Engine(spark, SMALL)
    q = spark.createDataFrame([("q", "kos putri dekat kampus")], "query_id string, query_text string")
    hits = e.search(q, "bm25", 5, F.col("tipe") == "putri").collect()
    assert 0 < len(hits) <= 5 and all(h.tipe == "putri" for h in hits)
    assert e.get(hits[0].doc_id).count() == 1 and e.get("none").count() == 0
    assert e.trace(spark.createDataFrame([("Kos murah",)], "text string")).first().trace[-1].stage == "stem"
    assert e.statistics().count() > 0 and e.status().count() == 4
    assert e.sheet(e.rank(q, "tfidf", 5)).count() == 5
    with pytest.raises(ValueError):
        e.search(q, "other")
    with pytest.raises(ValueError):
        e.search(q, "bm25", 99)
    with pytest.raises(LookupError):
        e.rank(q, "hybrid")
