import random
from datetime import datetime

import pytest

from lontar.llm import consensus as C

SCHEMA = "query_id string, listing_id string, annotator string, relevance int, labelled_at timestamp, vote int, n int"
NOW = datetime(2026, 1, 1)


def made(seed=1, items=400):
    """Labels of five annotators of known accuracy, and the truth."""
    rng = random.Random(seed)
    truth = {str(i): rng.choice([0, 0, 1, 1, 2]) for i in range(items)}
    out = []
    for name, accuracy in (("a", 0.9), ("b", 0.85), ("c", 0.8), ("d", 0.6), ("e", 1 / 3)):
        for i, t in truth.items():
            if rng.random() < 0.8:
                v = t if rng.random() < accuracy else rng.choice([x for x in (0, 1, 2) if x != t])
                out.append(("q", i, name, v, NOW, 9, 9))
    return out, truth


def test_accuracy_and_consensus(spark):
    labels, truth = made()
    df = spark.createDataFrame(labels, SCHEMA)
    accuracy = {r.annotator: r.accuracy for r in C.reliability(C.votes(df)).collect()}
    for name, expected in (("a", 0.9), ("b", 0.85), ("c", 0.8), ("d", 0.6), ("e", 1 / 3)):
        assert abs(accuracy[name] - expected) < 0.1
    got = {r.listing_id: r.relevance for r in C.consensus(df).collect()}
    assert sum(got[i] == truth[i] for i in got) / len(got) > 0.9  # the two good annotators alone agree with the truth less often


def test_last_valid_label_and_names(spark):
    later = datetime(2026, 1, 2)
    rows = [("q", "x", " Ann ", 0, NOW, 0, 0), ("q", "x", "ann", 2, later, 0, 0), ("q", "x", "ann", 7, datetime(2026, 1, 3), 0, 0), ("q", "x", "bo", None, NOW, 0, 0), ("q", "x", "bo", 1, None, 0, 0), (None, "x", "bo", 1, NOW, 0, 0)]
    votes = {(r.annotator, r.vote) for r in C.votes(spark.createDataFrame(rows + rows, SCHEMA)).collect()}
    assert votes == {("ann", 2), ("bo", 1)}


@pytest.mark.parametrize("rows", [[], [("q", "x", "a", 1, NOW, 0, 0)], [("q", "x", "a", 1, NOW, 0, 0), ("q", "x", "b", 2, NOW, 0, 0)], [("q", "x", None, 1, NOW, 0, 0)]])
def test_edges(spark, rows):
    got = C.consensus(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == (1 if rows and rows[0][2] else 0)
    if got:
        assert got[0].relevance == 1  # alone, or the smaller label of two equal weights


def test_confidence_is_compared_and_told_at_nine_decimals(spark):
    """A half at the seventh decimal rounds up, as in the SQL, whatever the order of summing leaves beyond the ninth."""
    labels, _ = made()
    for r in C.consensus(spark.createDataFrame(labels, SCHEMA)).collect():
        assert r.confidence == round(r.confidence, 9)
