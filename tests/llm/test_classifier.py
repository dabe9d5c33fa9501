"""Held-out accuracy, the flat arrays against a walk of the trees, and the edge cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_MID
from vulnsift.llm import classifier as C


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = (spark.read.parquet(f"{SF_MID}/{t}.parquet") for t in ("documents", "labels"))
    return {r.doc_id: r for r in C.score(docs, labels).collect()}, {r.doc_id: r.quality for r in labels.collect()}


def test_held_out_accuracy(scored):
    got, labels = scored
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert len(held) > 50
    assert np.mean([got[i].predicted == labels[i] for i in held]) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_inputs_of_a_score_are_the_text_only(spark, scored):
    got, _ = scored
    docs, labels = (spark.read.parquet(f"{SF_MID}/{t}.parquet") for t in ("documents", "labels"))
    other = docs.select("doc_id", "text", F.lit("xx").alias("lang"), F.lit("y").alias("source"))
    assert {r.doc_id: r.score for r in C.score(other, labels).collect()} == {i: r.score for i, r in got.items()}
    by_hash = labels.where(~C.held_out())       # held-out labels are never read
    assert {r.doc_id: r.score for r in C.score(docs, by_hash).collect()} == {i: r.score for i, r in got.items()}


def test_flat_arrays_equal_a_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(C.FEATURES)))
    y = (x[:, 0] + x[:, 3] * x[:, 4] > 0).astype(float)
    f = C.fit(x, y, trees=30)
    p = f.predict(x)
    assert ((p >= 0.5) == y).mean() > 0.95
    for row, want in zip(x[:50], p):
        margin = f.base
        for node in f.roots:
            while f.left[node] != node:
                node = f.left[node] if row[f.feature[node]] <= f.threshold[node] else f.right[node]
            margin += f.value[node]
        assert 1 / (1 + np.exp(-margin)) == pytest.approx(want, abs=1e-12)


def test_edge_cases(spark):
    schema = "doc_id long, text string, score string, held_out string"
    rows = [(1, "", "a", None), (2, None, "a", None), (3, " \n\t", "a", None), (None, "a b", "a", None), (4, "x " * 50000, "a", None),
            (4, "x " * 50000, "a", None), (5, "😀" * 10, "a", None)]
    df = spark.createDataFrame(rows, schema)
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = C.score(df, none).collect()
    assert len(got) == 7 and all(r.score == 0.5 for r in got)
    one = spark.createDataFrame([(i, 1) for i in range(1, 6)] + [(2, None), (None, 0)], "doc_id long, quality int")
    assert all(r.score > 0.5 for r in C.score(df, one).collect())
    both = spark.createDataFrame([(i, i % 2) for i in range(1, 6)] + [(4, 1)], "doc_id long, quality int")
    by = {}
    for r in C.score(df, both).collect():
        by.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(s) == 1 for s in by.values())
    assert C.score(df.where(F.lit(False)), both).count() == 0
    assert len(C.text_statistics("")) == len(C.text_statistics("a b\nc")) == len(C.FEATURES)
