import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from webgauge.llm import nbsvm


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = nbsvm.score_quality(docs.withColumn("score", F.lit(9)), labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.97
    assert sum(r.predicted for r in held if r.quality) == sum(r.quality for r in held)  # no clean document goes


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 40, 12)).astype(np.int32) for _ in range(80)]
    labels = np.array([float((x < 12).sum() > 3) for x in rows])
    ratio = nbsvm.log_ratio(rows, labels)
    w, b = nbsvm.fit_svm(rows, labels, ratio, rounds=400)
    x = np.zeros((80, 41))
    for k, r in enumerate(rows):
        x[k, r] = nbsvm._unit(ratio[r])
    x[:, 40] = 1
    y = np.where(labels == 1, 1.0, -1.0)
    c = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    primal = lambda v: 0.5 * v @ v + (c * np.maximum(0, 1 - y * (x @ v))).sum()
    found = np.append(w[:40], b)
    v, best = np.zeros(41), np.inf
    for k in range(1, 20001):  # subgradient steps
        v -= (v - x.T @ (c * y * (y * (x @ v) < 1))) / k
        best = min(best, primal(v))
    assert primal(found) <= best * 1.01


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (3, "x " * 5000), (3, "x " * 5000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = nbsvm.score_quality(docs, none).collect()
    assert len(rows) == 5 and {r.score for r in rows} == {0.5}
    both = spark.createDataFrame([(1, "b b"), (1, "a a"), (2, "c")], "doc_id long, text string")
    two = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    scores = [sorted((r.doc_id, r.text, r.score) for r in nbsvm.score_documents(x, nbsvm.train(x, two, F.lit(False))).collect()) for x in (both, both.orderBy("text"), both.orderBy(F.desc("text")))]
    assert scores[0] == scores[1] == scores[2]
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (3, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert len(nbsvm.score_quality(docs, labels).collect()) == 5
    assert nbsvm.score_quality(docs.limit(0), labels).count() == 0
    assert [len(x) for x in nbsvm.features(pa.array(["", None, "a"]))] == [0, 0, 2]
