"""Operator 4: quality classifier, a support vector machine over Naive Bayes features.

Features are indicators of n-grams: single words, pairs of words, pairs and triples of
one word (whatever word), and 1- to 3-grams
of word shapes (runs of lower case, upper case, digits and each punctuation mark,
squeezed), all hashed into ``2**BITS`` places.  Each indicator is scaled by its
class log-count ratio, vectors get unit length, and a linear hinge-loss model is fit
by dual coordinate descent (Wang and Manning, ACL 2012; Hsieh et al., ICML 2008).  A
logistic curve fit on out-of-fold margins turns margins into scores.

Learning uses at most ``SAMPLE`` labelled documents, those with the least hash of
their id, so the model fits in the driver whatever the corpus; each feature vector
has at most ``2**BITS`` entries.  Scoring reads every text whole, in one scan without
a shuffle.

Edge cases: a null or empty text has no feature and gets the score of the bias;
labels that are null are left out, and of several labels of a document the mean
decides (a tie is 0), of several texts of a labelled document the first in order is learned from; rows repeated in full get the same score; a null doc_id is not
held out and has no label; with no labels, or labels of one class, the score is that
class's share; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from . import textkernel as K
from .batches import pieces
from .common import materialize, read, remainder

BITS = 20
SAMPLE = 6_000
LINE = 0.3
FOLDS = 4

# a byte's place in a word shape
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[128:] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")

# pairs and triples of one word, whatever the word
_ECHO = np.array([0x9D1C5A0F3B7E2468, 0x4F6A8C1E0B2D3975], dtype=np.uint64)


def _shapes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a column after squeezing runs of alike classes within each word."""
    data, offsets = K.buffers(column)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    classes = np.where(K.IS_WORD[data], _SHAPE[data], np.uint8(32))
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = classes[1:] != classes[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    keep[begins] = True
    squeezed = classes[keep]
    ends = np.concatenate(([0], np.cumsum(keep)))[offsets]
    array = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(squeezed.tobytes())])
    return K.words(array, fold=False)


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct places of its n-grams."""
    hashes, at = K.words(column, fold=False)
    shapes, shape_at = _shapes(column)
    pairs = K.window_hashes(hashes, 2)
    same = hashes[1:] == hashes[:-1]
    echo = same[1:] & same[:-1]
    grams = [(shapes, 1), (K.window_hashes(shapes, 2), 2), (K.window_hashes(shapes, 3), 3)]
    shift = np.uint64(64 - BITS)
    for lo, hi, slo, shi in zip(at[:-1].tolist(), at[1:].tolist(), shape_at[:-1].tolist(), shape_at[1:].tolist(), strict=True):
        found = [_ECHO[[same[lo : max(lo, hi - 1)].any(), echo[lo : max(lo, hi - 2)].any()]]]
        found += [hashes[lo:hi] ^ np.uint64(0x11), pairs[lo : max(lo, hi - 1)] ^ np.uint64(0x22)]
        found += [K.distinct(g[slo : max(slo, shi - n + 1)]) ^ np.uint64(0x33 * (n + 1)) for g, n in grams]
        yield K.distinct((np.concatenate(found) * np.uint64(0x9E3779B97F4A7C15) >> shift).astype(np.int32))


def log_ratio(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    counts = np.ones((2, 1 << BITS))
    for x, y in zip(rows, labels, strict=True):
        counts[int(y)][x] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[1] / counts[0])


def fit_svm(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, c: float = 1.0, rounds: int = 30, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1 hinge loss; the bias is one more feature.  Classes weigh the same in total."""
    rng = np.random.default_rng(seed)
    scaled = [_unit(ratio[x]) for x in rows]
    y = np.where(labels == 1, 1.0, -1.0)
    share = max(labels.mean(), 1 / len(labels)), max(1 - labels.mean(), 1 / len(labels))
    bound = np.where(labels == 1, c * 0.5 / share[0], c * 0.5 / share[1])
    w, b, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    norms = np.array([v @ v for v in scaled]) + 1.0
    for _ in range(rounds):
        moved = 0.0
        for k in rng.permutation(len(rows)):
            x, v = rows[k], scaled[k]
            slope = y[k] * (w[x] @ v + b) - 1
            new = min(max(alpha[k] - slope / norms[k], 0.0), bound[k])
            step = (new - alpha[k]) * y[k]
            if step:
                alpha[k] = new
                w[x] += step * v
                b += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, b


def _unit(v: np.ndarray) -> np.ndarray:
    length = np.sqrt(v @ v)
    return v / length if length else v


def margin(x: np.ndarray, w: np.ndarray, b: float, ratio: np.ndarray) -> float:
    return float(w[x] @ _unit(ratio[x]) + b)


def fit_logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(1) by Newton steps, with Platt's smoothed targets."""
    n1, n0 = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones(len(margins))], 1)
    t = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        gradient = x.T @ (p - target)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        size = np.abs(step).max()
        t -= step * min(1.0, 4.0 / size) if size else step
        if size < 1e-8:
            break
    return float(t[0]), float(t[1])


class Model:
    """Weights with the ratio folded in; score() of a feature vector."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray):
        self.constant = None
        if len(rows) < 2 or labels.min() == labels.max():
            self.constant = float(labels.mean()) if len(rows) else 0.5
            return
        fold = np.arange(len(rows)) % FOLDS
        out = np.zeros(len(rows))
        for k in range(FOLDS):
            inside = np.flatnonzero(fold != k)
            part = [rows[i] for i in inside]
            if labels[inside].min() == labels[inside].max():
                continue
            ratio = log_ratio(part, labels[inside])
            w, b = fit_svm(part, labels[inside], ratio)
            for i in np.flatnonzero(fold == k):
                out[i] = margin(rows[i], w, b, ratio)
        self.slope, self.offset = fit_logistic(out, labels)
        ratio = log_ratio(rows, labels)
        w, self.bias = fit_svm(rows, labels, ratio)
        self.top, self.square = (w * ratio).astype(np.float32), (ratio * ratio).astype(np.float32)

    def score(self, x: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        length = float(self.square[x].sum(dtype=np.float64))
        m = float(self.top[x].sum(dtype=np.float64)) / np.sqrt(length) + self.bias if length else self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * m + self.offset, -30, 30))))


def train(docs: DataFrame, labels: DataFrame, held_out: Column, sample: int = SAMPLE, label: str = "quality") -> Model:
    """Fits the model on at most ``sample`` labelled documents that are not held out."""
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out)
    chosen = chosen.groupBy("doc_id").agg((F.avg(label) > 0.5).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = materialize(chosen)
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int64()), ("x", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, 2):
            rows = pa.array([x.tobytes() for x in features(piece.column(2))], pa.binary())
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1).cast(pa.int64()), rows], schema=schema)

    # at most ``sample`` ids, so they are broadcast and no other text leaves the JVM
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(chosen.select(F.col("doc_id").cast("long"), "y")), "doc_id").select("doc_id", "y", "text")
    least = texts.groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # of several texts of a document the first in order
    got = least.mapInArrow(run, "doc_id long, y long, x binary").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    return Model([np.frombuffer(r[2], np.int32) for r in got], np.array([r[1] for r in got], np.float64))


def score_documents(docs: DataFrame, model: Model, text: str = "text", line: float = LINE) -> DataFrame:
    """docs with two more columns, score and predicted (which replace any of these names); every text is read whole."""
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    names = [*docs.columns, "score", "predicted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, at):
            scores = np.array([shared.value.score(x) for x in features(piece.column(at))])
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(scores), pa.array((scores >= line).astype(np.int32))], names)

    schema = StructType([*docs.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return docs.mapInArrow(run, schema)


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    model = train(docs, labels, held_out, sample)
    rows = docs.select(F.col("doc_id"), held_out.alias("held_out"), "text")
    return score_documents(rows, model).drop("text")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
