"""Quality classifier: similarity-weighted votes of the nearest labelled latent-semantic vectors.

A text's terms are hashed byte 3-grams, 4-grams of its shape (upper, lower, digit, space, each sign)
and a count of words that repeat the one before. Weighted by tf-idf they are projected on the leading
singular vectors of the labelled sample. Every document is compared with every labelled vector (exact
cosines, one matrix product a block) and the ``NEIGHBOURS`` nearest vote with similarity ** POWER.

Scale: one scan, no shuffle. Labels are learned from at most ``SAMPLE`` rows (the lowest by hash of
doc_id), so all that is sent to the driver and broadcast is bounded: SAMPLE compressed count vectors of
``TERMS`` 16-bit counts, then TERMS x RANK and SAMPLE x RANK floats. Texts are read whole, ``CHUNK`` bytes at a
time; a block of ``ROWS`` texts is scored at once.

Defined cases: a null or empty text, or one without a similar neighbour, gets the sample's mean
label; with no labelled row every score is 0.5; of several labels of a doc_id the lowest counts; null
labels are ignored; repeated rows get equal scores; held_out is null for a null doc_id.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType

from folioflow.llm.common import small_batches, table

SAMPLE = 4096
GRAMS, SHAPES = 4096, 2048
TERMS = GRAMS + SHAPES + 2
RANK = 64
NEIGHBOURS = 25
POWER = 8
ROWS = 256
CHUNK = 1 << 20
THRESHOLD = 0.3

_CLASS = np.arange(256, dtype=np.uint32)  # a sign stands for itself
for _range, _as in ((range(65, 91), 65), (range(97, 123), 97), (range(48, 58), 48), ((9, 10, 11, 12, 13, 32), 32), (range(128, 256), 128)):
    _CLASS[list(_range)] = _as
_CLASS[10] = 10


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0


def counts(text: bytes | None) -> np.ndarray:
    """The text's counts of all terms."""
    out = np.zeros(TERMS, np.int64)
    data = np.frombuffer(text or b"", np.uint8)
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK + 3].astype(np.uint32)
        grams = (part[:-2] << 16) | (part[1:-1] << 8) | part[2:]
        out[:GRAMS] += np.bincount(((grams * np.uint32(2654435761)) >> np.uint32(20))[:CHUNK], minlength=GRAMS)[:GRAMS]
        shape = _CLASS[part]
        fours = ((shape[:-3] * np.uint32(31) + shape[1:-2]) * np.uint32(31) + shape[2:-1]) * np.uint32(31) + shape[3:]
        out[GRAMS : GRAMS + SHAPES] += np.bincount(((fours * np.uint32(2246822519)) >> np.uint32(21))[:CHUNK], minlength=SHAPES)[:SHAPES]
    words = (text or b"").split()
    again = sum(map(bytes.__eq__, words, words[1:]))
    out[-2:] = again, len(words) - again
    return out


@F.arrow_udf(BinaryType())
def _counted(texts: pa.Array) -> pa.Array:
    return pa.array([packed(counts(t)) for t in texts.cast(pa.binary()).to_pylist()], pa.binary())


def packed(tf: np.ndarray) -> bytes:
    """Counts as they are sent to the driver: 16 bits each, compressed."""
    return zlib.compress(np.minimum(tf, 65535).astype(np.uint16).tobytes(), 1)


def unpacked(sent: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(zlib.decompress(x), np.uint16) for x in sent])


class Model:
    """What the executors need: idf, projection, labelled vectors and labels, all of bounded size.

    Learned from packed counts: they are unpacked ``ROWS`` at a time, so the one large thing that the
    driver holds is the matrix of weights (32 bits for each of SAMPLE x TERMS).
    """

    def __init__(self, sent: list[bytes], labels: np.ndarray):
        n = len(sent)
        self.mean = float(labels.mean()) if n else 0.5
        self.labels = labels.astype(np.float32)
        blocks = [slice(at, at + ROWS) for at in range(0, n, ROWS)]
        df = sum(((unpacked(sent[b]) > 0).sum(axis=0) for b in blocks), np.zeros(TERMS, np.int64))
        self.idf = np.log((1 + n) / (1 + df)).astype(np.float32) + 0.1
        weighted = np.empty((n, TERMS), np.float32)
        for b in blocks:
            weighted[b] = self._weigh(unpacked(sent[b]))
        rank = min(RANK, n, TERMS)
        rng = np.random.default_rng(7)
        basis = rng.standard_normal((TERMS, rank + 16), dtype=np.float32)
        for _ in range(4):  # subspace iteration for the leading right singular vectors
            basis, _r = np.linalg.qr(weighted.T @ (weighted @ basis)) if n else (basis, None)
        self.projection = np.zeros((TERMS, 1), np.float32)
        if n:
            small = weighted @ basis
            _u, _s, right = np.linalg.svd(small, full_matrices=False)
            self.projection = np.ascontiguousarray((basis @ right.T)[:, :rank])
        self.vectors = self._project(weighted)

    def _weigh(self, tf: np.ndarray) -> np.ndarray:
        x = tf.astype(np.float32)
        np.log1p(x, out=x)
        x *= self.idf
        # grams, shapes and the share of repeated words weigh the same, whatever their number
        for part in (slice(0, GRAMS), slice(GRAMS, GRAMS + SHAPES)):
            x[:, part] /= np.maximum(np.linalg.norm(x[:, part], axis=1, keepdims=True), 1e-9)
        words = tf[:, -2:].astype(np.float32)
        x[:, -2:] = words / np.maximum(np.linalg.norm(words, axis=1, keepdims=True), 1)
        return x

    def _project(self, weighted: np.ndarray) -> np.ndarray:
        y = weighted @ self.projection
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        out = np.full(len(texts), self.mean)
        if not len(self.labels):
            return out
        for at in range(0, len(texts), ROWS):
            tf = np.stack([counts(t) for t in texts[at : at + ROWS]])
            near = self._project(self._weigh(tf)) @ self.vectors.T
            k = min(NEIGHBOURS, near.shape[1])
            best = np.argpartition(-near, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(near, best, 1), 0).astype(np.float64) ** POWER
            total = weight.sum(axis=1)
            voted = (weight * self.labels[best]).sum(axis=1) / np.maximum(total, 1e-30)
            used = (total > 1e-12) & (tf.sum(axis=1) > 0)
            out[at : at + ROWS] = np.where(used, np.clip(voted, 0, 1), self.mean)
        return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled rows that are not held out."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("label"))
    chosen = known.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", _counted("text").alias("tf"))
    best = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "tf").limit(sample).toArrow()  # repeated rows don't widen the bound
    return Model(best["tf"].to_pylist(), np.array(best["label"].to_pylist(), np.float64))


def classify(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a column ``out``: the score (0 to 1)."""

    @F.arrow_udf(DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(texts.cast(pa.binary()).to_pylist()), pa.float64())

    small_batches(docs.sparkSession)
    return docs.withColumn(out, score(F.col(text)))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    small_batches(spark)
    scored = classify(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
