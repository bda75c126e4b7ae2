"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A text is a histogram of hashed byte trigrams, and of words that equal the word before them: square roots of
relative counts, weighted by inverse document frequency. The singular vectors of the labelled sample's histograms give ``LATENT`` dimensions. Every document is compared with
every labelled vector, in exact blocked cosine products; the ``NEIGHBOURS`` nearest vote, weighted by a power of
their similarity, and the score is the weighted share of label 1.

The sample has at most ``LABELLED`` rows of each label (0 and 1), lowest hashes first, of rows outside the
held-out fold. Each vote is weighted to give back the labels' real shares, so that the bound shifts no score.
Only the sample's vectors are broadcast. Labels, lang, source and doc_id are no inputs of a score.

Edge cases: a null or empty text has no trigram and gets the share of label 1. Without labels every score is
0.5. All labelled vectors that tie with the last neighbour vote too. Rows are scored one by one, also of repeated or
null ids; of a repeated id the text of least hash is in the sample, and a repeated label counts once, 1 before 0; null
labels and ids are none. Very long texts are counted whole. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.llm.common import id_and_text, text_hashes
from trajspark.llm.sampling import fold, histograms, lowest_of_each, text_rows
from trajspark.shipping import ship

FOLDS, HELD_OUT = 5, 0
LABELLED = 1536
BUCKETS = 1024
NGRAMS = (3,)
#: A repeated word counts as so many trigrams.
REPEAT_WEIGHT = 8
LATENT = 64
NEIGHBOURS = 15
SHARPNESS = 8
CUT = 0.3
BLOCK = 512


def as_bytes(texts: pa.Array) -> list[bytes]:
    return [(x or "").encode().replace(b"\0", b" ") for x in texts.to_pylist()]


def features(texts: pa.Array) -> np.ndarray:
    """(texts, BUCKETS + 1): hashed trigrams, and repeated words."""
    data = as_bytes(texts)
    repeats = [REPEAT_WEIGHT * sum(map(eq, ws, ws[1:])) for ws in (x.split() for x in data)]
    return np.column_stack([histograms(data, NGRAMS, BUCKETS, False), np.array(repeats, np.float32)])


def relative(counts: np.ndarray) -> np.ndarray:
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Model:
    def __init__(self, counts: np.ndarray, labels: np.ndarray, share: float) -> None:
        """share: of label 1 among all labelled rows outside the held-out fold."""
        self.share = share
        x = relative(counts)
        self.idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
        vectors = np.linalg.svd(unit(x * self.idf), full_matrices=False)[2] if len(x) else np.zeros((1, BUCKETS + 1))
        self.axes = np.ascontiguousarray(vectors[:LATENT].T, np.float32)
        self.known = self.latent(counts) if len(x) else np.zeros((0, self.axes.shape[1]), np.float32)
        ones = max(1, int(labels.sum()))
        zeros = max(1, len(labels) - int(labels.sum()))
        self.vote = np.where(labels == 1, share / ones, (1 - share) / zeros).astype(np.float64) * len(labels)
        self.label = labels.astype(np.float64)

    def latent(self, counts: np.ndarray) -> np.ndarray:
        return unit(unit(relative(counts) * self.idf) @ self.axes).astype(np.float32)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        out = np.full(len(counts), self.share)
        k = min(NEIGHBOURS, len(self.known))
        if not k:
            return out
        at = np.flatnonzero(counts.sum(axis=1) > 0)
        vectors = self.latent(counts[at])
        for i in range(0, len(at), BLOCK):
            near = vectors[i : i + BLOCK] @ self.known.T
            row, best = np.nonzero(near >= np.partition(near, -k, axis=1)[:, -k, None])
            weight = np.maximum(near[row, best], 1e-6).astype(np.float64) ** SHARPNESS * self.vote[best]
            n = len(near)
            out[at[i : i + n]] = np.bincount(row, weight * self.label[best], n) / np.bincount(row, weight, n)
        return np.clip(out, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share = known.agg(F.avg("quality")).first()[0]
    sample = docs.join(F.broadcast(lowest_of_each(known, "quality", LABELLED)), "doc_id").select("quality", "doc_id", "text", text_hashes(F.col("text"))[0].alias("tie"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_rows(batches, 2):
            counts = features(part.column(2))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array([x.tobytes() for x in counts], pa.binary())], ["quality", "doc_id", "tie", "counts"])

    counted = sample.mapInArrow(run, "quality int, doc_id long, tie long, counts binary")
    rows = sorted(counted.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min_by("counts", "tie").alias("counts")).collect(), key=lambda r: r["doc_id"])
    counts = np.frombuffer(b"".join(r["counts"] for r in rows), np.float32).reshape(-1, BUCKETS + 1)
    return Model(counts, np.array([r["quality"] for r in rows]), 0.5 if share is None else share)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted)"""
    ship(docs.sparkSession)
    docs = id_and_text(docs)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_rows(batches, 1):
            found = model.value.scores(features(part.column(1)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], ["doc_id", "score"])

    scored = docs.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
