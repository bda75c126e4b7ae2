"""Language ID: averaged hashed subword embeddings under a linear softmax, trained in numpy, with calibrated rejection.

Subwords are the 2-, 3- and 4-byte pieces of words, with the space before and after, hashed into ``BUCKETS``
buckets. A text is the mean of its subwords' embeddings; a softmax of a linear layer gives the languages'
probabilities. Embeddings and layer are trained together by stochastic gradient descent on a sample of at most
about ``SAMPLE`` documents of each language, lowest hashes first, of rows outside the held-out fold. A tenth of
the sample sets the temperature of the softmax and the score under which a prediction is rejected: the
``REJECTED`` quantile of right answers.

Once trained, the embedding of a bucket times the layer is one row of numbers for each language; a text's
logits are the mean of its buckets' rows, so whole texts of any length cost one pass.

Edge cases: a null text, and one without a letter, is ``und`` with score 0. A text whose words are all under two
bytes still has subwords, by its spaces. Without a training row all are ``und``. Of equal probabilities the language of
least name wins. Rows are predicted one by one, also of repeated or null ids; of a repeated id the row of least language
and text hash is in the sample, null ids are not. Very long texts are counted whole. Extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.llm.common import id_and_text, text_hashes
from trajspark.llm.sampling import fold, histograms, lowest_of_each, text_rows
from trajspark.shipping import ship

FOLDS, HELD_OUT = 3, 1
SAMPLE = 512
BUCKETS = 2048
NGRAMS = (2, 3, 4)
DIMENSIONS = 16
EPOCHS = 40
RATE = 4.0
BATCH = 32
REJECTED = 0.005
UNKNOWN = "und"
#: ASCII letters in lower case; other ASCII is a gap between words; bytes of longer characters stay.
LETTERS = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i > 127 else 32 for i in range(256))


def as_words(texts: pa.Array) -> list[bytes]:
    """Words in lower case, one space before, between and after them."""
    return [b" " + b" ".join((x or "").lower().encode().translate(LETTERS).split()) + b" " for x in texts.to_pylist()]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def mean_rows(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


class Model:
    def __init__(self, counts: np.ndarray, langs: list[str]) -> None:
        self.names = sorted(set(langs))
        y = np.searchsorted(self.names, langs) if langs else np.zeros(0, np.int64)
        x = mean_rows(counts).astype(np.float32)
        held = np.arange(len(x)) % 10 == 9
        self.rows, self.bias = self._train(x[~held], y[~held])
        self.temperature, self.least = self._calibrate(x[held], y[held])

    def _train(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embeddings times layer (buckets, languages), and the bias."""
        rng = np.random.default_rng(0)
        k = max(1, len(self.names))
        embed = rng.normal(0, 0.5, (BUCKETS, DIMENSIONS)).astype(np.float32)
        layer, bias = np.zeros((DIMENSIONS, k), np.float32), np.zeros(k, np.float32)
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            order = rng.permutation(len(x))
            for i in range(0, len(order), BATCH):
                own = order[i : i + BATCH]
                h = x[own] @ embed
                g = softmax(h @ layer + bias)
                g[np.arange(len(own)), y[own]] -= 1
                g /= len(own)
                back = g @ layer.T
                layer -= rate * (h.T @ g)
                bias -= rate * g.sum(axis=0)
                embed -= rate * 16 * (x[own].T @ back)
        return (embed @ layer).astype(np.float32), bias

    def _calibrate(self, x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        if not len(x):
            return 1.0, 0.0
        z = x @ self.rows + self.bias
        loss = lambda t: -np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()
        t = min((0.25, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss)
        p = softmax(z / t)
        right = p.max(axis=1)[p.argmax(axis=1) == y]
        return t, float(np.quantile(right, REJECTED)) if len(right) else 0.0

    def predict(self, counts: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.names:
            return [UNKNOWN] * len(counts), np.zeros(len(counts))
        p = softmax((mean_rows(counts) @ self.rows + self.bias) / self.temperature)
        return [self.names[i] for i in p.argmax(axis=1)], p.max(axis=1).astype(np.float64)


def fit(docs: DataFrame) -> Model:
    """docs(doc_id, text, lang)"""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT)).select("doc_id", "lang")
    ids = lowest_of_each(known, "lang", SAMPLE).select(F.col("doc_id").alias("doc_id")).dropna().distinct()
    sample = docs.filter(F.col("lang").isNotNull()).join(F.broadcast(ids), "doc_id", "left_semi").select("lang", "doc_id", "text", text_hashes(F.col("text"))[0].alias("tie"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_rows(batches, 2):
            counts = histograms(as_words(part.column(2)), NGRAMS, BUCKETS, True)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array([x.tobytes() for x in counts], pa.binary())], ["lang", "doc_id", "tie", "counts"])

    counted = sample.mapInArrow(run, "lang string, doc_id long, tie long, counts binary")
    rows = sorted(counted.groupBy("doc_id").agg(F.min("lang").alias("lang"), F.min_by("counts", F.struct("lang", "tie")).alias("counts")).collect(), key=lambda r: r["doc_id"])
    counts = np.frombuffer(b"".join(r["counts"] for r in rows), np.float32).reshape(-1, BUCKETS)
    return Model(counts, [r["lang"] for r in rows])


def detect_language(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected)"""
    ship(docs.sparkSession)
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for part in text_rows(batches, 1):
            names, scores = m.predict(histograms(as_words(part.column(1)), NGRAMS, BUCKETS, True))
            letters = pc.fill_null(pc.match_substring_regex(part.column(1), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            scores = np.where(letters, scores, 0.0)
            names = [x if there else UNKNOWN for x, there in zip(names, letters, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores), pa.array(scores < m.least)], ["doc_id", "lang_pred", "score", "rejected"])

    found = id_and_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
    return found.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score", "rejected")
