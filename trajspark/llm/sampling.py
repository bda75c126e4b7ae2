"""Bounded samples of labelled rows, and histograms of hashed byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.llm.tokens import slices

SALTS = 64


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds))


def lowest_of_each(rows: DataFrame, label: str, most: int) -> DataFrame:
    """About ``most`` rows (doc_id, label) of each label, those of lowest hash: of each of 64 salts the same number.

    A label may hold most rows, so it is dealt over the salts before rows are ranked.
    """
    salted = rows.withColumn("h", F.xxhash64("doc_id")).withColumn("salt", F.pmod(F.col("h"), F.lit(SALTS)))
    rank = F.row_number().over(Window.partitionBy(label, "salt").orderBy("h", "doc_id"))
    return salted.withColumn("rank", rank).filter(F.col("rank") <= -(-most // SALTS)).select("doc_id", label)


def ngram_codes(data: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each byte (the last n - 1 have none)."""
    size = len(data) - n + 1
    code = np.zeros(size, np.uint64)
    for j in range(n):
        code = (code << np.uint64(8)) | data[j : size + j]
    code = (code + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
    return (code >> np.uint64(64 - int(buckets).bit_length() + 1)).astype(np.int64)


def histograms(texts: list[bytes], sizes: tuple[int, ...], buckets: int, words_only: bool) -> np.ndarray:
    """Counts of the hashed n-grams of each text: (texts, buckets).

    words_only: n-grams that have a space inside, between two words, are left out.
    """
    out = np.zeros((len(texts), buckets), np.float32)
    pad = b"\0" * (max(sizes) - 1)
    data = np.frombuffer(pad.join(texts) + pad, np.uint8)
    ends = np.cumsum([len(t) + len(pad) for t in texts]) if texts else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    for n in sizes:
        if len(data) < n:
            continue
        codes = ngram_codes(data, n, buckets)
        whole = data[n - 1 :] != 0
        for j in range(n - 1):
            whole &= data[j : len(codes) + j] != 0
        if words_only:
            for j in range(1, n - 1):
                whole &= data[j : len(codes) + j] != 32
        at = row[: len(codes)][whole] * buckets + codes[whole]
        out += np.bincount(at, minlength=out.size).reshape(out.shape)
    return out


def text_rows(batches: Iterator[pa.RecordBatch], text_column: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, text_column)
