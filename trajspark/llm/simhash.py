"""SimHash near-duplicates by anchor-point covering.

Fingerprints: each bit is set if over half of the XXH64 hashes (seed 42) of a text's 3-word shingles have it.

Links: fingerprints at ``MAX_BITS`` = 2 or fewer differing bits. Anchors are the codewords of the product of three
perfect codes: binary Golay codes [23, 12] of radius 3 over bits 0-22 and 23-45, and a Hamming code [15, 11] of
radius 1 over bits 46-60. Each part of a fingerprint has one codeword within its code's radius: together its home.
A link has e1 + e2 + e3 <= 2 errors in the parts, so the linked fingerprint lies within radius + e of each of
that home's codewords. Each distinct fingerprint is sent to all anchors whose distances exceed the radii by 2 or
less in sum, about 153 of 2^35, and is compared there with those whose home it is. Every linked pair meets,
whatever the other 3 bits are, and exactly once in each direction. Pairs that meet by chance are
153 n^2 / 2^35 of n fingerprints: 45 million at 10^8, 4.5 billion at 10^9.

Only distinct fingerprints are compared; equal ones share a row. Links become components by large and small
stars. Nothing is collected to the driver.

Edge cases: null and empty texts and texts without words have the fingerprint zero, which links like any
other. A null id keeps its row; a component's id is its least id that is not null. Very long texts are read in
segments. Repeated rows each return a row. Extra columns are ignored, ``keep_one_of_each`` keeps them, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.llm.common import checkpointed, fresh, id_and_text, release_memory
from trajspark.llm.components import star_components
from trajspark.shipping import ship

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 2
#: Bytes of a text that are split into words at a time.
SEGMENT_BYTES = 1 << 20


class Code(NamedTuple):
    """A perfect binary code over ``length`` bits from ``shift`` on: each word has one codeword within ``radius``."""

    shift: int
    length: int
    radius: int
    check_bits: int
    polynomial: int


# Lengths, radii and generator polynomials of the Golay and Hamming codes.
CODES = (Code(0, 23, 3, 11, 0b101011100011), Code(23, 23, 3, 11, 0b101011100011), Code(46, 15, 1, 4, 0b10011))

BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
LANES = np.arange(8) * 256


def word_segments(data: bytes) -> Iterator[list[bytes]]:
    """Lists of words, of about SEGMENT_BYTES each; bytes.split() and .lower() know ASCII only."""
    at = 0
    while at < len(data):
        end = min(len(data), at + SEGMENT_BYTES)
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        yield data[at:end].lower().split()
        at = end


def shingle_hashes(data: bytes) -> Iterator[np.ndarray]:
    kept: list[bytes] = []
    short = True
    digest = xxhash.xxh64_intdigest
    for part in word_segments(data):
        ws = kept + part
        if len(ws) >= SHINGLE_WORDS:
            short = False
            ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
            starts = np.concatenate([[0], ends[: -SHINGLE_WORDS] + 1])
            line = b" ".join(ws)
            n = len(ws) - SHINGLE_WORDS + 1
            yield np.fromiter((digest(line[i:j], SEED) for i, j in zip(starts.tolist(), ends[SHINGLE_WORDS - 1 :].tolist(), strict=True)), np.uint64, n)
        kept = ws[-(SHINGLE_WORDS - 1) :]
    if short and kept:
        yield np.array([digest(b" ".join(kept), SEED)], np.uint64)


def fingerprint(text: str | None) -> int:
    """64 bits as a signed long."""
    counts, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes((text or "").encode("utf-8", "replace")):
        lanes = np.bincount((h.astype("<u8").view(np.uint8).reshape(-1, 8) + LANES).ravel(), minlength=2048).reshape(8, 256)
        counts += (lanes @ BYTE_BITS).ravel()
        n += len(h)
    bits = (2 * counts > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, same, fp); same: hash of the text, which tells rows of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((fingerprint(x.as_py()) for x in b.column(2)), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found)], ["doc_id", "same", "fp"])
        release_memory()

    ship(docs.sparkSession)
    slim = id_and_text(docs).select("doc_id", F.xxhash64("text").alias("same"), "text")
    return slim.mapInArrow(run, "doc_id long, same long, fp long")


def syndrome(x: np.ndarray, code: Code) -> np.ndarray:
    """Remainder of a word by the generator polynomial: check_bits bits."""
    x = x.copy()
    for i in range(code.length - 1, code.check_bits - 1, -1):
        x = np.where((x >> i) & 1, x ^ (code.polynomial << (i - code.check_bits)), x)
    return x


@cache
def coset_patterns(code: Code) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For 0, 1, 2 errors over the radius: (patterns of that weight sorted by syndrome, first of each syndrome, count).

    The first entry has all weights up to the radius: the code is perfect, so each syndrome has one.
    """
    out = []
    for weights in (tuple(range(code.radius + 1)), *((code.radius + e,) for e in range(1, MAX_BITS + 1))):
        found = np.array([sum(1 << i for i in c) for w in weights for c in combinations(range(code.length), w)], np.int64)
        s = syndrome(found, code)
        order = np.argsort(s, kind="stable")
        count = np.bincount(s, minlength=1 << code.check_bits)
        out.append((found[order], np.concatenate([[0], np.cumsum(count)[:-1]]), count))
    return out


def _anchors_of_part(x: np.ndarray, code: Code, over: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword) for the codewords that are ``over`` errors beyond the radius away from x."""
    found, first, count = coset_patterns(code)[over]
    s = syndrome(x, code)
    n = count[s]
    rows = np.repeat(np.arange(len(x)), n)
    within = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
    return rows, x[rows] ^ found[np.repeat(first[s], n) + within]


def _part(fp: np.ndarray, code: Code) -> np.ndarray:
    return (fp >> code.shift) & ((1 << code.length) - 1)


def home_anchor(fp: np.ndarray) -> np.ndarray:
    return sum(_anchors_of_part(_part(fp, code), code, 0)[1] << code.shift for code in CODES)


def all_anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fp, anchor) for all anchors that a fingerprint is sent to."""
    fps, anchors = [], []
    for errors in product(range(MAX_BITS + 1), repeat=len(CODES)):
        if sum(errors) > MAX_BITS:
            continue
        rows, anchor = np.arange(len(fp)), np.zeros(len(fp), np.int64)
        for code, over in zip(CODES, errors, strict=True):
            own, word = _anchors_of_part(_part(fp[rows], code), code, over)
            rows, anchor = rows[own], anchor[own] | (word << code.shift)
        fps.append(fp[rows])
        anchors.append(anchor)
    return np.concatenate(fps), np.concatenate(anchors)


def links(distinct: DataFrame) -> DataFrame:
    """distinct(fp) -> (u, v): pairs of different fingerprints at MAX_BITS or fewer differing bits."""

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(home_anchor(fp)), b.column(0)], ["anchor", "u"])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy()
            for at in range(0, len(fp), 2000):
                v, anchor = all_anchors(fp[at : at + 2000])
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(v)], ["anchor", "v"])

    ship(distinct.sparkSession)
    # a fingerprint is a few bytes and its visits 2.4 KB: dealt over as many tasks as a shuffle has, not by its own size
    dealt = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    at_home = distinct.mapInArrow(homes, "anchor long, u long")
    visiting = dealt.mapInArrow(visits, "anchor long, v long")
    near = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS)
    # merged, never broadcast: plans take the visits for as small as the fingerprints that they are made of
    return visiting.join(at_home.hint("merge"), "anchor").filter(near).select("u", "v")


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, same, fp, component, component_id): component is the least fingerprint of the group, component_id its least id."""
    marked = checkpointed(fingerprints(docs))
    classes = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = star_components(links(classes.select("fp")))
    linked = classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    # a row for each fingerprint, below for each document: merged, never broadcast, so that no process holds them all
    return marked.join(linked.select("fp", "component").join(least, "component").hint("merge"), "fp")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id)"""
    return grouped(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """All columns of docs; of each component the document with the least id stays. Of several texts of that id the one
    of least hash stays, and of rows equal in id and text the one whose other columns have the least hash."""
    own = grouped(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept_id, kept_same, same = fresh(docs, "kept_id", "kept_same", "same")
    kept = own.groupBy("component").agg(F.min(F.struct("doc_id", "same")).alias("k")).select("k.doc_id", "k.same").distinct().toDF(kept_id, kept_same)
    marked = docs.withColumn(same, F.xxhash64(F.col("text").cast("string")))
    here = F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)) & (F.col(same) == F.col(kept_same))
    left = marked.join(kept.hint("merge"), here, "left_semi")
    columns = [f"`{c}`" for c in docs.columns]
    others = [c for c in columns if c.lower() not in ("`doc_id`", "`text`")]
    order = F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0)
    row, key = fresh(docs, "row", "key")
    one = left.groupBy(F.col("doc_id").cast("long").alias(key), same).agg(F.min_by(F.struct(*columns), order).alias(row))
    return one.select(*[F.col(f"{row}.{c}") for c in columns])
