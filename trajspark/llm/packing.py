"""Best-fit packing of token sequences by exact-complement hashing.

Documents become pieces of at most ``CAPACITY`` ids. Only the histogram of piece lengths, CAPACITY numbers at
most, comes to the driver. The plan is made on it, from the longest length down:

* the gap that a length leaves is filled exactly by one, two or three available lengths, found in a hash of
  pair sums, as often as the available counts allow;
* what is left is packed best-fit decreasing, over groups of equal bins; if it does not reach the least possible
  number of bins, a few of the last exact fills are taken back into it.

A plan is a list of patterns (lengths, how often, first sequence). Each piece finds its sequence by its length
and its rank among the pieces of that length. Ranks are dealt over 64 hash buckets of each length, so that one
very common length is not ranked in one task.

Ids are those of the library as it comes: a special token in a text, ``<|endoftext|>``, is its id
(``special_as_text``: the ids of its characters).

Edge cases: a null or empty text has the end id alone. A very long text is cut into pieces, nothing of it is lost.
Repeated rows are packed one by one. Ties among equal
lengths go by bucket, id and piece. Null ids are kept. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajspark.llm import tokens
from trajspark.llm.common import checkpointed, id_and_text, release_memory
from trajspark.shipping import ship

CAPACITY = 2048
END_ID = 0
RANK_BUCKETS = 64
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

Pattern = tuple[tuple[int, ...], int]


def cut_bounds(n: int, capacity: int = CAPACITY) -> list[int]:
    """Starts of the pieces of n ids: full ones, after a shorter first one if they don't fit exactly."""
    return [0, *range(n % capacity or capacity, n, capacity)]


def pieces(docs: DataFrame, *, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, special_as_text: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and the ids themselves if asked for."""
    path = tokenizer or tokens.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path, special_as_text=special_as_text)
        for batch in batches:
            for part in tokens.slices(batch):
                ids, n = encoder.encode(part.column(1))
                data = np.insert(ids, np.cumsum(n), end_id).astype("<u4")
                n = n + 1
                rows: list[tuple] = []
                for doc, z, size in zip(part.column(0).to_pylist(), np.cumsum(n).tolist(), n.tolist(), strict=True):
                    starts = cut_bounds(size, capacity)
                    for k, (a, b) in enumerate(zip(starts, [*starts[1:], size], strict=True)):
                        own = data[z - size + a : z - size + b]
                        rows.append((doc, k, a, b - a, zlib.crc32(own), own))
                if rows:
                    columns = list(zip(*rows, strict=True))
                    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                    arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=False)]
                    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                    if with_ids:
                        arrays.append(pa.array([x.astype(np.int32) for x in columns[5]], pa.list_(pa.int32())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(arrays, names)
        release_memory()

    ship(docs.sparkSession)
    return id_and_text(docs).mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


class PairSums:
    """Hash of pair sums: for each sum the pairs of available lengths, longest first; used-up ones are passed over."""

    def __init__(self, left: list[int]) -> None:
        self.left = left
        self.lengths = [i for i, n in enumerate(left) if n]
        self.at: dict[int, int] = defaultdict(int)

    def pair(self, total: int, taken: tuple[int, ...] = ()) -> tuple[int, int] | None:
        """The pair of that sum with the longest available length, beside the lengths that are taken already."""
        key = self.at[total]
        longest = min(total - 1, len(self.left) - 1)
        a = longest - key
        while 2 * a >= total:
            b = total - a
            if not self.left[a] or not self.left[b] or (a == b and self.left[a] < 2):
                # lengths only get fewer, so a pair that is used up stays so
                if self.at[total] == longest - a:
                    self.at[total] += 1
            elif fits(self.left, (*taken, a, b)):
                return a, b
            a -= 1
        return None


def fits(left: list[int], lengths: tuple[int, ...]) -> bool:
    return all(left[x] >= lengths.count(x) for x in set(lengths))


def take(left: list[int], lengths: tuple[int, ...], out: list[Pattern]) -> None:
    """As many bins of these lengths as the counts allow."""
    times = min(left[x] // lengths.count(x) for x in set(lengths))
    if times:
        for x in lengths:
            left[x] -= times
        out.append((lengths, times))


def exact_fills(left: list[int], capacity: int) -> list[Pattern]:
    out: list[Pattern] = []
    if left[capacity]:
        take(left, (capacity,), out)
    sums = PairSums(left)
    for size in range(capacity - 1, 0, -1):
        gap = capacity - size
        if left[size]:
            take(left, (size, gap), out)
        while left[size] and (found := sums.pair(gap, (size,))):
            take(left, (size, *found), out)
        for a in range(min(gap - 2, size), 0, -1):
            if not left[size]:
                break
            while left[a] and left[size] and fits(left, (size, a)) and (found := sums.pair(gap - a, (size, a))):
                take(left, (size, a, *found), out)
    return out


def best_fit(left: list[int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over groups of equal bins; left is used up."""
    groups: dict[int, list[Pattern]] = defaultdict(list)  # by gap
    for size in range(capacity, 0, -1):
        gap = size
        while left[size] and gap < capacity:
            while left[size] and groups[gap]:
                lengths, times = groups[gap].pop()
                used = min(times, left[size])
                if used < times:
                    groups[gap].append((lengths, times - used))
                groups[gap - size].append(((*lengths, size), used))
                left[size] -= used
            gap += 1
        fill = capacity // size
        if left[size] >= fill:
            groups[capacity - fill * size].append(((size,) * fill, left[size] // fill))
        if rest := left[size] % fill:
            groups[capacity - rest * size].append(((size,) * rest, 1))
        left[size] = 0
    return [p for group in groups.values() for p in group]


def bins(plan: list[Pattern]) -> int:
    return sum(times for _, times in plan)


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Exact fills, then best fit of the rest. Where the rest packs badly, the last exact fills, which are those of the
    shortest lengths, are taken back and join it: 1, 2, 4, ... of them, the fewest that give the fewest bins."""
    left = [counts.get(i, 0) for i in range(capacity + 1)]
    bound = -(-sum(i * n for i, n in enumerate(left)) // capacity)
    exact = exact_fills(left, capacity)
    best: list[Pattern] | None = None
    back = 0
    while True:
        kept = exact[: len(exact) - back]
        rest = list(left)
        for lengths, times in exact[len(kept) :]:
            for x in lengths:
                rest[x] += times
        plan = kept + best_fit(rest, capacity)
        if best is None or bins(plan) < bins(best):
            best = plan
        if bins(best) == bound or back == len(exact):
            return best
        back = min(len(exact), max(1, 2 * back))


def plan_rows(plan: list[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, sequence of the first, offset in the sequence)"""
    rank: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for lengths, times in plan:
        offset = 0
        for x in lengths:
            rows.append((x, rank[x], rank[x] + times, sequence, offset))
            rank[x] += times
            offset += x
        sequence += times
    return rows


def ranked(found: DataFrame) -> DataFrame:
    """Adds ``rank``, gapless from 0 among the pieces of each length."""
    dealt = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANK_BUCKETS)).cast("int"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    sizes = dealt.groupBy("length", "bucket").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("length", "bucket", before.alias("before"))  # CAPACITY x RANK_BUCKETS rows at most
    return dealt.withColumn("own", own).join(F.broadcast(offsets), ["length", "bucket"]).withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "bucket")


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces; they are read three times, so they should be a stored table."""
    spark = found.sparkSession
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}
    rows = plan_rows(packing_plan(counts, capacity))
    plan = spark.createDataFrame(rows, "length long, lo long, hi long, base long, offset long")
    placed = ranked(found).join(F.broadcast(plan), "length").filter((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.withColumn("sequence_id", F.col("base") + F.col("rank") - F.col("lo")).drop("rank", "lo", "hi", "base")


def best_fit_packing(docs: DataFrame, *, tokenizer: str | None = None, capacity: int = CAPACITY, special_as_text: bool = False) -> DataFrame:
    found = checkpointed(pieces(docs, tokenizer=tokenizer, capacity=capacity, special_as_text=special_as_text))
    return pack(found, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
