"""Token-id files under Re-Pair grammar compression.

Documents are put in ascending id order (range partitions, sorted within), encoded, and written as shards of
about ``SHARD_TOKENS`` ids. A shard is one row of a Parquet table:

    part, block         place of the shard: ascending (part, block) is ascending doc_id
    n_tokens            ids in the shard
    doc_ids             long[] as little-endian bytes; doc_null: a byte for each, 1 if the id is null
    doc_sizes           long[] ids of each document, its end id included
    rules               uint32[2 r]: the two symbols of each nonterminal
    expansions          uint32[r]: how many ids each nonterminal stands for
    symbols             uint32[]: the compressed ids

Ids are those of the library as it comes: a special token in a text, ``<|endoftext|>``, is its id.
Symbols under ``FIRST_RULE`` are ids. Re-Pair replaces the most frequent pairs of neighbours by nonterminals,
at most ``PAIRS_A_ROUND`` a round, until no pair of neighbours occurs ``MIN_COUNT`` times in the shard. Early rounds
count one pair of each frequent hash bin; the last ones count all pairs of such bins, so that none waits for ever, and after the first
of them only at places where a pair was frequent or has a new symbol: others only become rarer. The expansion lengths
tell where an id of a given place is, so any range of ids is decoded without the rest (``decode_range``).

Edge cases: a null or empty text has the end id alone. Null ids come first. Rows of one id are ordered by a
hash of their text. Repeated rows are written one by one. Extra columns are ignored; an empty table gives no
rows. A long document stays in one shard, which is then longer.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajspark.llm import tokens
from trajspark.llm.common import id_and_text, release_memory, shared_folder
from trajspark.shipping import ship

END_ID = 2
#: Above all ids of the vocabulary.
FIRST_RULE = 1 << 16
SHARD_TOKENS = 2 << 20
PAIRS_A_ROUND = 4096
#: A pair that is rarer than this isn't replaced.
MIN_COUNT = 8
HASH_BITS = 19
#: Of the table that finds a pair among the frequent ones.
INDEX_BITS = 20
#: Bytes of texts that are encoded at a time: each distinct chunk of them is looked up once.
ENCODED_BYTES = 8 << 20
#: Chunks that a worker's encoder remembers.
CACHED_CHUNKS = 1_300_000

SHARD_SCHEMA = "part int, block int, n_tokens long, doc_ids binary, doc_null binary, doc_sizes binary, rules binary, expansions binary, symbols binary"


def _pair_bins(s: np.ndarray) -> np.ndarray:
    h = s[:-1] * np.uint32(0x9E3779B1)
    h ^= s[1:]
    h *= np.uint32(0x85EBCA6B)
    h >>= np.uint32(32 - HASH_BITS)
    return h.astype(np.intp)


def _pairs(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The symbols at each place and after it, as one number."""
    pair = s.take(at).astype(np.uint64)
    pair <<= np.uint64(32)
    pair |= s[1:].take(at)
    return pair


def _apart(at: np.ndarray) -> np.ndarray:
    """Which of rising places are the first, third, fifth ... of their run of neighbours: pairs that don't overlap."""
    place = np.arange(len(at), dtype=np.int32)
    new = np.ones(len(at), bool)
    np.not_equal(at[1:] - at[:-1], 1, out=new[1:])
    start = np.maximum.accumulate(np.where(new, place, 0))
    return ((place - start) & 1) == 0


def _stand_ins(s: np.ndarray, bins: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, places, pair of each place) of the most frequent bins. A bin stands for one of its pairs, the last one seen,
    which is counted exactly; others wait for a later round."""
    least = max(MIN_COUNT, int(np.partition(counts, -PAIRS_A_ROUND)[-PAIRS_A_ROUND]))
    frequent = counts >= least
    at = np.flatnonzero(frequent[bins])
    most = np.flatnonzero(frequent)
    rank = np.zeros(len(counts), np.intp)
    rank[most] = np.arange(len(most))
    own = rank.take(bins.take(at))
    pair = _pairs(s, at)
    stands = np.zeros(len(most), np.uint64)
    stands[own] = pair
    same = np.flatnonzero(stands.take(own) == pair)
    at, own = at.take(same), own.take(same)
    good = np.bincount(own, minlength=len(stands)) >= MIN_COUNT
    if good.all():
        return stands, at, own
    chosen = np.flatnonzero(good.take(own))
    return stands[good], at.take(chosen), (np.cumsum(good) - 1).take(own.take(chosen))


def _index(found: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Where each pair stands in ``found``, which rises; -1: not at all. A table of hashes has it but for found ones that share a place."""
    place = lambda p: ((p * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - INDEX_BITS)).astype(np.intp)
    table = np.zeros(1 << INDEX_BITS, np.int32)
    taken = place(found)
    table[taken] = np.arange(len(found), dtype=np.int32)
    shared = np.zeros(1 << INDEX_BITS, bool)
    shared[taken[table[taken] != np.arange(len(found))]] = True
    at = place(pair)
    own = table[at]
    other = found[own] != pair
    own[other] = -1
    other = np.flatnonzero(other)
    other = other[shared[at[other]]]
    if len(other):
        near = np.searchsorted(found, pair[other]) % len(found)
        own[other] = np.where(found[near] == pair[other], near, -1)
    return own


def _all_counted(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, places, pair of each place, places of all pairs that reach MIN_COUNT); pairs are none only if none reaches it.
    ``at`` has rising places, all of a pair or none, and all of those that reach MIN_COUNT."""
    pair = _pairs(s, at)
    found, n = np.unique(pair, return_counts=True)
    found, n = found[n >= MIN_COUNT], n[n >= MIN_COUNT]
    if not len(found):
        return found, at[:0], at[:0], at[:0]
    own = _index(found, pair)
    at, own = at[own >= 0], own[own >= 0]
    most = np.sort(np.argsort(-n, kind="stable")[:PAIRS_A_ROUND])
    rank = np.full(len(found), -1, np.intp)
    rank[most] = np.arange(len(most))
    chosen = rank[own]
    now = chosen >= 0
    return found[most], at[now], chosen[now], at


def compress(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules as (r, 2), expansion lengths)"""
    s = ids.astype(np.uint32)
    rules = np.zeros((0, 2), np.uint32)
    expansions = np.zeros(0, np.uint32)
    exact = False
    # of the exact rounds: pairs only become rarer, but for those with a new symbol, so other places need no further count
    places: np.ndarray | None = None
    while len(s) > MIN_COUNT:
        if places is None:
            bins = _pair_bins(s)
            counts = np.bincount(bins, minlength=1 << HASH_BITS)
            if counts.max() < MIN_COUNT:
                break
            if exact:
                places = np.flatnonzero((counts >= MIN_COUNT)[bins])
        if exact:
            pairs, at, own, places = _all_counted(s, places)
        else:
            pairs, at, own = _stand_ins(s, bins, counts)
        if not len(pairs):
            if exact:
                break
            exact = True
            continue
        left = np.flatnonzero(_apart(at))
        # neighbours take places from each other: pairs with few left get no rule now, and the most frequent one is sure of its places
        used = np.bincount(own.take(left), minlength=len(pairs)) >= MIN_COUNT // 2
        if not used.any():
            used[np.bincount(own).argmax()] = True
            at, own = at[used[own]], own[used[own]]
            left = np.flatnonzero(_apart(at))
        own = own.take(left)
        left = at.take(left)
        if not used.all():
            kept = np.flatnonzero(used.take(own))
            left, own = left.take(kept), own.take(kept)
        number = (np.cumsum(used) - 1 + len(rules) + FIRST_RULE).astype(np.uint32)
        new = np.stack([pairs[used] >> np.uint64(32), pairs[used] & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
        grown = (symbol_sizes(new[:, 0], expansions) + symbol_sizes(new[:, 1], expansions)).astype(np.uint32)
        s[left] = number.take(own)
        keep = np.ones(len(s), bool)
        keep[left + 1] = False
        if places is not None:
            counted = np.zeros(len(s), bool)
            counted[places] = True
            counted[left] = True
            counted[left[left > 0] - 1] = True
            places = np.flatnonzero(counted[keep][:-1])
        exact = exact or len(left) < len(s) // 100
        s = s[keep]
        rules, expansions = np.concatenate([rules, new]), np.concatenate([expansions, grown])
    return s, rules, expansions


def symbol_sizes(symbols: np.ndarray, expansions: np.ndarray) -> np.ndarray:
    size = np.ones(len(symbols), np.int64)
    rule = symbols >= FIRST_RULE
    size[rule] = expansions[symbols[rule].astype(np.int64) - FIRST_RULE]
    return size


def unfolded(s: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """The ids that symbols stand for, one after the other; as many passes as the rules in them are deep."""
    while (rule := s >= FIRST_RULE).any():
        n = 1 + rule.astype(np.int64)
        ends = np.cumsum(n)
        out = np.empty(int(ends[-1]), np.uint32)
        out[ends - n] = s
        pair = rules[s[rule].astype(np.int64) - FIRST_RULE]
        at = (ends - n)[rule]
        out[at], out[at + 1] = pair[:, 0], pair[:, 1]
        s = out
    return s


def expand(symbols: np.ndarray, rules: np.ndarray, expansions: np.ndarray) -> np.ndarray:
    """The ids of a whole shard: each nonterminal is unfolded once, into a table from which its ids are copied, after all ids."""
    table = unfolded(np.arange(FIRST_RULE + len(rules), dtype=np.uint32), rules)
    sizes = np.concatenate([np.ones(FIRST_RULE, np.int32), expansions.astype(np.int32)])
    kind = np.int64 if len(table) + len(symbols) > 1 << 30 or expansions.sum(dtype=np.int64) > 1 << 30 else np.int32
    sources = (np.cumsum(sizes, dtype=np.int64) - sizes).astype(kind)
    n = sizes[symbols]
    ends = np.cumsum(n, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if kind is np.int32 and total < 1 << 30 else np.int64
    at = np.repeat(sources[symbols].astype(kind) - (ends - n).astype(kind), n)
    at += np.arange(total, dtype=kind)
    return table[at]


def decode_range(symbols: np.ndarray, rules: np.ndarray, expansions: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Ids start .. stop - 1 of a shard; only the rules that the range meets are unfolded."""
    if stop <= start:
        return np.zeros(0, np.uint32)
    ends = np.cumsum(symbol_sizes(symbols, expansions))
    a, z = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
    before = int(ends[a - 1]) if a else 0
    return unfolded(symbols[a:z], rules)[start - before : stop - before]


def ordered(docs: DataFrame) -> DataFrame:
    keyed = id_and_text(docs).withColumn("tie", F.xxhash64("text"))
    return keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")


def write_shards(docs: DataFrame, folder: str, *, tokenizer: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, special_as_text: bool = False) -> None:
    """Writes the shard files of docs to ``folder``."""
    path = tokenizer or tokens.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block = TaskContext.get().partitionId(), 0
        encoder = tokens.encoder(path, CACHED_CHUNKS, special_as_text)
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        held_tokens = 0

        def shard() -> pa.RecordBatch:
            ids = np.concatenate([x[1] for x in held])
            names = [d for x in held for d in x[0]]
            symbols, rules, expansions = compress(ids)
            row = {
                "part": part,
                "block": block,
                "n_tokens": len(ids),
                "doc_ids": np.array([d or 0 for d in names], "<i8").tobytes(),
                "doc_null": np.array([d is None for d in names], np.uint8).tobytes(),
                "doc_sizes": np.concatenate([x[2] for x in held]).astype("<i8").tobytes(),
                "rules": rules.astype("<u4").tobytes(),
                "expansions": expansions.astype("<u4").tobytes(),
                "symbols": symbols.astype("<u4").tobytes(),
            }
            kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds, strict=True)], list(row))

        for batch in batches:
            for encoded in tokens.slices(batch, size=ENCODED_BYTES):
                ids, n = encoder.encode(encoded.column(1))
                ids = np.insert(ids, np.cumsum(n), end_id)
                n += 1
                for piece in tokens.slices(encoded):
                    sizes, n = n[: piece.num_rows], n[piece.num_rows :]
                    own, ids = np.split(ids, [sizes.sum()])
                    held.append((piece.column(0).to_pylist(), own, sizes))
                    held_tokens += len(own)
                    if held_tokens >= shard_tokens:
                        yield shard()
                        held, held_tokens, block = [], 0, block + 1
        if held:
            yield shard()
        held = []
        release_memory()

    ship(docs.sparkSession)
    ordered(docs).mapInArrow(run, SHARD_SCHEMA).write.option("compression", "zstd").parquet(folder)


def read_documents(spark: SparkSession, folder: str, *, with_ids: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32, and the ids if asked for."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(folder)
    columns = ["part", "block", "doc_id", "at", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = expand(np.frombuffer(r["symbols"], "<u4"), np.frombuffer(r["rules"], "<u4").reshape(-1, 2), np.frombuffer(r["expansions"], "<u4")).astype("<u4")
                sizes = np.frombuffer(r["doc_sizes"], "<i8")
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(ids[z - n : z]) for z, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                doc_ids = pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=np.frombuffer(r["doc_null"], np.uint8).astype(bool))
                n = len(sizes)
                arrays = [pa.array(np.full(n, r["part"], np.int32)), pa.array(np.full(n, r["block"], np.int32)), doc_ids, pa.array(ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())]
                if with_ids:
                    arrays.append(pa.array([ids[z - k : z].astype(np.int32) for z, k in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, columns + ["ids"] * with_ids)

    ship(spark)
    found = shards.mapInArrow(run, "part int, block int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    # ids before a shard: within its part, and of the parts before; a row for each part, so that one task can sum them
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.select("part", F.coalesce(F.sum("n").over(ahead(Window.orderBy("part"))), F.lit(0)).alias("parts_before"))
    blocks = shards.select("part", "block", F.coalesce(F.sum("n_tokens").over(ahead(Window.partitionBy("part").orderBy("block"))), F.lit(0)).alias("before"))
    place = blocks.join(parts, "part").select("part", "block", (F.col("before") + F.col("parts_before")).alias("before"))
    return found.join(place, ["part", "block"]).select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_files(docs: DataFrame, *, folder: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Writes docs to shard files and returns what they hold."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write_shards(docs, folder, tokenizer=tokenizer)
    return read_documents(spark, folder)
