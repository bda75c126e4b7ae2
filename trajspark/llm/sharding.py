"""Sharding by a hierarchical weighted hash tree. DataFrame functions only. Law: ``key``.

The tree has regions, racks and shards. At each level a document descends to the child of the least draw
``-ln(u) / weight``, with u hashed from (doc_id, parent, child) and the weight of the child's subtree: first among
the regions, then among that region's racks, then among that rack's shards, 2 + 3 + 4 draws of 24 shards. A changed
weight changes the draws of the nodes above it alone, so documents only move into or out of subtrees whose weights
change; of a heavier shard they come from other racks into its rack and there go where the rack's draws say.

Shards added later (from ``base`` on) stand beside the regions, each a region of its own that competes with its
weight at the first level. So one more shard takes rows only into itself, from 24 to 25 and on, for any number of
added shards: with levels of their own they would take rows from the shard that was added before. A tree is
rebuilt, and rows moved, by choosing a new base.

Slots are numbered without a global sort: rows are ranked within (shard, one of 256 hash buckets), and the
counts of these at most 256 x shards groups give the offsets.

Edge cases: a null id hashes as an empty string, so that all null ids are in one shard, as one key; they are ranked
in buckets by their row's place in the table, which are stored with the rows. A null text has size 8 and the checksum 0 of no bytes. Rows of
one id go to one shard, each with a slot of its own, and rows equal in id and text are ranked in one bucket. Very
long texts only give their size and checksum. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.llm.common import checkpointed, id_and_text, let

SHARDS = 24
SHARDS_PER_RACK = 4
RACKS_PER_REGION = 3
LAW = "key"
HEX_DIGITS = 13  # 52 bits of a draw
BUCKETS = 256


@dataclass(frozen=True)
class Tree:
    """weights[i]: of shard i. The first ``base`` shards (None: all) fill racks in order and racks fill regions."""

    weights: tuple[float, ...]
    base: int | None = None
    shards_per_rack: int = SHARDS_PER_RACK
    racks_per_region: int = RACKS_PER_REGION

    def regions(self) -> list[list[list[int]]]:
        """Regions as lists of racks, racks as lists of shards."""
        n, k, r = len(self.weights) if self.base is None else self.base, self.shards_per_rack, self.racks_per_region
        racks = [list(range(i, min(n, i + k))) for i in range(0, n, k)]
        return [racks[i : i + r] for i in range(0, len(racks), r)]

    def added(self) -> list[int]:
        return [] if self.base is None else list(range(self.base, len(self.weights)))

    def weight(self, shards: list[int]) -> float:
        return sum(self.weights[i] for i in shards)

    def grown(self, *weights: float) -> Tree:
        base = len(self.weights) if self.base is None else self.base
        return Tree((*self.weights, *weights), base, self.shards_per_rack, self.racks_per_region)


def even_tree(shards: int) -> Tree:
    return Tree((1.0,) * shards)


def key_text(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def draw(key: Column, weight: Column) -> Column:
    u = (F.conv(F.substring(F.md5(key), 1, HEX_DIGITS), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << (4 * HEX_DIGITS)))
    return -F.log(u) / weight


def _least(draws: Column) -> Column:
    """Place, from 0, of the least draw; the first of equal ones."""
    return let(draws, lambda d: (F.array_position(d, F.array_min(d)) - 1).cast("int"))


def _among(path: Column, weights: Column) -> Column:
    """The child of least draw under a node: place in its list of weights."""
    return _least(F.transform(weights, lambda w, j: draw(F.concat(path, F.lit("/"), j.cast("string")), w)))


def place(doc_id: Column, tree: Tree) -> Column:
    """The shard at which the descent through region, rack and shard ends."""
    regions, added = tree.regions(), tree.added()
    numbers = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    rack_weights = F.array(*[numbers(tree.weight(rack) for rack in region) for region in regions])
    shard_weights = F.array(*[F.array(*[numbers(tree.weights[i] for i in rack) for rack in region]) for region in regions])
    first = F.array(*[F.array(*[F.lit(rack[0]) for rack in region]) for region in regions])
    path = F.concat(key_text(doc_id), F.lit("/r"))
    tops = [draw(F.concat(path, F.lit(f"/{i}")), F.lit(float(sum(tree.weight(rack) for rack in region)))) for i, region in enumerate(regions)]
    tops += [draw(F.concat(path, F.lit(f"/s{i}")), F.lit(float(tree.weights[i]))) for i in added]

    def down(region: Column, below: Column) -> Column:
        rack = _among(below, F.get(rack_weights, region))
        return let(rack, lambda k: F.get(F.get(first, region), k) + _among(F.concat(below, F.lit("/"), k.cast("string")), F.get(F.get(shard_weights, region), k)))

    def from_top(i: Column) -> Column:
        inside = let(F.concat(path, F.lit("/"), i.cast("string")), lambda below: down(i, below))
        return F.when(i < len(regions), inside).otherwise(i - len(regions) + (added[0] if added else 0))

    return let(_least(F.array(*tops)), from_top)


def slots(rows: DataFrame) -> DataFrame:
    """Adds ``slot``: gapless from 0 within ``shard``, in the order of (hash bucket, doc_id, text_crc32, size)."""
    own = F.when(F.col("doc_id").isNull(), F.concat(F.lit("/"), F.monotonically_increasing_id().cast("string"))).otherwise(F.col("doc_id").cast("string"))
    digest = F.md5(F.concat(own, F.lit("/"), F.col("text_crc32").cast("string"), F.lit("/slot")))
    bucketed = checkpointed(rows.withColumn("bucket", F.substring(digest, 1, 2)))
    counts = bucketed.groupBy("shard", "bucket").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "bucket", before.alias("before"))  # BUCKETS x shards rows at most
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    ranked = bucketed.withColumn("rank", rank)
    return ranked.join(F.broadcast(offsets), ["shard", "bucket"]).withColumn("slot", (F.col("before") + F.col("rank") - 1).cast("long")).drop("bucket", "before", "rank")


def hash_tree_shards(docs: DataFrame, *, tree: Tree | None = None, grown: Tree | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard); grown: the tree of grown_shard, by default one more shard."""
    tree = tree or even_tree(SHARDS)
    grown = grown or tree.grown(1.0)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = id_and_text(docs).select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.lit(LAW).alias("law"),
        place(F.col("doc_id"), tree).cast("int").alias("shard"),
        place(F.col("doc_id"), grown).cast("int").alias("grown_shard"),
    )
    return slots(rows).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


#: The same in SQL, level by level; the checksum by its table over UTF-8 bytes.
ORACLE = r"""
WITH ids AS (
  SELECT DISTINCT doc_id, concat(coalesce(doc_id::VARCHAR, ''), '/r') AS path FROM documents
), regions AS (
  SELECT doc_id, path, child, -ln((('0x' || substr(md5(concat(path, '/', child)), 1, 13))::BIGINT + 0.5e0) / 4503599627370496.0e0) / weight AS draw
  FROM ids, (VALUES ('0', 12.0e0), ('1', 12.0e0), ('s24', 1.0e0)) AS v(child, weight)
), tops AS (
  SELECT doc_id, arg_min(child, draw) FILTER (WHERE child <> 's24') AS region, arg_min(child, draw) = 's24' AS is_new, any_value(path) AS path FROM regions GROUP BY doc_id
), racks AS (
  SELECT doc_id, region, is_new, path, rack, -ln((('0x' || substr(md5(concat(path, '/', region, '/', rack)), 1, 13))::BIGINT + 0.5e0) / 4503599627370496.0e0) / 4.0e0 AS draw
  FROM tops, (SELECT range AS rack FROM range(3))
), in_rack AS (
  SELECT doc_id, region, is_new, any_value(path) AS path, arg_min(rack, draw) AS rack FROM racks GROUP BY ALL
), leaves AS (
  SELECT doc_id, region, is_new, rack, leaf, -ln((('0x' || substr(md5(concat(path, '/', region, '/', rack, '/', leaf)), 1, 13))::BIGINT + 0.5e0) / 4503599627370496.0e0) AS draw
  FROM in_rack, (SELECT range AS leaf FROM range(4))
), placed AS (
  SELECT doc_id, shard, CASE WHEN is_new THEN 24 ELSE shard END::INT AS grown_shard FROM (
    SELECT doc_id, is_new, (region::INT * 12 + rack * 4 + arg_min(leaf, draw))::INT AS shard FROM leaves GROUP BY doc_id, is_new, region, rack)
), crc_table AS (
  SELECT list(list_reduce(list_concat([n], [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]), lambda acc, x: CASE WHEN acc % 2 = 1 THEN xor(acc // 2, 3988292384) ELSE acc // 2 END) ORDER BY n) AS tbl FROM (SELECT range AS n FROM range(256))
), bytes AS (
  SELECT doc_id, text, flatten(list_transform(list_filter(string_split(coalesce(text, ''), ''), lambda c: c <> ''), lambda c: CASE
    WHEN unicode(c) < 128 THEN [unicode(c)]
    WHEN unicode(c) < 2048 THEN [192 + unicode(c) // 64, 128 + unicode(c) % 64]
    WHEN unicode(c) < 65536 THEN [224 + unicode(c) // 4096, 128 + (unicode(c) // 64) % 64, 128 + unicode(c) % 64]
    ELSE [240 + unicode(c) // 262144, 128 + (unicode(c) // 4096) % 64, 128 + (unicode(c) // 64) % 64, 128 + unicode(c) % 64] END))::BIGINT[] AS b
  FROM documents
), sized AS (
  SELECT doc_id, len(b) + 8 AS size, xor(list_reduce(list_concat([4294967295], b), lambda acc, x: xor(acc // 256, tbl[xor(acc % 256, x) + 1])), 4294967295) AS text_crc32 FROM bytes, crc_table
)
SELECT s.doc_id, s.size::BIGINT AS size, s.text_crc32::BIGINT AS text_crc32, 'key' AS law, p.shard,
       row_number() OVER (PARTITION BY p.shard ORDER BY substr(md5(concat(s.doc_id, '/', s.text_crc32, '/slot')), 1, 2), s.doc_id, s.text_crc32, s.size) - 1 AS slot, p.grown_shard
FROM sized s JOIN placed p ON p.doc_id IS NOT DISTINCT FROM s.doc_id
"""
