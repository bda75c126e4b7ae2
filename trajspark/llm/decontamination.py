"""Benchmark decontamination by template windows with typed slots.

Texts become words without edge punctuation, in lower case. A template has placeholders for numbers, for
quantities (a number with letters, ``5km``), for units after a number and for names: words of the form
``Name`` that don't begin a sentence or a line. Two templates are made of each text, with and without name
slots, so that a lower-cased copy still meets its item.

1. Every ``WINDOW``-word window of every benchmark item is hashed with its slots' values (items of 5 words at
   least; a window needs ``MIN_LITERALS`` words outside slots).
2. Windows of documents pass a bit table of fixed size that has a bit for each benchmark hash, whatever the
   benchmark's size, and are then hash-joined with the benchmark's windows.
3. Matches of a document with an item are grouped by alignment (place in the document minus place in the item).
   Slots must be consistent there: one value of the item always becomes the same value of the document. That
   keeps a re-parameterised question and drops chance matches of slots. Windows with a value that becomes several
   are dropped, but not those whose values all equal the item's.
4. A document is contaminated by an item if consistent windows cover ``MIN_COVERAGE`` of the item's windows.

Items without a window (under 5 words, or nearly all slots) are found, if ``whole``, only word for word: all their
words, literal and numbers alike, are compared in one window of their size, or in all 5-word windows at one
alignment. The query and the pipeline do so; a word alone is then an item that every text with it holds.

Items with the same template and the same slot values count as one, the one of the least id (null ids last).

A document, and an item, is a row: its id and a hash of its text. So rows of one id with different texts are judged
each by itself, and null ids are like any other.

Edge cases: null and empty texts match nothing, nor, without ``whole``, do items that have no window. The report has
a row for each document and item by that key: several with one (doc_id, item_id) if ids repeat over different texts,
one if rows are equal. Null ids, of documents and items, are kept in the report. ``drop_contaminated`` drops exactly
the rows whose own text holds an item, and keeps all columns, whatever their names; ``contaminated`` ignores extra
columns. Very long texts are read in slices of rows, never cut. An empty table, or an empty benchmark, gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajspark.llm.common import checkpointed, fresh, release_memory, text_hashes
from trajspark.llm.tokens import slices
from trajspark.shipping import ship

WINDOW = 5
MIN_LITERALS = 2
MIN_COVERAGE = 0.35
TABLE_BITS = 22
CACHED_WORDS = 300_000

# Unit words.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t ton tons tonne tonnes oz lb lbs pound pounds "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks "
    "month months year years hz khz mhz ghz b kb mb gb tb w kw mw v kv a ma j kj cal kcal pa kpa bar psi mph kmh kph k c f "
    "percent dollar dollars euro euros cent cents degree degrees".split()
)

LITERAL, NUMBER, QUANTITY, UNIT, NAME, NEWLINE, NOTHING = range(7)
NUMBER_FORM = re.compile(r"\d+(?:[.,:/]\d+)*")
QUANTITY_FORM = re.compile(r"\d+(?:[.,:/]\d+)*[^\W\d_]+")
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
SENTENCE_END = re.compile(r"[.!?:;][\W_]*$")
SLOT_CODE = np.array([0, *(xxhash.xxh64_intdigest(f"<slot {k}>") for k in (NUMBER, QUANTITY, UNIT, NAME))], np.uint64)
POWERS = np.array([pow(0x9E3779B97F4A7C15, j, 1 << 64) for j in range(WINDOW)], np.uint64)

#: For the hashes of windows whose words are all literal.
EXACT_CODE = np.uint64(xxhash.xxh64_intdigest("<exact>"))

WINDOWS = "id long, same long, at long, hash long, slots array<string>"


class Vocabulary:
    """What is known of each distinct word: its kind, the hash of its bare form, whether it ends a sentence."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.bare: list[str] = []
        self.kind = np.zeros(1 << 12, np.int8)
        self.code = np.zeros(1 << 12, np.uint64)
        self.ends = np.zeros(1 << 12, bool)

    def numbers(self, words: list[str]) -> np.ndarray:
        if len(self.at) + len(words) > CACHED_WORDS and self.at:
            self.__init__()
        for w in words:
            if w not in self.at:
                self._add(w)
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))

    def _add(self, word: str) -> None:
        n = len(self.bare)
        if n == len(self.kind):
            for name in ("kind", "code", "ends"):
                a = getattr(self, name)
                setattr(self, name, np.concatenate([a, np.zeros(len(a), a.dtype)]))
        bare = word.lower() if word.isalnum() else EDGE.sub("", word).lower()
        if word == "\n":
            kind = NEWLINE
        elif not bare:
            kind = NOTHING
        elif bare[0].isdigit() and NUMBER_FORM.fullmatch(bare):
            kind = NUMBER
        elif bare[0].isdigit() and QUANTITY_FORM.fullmatch(bare):
            kind = QUANTITY
        elif bare in UNITS:
            kind = UNIT
        else:
            plain = EDGE.sub("", word)
            kind = NAME if plain[:1].isupper() and plain[1:].islower() else LITERAL
        self.at[word] = n
        self.bare.append(bare)
        self.kind[n], self.code[n], self.ends[n] = kind, xxhash.xxh64_intdigest(bare), not word.isalnum() and bool(SENTENCE_END.search(word))


def _words(vocabulary: Vocabulary, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word of the texts: row of the text, number, kind, whether it begins a sentence."""
    lines = pc.replace_substring(pc.replace_substring_regex(pc.fill_null(texts, ""), r"[\t\v\f\r]", " "), "\n", " \n ")
    cut = pc.split_pattern(lines, " ")
    flat = cut.flatten().dictionary_encode()
    if not len(flat):
        return (np.zeros(0, np.int64),) * 4
    row = np.repeat(np.arange(len(texts)), np.diff(cut.offsets.to_numpy()))
    word = vocabulary.numbers(flat.dictionary.to_pylist())[flat.indices.to_numpy()]
    there = vocabulary.kind[word] != NOTHING
    row, word = row[there], word[there]
    kind = vocabulary.kind[word]
    # a sentence begins after a newline, after a word that ends one, and with the text
    ends = vocabulary.ends[word] | (kind == NEWLINE)
    begins = np.ones(len(word), bool)
    begins[1:] = ends[:-1] | (row[1:] != row[:-1])
    real = kind != NEWLINE
    return row[real], word[real], kind[real], begins[real]


def template_windows(vocabulary: Vocabulary, texts: pa.Array, passes=None, sizes: tuple[int, ...] = ()) -> Iterator[tuple[int, int, int, list[str]]]:
    """(row of the text, place, hash, slot values) of both templates' windows, those of which passes(hashes) is true;
    and of windows of ``sizes`` words that are all literal."""
    row, word, kind, begins = _words(vocabulary, texts)
    for size in sizes:
        yield from exact_windows(vocabulary, row, word, size, passes)
    n = len(word) - WINDOW + 1
    if n <= 0:
        return
    first = np.searchsorted(row, row)  # of the text
    after_number = np.zeros(len(word), bool)
    after_number[1:] = np.isin(kind[:-1], (NUMBER,)) & (row[1:] == row[:-1])
    slot = np.where(np.isin(kind, (NUMBER, QUANTITY)), kind, 0)
    slot = np.where((kind == UNIT) & after_number, UNIT, slot)
    named = np.where((kind == NAME) & ~begins, NAME, slot)
    whole = row[:n] == row[WINDOW - 1 :]
    has_name = np.convolve(named == NAME, np.ones(WINDOW, int), "valid") > 0
    for slots, use in ((slot, whole), (named, whole & has_name)):
        code = np.where(slots > 0, SLOT_CODE[slots], vocabulary.code[word])
        h = sum(code[j : n + j] * POWERS[j] for j in range(WINDOW))
        use = use & (np.convolve(slots == 0, np.ones(WINDOW, int), "valid") >= MIN_LITERALS)
        if passes is not None:
            use = use & passes(h)
        for i in np.flatnonzero(use).tolist():
            values = [f"{slots[i + j]}:{vocabulary.bare[word[i + j]]}" for j in range(WINDOW) if slots[i + j]]
            yield int(row[i]), int(i - first[i]), int(h[i : i + 1].view(np.int64)[0]), values


def exact_windows(vocabulary: Vocabulary, row: np.ndarray, word: np.ndarray, size: int, passes=None) -> Iterator[tuple[int, int, int, list[str]]]:
    """As template_windows, of windows of ``size`` words; each word is a value ``=word``. Of equal windows under
    WINDOW words, which are whole items, a text has the first one only."""
    n = len(word) - size + 1
    if n <= 0:
        return
    first = np.searchsorted(row, row)
    code = vocabulary.code[word]
    h = sum(code[j : n + j] * POWERS[j] for j in range(size)) ^ (EXACT_CODE * np.uint64(2 * size + 1))
    use = row[:n] == row[size - 1 :]
    if passes is not None:
        use = use & passes(h)
    seen = set()
    for i in np.flatnonzero(use).tolist():
        key = (int(row[i]), int(h[i]))
        if size < WINDOW and key in seen:
            continue
        if size < WINDOW:
            seen.add(key)
        yield key[0], int(i - first[i]), int(h[i : i + 1].view(np.int64)[0]), [f"={vocabulary.bare[word[i + j]]}" for j in range(size)]


def whole_items(vocabulary: Vocabulary, texts: pa.Array) -> Iterator[tuple[int, int, int, list[str]]]:
    """The literal windows that the texts consist of: one of all words, or all of WINDOW words if there are more."""
    row, word, _, _ = _words(vocabulary, texts)
    for start, n in zip(*np.unique(row, return_index=True, return_counts=True)[1:], strict=True):
        yield from exact_windows(vocabulary, row[start : start + n], word[start : start + n], min(int(n), WINDOW))


def windows(rows: DataFrame, table: bytes | None = None, *, sizes: tuple[int, ...] = (), whole: bool = False) -> DataFrame:
    """rows(id, same, text) -> WINDOWS; same: a hash of the text; only those in the bit table, if there is one, and literal windows of ``sizes`` words.
    whole: texts without a window of a template have literal windows instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        bits = None if table is None else np.unpackbits(np.frombuffer(table, np.uint8), bitorder="little").astype(bool)
        passes = None if table is None else lambda h: bits[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
        for batch in batches:
            for part in slices(batch, 2):
                found = list(template_windows(vocabulary, part.column(2), passes, sizes))
                if whole:
                    bare = np.setdiff1d(np.arange(part.num_rows), [x[0] for x in found])
                    found += [(int(bare[r]), *x) for r, *x in whole_items(vocabulary, part.column(2).take(pa.array(bare, pa.int64())))]
                if found:
                    at, place, h, slots = zip(*found, strict=True)
                    own = pa.array(at, pa.int64())
                    columns = [part.column(0).take(own), part.column(1).take(own), pa.array(place, pa.int64()), pa.array(h, pa.int64()), pa.array(slots, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "same", "at", "hash", "slots"])
        del vocabulary
        release_memory()

    ship(rows.sparkSession)
    return rows.mapInArrow(run, WINDOWS)


def _rows(table: DataFrame, key: str) -> DataFrame:
    """(id, same, text), each row once."""
    text = F.col("text").cast("string")
    return table.select(F.col(key).cast("long").alias("id"), text_hashes(text)[0].alias("same"), text.alias("text"))


def benchmark_windows(benchmark: DataFrame, whole: bool = False) -> DataFrame:
    """Windows of the benchmark with item_windows, and whether the item has literal windows; equal items are one."""
    found = windows(_rows(benchmark, "item_id"), whole=whole)
    sizes = found.groupBy("id", "same").agg(F.countDistinct("at").alias("item_windows"), F.sort_array(F.collect_set(F.struct("at", "hash", "slots"))).alias("all"))
    content = [F.xxhash64("all"), F.xxhash64(F.lit(1), "all")]
    first = F.row_number().over(Window.partitionBy(*content).orderBy(F.col("id").asc_nulls_last(), "same"))
    sizes = sizes.withColumn("first", first).filter("first = 1")
    exact = F.coalesce(F.get("w.slots", F.lit(0)).startswith("="), F.lit(False))
    own = sizes.select("id", "same", "item_windows", F.explode("all").alias("w"))
    return checkpointed(own.select(F.col("id").alias("item_id"), F.col("same").alias("item_same"), "item_windows", F.col("w.at").alias("item_at"), F.col("w.hash").alias("hash"), F.col("w.slots").alias("item_slots"), exact.alias("exact")))


def bit_table(found: DataFrame) -> bytes:
    """A bit for each hash, 2 ** TABLE_BITS in all, made as bitmaps by the cluster: the driver gets half a MB."""
    place = F.shiftrightunsigned("hash", 64 - TABLE_BITS) + 1  # bitmaps count from 1
    maps = found.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    size = 1 << 12  # bytes of Spark's bitmaps
    table = bytearray(max(1 << (TABLE_BITS - 3), size))
    for r in maps:
        table[(r["bucket"] - 1) * size : r["bucket"] * size] = r["bits"]
    return bytes(table)


ITEM = ["item_id", "item_same"]


def contaminated_rows(docs: DataFrame, benchmark: DataFrame, *, min_coverage: float = MIN_COVERAGE, whole: bool = False) -> DataFrame:
    """(id, same, item_id, item_same, n_windows, item_windows, coverage, same_values): documents and the items that they hold."""
    known = benchmark_windows(benchmark, whole)
    sizes = tuple(r["n"] for r in known.filter("exact").select(F.size("item_slots").alias("n")).distinct().collect()) if whole else ()
    fits = F.when(F.col("exact"), F.col("slots") == F.col("item_slots")).otherwise(F.size("slots") == F.size("item_slots"))
    met = windows(_rows(docs, "doc_id"), bit_table(known), sizes=sizes).join(known, "hash").filter(fits)
    pairs = F.zip_with("item_slots", "slots", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    aligned = met.groupBy("id", "same", *ITEM, (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.max("item_windows").alias("item_windows"),
        F.max("exact").alias("exact"),
        F.collect_set(F.struct(F.col("item_at").alias("at"), pairs.alias("pairs"))).alias("met"),
    )
    aligned = aligned.withColumn("pairs", F.sort_array(F.array_distinct(F.flatten(F.transform("met", lambda w: w["pairs"])))))
    # values of the item that become several values; sorted pairs have them side by side
    torn = F.transform(F.filter("pairs", lambda x, i: (x["a"] == F.get("pairs", i - 1)["a"]).eqNullSafe(True)), lambda x: x["a"])
    equal = lambda pairs: F.forall(pairs, lambda x: x["a"] == x["b"])
    kept = F.filter("met", lambda w: equal(w["pairs"]) | ~F.arrays_overlap(F.transform(w["pairs"], lambda x: x["a"]), F.col("torn")))
    consistent = aligned.withColumn("torn", torn).withColumn("at", F.array_distinct(F.transform(kept, lambda w: w["at"])))
    consistent = consistent.filter(F.size("at") > 0).filter(~F.col("exact") | (F.size("at") == F.col("item_windows")))
    found = consistent.groupBy("id", "same", *ITEM).agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("n_windows"),
        F.max("item_windows").alias("item_windows"),
        F.max(equal("pairs")).alias("same_values"),
    )
    return found.withColumn("coverage", F.col("n_windows") / F.col("item_windows")).filter(F.col("coverage") >= min_coverage)


def contaminated(docs: DataFrame, benchmark: DataFrame, *, min_coverage: float = MIN_COVERAGE, whole: bool = False) -> DataFrame:
    """(doc_id, item_id, n_windows, item_windows, coverage, same_values): one row per document and item that it holds.
    whole: also items without a window of a template, by all their words."""
    found = contaminated_rows(docs, benchmark, min_coverage=min_coverage, whole=whole)
    return found.select(F.col("id").alias("doc_id"), "item_id", "n_windows", "item_windows", "coverage", "same_values")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, min_coverage: float = MIN_COVERAGE, whole: bool = False) -> DataFrame:
    """docs without the documents that hold a benchmark item."""
    gone, gone_same, same = fresh(docs, "gone", "gone_same", "same")
    found = contaminated_rows(docs, benchmark, min_coverage=min_coverage, whole=whole).select("id", "same").distinct().toDF(gone, gone_same)
    own = docs.withColumn(same, text_hashes(F.col("text").cast("string"))[0])
    here = (F.col(same) == F.col(gone_same)) & F.col("doc_id").cast("long").eqNullSafe(F.col(gone))
    return own.join(found, here, "left_anti").drop(same)


#: The same in SQL: templates are compared as texts.
ORACLE = r"""
WITH texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), lines AS (
  SELECT side, id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM texts
), pieces AS (
  SELECT side, id, ln, unnest(regexp_split_to_array(line, '[ \t\v\f\r]+')) AS piece, generate_subscripts(regexp_split_to_array(line, '[ \t\v\f\r]+'), 1) AS wn FROM lines
), bare AS (
  SELECT side, id, ln, wn, piece, regexp_replace(piece, '^[^\pL\pN]+|[^\pL\pN]+$', '', 'g') AS plain FROM pieces
), words AS (
  SELECT side, id, ln, plain, lower(plain) AS low, row_number() OVER (PARTITION BY side, id ORDER BY ln, wn) AS n,
         regexp_matches(piece, '[.!?:;][^\pL\pN]*$') AS stops,
         CASE WHEN regexp_full_match(lower(plain), '\d+([.,:/]\d+)*') THEN '1' WHEN regexp_full_match(lower(plain), '\d+([.,:/]\d+)*\pL+') THEN '2' WHEN lower(plain) IN (@UNITS) THEN '3' ELSE '' END AS form
  FROM bare WHERE plain <> ''
), marked AS (
  SELECT *, CASE WHEN form = '3' AND coalesce(lag(form) OVER w, '') <> '1' THEN '' ELSE form END AS k1,
         CASE WHEN form = '' AND regexp_full_match(plain, '\p{Lu}[^\p{Lu}\p{Lt}]*') AND regexp_matches(substr(plain, 2), '\p{Ll}') AND NOT coalesce(lag(stops) OVER w OR lag(ln) OVER w <> ln, true) THEN '4' ELSE '' END AS is_name
  FROM words WINDOW w AS (PARTITION BY side, id ORDER BY n)
), spans AS (
  SELECT side, id, n - 1 AS place, [low, lead(low, 1) OVER w, lead(low, 2) OVER w, lead(low, 3) OVER w, lead(low, 4) OVER w] AS lows,
         [k1, lead(k1, 1) OVER w, lead(k1, 2) OVER w, lead(k1, 3) OVER w, lead(k1, 4) OVER w] AS ks,
         [is_name, lead(is_name, 1) OVER w, lead(is_name, 2) OVER w, lead(is_name, 3) OVER w, lead(is_name, 4) OVER w] AS names
  FROM marked WINDOW w AS (PARTITION BY side, id ORDER BY n)
), kinds AS (
  SELECT side, id, place, lows, ks FROM spans WHERE lows[5] IS NOT NULL
  UNION ALL
  SELECT side, id, place, lows, list_transform(range(1, 6), lambda i: ks[i] || names[i]) FROM spans WHERE lows[5] IS NOT NULL AND list_contains(names, '4')
), templates AS (
  SELECT side, id, place, array_to_string(list_transform(range(1, 6), lambda i: CASE WHEN ks[i] = '' THEN lows[i] ELSE '<' || ks[i] || '>' END), ' ') AS template,
         list_transform(list_filter(range(1, 6), lambda i: ks[i] <> ''), lambda i: ks[i] || ':' || lows[i]) AS slots
  FROM kinds WHERE len(list_filter(ks, lambda k: k = '')) >= 2
), items AS (
  SELECT id, min(id) OVER (PARTITION BY content) AS same, item_windows FROM (
    SELECT id, string_agg(place || '|' || template || '|' || array_to_string(slots, ','), chr(10) ORDER BY place, template) AS content, count(DISTINCT place) AS item_windows FROM templates WHERE side = 'b' GROUP BY id)
), met AS (
  SELECT d.id AS doc_id, b.id AS item_id, d.place - b.place AS shift, b.place AS place, list_zip(b.slots, d.slots) AS z, i.item_windows
  FROM templates b JOIN items i ON i.id = b.id AND i.same = b.id AND b.side = 'b' JOIN templates d ON d.side = 'd' AND d.template = b.template
), torn AS (
  SELECT doc_id, item_id, shift FROM (SELECT doc_id, item_id, shift, unnest(z) AS p FROM met) GROUP BY ALL HAVING count(DISTINCT p) > count(DISTINCT p[1])
), aligned AS (
  SELECT doc_id, item_id, shift, list(DISTINCT place) AS places, max(item_windows) AS item_windows, bool_and(len(list_filter(z, lambda p: p[1] <> p[2])) = 0) AS same
  FROM met ANTI JOIN torn USING (doc_id, item_id, shift) GROUP BY ALL
), found AS (
  SELECT doc_id, item_id, len(list_distinct(flatten(list(places)))) AS n_windows, max(item_windows) AS item_windows, bool_or(same) AS same_values FROM aligned GROUP BY ALL
)
SELECT doc_id, item_id, n_windows::BIGINT AS n_windows, item_windows, n_windows / item_windows::DOUBLE AS coverage, same_values FROM found WHERE n_windows / item_windows::DOUBLE >= @COVERAGE
""".replace("@UNITS", ", ".join(f"'{u}'" for u in sorted(UNITS))).replace("@COVERAGE", str(MIN_COVERAGE))
