"""Line dedup by winnowing over line hashes. DataFrame functions only.

The sequence of a document is its ``\\n``-split lines that have a word. A window is a least span of consecutive
lines with ``MIN_WORDS`` words or more: one that starts at each line, and one that ends at each line. Winnowing
selects of each window its least line hash (the rightmost of equal ones) as a fingerprint. Two equal runs of
lines with at least MIN_WORDS words share a whole window and with it the window's fingerprint.

1. Windows are made once, stored, and carry their fingerprint and its position.
2. Fingerprints are joined by position: those with one position in all documents are dropped, as nothing repeats
   around them. Windows of a position have the same position, so a task sends one number a fingerprint.
3. At the joined positions a match is extended both ways: the windows around a position that equal windows at an
   earlier position of the same fingerprint. Windows that start at a line reach to its left end, windows that end
   at a line to its right end: together they cover exactly the repeated run. The earlier position may be another
   one for each window, so a run is found whichever earlier documents hold its parts, and no pairs are made.
4. Lines in a run that occurs earlier are deleted.

So a line goes if and only if it is in a run of consecutive lines, with at least MIN_WORDS words, that also
occurs at an earlier position. Each line keeps its first occurrence. Steps 2 and 3 aggregate least and greatest
positions before they shuffle, so common lines make no pairs; Spark splits a fingerprint of very many
positions over tasks (adaptive skew join), since all but its first position is on one side of the join.

Positions and deletions belong to a row: its id and two hashes of its text. Order is by id (null ids last), then
by those hashes.

With ``sentences`` the lines are cut further, after each sentence end that white space follows (or that is full width),
and pieces are compared without the white space around them. So a passage that begins or ends inside a line, or lies
inside one, is found if its whole sentences hold MIN_WORDS words. Line ends go with the piece before them.

Edge cases: a null text stays null and has no lines; an empty text stays empty; a document may lose all its
lines and then is an empty text. Lines without a word are kept and lie in no window. Rows with one id, or none,
and different texts are different documents. Rows equal in id and text are one document: all of them stay, or
lose the same lines. Very long texts are one row of many windows. Extra columns, whatever their names, are kept
by ``drop_repeated_lines`` and ignored by ``line_dedup``; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.llm.common import WORD_GAP, checkpointed, fresh, id_and_text, let, stored, text_hashes, with_mark

MIN_WORDS = 50
#: More than the lines of any window, which has at most one line a word.
SPAN_BITS = 16
SPAN = 1 << SPAN_BITS
#: A document: its id and two hashes of its text.
ROW = ["doc_id", "h1", "h2"]


#: Places behind a line end or a sentence end; pieces keep what ends them, so they join to the text as it was.
SENTENCE_ENDS = r"(?<=\n)|(?<=[.!?][ \t])|(?<=[\u3002\uFF01\uFF1F])"
BLANKS = " \t\n\x0b\x0c\r"


def _lines(text: Column, sentences: bool) -> Column:
    return F.split(F.coalesce(text, F.lit("")), SENTENCE_ENDS if sentences else "\n", -1)


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _n_words(line: Column) -> Column:
    return F.size(F.array_remove(F.split(line, WORD_GAP), ""))


def windows(text: Column, min_words: int = MIN_WORDS, sentences: bool = False) -> Column:
    """Array of (span, fp, key, at): first line * SPAN + number of lines of each window, its fingerprint, a hash of its lines,
    the fingerprint's line. Windows are equal if fingerprint and key are: 128 bits."""
    same = lambda x: F.btrim(x, F.lit(BLANKS)) if sentences else x
    lines = F.transform(F.filter(_lines(text, sentences), _has_word), lambda x: F.struct(F.xxhash64(same(x)).alias("h"), _n_words(x).alias("w")))

    def reach(counts: Column) -> Column:
        """Lines until min_words words are met, 0 if they are not."""
        start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("n"))
        step = lambda acc, w: F.when(acc["words"] >= min_words, acc).otherwise(F.struct((acc["words"] + w).alias("words"), (acc["n"] + 1).alias("n")))
        return F.aggregate(counts, start, step, lambda acc: F.when(acc["words"] >= min_words, acc["n"]).otherwise(0))

    def spans(hs: Column, ws: Column) -> Column:
        size = F.size(hs)
        at = F.sequence(F.lit(1), size)
        # a span is one long, start * SPAN + lines, so that equal ones are found by hash and not by comparing all pairs
        ahead = F.transform(at, lambda i: i.cast("long") * SPAN + reach(F.slice(ws, i, F.lit(min_words))))

        def back(i: Column) -> Column:
            first = F.greatest(F.lit(1), i - (min_words - 1))
            n = reach(F.reverse(F.slice(ws, first, i - first + 1)))
            return let(n, lambda m: (i - m + 1).cast("long") * SPAN + m)

        both = F.array_distinct(F.filter(F.concat(ahead, F.transform(at, back)), lambda x: x % SPAN > 0))

        def winnowed(start: Column, span: Column) -> Column:
            n = (span % SPAN).cast("int")
            return let(
                F.slice(hs, start, n),
                lambda part: let(
                    F.array_min(part),
                    lambda least: F.struct(
                        span.alias("span"),
                        least.alias("fp"),
                        F.xxhash64(part).alias("key"),
                        # place of the fingerprint, the rightmost of equal ones
                        (start + n - F.array_position(F.reverse(part), least).cast("int")).alias("at"),
                    ),
                ),
            )

        return F.when(size > 0, F.transform(both, lambda x: winnowed(F.shiftright(x, SPAN_BITS).cast("int"), x)))

    return let(lines, lambda a: let(F.transform(a, lambda x: x["h"]), lambda hs: let(F.transform(a, lambda x: x["w"]), lambda ws: spans(hs, ws))))


def rows_of(docs: DataFrame) -> DataFrame:
    h1, h2 = text_hashes(F.col("text"))
    return id_and_text(docs).select("doc_id", h1.alias("h1"), h2.alias("h2"), "text")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, sentences: bool = False) -> DataFrame:
    """(doc_id, h1, h2, gone): the places, among the lines with a word and from 1, of the lines to delete."""
    found = stored(rows_of(docs).select(*ROW, F.explode(windows(F.col("text"), min_words, sentences)).alias("x")).select(*ROW, "x.*"))
    # the positions of a fingerprint, each as one number: more than one means that it repeats
    position = F.xxhash64(*ROW, "at")
    again = found.groupBy("fp").agg(F.min(position).alias("a"), F.max(position).alias("z")).filter("a <> z").select("fp")
    around = checkpointed(found.join(again, "fp", "left_semi").select("fp", "key", *ROW, "span"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), *ROW, "span")
    first = around.groupBy("fp", "key").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").select("fp", "key", "first")
    later = around.join(first, ["fp", "key"]).filter(place > F.col("first"))
    gone = later.groupBy(*ROW).agg(F.collect_set("span").alias("spans"))
    lines = lambda x: F.sequence(F.shiftright(x, SPAN_BITS).cast("int"), (F.shiftright(x, SPAN_BITS) + x % SPAN - 1).cast("int"))
    return gone.select(*ROW, F.array_distinct(F.flatten(F.transform("spans", lines))).alias("gone"))


def _whole(text: Column, sentences: bool) -> Column:
    return F.struct(F.when(text.isNull(), 0).otherwise(F.size(_lines(text, sentences))).alias("n_lines"), F.lit(0).alias("n_deleted"), text.alias("text"))


def _cleaned(text: Column, gone: Column, sentences: bool) -> Column:
    """Struct of n_lines, n_deleted and the text without the lines at the places ``gone``."""

    def cut(lines: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(lines) - 1)
        worded = F.filter(at, lambda i: _has_word(F.get(lines, i)))
        drop = let(worded, lambda w: F.transform(gone, lambda p: F.get(w, p - 1)))
        left = F.transform(F.array_except(at, drop), lambda i: F.get(lines, i))
        return F.struct(F.size(lines).alias("n_lines"), F.size(gone).alias("n_deleted"), F.array_join(left, "" if sentences else "\n").alias("text"))

    return F.when(gone.isNull() | text.isNull(), _whole(text, sentences)).otherwise(let(_lines(text, sentences), cut))


def _with_counts(docs: DataFrame, min_words: int, sentences: bool) -> tuple[DataFrame, str]:
    """docs with the new text, and a struct of n_lines and n_deleted under a name of its own."""
    new, gone, maybe, *row = fresh(docs, "new", "gone", "maybe", *ROW)
    found = checkpointed(repeated_runs(docs, min_words, sentences)).toDF(*row, gone)
    text = F.col("text").cast("string")
    h1, h2 = text_hashes(text)
    own = docs.select("*", F.col("doc_id").cast("long").alias(row[0] + "_"), h1.alias(row[1] + "_"), h2.alias(row[2] + "_"))
    here = F.col(row[1]) == F.col(row[1] + "_")
    here = here & (F.col(row[2]) == F.col(row[2] + "_")) & F.col(row[0]).eqNullSafe(F.col(row[0] + "_"))
    # only texts that may lose lines are shuffled to meet their deletions
    own = with_mark(own, F.col(row[1] + "_"), found, F.col(row[1]), maybe)
    met = own.filter(F.col(maybe)).join(found.hint("merge"), here, "left").withColumn(new, _cleaned(text, F.col(gone), sentences)).drop(gone, *row)
    others = own.filter(~F.col(maybe)).withColumn(new, _whole(text, sentences))
    cleaned = met.unionByName(others)
    columns = [F.col(f"{new}.text").alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns]
    return cleaned.select(*columns, F.col(new)), new


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, sentences: bool = False) -> DataFrame:
    """docs with the same columns, and __n_lines and __n_deleted (with more underscores if docs has such columns);
    the text has lost its later repeated runs."""
    out, new = _with_counts(docs, min_words, sentences)
    counts = zip(("n_lines", "n_deleted"), fresh(docs, "n_lines", "n_deleted"), strict=True)
    return out.select("*", *[F.col(f"{new}.{c}").alias(name) for c, name in counts]).drop(new)


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_lines, n_deleted, text)"""
    out, new = _with_counts(docs.select("doc_id", "text"), min_words, sentences=False)
    return out.select("doc_id", F.col(f"{new}.n_lines").alias("n_lines"), F.col(f"{new}.n_deleted").alias("n_deleted"), "text")


#: The same rule in plain SQL: windows are compared as texts, without hashes, fingerprints or joins by them.
ORACLE = r"""
WITH lines AS (
  SELECT doc_id, i, l, len(list_filter(regexp_split_to_array(l, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
), seq AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p,
         sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS z FROM lines WHERE w > 0
), ends AS (
  SELECT a.doc_id, a.p AS s, (SELECT min(b.p) FROM seq b WHERE b.doc_id = a.doc_id AND b.z - a.z + a.w >= 50) AS e FROM seq a
  UNION
  SELECT a.doc_id, (SELECT max(b.p) FROM seq b WHERE b.doc_id = a.doc_id AND a.z - b.z + b.w >= 50) AS s, a.p AS e FROM seq a
), spans AS (
  SELECT w.doc_id, w.s, w.e, string_agg(q.l, chr(10) ORDER BY q.p) AS t
  FROM ends w JOIN seq q ON q.doc_id = w.doc_id AND q.p BETWEEN w.s AND w.e
  WHERE w.s IS NOT NULL AND w.e IS NOT NULL GROUP BY ALL
), later AS (
  SELECT doc_id, s, e FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS k FROM spans) WHERE k > 1
), gone AS (
  SELECT DISTINCT q.doc_id, q.i FROM later x JOIN seq q ON q.doc_id = x.doc_id AND q.p BETWEEN x.s AND x.e
), left_over AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_deleted,
         coalesce(string_agg(l.l, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS text
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(x.n_lines, 0)::INT AS n_lines, coalesce(x.n_deleted, 0)::INT AS n_deleted,
       CASE WHEN d.text IS NULL THEN NULL ELSE x.text END AS text
FROM documents d LEFT JOIN left_over x ON x.doc_id = d.doc_id
"""
