"""Quality rules: base counts of each text and a hashed n-gram log-likelihood ratio. DataFrame functions only.

Every document gets a score: the mean over its hashed unigrams and bigrams of
``log p_target(bucket) - log p_raw(bucket)``. The raw multinomial counts all n-grams of all documents; the
target multinomial counts those of all trusted documents. Each bucket of both has ``SMOOTHING`` more, so that counts
of a few copies are no evidence.

Edge cases: a null text has no words, as an empty one; both fail the base rule and score 0. Without trusted
documents every score is 0, so only the base rule decides. Repeated rows are scored one by one and all count
in the raw multinomial; all rows of a trusted id count in the target one. Null ids are kept and never trusted. Very
long texts are counted whole, in the memory of one row. Extra columns are ignored, ``keep_good`` keeps them. An empty
table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.llm.common import id_and_text, let, with_mark, words

BUCKETS = 1 << 14
SMOOTHING = 8
THRESHOLD = -0.25
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def repeated_words(ws: Column) -> Column:
    """Words within 3-word windows that the text has twice or more, the first included.

    Window hashes are sorted as longs to find those that occur again; only texts that have any sort
    (hash, position) pairs. Repeated windows start at s1 < s2 < ...; they cover
    ``sum(min(3, s[k+1] - s[k])) + 3`` words.
    """
    n = F.size(ws)

    def covered(starts: Column) -> Column:
        gaps = F.zip_with(starts, F.slice(starts, F.lit(2), F.size(starts)), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, g: acc + g)

    def starts_of(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = let(
            pairs,
            lambda p: F.filter(p, lambda x, i: (x["h"] == F.get(p, i - 1)["h"]).eqNullSafe(True) | (x["h"] == F.get(p, i + 1)["h"]).eqNullSafe(True)),
        )
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    def has_repeat(h: Column) -> Column:
        return F.size(F.array_distinct(h)) < F.size(h)

    hashes = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    return let(hashes, lambda h: F.when(has_repeat(h), let(starts_of(h), covered)).otherwise(F.lit(0).cast("long")))


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long"))


def base_counts(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    return let(
        words(text),
        lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            duplicate_lines(text).alias("n_dup_lines"),
            repeated_words(ws).alias("n_repeat_words"),
        ),
    )


def ngram_buckets(text: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of the unigrams and bigrams of lower-cased letter runs and symbol runs."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"), F.lit(0))
    mask = F.lit(buckets - 1).cast("long")
    return let(
        tokens,
        lambda t: F.concat(
            F.transform(t, lambda x: F.xxhash64(x).bitwiseAND(mask).cast("int")),
            F.when(F.size(t) >= 2, F.transform(F.sequence(F.lit(0), F.size(t) - 2), lambda i: F.xxhash64(F.get(t, i), F.get(t, i + 1)).bitwiseAND(mask).cast("int"))).otherwise(F.array().cast("array<int>")),
        ),
    )


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.filter(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("doc_id")).dropna().distinct()


def bucket_counts(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, target): n-grams of all documents, and of the trusted ones. Each text is cut once, and only texts
    that may be trusted are shuffled to meet their label."""
    trusted = trusted_ids(labels)
    marked = with_mark(docs, F.col("doc_id"), trusted, F.col("doc_id"), "maybe")
    met = marked.filter("maybe").join(trusted.withColumn("trusted", F.lit(1)).hint("merge"), "doc_id", "left").select("trusted", "text")
    others = marked.filter("NOT maybe").select(F.lit(None).cast("int").alias("trusted"), "text")
    grams = met.union(others).select("trusted", F.explode(ngram_buckets(F.col("text"), buckets)).alias("bucket"))
    return grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("trusted").alias("target"))


def ratio_weights(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """Log ratio of each bucket: a list of the fixed length ``buckets``."""
    raw, target = [0] * buckets, [0] * buckets
    for r in bucket_counts(docs, labels, buckets).collect():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not sum(target):
        return [0.0] * buckets
    n_t, n_r = sum(target) + SMOOTHING * buckets, sum(raw) + SMOOTHING * buckets
    return [math.log((t + SMOOTHING) / n_t) - math.log((r + SMOOTHING) / n_r) for t, r in zip(target, raw, strict=True)]


def judged(text: Column, weights: list[float], threshold: float) -> Column:
    """Struct of the base counts, base_failed, kept and score of ``text``."""
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folded to one literal
    score = let(
        ngram_buckets(text, len(weights)),
        lambda b: F.when(F.size(b) > 0, F.aggregate(b, F.lit(0.0), lambda acc, x: acc + F.get(table, x)) / F.size(b)).otherwise(F.lit(0.0)),
    )
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def verdict(base: Column, value: Column) -> Column:
        failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])
        return F.struct(*[base[n].alias(n) for n in names], failed.alias("base_failed"), (~failed & (value >= threshold)).alias("kept"), value.alias("score"))

    return let(base_counts(text), lambda base: let(score, lambda value: verdict(base, value)))


def quality_rules(docs: DataFrame, labels: DataFrame, *, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: base counts, base_failed, the verdict ``kept``, and the score."""
    docs = id_and_text(docs)
    weights = ratio_weights(docs, labels, buckets)
    return docs.select("doc_id", judged(F.col("text"), weights, threshold).alias("x")).select("doc_id", "x.*")


def keep_good(docs: DataFrame, labels: DataFrame, *, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, without the documents that quality_rules rejects."""
    weights = ratio_weights(id_and_text(docs), labels, buckets)
    return docs.filter(judged(F.col("text").cast("string"), weights, threshold)["kept"])
